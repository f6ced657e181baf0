import random
import struct
import sys

import pytest
from pyspark.sql import functions as F

from packetloom.operators import fragments, matching, patterns, synscan
from packetloom.operators.programs import Cooldown, Reassembly, SynScan
from packetloom.sources import capture, rules

S = 1_000_000
START = 1_700_000_000 * S


def probes(spark, n=600, seed=5, sources=2, hosts=4, ports=9, span=120):
    rng = random.Random(seed)
    rows = [
        (i, START + rng.randrange(span * 4) * S // 4, f"10.0.0.{rng.randrange(sources)}", f"10.1.0.{rng.randrange(hosts)}", 6, 2, rng.randrange(ports))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "packet_id long, us long, src_ip string, dst_ip string, ip_proto int, tcp_flags int, dst_port int")
    return rows, df.withColumn("ts", F.timestamp_micros("us"))


def naive_syn_scan(rows, window=10, ports=5, pairs=12, cooldown=30):
    """Straight replay with sets recomputed at every packet."""
    out, queues, last = [], {}, {}
    for i, us, src, dst, _, _, port in sorted(rows, key=lambda r: (r[1], r[0])):
        q = queues.setdefault(src, [])
        q.append((us, dst, port))
        q[:] = [e for e in q if e[0] >= us - window * S]
        for key, seen, limit in (((src, dst), {p for _, d, p in q if d == dst}, ports), ((src, "all"), {e[1:] for e in q}, pairs)):
            if len(seen) >= limit and (key not in last or us - last[key] > cooldown * S):
                last[key] = us
                out.append((i, len(seen)))
                q.clear()
                break
    return sorted(out)


@pytest.mark.parametrize("segment_rows", [60, 10**9])
def test_syn_scan_equals_replay(spark, segment_rows):
    rows, df = probes(spark)
    alerts = synscan.detect_syn_scan(df, segment_rows=segment_rows)
    got = alerts.select("packet_id", F.regexp_extract("info", r"ports=(\d+)", 1).cast("int").alias("n")).collect()
    want = naive_syn_scan(rows)
    assert want and sorted(map(tuple, got)) == want


def test_reassembly_equals_replay():
    rng = random.Random(11)
    for _ in range(60):
        program, state, held, offsets, first, total = Reassembly(5, 6, 400), None, [], set(), None, 0
        state, us = program.initial(), 0
        for i in range(60):
            us += rng.randrange(2 * S)
            start, size, more = rng.randrange(12) * 8, rng.choice([0, 0, 8, 16, 24, 40]), rng.random() < 0.9
            got = {o[2] for o in program.step(state, (us, i, start, size, more))}
            want = set()
            if first is not None and us - first > 5 * S:
                want.add("timeout")
                held, offsets, first, total = [], set(), None, 0
            first = us if first is None else first
            total += size
            overlap = any(start < e and start + size > s for s, e in held)
            held.append((start, start + size))
            if overlap:
                assert got == want | {"overlap"}
                continue
            if start in offsets:
                want.add("duplicate")
            offsets.add(start)
            if len(held) > 6:
                want.add("excessive")
            if total > 400:
                want.add("oversized")
            if not more:
                held, offsets, first, total = [], set(), None, 0
            assert got == want


def test_words_are_necessary_for_patterns(spark):
    """Wherever a pattern matches, its substring tests hold."""
    from checks.views import PROBES, load

    docs = load(spark, "/root/testdata/sf0.001", "documents").select("text")
    pages = load(spark, "/root/testdata/sf0.001", "pages").select(F.col("html").alias("text"))
    odd = [p.upper() for p in PROBES] + ["<ſcript>", "İF(1=1)", "unıon all SELECT", "K`id`", "onerror = x", "\x00", "a--b", "/*x*/"]
    texts = docs.unionByName(pages).unionByName(spark.createDataFrame([(t,) for t in PROBES + odd], "text string"))
    texts = texts.withColumn("folded", patterns.fold(F.col("text")))
    subject, broken = patterns.Subject("text", "folded", {}), []
    for pattern in patterns.NEEDS:
        exact = f"text RLIKE {patterns._quoted(patterns.java_pattern(pattern, ignore_case=pattern not in patterns.CASE_SENSITIVE))}"
        broken.append(f"count_if({exact} AND NOT ({subject.may_match(pattern)})) AS p{len(broken)}")
    assert set(texts.selectExpr(*broken).first()) == {0}


def test_compiled_and_indexed_first_match_agree(spark):
    from checks.views import view

    table = rules.parse_rules(view(spark, "/root/testdata/sf0.01", "rules_ev")).where("error is null").persist()
    packets = view(spark, "/root/testdata/sf0.001", "http_ev").withColumn("length", F.lit(60))
    few = table.collect()
    one = matching.first_match_compiled(packets, few).select("packet_id", "rule_pos", "matched_rule").collect()
    two = matching.first_match_indexed(packets, table, rule_count=len(few), chunk_rules=30).select("packet_id", "rule_pos", "matched_rule").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and any(r.rule_pos for r in one)


def test_port_and_address_terms(spark):
    cases = {"any": 7, "[1024:]": 2000, "[:50]": 7, "135,139": 139, "![500-510]": 7, "!22": 7, "$HTTP_PORTS": 443, "$NOPE": 1, "1:9": 9}
    misses = {"[1024:]": 7, "[135,139]": 7, "22": 7, "!$HTTP_PORTS": 443, "[a]": 7, "!$NOPE": 1, ":": 7, "[500-510]": 505}
    rows = [(p, v, True) for p, v in cases.items()] + [(p, v, False) for p, v in misses.items()]
    df = spark.createDataFrame(rows, "raw string, port int, want boolean")
    df = df.withColumn("terms", rules.port_terms(F.col("raw"), rules.NETWORK_VARIABLES))
    got = df.withColumn("hit", matching.in_terms(F.col("terms"), F.col("port"))).where("hit <> want").collect()
    assert got == []


def test_capture_file_round_trip(spark, tmp_path):
    def frame(proto, body, src=b"\x0a\x00\x00\x01", dst=b"\x08\x08\x08\x08"):
        ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 77, 0, 64, proto, 0) + src + dst
        return b"\x01" * 6 + b"\x02" * 6 + b"\x08\x00" + ip + body

    question = b"\x03abc\x07example\x03com\x00"
    query = struct.pack(">HHHHHH", 1, 0x0100, 1, 0, 0, 0) + question + b"\x00\x10\x00\x01"
    answer = struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0) + question + b"\x00\x10\x00\x01"
    answer += b"\xc0\x0c\x00\x10\x00\x01\x00\x00\x00\x05" + struct.pack(">H", 33) + b"\x20" + b"x" * 32
    frames = [
        frame(17, struct.pack(">HHHH", 4000, 53, 8 + len(query), 0) + query),
        frame(17, struct.pack(">HHHH", 53, 4000, 8 + len(answer), 0) + answer),
        frame(6, struct.pack(">HHIIBBHHH", 5000, 80, 1, 2, 0x50, 0x18, 9, 0, 0) + b"GET / HTTP/1.1"),
        frame(1, b"\x08\x00\x00\x00\x00\x05\x00\x01"),
        b"\x01" * 6 + b"\x02" * 6 + b"\x08\x06" + b"\x00\x01\x08\x00\x06\x04\x00\x02" + b"\xaa" * 6 + b"\x0a\x00\x00\x09" + b"\x00" * 6 + b"\x0a\x00\x00\x09",
    ]
    body = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        body += struct.pack("<IIII", 1700000000 + i, 250000, len(f), len(f)) + f
    (tmp_path / "a.pcap").write_bytes(body + b"\x00\x00")
    numbered = capture.number_packets(capture.read_captures(spark, str(tmp_path)))
    got = {r.packet_id: r for r in capture.decode_frames(numbered, "packet_id").collect()}
    assert [got[i].proto for i in range(1, 6)] == ["DNS", "DNS", "HTTP", "ICMP", "ARP"]
    assert (got[1].dns_qr, got[1].dns_qname, got[1].src_ip, got[1].dst_port, got[1].ip_id) == (0, "abc.example.com", "10.0.0.1", 53, 77)
    assert (got[2].dns_qr, got[2].dns_txt_sizes) == (1, [33])
    assert (got[3].tcp_flags, bytes(got[3].payload)) == (24, b"GET / HTTP/1.1")
    assert (got[4].icmp_type, got[4].icmp_id) == (8, 5)
    assert (got[5].arp_op, got[5].arp_psrc, got[5].arp_pdst, got[5].arp_hwsrc) == (2, "10.0.0.9", "10.0.0.9", "aa:aa:aa:aa:aa:aa")


def test_stream_equals_batch(spark, tmp_path):
    from packetloom.streaming import flows

    rows, df = probes(spark, seed=6)
    df.repartition(1).sortWithinPartitions("us", "packet_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumnsRenamed({"src_ip": "src", "dst_ip": "dst"}).drop("us")
    out = flows.run_to_end(
        flows.stream_scan(stream, ["src"], SynScan(), synscan.SCAN_OUT, ttl_seconds=600), str(tmp_path / "run")
    )
    assert sorted((r.packet_id, r["count"]) for r in out.collect()) == naive_syn_scan(rows)
