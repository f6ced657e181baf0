"""Roll-ups over odd captures, rule matching across its access paths, and files with odd rows."""

from datetime import datetime, timedelta

from pyspark.sql import Row

from packetloom.operators import matching, rollups
from packetloom.sources import rules
from packetloom.sources.flows import read_flows


def test_rate_with_a_stray_time_stamp(spark):
    start = datetime(2024, 1, 1)
    rows = [Row(ts=start + timedelta(seconds=i // 3), length=10) for i in range(300)] + [Row(ts=start - timedelta(days=40), length=1)]
    rates = rollups.traffic_rate(spark.createDataFrame(rows))
    assert rates.count() == 40 * 86_400 + 100
    assert rates.agg({"total": "max"}).first()[0] == 301
    assert rates.where("second >= '2024-01-01'").agg({"pps": "sum"}).first()[0] == 300


def test_level_over_many_blocks(spark):
    threats = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    rows = [Row(packet_id=i, threat=threats[(i * 7) % 11 % 4]) for i in range(500)]
    got = {r.packet_id: r.level for r in rollups.overall_level(spark.createDataFrame(rows), last=5, block=7).collect()}
    for i in range(500):
        assert got[i] == max((threats[(k * 7) % 11 % 4] for k in range(max(0, i - 4), i + 1)), key=threats.index)


def packets(spark):
    rows = [
        Row(packet_id=i, ts=datetime(2024, 1, 1) + timedelta(seconds=i), src_ip=f"10.0.0.{i % 5}", dst_ip=f"192.168.0.{i % 3}", src_port=1000 + i,
            dst_port=[80, 443, 22, 53][i % 4], ip_proto=6 if i % 2 else 17, tcp_flags=2 if i % 2 else None, length=60, payload=b"GET /admin" if i % 7 == 0 else b"x")
        for i in range(200)
    ]
    schema = "packet_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, tcp_flags int, length int, payload binary"
    return spark.createDataFrame(rows, schema).selectExpr("*", "CAST(NULL AS INT) AS icmp_type", "CAST(NULL AS INT) AS arp_op")


def test_first_match_is_the_same_on_every_path(spark):
    lines = [
        '1: TCP 10.0.0.1:any -> any:443 * x', 'alert tcp any any -> any 443 (msg:"a"; sid:5; content:"GET"; nocase;)', "2: UDP any:any -> 192.168.0.1:80 * y",
        'alert udp any any -> any 80 (msg:"b"; sid:6;)', 'alert tcp any any -> any any (msg:"c"; sid:7; flags:S;)', "3: TCP any:any -> any:22 * z",
    ]
    table = rules.parse_rules(spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string"))
    found = []
    for options in ({}, {"compile_limit": 0}, {"compile_limit": 0, "chunk_rules": 2}, {"compile_limit": 0, "rule_count": 6, "chunk_rules": 1}):
        out = matching.first_match(packets(spark), table, **options)
        found.append(sorted((r.packet_id, r.rule_pos, r.matched_rule, r.is_alert) for r in out.collect()))
    assert found[0] == found[1] == found[2] == found[3]
    assert len(found[0]) == 200 and any(r[3] for r in found[0]) and not all(r[3] for r in found[0])


def test_flow_rows_do_not_depend_on_the_selection(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,2,3\n1,2\n1,2,3,4\n"x,y",2,3\n1,2,3,\n7\n')
    rows = read_flows(spark, str(tmp_path), ["a", "b", "c"])
    want = [("1", "2", "3"), ("1", "2", None), ("x,y", "2", "3"), ("7", None, None)]
    assert [tuple(r) for r in rows.collect()] == want
    assert [r.c for r in rows.select("c").collect()] == [w[2] for w in want]
    assert rows.count() == 4


def test_rules_that_ask_for_the_same_are_met_once(spark):
    """Two hundred rules of four conditions in chunks of one: the packets are read a few times, and every rule still has its hits."""
    asks = ["any 443", "any 22", "10.0.0.1 443", "any any"]
    lines = [(i + 1, f'alert tcp {asks[i % 4].split()[0]} any -> any {asks[i % 4].split()[1]} (msg:"m{i}"; sid:{i % 7};)') for i in range(200)]
    lines += [(201 + i, f'alert tcp any any -> any any (msg:"n"; byte_test:1,>,2,0; sid:{i};)') for i in range(50)]
    table = rules.parse_rules(spark.createDataFrame(lines, "line int, text string"))
    few = packets(spark).where("packet_id < 40")
    rows = [(r.packet_id, r.dst_port, r.src_ip) for r in few.where("ip_proto = 6").collect()]
    meets = [lambda port, src: port == 443, lambda port, src: port == 22, lambda port, src: port == 443 and src == "10.0.0.1", lambda port, src: True]
    want = sorted((p, n, f"{(n - 1) % 7}", f"m{n - 1}") for p, port, src in rows for n in range(1, 201) if meets[(n - 1) % 4](port, src))
    met = matching.all_matches(few, table, chunk_rules=1)
    assert sorted((r.packet_id, r.rule_pos, r.sid, r.rule) for r in met.select("packet_id", "rule_pos", "sid", "rule").collect()) == want
    first = matching.first_match_indexed(few, table, chunk_rules=1)
    assert {r.packet_id: r.rule_pos for r in first.where("is_alert").collect()} == {p: min(n for q, n, *_ in want if q == p) for p, *_ in want}
    for out in (met, first):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") <= matching.PASSES


def test_many_rules_are_compiled_as_rows(spark):
    lines = [(i + 1, f"{i}: any any:{1000 + i} -> any:any *") for i in range(250)]
    table = rules.parse_rules(spark.createDataFrame(lines, "line int, text string"))
    out = matching.first_match_compiled(packets(spark), table.collect())
    assert "Join LeftOuter" in out._jdf.queryExecution().analyzed().toString()
    got = {r.packet_id: r.rule_pos for r in out.collect()}
    assert got == {i: i + 1 for i in range(200)}
