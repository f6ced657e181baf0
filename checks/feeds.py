"""Alert feed, plug-ins, log format, evidence, packet views, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from checks.payloads import hits_sql, suppressed_sql
from checks.registry import alert_sql, query
from checks.traffic import LABELLED, SMALL, dos_sql, window_join
from checks.detectors import ALL_BRUTE, ARP, ARP_FLOODS, ARP_GRATUITOUS, ARP_TAKEOVERS, ENUM, FLOOD, FOLD, FRAG, FRAG_LIMITS, NAMED, PROBES, SYN_SCANS, failures
from checks.registry import cooldown_sql
from checks.views import SPARK, VIEWS, duck, load, view
from packetloom.functions import text
from packetloom.operators import dos
from packetloom.functions.timecols import micros
from packetloom.operators import bruteforce, fragments, synscan
from packetloom.operators.durable import fresh
from packetloom.operators.programs import Cooldown, CountThenReset, Reassembly, SlidingCount, SynScan, UsernameEnumeration
from packetloom.plans.registry import Registry, numbered_feed
from packetloom.sources import alertlog, capture
from packetloom.streaming import flows as st

EV = duck("packets_ev")
ICMP = f"(SELECT * FROM {EV} p WHERE icmp_type IS NOT NULL)"
BARE_SYN = f"(SELECT * FROM {EV} p WHERE (tcp_flags & 23) = 2)"
PAIR = ["src_ip", "dst_ip"]
BOTH = f"({dos_sql(ICMP, 'icmp', PAIR)} UNION ALL {dos_sql(BARE_SYN, 'syn', PAIR)})"


def two_detections(packets):
    """SYN and ICMP rates."""
    return dos.detect_dos(packets, ["icmp", "syn"], **SMALL)


@query("alert_feed", f"SELECT row_number() OVER (ORDER BY ts, packet_id, sid) AS id, ts, sid, threat, type, src, dst, info, packet_id FROM {BOTH} b")
def _(spark, d):
    feed = numbered_feed(two_detections(view(spark, d, "packets_ev")))
    return feed.select("id", "ts", "sid", "threat", "type", "src", "dst", "info", "packet_id")


@query("alert_latest", f"SELECT packet_id, ts, sid FROM {BOTH} b ORDER BY packet_id DESC, sid DESC LIMIT 100")
def _(spark, d):
    alerts = two_detections(view(spark, d, "packets_ev"))
    return alerts.orderBy(F.desc("packet_id"), F.desc("sid")).limit(100).select("packet_id", "ts", "sid")


def plugged():
    registry = Registry()
    registry.register("RateDetector", two_detections)
    registry.register("BrokenDetector", lambda packets: packets.select("no_such_column"))
    return registry


@query("plugin_alerts", f"SELECT packet_id, sid, src, dst FROM {BOTH} b")
def _(spark, d):
    return plugged().run(view(spark, d, "packets_ev"))[0].select("packet_id", "sid", "src", "dst")


@query(
    "plugin_errors",
    f"""SELECT 'RateDetector' AS detector, count(*) AS alerts, CAST(NULL AS VARCHAR) AS error FROM {BOTH} b
        UNION ALL SELECT 'BrokenDetector', 0, 'AnalysisException'""",
)
def _(spark, d):
    return plugged().report(view(spark, d, "packets_ev"))


@query("plugin_runtime_errors", f"SELECT 'RateDetector' AS detector, count(*) AS alerts, false AS failed FROM {BOTH} b UNION ALL SELECT 'FailingDetector', 0, true UNION ALL SELECT 'BrokenDetector', 0, true")
def _(spark, d):
    """One detector fails on a row while it runs, one can't be planned; the alerts of the third are complete."""
    registry = plugged()
    failing = F.when(F.col("packet_id") % 100 == 7, F.raise_error(F.lit("a row that can't be read")).cast("string")).otherwise(F.col("info"))
    registry.register("FailingDetector", lambda packets: two_detections(packets).withColumn("info", failing))
    names = ["FailingDetector", "RateDetector", "BrokenDetector"]
    alerts, errors = registry.run_isolated(view(spark, d, "packets_ev"), names)
    of = alerts.groupBy(F.when(F.col("sid").isNotNull(), "RateDetector").alias("detector")).agg(F.count("*").alias("alerts"))
    known = spark.createDataFrame([(n,) for n in names], "detector string").join(of, "detector", "left")
    failed = errors.select("detector", F.lit(True).alias("failed"))
    return known.join(failed, "detector", "left").select("detector", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("failed", F.lit(False)).alias("failed"))


@query("plugin_disabled", f"SELECT sid, packet_id, ts FROM {BOTH} b WHERE false")
def _(spark, d):
    """All built-in detectors start disabled: an empty table with the alerts' types."""
    return Registry().run(view(spark, d, "packets_ev"))[0].select("sid", "packet_id", "ts")


SHARED = ["ArpSpoofDetector", "BruteForceDetector", "RCEDetector", "SQLiDetector", "XSSDetector"]


@query(
    "all_detectors_feed",
    f"""SELECT packet_id, ts, detector, sid, src, dst, info FROM (
        {ARP_FLOODS} UNION ALL {ARP_TAKEOVERS} UNION ALL {ARP_GRATUITOUS} UNION ALL {ALL_BRUTE} UNION ALL
        {" UNION ALL ".join(alert_sql(suppressed_sql(hits_sql(duck("post_ev"), x), x), x, "CRITICAL", "sid", "info", "src", "dst") for x in SHARED[2:])}) f""",
)
def _(spark, d):
    """ARP, login and web traffic in one packet table, its detectors over shared candidate tables."""
    tables = [view(spark, d, name) for name in ("arp_ev", "auth_ev", "post_ev")]
    packets = tables[0]
    for more in tables[1:]:
        packets = packets.unionByName(more, allowMissingColumns=True)
    alerts, _ = Registry().run_shared(packets, SHARED)
    return alerts.select("packet_id", "ts", "detector", "sid", "src", "dst", "info")


@query("alert_log_round_trip", f"SELECT info, sid, src, dst FROM {BOTH} b")
def _(spark, d):
    return alertlog.parse_log_lines(alertlog.log_lines(two_detections(view(spark, d, "packets_ev"))))


@query(
    "alert_evidence",
    f"""SELECT alert_id, position, packet_id FROM (SELECT a.packet_id AS alert_id, p.packet_id, row_number() OVER (PARTITION BY a.packet_id
        ORDER BY p.ts, p.packet_id) AS position FROM ({dos_sql(ICMP, 'icmp', PAIR)}) a JOIN {EV} p ON p.src_ip = a.src
        AND p.ts BETWEEN a.ts - INTERVAL '10 seconds' AND a.ts) q WHERE position <= 3""",
)
def _(spark, d):
    packets = view(spark, d, "packets_ev")
    alerts = dos.detect_dos(packets, ["icmp"], **SMALL)
    return alertlog.evidence(alerts, packets, per_alert=3).select("alert_id", "position", "packet_id")


@query(
    "hex_dump",
    """SELECT page_id, n, first_hex, rtrim(first_ascii) AS first_ascii FROM (SELECT page_id, CAST((least(length(url), 256) + 15) // 16 AS INT) AS n,
        rpad(rtrim(regexp_replace(lower(hex(encode(url)[1:16])), '(..)', '\\1 ', 'g')), 47, ' ') AS first_hex, url[1:16] AS first_ascii FROM pages) p""",
)
def _(spark, d):
    dump = text.hex_dump(F.col("url").cast("binary"))
    rows = spark.read.parquet(f"{d}/pages.parquet").withColumn("dump", dump)
    return rows.select(
        "page_id", F.size("dump").alias("n"), F.col("dump")[0]["hex"].alias("first_hex"), F.rtrim(F.col("dump")[0]["ascii"]).alias("first_ascii")
    )


@query(
    "layer_tree",
    f"""SELECT packet_id, CASE WHEN tcp_flags IS NOT NULL THEN 'TCP' WHEN ip_proto = 17 THEN 'UDP' ELSE 'ICMP' END AS inner_name,
        CAST(coalesce(src_port, icmp_type) AS VARCHAR) AS first_value, 2 AS layers FROM {EV} p""",
)
def _(spark, d):
    packets = view(spark, d, "packets_ev")
    rows = packets.withColumn("tree", capture.layer_tree(packets))
    inner = F.element_at("tree", -1)
    return rows.select(
        "packet_id", inner["name"].alias("inner_name"), inner["fields"][0]["value"].alias("first_value"), F.size("tree").alias("layers")
    )


# Ethernet, IPv4 and UDP headers written as hexadecimal text around values of ``events``.
FRAME = """concat('001122334455', '66778899aabb', '0800', '4500', {len}, {id}, '2003', '40', '11', '0000', '0a0000', {host}, 'c0a80005',
    {sport}, '0050', {ulen}, '0000', hex(encode('abc', 'utf-8')))"""


@query(
    "frame_decode",
    """SELECT event_id AS packet_id, '10.0.0.' || (user_id % 200) AS src_ip, '192.168.0.5' AS dst_ip, CAST(1024 + event_id % 5000 AS INT) AS src_port, 80 AS dst_port,
        17 AS ip_proto, CAST(event_id % 65536 AS INT) AS ip_id, 31 AS ip_len, false AS ip_mf, 'UDP' AS proto, 'abc' AS payload, '66:78:89:9a:ab:bc' AS src_mac
        FROM events""".replace("66:78:89:9a:ab:bc", "66:77:88:99:aa:bb"),
)
def _(spark, d):
    def word(value, width=4):
        return F.lpad(F.hex(value), width, "0")

    events = spark.read.parquet(f"{d}/events.parquet")
    header = F.concat(
        F.lit("001122334455" "66778899aabb" "0800" "4500" "001f"), word(F.col("event_id") % 65536), F.lit("0000" "40" "11" "0000" "0a0000"),
        word(F.col("user_id") % 200, 2), F.lit("c0a80005"), word(1024 + F.col("event_id") % 5000), F.lit("0050" "000b" "0000" "616263"),
    )
    frames = events.select(
        F.lit("events").alias("path"), F.col("event_id").alias("frame_no"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(45).alias("length"), F.unhex(header).alias("frame"),
    )
    rows = capture.decode_frames(frames)
    return rows.select(
        "packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "ip_proto", "ip_id", "ip_len", "ip_mf", "proto",
        F.col("payload").cast("string").alias("payload"), "src_mac",
    )


@query(
    "dns_decode",
    """SELECT page_id, CASE page_id % 4 WHEN 1 THEN rtrim(repeat('abcdefgh' || page_id % 10 || '.', 40), '.') WHEN 3 THEN 'www.example.' || page_id
              ELSE 'q' || page_id || '.example' END AS qname, CAST(page_id % 90 AS BIGINT) AS answers, CAST(page_id % 90 * (page_id % 150) AS BIGINT) AS bytes
        FROM pages""",
)
def _(spark, d):
    """Replies with up to 89 TXT answers under plain and compressed owner names; questions plain, over 255 bytes, or behind a pointer."""
    pages = load(spark, d, "pages").select("page_id")
    page = F.col("page_id")

    def word(value, width=4):
        return F.lpad(F.hex(value.cast("long")), width, "0")

    def label(text):
        return F.concat(word(F.length(text), 2), F.hex(F.encode(text, "utf-8")))

    number = page.cast("string")
    long_name = F.concat(F.repeat(label(F.concat(F.lit("abcdefgh"), (page % 10).cast("string"))), 40), F.lit("00"))
    plain = F.concat(label(F.concat(F.lit("q"), number)), label(F.lit("example")), F.lit("00"))
    # www, then a pointer to the labels that lie after the answers' owner, i.e. at the very end of the message
    owner = F.when(page % 2 == 0, F.concat(label(F.lit("own")), label(F.lit("er")), F.lit("00"))).otherwise(F.lit("c00c"))
    answer = F.concat(owner, F.lit("0010" "0001" "00000000"), word(page % 150), F.repeat(F.lit("41"), (page % 150).cast("int")))
    answers = F.repeat(answer, (page % 90).cast("int"))
    tail = F.concat(label(F.lit("example")), label(number), F.lit("00"))
    pointer = word(0xC000 + 12 + 4 + 2 + 4 + F.length(answers) / 2)
    question = F.when(page % 4 == 1, long_name).when(page % 4 == 3, F.concat(label(F.lit("www")), pointer)).otherwise(plain)
    header = F.concat(F.lit("abcd" "8180" "0001"), word(page % 90), F.lit("0000" "0000"))
    dns = F.concat(header, question, F.lit("0010" "0001"), answers, F.when(page % 4 == 3, tail).otherwise(""))
    size = (F.length(dns) / 2).cast("int")
    packet = F.concat(
        F.lit("001122334455" "66778899aabb" "0800" "4500"), word(size + 28), F.lit("0000" "0000" "40" "11" "0000" "0a000001" "c0a80005" "0035" "1234"), word(size + 8), F.lit("0000"), dns,
    )
    frames = pages.select(F.lit("pages").alias("path"), page.alias("frame_no"), F.lit(0).cast("timestamp").alias("ts"), F.lit(60).alias("length"), F.unhex(packet).alias("frame"))
    rows = capture.decode_frames(frames)
    total = F.aggregate("dns_txt_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(F.col("packet_id").alias("page_id"), F.col("dns_qname").alias("qname"), F.size("dns_txt_sizes").cast("long").alias("answers"), total.alias("bytes"))


# ---------------------------------------------------------------- streams


def event_packets(spark, d):
    """``packets_ev`` over a stream of the events file."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").createOrReplaceTempView("events")
    return spark.sql(VIEWS["packets_ev"](SPARK))


def folder(spark):
    return fresh(spark, "stream")


def in_turns(rows, files=5, jitter=30, most=None):
    """``rows`` in ``files`` parts that land one after the other, with rows up to ``jitter`` seconds out of order.

    ``most`` makes more parts of about so many rows each, which are dealt out together beforehand.
    """
    late = micros(rows, "ts") + F.pmod(F.xxhash64("packet_id"), F.lit(jitter * 1_000_000))
    lo, hi, n = rows.agg(F.min(late), F.max(late), F.count("*")).first()
    parts = max(files, -(-n // most)) if most else files
    turn = F.floor((late - lo) * parts / (hi - lo + 1))
    if parts == files:
        return [rows.where(turn == k).repartition(1) for k in range(parts)]
    dealt = fresh(rows.sparkSession, "dealt")
    rows.withColumn("__turn", turn).repartition(parts, "__turn").write.partitionBy("__turn").parquet(dealt)
    table = rows.sparkSession.read.parquet(dealt)
    return [table.where(F.col("__turn") == k).drop("__turn").repartition(1) for k in range(parts)]


def over(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def landed(spark, rows, files=5, jitter=30, most=None):
    """``rows`` as a stream over the files of ``in_turns``, one in each micro-batch."""
    path = fresh(spark, "landed")
    for part in in_turns(rows, files, jitter, most):
        part.write.mode("append").parquet(path)
    return over(spark, path, rows.schema)


def naive(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if "ts" in df.columns else df


@query(
    "stream_second_rates",
    f"""SELECT make_timestamp(sec * 1000000) AS second, count(*) AS pps, CAST(sum(length) AS BIGINT) AS bps
        FROM (SELECT *, epoch_us(ts) // 1000000 AS sec FROM {EV} p) q GROUP BY sec""",
)
def _(spark, d):
    rates = st.run_to_end(st.second_rates(event_packets(spark, d)), folder(spark))
    return rates.withColumn("second", F.col("second").cast("timestamp_ntz"))


COUNT_OUT = T.StructType([T.StructField("at", T.LongType()), T.StructField("packet_id", T.LongType()), T.StructField("n", T.LongType())])
KEPT_OUT = T.StructType([T.StructField("at", T.LongType()), T.StructField("packet_id", T.LongType())])


SLIDING = window_join(EV, PAIR, 20, "a.src_ip, a.dst_ip, a.packet_id, count(b.packet_id) AS n")


@query("stream_sliding_count", SLIDING)
def _(spark, d):
    stream = st.stream_scan(landed(spark, view(spark, d, "packets_ev")), PAIR, SlidingCount(20), COUNT_OUT)
    return st.run_to_end(stream, folder(spark)).drop("at")


@query("stream_cooldown", f"SELECT src_ip, dst_ip, packet_id FROM {cooldown_sql(EV, PAIR, 30, True)} c")
def _(spark, d):
    stream = st.stream_scan(event_packets(spark, d), PAIR, Cooldown(30, True), KEPT_OUT)
    return st.run_to_end(stream, folder(spark)).drop("at")


@query("stream_syn_scan", f"SELECT src, packet_id, dst, kind, count FROM {SYN_SCANS} s")
def _(spark, d):
    probes = landed(spark, synscan.syn_probes(view(spark, d, "packets_ev")))
    stream = st.stream_scan(probes, ["src"], SynScan(60, 3, 6), synscan.SCAN_OUT)
    return st.run_to_end(stream, folder(spark)).select("src", "packet_id", "dst", "kind", "count")


@query("stream_arp_flood", f"SELECT packet_id, 25 AS n FROM {FLOOD} f")
def _(spark, d):
    """One count over all ARP packets, as the detector keeps it."""
    packets = landed(spark, view(spark, d, "arp_ev").select("packet_id", "ts"), most=500_000).withColumn("network", F.lit("local"))
    stream = st.stream_scan(packets, ["network"], CountThenReset(10, 25), COUNT_OUT)
    return st.run_to_end(stream, folder(spark)).select("packet_id", "n")


@query("stream_name_enumeration", f"SELECT client, service, packet_id, server, 10 AS found FROM {ENUM} e")
def _(spark, d):
    named = failures(spark, d).where(F.col("username").isNotNull() & (F.col("username") != "unknown"))
    rows = landed(spark, named.select("packet_id", "ts", "client", "service", "server", "username"))
    stream = st.stream_scan(rows, ["client", "service"], UsernameEnumeration(10), bruteforce.ENUM_OUT)
    return st.run_to_end(stream, folder(spark)).select("client", "service", "packet_id", "server", "found")


@query(
    "stream_reassembly",
    f"SELECT src, dst, ip_id, packet_id, kind, CAST(value AS BIGINT) AS value FROM {FOLD} f",
)
def _(spark, d):
    rows = landed(spark, fragments.ip_fragments(view(spark, d, "frag_ev")))
    stream = st.stream_scan(rows, ["src", "dst", "ip_id"], Reassembly(FRAG_LIMITS.timeout, FRAG_LIMITS.per_packet), fragments.FRAGMENT_OUT, buckets=512)
    packets = view(spark, d, "frag_ev")
    last = packets.where("ip_proto is not null").agg(F.max(micros(packets, "ts"))).first()[0]
    found = st.run_to_end(stream, folder(spark)).where((F.col("kind") != "timeout") | (F.col("us") < last))  # as far as the capture goes
    return found.select("src", "dst", "ip_id", "packet_id", "kind", "value")


@query(
    "stream_hopping_totals",
    f"""SELECT make_timestamp(slot * 1000000) AS ts, src_ip, count(*) AS n FROM (SELECT src_ip, epoch_us(ts) // 20000000 * 20 + 20 * k AS slot
        FROM {EV} p, (VALUES (1), (2), (3)) v(k)) q GROUP BY slot, src_ip HAVING count(*) >= 4""",
)
def _(spark, d):
    counts = st.run_to_end(st.hopping_counts(event_packets(spark, d), ["src_ip"], "60 seconds", "20 seconds", 4), folder(spark))
    return counts.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_hopping_counts")
def _(spark, d):
    return st.run_to_end(st.hopping_counts(event_packets(spark, d), ["src_ip"], "60 seconds", "20 seconds", 4, "dst_ip"), folder(spark))
