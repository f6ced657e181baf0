"""Suppressed signature alerts: rules that agree are followed once, those that share a sid together."""

from pyspark.sql import functions as F

from checks import load, rulesets
from packetloom.operators import matching
from packetloom.operators.chains import cooldown
from packetloom.sources import rules as rl


def packets(spark):
    rows = [(i, 3 * i, f"10.0.0.{i % 2 + 1}", "192.168.0.1" if i % 5 else "192.168.0.255", 17, 2000, 53 if i % 3 else 80) for i in range(90)]
    df = spark.createDataFrame(rows, "packet_id long, s long, src_ip string, dst_ip string, ip_proto int, src_port int, dst_port int")
    none = [F.lit(None).cast("int").alias(c) for c in ("tcp_flags", "icmp_type", "icmp_code", "icmp_id", "arp_op")]
    return df.select("*", F.timestamp_seconds("s").alias("ts"), *none).drop("s")


def rule_lines(spark):
    form = "alert udp any any -> any {} ( msg:\"m{}\"; {}sid:{}; )"
    limit = "detection_filter:track by_src, count 3, seconds 20; "
    alike = [form.format(53, n, "", n) for n in range(1, 41)] + [form.format(53, n, limit, n) for n in range(41, 61)]
    shared = [form.format(port, "s", limit, 99) for port in (53, 53, 80)] + [form.format("any", "u", "", 98), form.format(53, "u", "", 98)]
    nameless = [form.format(53, "none", "", "").replace("sid:; ", "")] * 2
    return spark.createDataFrame(list(enumerate([*alike, *shared, *nameless], 1)), "line int, text string")


def test_rules_that_agree_are_followed_once(spark, monkeypatch):
    traffic, rules = packets(spark), rl.parse_rules(rule_lines(spark)).localCheckpoint()
    columns = ["packet_id", "ts", "sid", "rule_pos", "rule", "src_ip", "dst_ip"]
    each = matching.detection_filter(matching.all_matches(traffic, rules)).where(matching.not_broadcast()).select(*columns)
    tied = each.withColumn("__tie", F.struct("packet_id", "rule_pos"))
    want = sorted(map(repr, cooldown(tied, ["sid", "src_ip", "dst_ip"], 60, strict=False, tie="__tie").select(*columns).collect()))

    sizes, filtered = [], matching.detection_filter
    monkeypatch.setattr(matching, "detection_filter", lambda hits: sizes.append(hits.count()) or filtered(hits))
    monkeypatch.setattr(matching, "CLASS_RULES", 7)
    got = matching.signature_alerts(traffic, rules)
    assert got.columns == columns and sorted(map(repr, got.collect())) == want and len(want) > 200
    # of the 60 rules with an own sid on port 53 two are followed
    assert sizes == [2 * 60 + (60 + 60 + 30) + (90 + 60) + 2 * 60]


def test_rows_of_a_lot_follow_each_other(spark, monkeypatch):
    """Rules come again within few rows, so a page of a stored table holds the rules of a lot or two, not those of a whole class."""
    monkeypatch.setattr(matching, "CLASS_RULES", 20)
    traffic = packets(spark).crossJoin(spark.range(8).withColumnRenamed("id", "k")).withColumn("packet_id", F.col("packet_id") * 8 + F.col("k")).drop("k")
    lines = [(n, f'alert udp any any -> any 53 ( msg:"m{n}"; sid:{n}; )') for n in range(1, 301)]
    met = matching.all_matches(traffic, rl.parse_rules(spark.createDataFrame(lines, "line int, text string")))
    parts = met.select("packet_id", "rule_pos").rdd.glom().collect()
    rows = [tuple(r) for part in parts for r in part]
    assert len(rows) == len(set(rows)) == 60 * 8 * 300
    pages = [len({r for _, r in rows[i : i + 200]}) for i in range(0, len(rows), 200)]
    assert sum(pages) / len(pages) < 60


def test_rules_that_agree_are_counted_once(spark, tmp_path, monkeypatch):
    """The query's own threshold step gets the hits of stand-ins; its rows are those of every rule by itself, one without a sid included."""
    pings = F.when(F.col("event_type") == "purchase", '{"k": 11}').otherwise(F.col("props"))
    dense = F.expr("timestampadd(SECOND, event_id * 200, TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("props", pings).withColumn("ts", dense)
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.range(600).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    rules, traffic = rulesets.rule_table(spark, str(tmp_path)).where("kind = 'snort'"), rulesets.arrivals(spark, str(tmp_path))
    rules = rules.withColumn("sid", F.when(F.col("line") == 12, None).otherwise(F.when(F.col("line").isin(112, 212), "9").otherwise(F.col("sid")))).localCheckpoint()
    columns = ["packet_id", "rule_pos", "sid"]
    each = matching.detection_filter(matching.all_matches(traffic, rules)).select(*columns)
    want = sorted(map(repr, each.collect()))
    assert any("sid=None" in r for r in want) and any("sid='9'" in r for r in want) and len(want) > 2000

    counted, filtered = [], matching.detection_filter
    monkeypatch.setattr(rulesets, "rule_table", lambda spark, d: rules)
    monkeypatch.setattr(matching, "detection_filter", lambda hits: counted.append(hits.count()) or filtered(hits))
    monkeypatch.setattr(matching, "CLASS_RULES", 4)
    got = load()["rule_detection_filter"][0](spark, str(tmp_path))
    assert got.columns == columns and sorted(map(repr, got.collect())) == want
    assert counted[0] < len(want) * 2 / 3
