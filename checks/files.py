"""Tables that go through their file forms and come back: captures, packets, alerts and log, evidence, rules, models."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from checks.feeds import BOTH, EV, ICMP, PAIR, two_detections
from checks.flows import FEATURES, FLOWS, model
from checks.registry import query
from checks.rulesets import SIMPLE
from checks.traffic import SMALL, dos_sql
from checks.views import view
from packetloom.operators import classify as cl, dos
from packetloom.operators.durable import fresh
from packetloom.schema import PACKETS
from packetloom.sources import alertlog, capture, rules as rl

# ---------------------------------------------------------------- captures


#: Frames of one capture file, about, so that no task holds more; three files at least.
CAPTURED = 200_000


def _captured(batches):
    """One capture file's bytes per task, with microsecond stamps."""
    parts = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for pdf in batches:
        for us, frame in zip(pdf["us"], pdf["frame"], strict=True):
            parts += [struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), len(frame)), frame]
    yield pd.DataFrame({"value": [b"".join(parts)]})


def event_frames(spark, d):
    """An Ethernet frame per event: UDP, TCP behind a VLAN tag, ICMP echo and ARP; the source address holds the event's number."""

    def word(value, width=4):
        return F.lpad(F.hex(value.cast("long")), width, "0")

    n = F.col("event_id")
    head, source = F.lit("0011223344556677" + "8899aabb"), F.concat(F.lit("0a"), word(n, 6))
    ip = lambda proto, size: F.concat(F.lit("4500"), F.lit(f"{size:04x}"), word(n % 65536), F.lit(f"000040{proto}0000"), source, F.lit("c0a80005"))
    udp = F.concat(head, F.lit("0800"), ip("11", 31), word(1024 + n % 5000), F.lit("0050000b0000616263"))
    tcp = F.concat(head, F.lit("810000070800"), ip("06", 40), word(1024 + n % 5000), F.lit("01bb" "00000001" "00000000" "5002" "ffff" "0000" "0000"))
    icmp = F.concat(head, F.lit("0800"), ip("01", 28), F.lit("08000000"), word(n % 65536), F.lit("0001"))
    arp = F.concat(head, F.lit("0806" "0001080006040002" "8899aabbccdd"), source, F.lit("001122334455c0a80005"))
    frame = F.when(n % 4 == 0, udp).when(n % 4 == 1, tcp).when(n % 4 == 2, icmp).otherwise(arp)
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.unhex(frame).alias("frame"))


ADDRESS = "'10.' || (event_id // 65536) || '.' || (event_id // 256 % 256) || '.' || (event_id % 256)"


@query(
    "capture_files",
    f"""SELECT {ADDRESS} AS src_ip, '192.168.0.5' AS dst_ip, CASE event_id % 4 WHEN 0 THEN 'UDP' WHEN 1 THEN 'TLS' WHEN 2 THEN 'ICMP' ELSE 'ARP' END AS proto,
        CASE WHEN event_id % 4 < 2 THEN CAST(1024 + event_id % 5000 AS INT) END AS src_port, CASE event_id % 4 WHEN 1 THEN 2 END AS tcp_flags,
        CASE event_id % 4 WHEN 2 THEN 8 END AS icmp_type, CASE event_id % 4 WHEN 2 THEN CAST(event_id % 65536 AS INT) END AS icmp_id,
        CASE event_id % 4 WHEN 3 THEN 2 END AS arp_op, epoch_us(ts) AS us FROM events""",
)
def _(spark, d):
    folder = fresh(spark, "captures")
    frames = event_frames(spark, d)
    files = frames.repartition(max(3, -(-frames.count() // CAPTURED))).mapInPandas(_captured, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.text(folder)
    rows = capture.decode_frames(capture.number_packets(capture.read_captures(spark, f"{folder}/part-*")), "packet_id")
    return rows.select("src_ip", "dst_ip", "proto", "src_port", "tcp_flags", "icmp_type", "icmp_id", "arp_op", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("packet_table", f"SELECT packet_id, epoch_us(ts) AS us, src_ip, dst_ip, ip_proto, tcp_flags, src_port, dst_port, icmp_type, length FROM {EV} p")
def _(spark, d):
    packets, folder = view(spark, d, "packets_ev"), fresh(spark, "packets")
    full = [(F.col(f.name) if f.name in packets.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKETS]
    capture.write_packets(packets.select(*full), folder)
    rows = capture.read_packets(spark, folder)
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    return rows.select("packet_id", us, "src_ip", "dst_ip", "ip_proto", "tcp_flags", "src_port", "dst_port", "icmp_type", "length")


# ---------------------------------------------------------------- alerts


@query("alert_table", f"SELECT packet_id, sid, src, dst, threat, info FROM {BOTH} b")
def _(spark, d):
    folder = fresh(spark, "alerts")
    alertlog.write_alerts(two_detections(view(spark, d, "packets_ev")), folder)
    return spark.read.parquet(folder).select("packet_id", "sid", "src", "dst", "threat", "info")


@query("alert_log_files", f"SELECT info, sid, src, dst FROM {BOTH} b")
def _(spark, d):
    folder = fresh(spark, "alert-log")
    alertlog.write_alert_log(two_detections(view(spark, d, "packets_ev")), folder)
    return alertlog.read_alert_log(spark, folder).select("info", "sid", "src", "dst")


@query(
    "evidence_table",
    f"""SELECT alert_id, position, packet_id, sid FROM (SELECT a.packet_id AS alert_id, a.sid, p.packet_id, row_number() OVER (PARTITION BY a.packet_id
        ORDER BY p.ts, p.packet_id) AS position FROM ({dos_sql(ICMP, 'icmp', PAIR)}) a JOIN {EV} p ON p.src_ip = a.src
        AND p.ts BETWEEN a.ts - INTERVAL '10 seconds' AND a.ts) q WHERE position <= 8""",
)
def _(spark, d):
    packets, folder = view(spark, d, "packets_ev"), fresh(spark, "evidence")
    alertlog.write_evidence(dos.detect_dos(packets, ["icmp"], **SMALL), packets, folder)
    return spark.read.parquet(folder).select("alert_id", "position", "packet_id", "sid")


# ---------------------------------------------------------------- rules, models


@query("rule_files", f"SELECT line, sid, proto, src_ip, src_port, direction, dst_ip, dst_port, payload FROM {SIMPLE} s")
def _(spark, d):
    folder = fresh(spark, "rules")
    lines = view(spark, d, "rules_ev").orderBy("line").coalesce(1)  # one rule file, its lines in order
    lines.select("text").write.text(folder)
    rules = rl.usable(rl.load_rules(spark, folder)).where("kind = 'simple'")
    return rules.select("line", "sid", "proto", "src_ip", "src_port", "direction", "dst_ip", "dst_port", "payload")


@query("forest_saved", f"SELECT true AS same, count(*) AS flows FROM {FLOWS} f")
def _(spark, d):
    """Predictions of a model and of its copy read back from disk."""
    fitted, folder = model(spark, d), fresh(spark, "model")
    fitted.save(folder)
    flows = view(spark, d, "flows_ev")
    # several flows may share a key and part, so the predictions of each are compared as a multiset
    counts = lambda m, name: cl.predict(m, flows, ["flow_key", "part"]).groupBy("flow_key", "part", "prediction").agg(F.count("*").alias(name))
    both = counts(fitted, "was").join(counts(cl.FlowModel.load(folder), "n"), ["flow_key", "part", "prediction"], "full")
    same = F.coalesce(F.col("was") == F.col("n"), F.lit(False))
    return both.groupBy(same.alias("same")).agg(F.sum(F.coalesce("was", "n")).alias("flows"))


@query(
    "forest_facts",
    f"""SELECT count(*) AS flows, true AS known, true AS sums, {len(FEATURES)} AS features FROM {FLOWS} f""",
)
def _(spark, d):
    """Every flow gets a class of the training data, and its likeliest classes sum to at most one, the first being the prediction."""
    fitted = model(spark, d)
    rows = cl.predict_requests(fitted, view(spark, d, "flows_ev"), ["flow_key"])
    classes = view(spark, d, "flows_ev").select("label").distinct().agg(F.collect_set("label").alias("classes"))  # the class names
    listed = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p["prob"])
    good = (listed <= 100.1) & (F.get("probabilities", F.lit(0))["prob"] == F.col("confidence"))
    known = F.array_contains("classes", F.col("prediction"))
    facts = rows.crossJoin(F.broadcast(classes)).agg(F.count("*").alias("flows"), F.min(known).alias("known"), F.min(good).alias("sums"))
    return facts.withColumn("features", F.lit(len(fitted.features)))
