"""Stealth SYN scans: few ports on one target, or many (target, port) pairs, with state that resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from packetloom.functions import net
from packetloom.functions.timecols import from_micros, is_ntz, micros
from packetloom.operators.alerts import as_alerts
from packetloom.operators.programs import SynScan
from packetloom.operators.scan import keyed_scan
from packetloom.operators.sliding import null_safe_join, sliding_distinct

SCAN_SIDS = {"syn_scan_per_target": 1000013, "syn_scan_distributed": 1000014}

SCAN_OUT = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("packet_id", T.LongType()),
        T.StructField("dst", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)


def syn_probes(packets: DataFrame) -> DataFrame:
    probes = packets.where(net.is_ip() & net.is_syn_only() & F.col("dst_port").isNotNull())
    return probes.select(
        "packet_id", "ts", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "dst_port"
    )


def detect_syn_scan(
    packets: DataFrame,
    *,
    window: float = 10.0,
    ports: int = 5,
    pairs: int = 12,
    cooldown: float = 30.0,
    **options,
) -> DataFrame:
    """Only sources that ever show enough distinct pairs within a window reach the state machine:
    resets can lower the counts but never raise them."""
    probes = syn_probes(packets)
    paired = probes.withColumn("pair", F.concat_ws("|", "dst", "dst_port"))
    busy = sliding_distinct(paired, ["src"], "pair", window).where(F.col("n_distinct") >= min(ports, pairs))
    suspects = null_safe_join(probes, busy.select("src").distinct(), ["src"], "left_semi")
    timed = suspects.withColumn("us", micros(suspects, "ts"))
    program = SynScan(window, ports, pairs, cooldown)
    hits = keyed_scan(timed, ["src"], ["us", "packet_id"], program, SCAN_OUT, **options)
    hits = hits.withColumn("ts", from_micros("us", is_ntz(packets, "ts")))
    info = F.format_string(
        f"[ALERT] SYN-SCAN Detected (custom detector) src=%s -> %s ports=%d window={window:g}s priority=HIGH type=%s",
        "src",
        "dst",
        "count",
        "kind",
    )
    sid = F.when(F.col("kind") == "syn_scan_per_target", 1000013).otherwise(1000014)
    return as_alerts(hits, "SynScanDetector", sid, info, F.col("src"), F.col("dst"))
