"""Streamed detectors: the detections of ``operators`` as branches of one stream of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from packetloom.functions import net
from packetloom.operators.alerts import as_alerts, source_address, target_address
from packetloom.operators.dos import DOS_LIMITS, DOS_MESSAGES, DOS_SIDS, bare_syn
from packetloom.operators.programs import Branched, SlidingCount, SlidingDistinct
from packetloom.streaming.flows import WATERMARK, stream_scan

#: States that the keys of all branches share.
BUCKETS = 512

_FOUND = T.StructType([T.StructField("us", T.LongType()), T.StructField("packet_id", T.LongType()), T.StructField("n", T.LongType())])


def stream_rates(packets: DataFrame, only: list[str] | None = None, delay: str = WATERMARK, buckets: int | None = BUCKETS, **limits: tuple[float, int]) -> DataFrame:
    """Alerts of the rate and spread detections that need no connection state, as branches of one stream.

    Same limits and rows as :func:`packetloom.operators.dos.detect_dos`, for the names of ``STREAMED``. A packet becomes a row for
    each detection that counts it, keyed by the detection and what it counts for, and one state machine follows all keys, so the
    branches share the scan, the watermark and one state store. Pairs and ports are many and most have few rows, so keys share ``buckets`` states.
    """
    chosen = only or STREAMED
    limit = {**DOS_LIMITS, **limits}
    plain = packets.withColumn("src", source_address()).withColumn("dst", target_address())
    udp, tcp, ported = net.is_udp(), net.is_tcp(), F.col("dst_port").isNotNull()
    none, port = F.lit(None).cast("string"), F.col("dst_port").cast("string")  # text, as pandas turns numbers beside nulls into fractions
    # which packets count, the port if it is part of the key, the value whose variety counts
    rules = {
        "syn": (bare_syn(), none, none),
        "syn_port_scan": (net.is_syn_only() & ported, none, port),
        "udp": (udp, port, none),
        "udp_port_scan": (udp & ported, none, port),
        "icmp": (net.is_icmp(), none, none),
        "port_scan": ((tcp | udp) & ported, none, port),
    }
    kind = "struct<branch:string,port:string,value:string>"
    branches = F.array(*[F.when(rules[n][0], F.struct(F.lit(n).alias("branch"), rules[n][1].alias("port"), rules[n][2].alias("value"))).cast(kind) for n in chosen])
    rows = plain.select("packet_id", "ts", "src", "dst", F.explode(F.filter(branches, lambda b: b.isNotNull())).alias("b")).select("packet_id", "ts", "src", "dst", "b.*")
    programs = {n: SlidingCount(limit[n][0]) if n in ("syn", "udp", "icmp") else SlidingDistinct(limit[n][0]) for n in chosen}
    least = F.create_map(*[F.lit(x) for n in chosen for x in (n, limit[n][1])])
    found = stream_scan(rows, ["branch", "src", "dst", "port"], Branched(programs), _FOUND, delay=delay, buckets=buckets)
    hits = found.where(F.col("n") >= F.element_at(least, F.col("branch"))).withColumn("ts", F.timestamp_micros("us"))
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for n in chosen for x in (n, table[n])]), F.col("branch"))
    return as_alerts(hits, "DosDetector", of(DOS_SIDS), of(DOS_MESSAGES), F.col("src"), F.col("dst"))


STREAMED = ["syn", "syn_port_scan", "udp", "udp_port_scan", "icmp", "port_scan"]
