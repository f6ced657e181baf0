"""Floods, scans and stealth-flag probes over sliding windows. One alert per packet over threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from packetloom.functions import net
from packetloom.functions.timecols import from_micros, is_ntz, micros
from packetloom.operators.alerts import as_alerts, source_address, target_address, union_all
from packetloom.operators.flowstate import with_flow_state
from packetloom.operators.programs import FirstSeen
from packetloom.operators.scan import keyed_scan
from packetloom.operators.sliding import reaches_count, sliding_distinct

# Fixed values: (window seconds, threshold), sid and message of each detection, names of flag sets.
DOS_LIMITS = {
    "any": (10.0, 500),
    "syn": (5.0, 20),
    "syn_port_scan": (30.0, 8),
    "udp": (5.0, 100),
    "udp_port_scan": (30.0, 15),
    "icmp": (5.0, 20),
    "port_scan": (30.0, 20),
    "hscan": (30.0, 10),
    "flags": (30.0, 15),
}
DOS_SIDS = {
    "any": 1000004,
    "syn": 1000001,
    "syn_port_scan": 1000013,
    "udp": 1000002,
    "udp_port_scan": 1000014,
    "icmp": 1000003,
    "port_scan": 1000010,
    "hscan": 1000012,
    "flags": 1000011,
}
DOS_MESSAGES = {
    "any": "FLOOD - high packet rate (any)",
    "syn": "SCAN - TCP SYN scan detected",
    "syn_port_scan": "SCAN - SYN port scan detected (many SYN dst ports)",
    "udp": "DOS - UDP flood detected",
    "udp_port_scan": "SCAN - UDP port scan detected (many UDP dst ports)",
    "icmp": "DOS - ICMP flood detected",
    "port_scan": "SCAN - port scan detected (many dst ports)",
    "hscan": "SCAN - horizontal scan detected (many dst IPs)",
}
FLAG_SCANS = {0x00: "NULL", 0x01: "FIN", 0x29: "XMAS", 0x10: "ACK"}

_KEPT = ["packet_id", "ts", "src", "dst"]


def _addressed(packets: DataFrame) -> DataFrame:
    """Detector view of the packets, with the columns the detections read."""
    return packets.withColumn("src", source_address()).withColumn("dst", target_address())


def bare_syn() -> Column:
    flags = F.col("tcp_flags")
    return net.is_syn_only() & ~net.has_flag(flags, net.RST) & ~net.has_flag(flags, net.FIN)


def with_established(packets: DataFrame) -> DataFrame:
    """All packets with their flow state; only TCP takes part in the connection lookup."""
    tcp = with_flow_state(packets.where(net.is_tcp()))
    rest = packets.where(~net.is_tcp())
    return tcp.unionByName(rest, allowMissingColumns=True)


def _flag_scan_name(established_after: Column) -> Column:
    flags = F.col("tcp_flags")
    plain = F.when(flags == 0x00, "NULL").when(flags == 0x01, "FIN").when(flags == 0x29, "XMAS")
    return plain.when((flags == 0x10) & ~F.coalesce(established_after, F.lit(False)), "ACK")


def detect_dos(packets: DataFrame, only: list[str] | None = None, *, reference_ageing: bool = False, **limits: tuple[float, int]) -> DataFrame:
    """Alerts of the selected detections (all nine by default).

    ``limits`` overrides ``(window seconds, threshold)`` by name. Established TCP is exempt from the
    any-protocol flood and from the ACK scan. The horizontal scan counts the distinct targets of its window; with ``reference_ageing``
    it counts a list on which a target stays for a window after it was first added, however often it comes again (:class:`FirstSeen`).
    """
    chosen = only or list(DOS_LIMITS)
    limit = {**DOS_LIMITS, **limits}
    plain = _addressed(packets)
    udp, tcp = net.is_udp(), net.is_tcp()

    def counted(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return reaches_count(rows.select(*dict.fromkeys([*_KEPT, *keys])), keys, *limit[name])

    def spread(name: str, rows: DataFrame, keys: list[str], value: str, adds: Column | None = None) -> DataFrame:
        window, threshold = limit[name]
        rows = rows.withColumn("__adds", F.lit(True) if adds is None else adds)
        rows = rows.select(*dict.fromkeys([*_KEPT, *keys, value, "__adds"]))
        return sliding_distinct(rows, keys, value, window, where=F.col("__adds")).where(F.col("n_distinct") >= threshold)

    found = []
    if "any" in chosen:
        stateful = _addressed(with_established(packets.select(*_flow_columns(packets))))
        open_rows = stateful.where(~F.coalesce(F.col("established_before"), F.lit(False)))
        found.append(("any", counted("any", open_rows, ["src", "dst"])))
    if "syn" in chosen:
        found.append(("syn", counted("syn", plain.where(bare_syn()), ["src", "dst"])))
    if "syn_port_scan" in chosen:
        rows = plain.where(net.is_syn_only() & F.col("dst_port").isNotNull())
        found.append(("syn_port_scan", spread("syn_port_scan", rows, ["src", "dst"], "dst_port")))
    if "udp" in chosen:
        found.append(("udp", counted("udp", plain.where(udp), ["src", "dst", "dst_port"])))
    if "udp_port_scan" in chosen:
        rows = plain.where(udp & F.col("dst_port").isNotNull())
        found.append(("udp_port_scan", spread("udp_port_scan", rows, ["src", "dst"], "dst_port")))
    if "icmp" in chosen:
        found.append(("icmp", counted("icmp", plain.where(net.is_icmp()), ["src", "dst"])))
    if "port_scan" in chosen:
        rows = plain.where((tcp | udp) & F.col("dst_port").isNotNull())
        found.append(("port_scan", spread("port_scan", rows, ["src", "dst"], "dst_port")))
    if "hscan" in chosen:
        probes = (net.is_syn_only() | (~tcp & udp)) & ~net.is_multicast_or_broadcast(F.col("dst"))
        if reference_ageing:
            found.append(("hscan", _listed_targets(plain, F.coalesce(probes, F.lit(False)), *limit["hscan"])))
        else:
            found.append(("hscan", spread("hscan", plain, ["src"], "dst", F.coalesce(probes, F.lit(False)))))
    alerts = [
        as_alerts(hits, "DosDetector", F.lit(DOS_SIDS[name]), F.lit(DOS_MESSAGES[name]), F.col("src"), F.col("dst"))
        for name, hits in found
    ]
    if "flags" in chosen:
        # Only bare ACKs depend on the connection state; the other flag sets skip the lookup.
        others = plain.where(F.col("tcp_flags").isin(0x00, 0x01, 0x29)).withColumn("flagname", _flag_scan_name(F.lit(False)))
        state = with_flow_state(packets.where(net.is_tcp()).select(*_flow_columns(packets)))
        acks = _addressed(state.where(F.col("tcp_flags") == 0x10)).withColumn(
            "flagname", _flag_scan_name(F.col("established_after"))
        )
        named = others.select(*_KEPT, "flagname").unionByName(acks.select(*_KEPT, "flagname").where("flagname is not null"))
        hits = counted("flags", named, ["flagname", "src"])
        info = F.concat(F.lit("SCAN - "), F.col("flagname"), F.lit(" flag scan detected"))
        alerts.append(as_alerts(hits, "DosDetector", F.lit(DOS_SIDS["flags"]), info, F.col("src"), F.col("dst")))
    return union_all(alerts)


def _listed_targets(packets: DataFrame, adds: Column, window: float, threshold: int) -> DataFrame:
    out = T.StructType([T.StructField("us", T.LongType()), T.StructField("packet_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("dst", T.StringType())])
    rows = packets.select("packet_id", micros(packets, "ts").alias("us"), "src", "dst", adds.alias("adds"))
    counts = keyed_scan(rows, ["src"], ["us", "packet_id"], FirstSeen(window), out)
    return counts.where(F.col("n") >= threshold).withColumn("ts", from_micros("us", is_ntz(packets, "ts"))).drop("us")


def _flow_columns(packets: DataFrame) -> list[str]:
    wanted = ["packet_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "ip_proto", "tcp_flags", "payload"]
    return [c for c in wanted if c in packets.columns]
