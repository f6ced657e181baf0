"""Building rows of the common alert table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.labels import alert_type, message_threat
from packetloom.schema import ALERT_COLUMNS

# Identifier, display name, description, severity and default state of each detector.
DETECTORS = [
    ("ArpSpoofDetector", "ARP Spoof Detector", "Detects ARP flooding, spoofing, and poisoning anomalies.", "HIGH", False),
    ("BruteForceDetector", "Brute Force Detector", "Detects SSH, RDP, FTP, SMTP, and HTTP brute-force credential attacks.", "HIGH", False),
    ("DNSTunnelDetector", "DNS Tunnel Detector", "Detects data exfiltration and Command & Control heartbeats in DNS queries.", "MEDIUM", False),
    ("DosDetector", "DoS/Scan Detector", "Detects SYN, UDP, and ICMP flood attacks, as well as distinct port scanning.", "HIGH", False),
    ("FragmentationDetector", "Fragmentation Detector", "Detects IP fragmentation anomalies, overlapping fragments, and teardrop attacks.", "MEDIUM", False),
    ("RCEDetector", "RCE Detector", "Detects Remote Code Execution and malicious file upload patterns in HTTP payloads.", "CRITICAL", False),
    ("SQLiDetector", "SQL Injection Detector", "Detects SQL Injection (SQLi) patterns and query manipulations in HTTP requests.", "CRITICAL", False),
    ("SynScanDetector", "SYN Scan Detector", "Detects SYN-only stealth port scans (such as nmap -sS) and distributed sweeps.", "HIGH", False),
    ("XSSDetector", "XSS Detector", "Detects Cross-Site Scripting (XSS) script tag, event handler, and polyglot injections.", "CRITICAL", False),
]
SEVERITY = {row[0]: row[3] for row in DETECTORS}

# Fixed value: address used for packets without an IP layer.
UNKNOWN = "unknown"


def source_address() -> Column:
    return F.coalesce(F.when(F.col("ip_proto").isNotNull(), F.col("src_ip")), F.lit(UNKNOWN))


def target_address() -> Column:
    return F.coalesce(F.when(F.col("ip_proto").isNotNull(), F.col("dst_ip")), F.lit(UNKNOWN))


def as_alerts(
    df: DataFrame, detector: str, sid: Column, info: Column, src: Column, dst: Column, severity: str | None = None
) -> DataFrame:
    """Alert rows from hits; threat, type and rule text follow from the message."""
    default = F.lit(severity or SEVERITY[detector])
    return (
        df.select(
            "ts",
            F.lit(detector).alias("detector"),
            sid.cast("int").alias("sid"),
            src.alias("src"),
            dst.alias("dst"),
            info.alias("info"),
            "packet_id",
        )
        .withColumn("threat", message_threat(F.col("info"), default))
        .withColumn("type", alert_type(F.col("info"), F.col("detector")))
        .withColumn("proto", F.lit("IP"))
        .withColumn("rule", F.concat(F.lit(f"[{detector}] "), F.col("info")))
        .select(*ALERT_COLUMNS)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
