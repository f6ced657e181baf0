"""ARP floods, address takeovers and gratuitous replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.operators.alerts import as_alerts, union_all
from packetloom.operators.chains import greedy_chain
from packetloom.operators.sliding import previous_value, reaches_count, running_rank

# Window seconds, flood threshold, sid and the addresses put on ARP alerts.
ARP_WINDOW = 10
ARP_FLOOD = 25
ARP_SID = 1000005
ARP_SOURCE, ARP_TARGET = "ARP Protocol", "Local Network"


def _alerts(hits: DataFrame, info: Column) -> DataFrame:
    return as_alerts(hits, "ArpSpoofDetector", F.lit(ARP_SID), info, F.lit(ARP_SOURCE), F.lit(ARP_TARGET))


def arp_flood(packets: DataFrame, window: int = ARP_WINDOW, threshold: int = ARP_FLOOD, **options) -> DataFrame:
    """``threshold`` ARP packets within the window; every alert empties the count.

    A packet can complete a flood when the packet ``threshold - 1`` places before it is inside the
    window. After an alert at position p the next one needs a position of at least p + threshold, so
    the emptied count is a greedy chain over positions.
    """
    arp = packets.where("arp_op is not null").select("packet_id", "ts")
    ranked = running_rank(arp, [], "__pos")
    candidates = reaches_count(ranked, [], window, threshold)
    fired = greedy_chain(candidates, [], threshold, **options)
    return _alerts(fired, F.lit(f"[ALERT] ARP-FLOOD Detected count={threshold} window={window}s priority=HIGH"))


def arp_takeover(packets: DataFrame) -> DataFrame:
    """An address answered by another hardware address than the last time."""
    arp = packets.where("arp_op is not null").select("packet_id", "ts", "arp_psrc", "arp_hwsrc")
    seen = previous_value(arp, ["arp_psrc"], "arp_hwsrc")
    changed = seen.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("arp_hwsrc")))
    info = F.format_string(
        "[ALERT] ARP-SPOOFING / POISONING Detected IP=%s old_mac=%s new_mac=%s conflicts=2 priority=HIGH",
        "arp_psrc",
        "previous",
        "arp_hwsrc",
    )
    return _alerts(changed, info)


def arp_gratuitous(packets: DataFrame) -> DataFrame:
    replies = packets.where("arp_op = 2 and arp_psrc = arp_pdst")
    info = F.format_string(
        "[ALERT] Suspicious Gratuitous ARP Detected IP=%s MAC=%s priority=MEDIUM", "arp_psrc", "arp_hwsrc"
    )
    return _alerts(replies, info)


def detect_arp(packets: DataFrame, window: int = ARP_WINDOW, threshold: int = ARP_FLOOD) -> DataFrame:
    return union_all([arp_flood(packets, window, threshold), arp_takeover(packets), arp_gratuitous(packets)])
