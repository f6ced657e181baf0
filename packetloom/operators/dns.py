"""DNS tunnelling: long and random names, query rate, name counts, large TXT answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from packetloom.functions import net
from packetloom.functions.text import base_domain, label_entropy
from packetloom.operators.alerts import as_alerts, union_all
from packetloom.operators.chains import cooldown
from packetloom.operators.sliding import cumulative_distinct, sliding_count


@dataclass(frozen=True)
class DnsLimits:
    length: int
    length_high: int
    entropy: float
    entropy_high: float
    rate: int
    subdomains: int
    txt_size: int
    rate_window: float = 10.0


# Limits per sensitivity. The loose entropy lies below the moderate one.
DNS_LIMITS = {
    "strict": DnsLimits(50, 100, 4.0, 4.5, 10, 20, 100),
    "moderate": DnsLimits(80, 150, 3.8, 4.5, 20, 50, 200),
    "loose": DnsLimits(120, 200, 3.5, 4.2, 50, 100, 500),
}
DNS_COOLDOWN = 30.0


def dns_messages(packets: DataFrame) -> DataFrame:
    """DNS packets with the name cleaned and its base domain."""
    port_53 = (F.col("dst_port") == 53) | (F.col("src_port") == 53)
    carried = packets.where(net.is_ip() & (net.is_udp() | net.is_tcp()) & port_53 & F.col("dns_qr").isNotNull())
    name = F.rtrim(F.col("dns_qname"), F.lit("."))
    return carried.select(
        "packet_id",
        "ts",
        F.col("src_ip").alias("src"),
        F.col("dst_ip").alias("dst"),
        "dns_qr",
        "dns_txt_sizes",
        name.alias("qname"),
        base_domain(name).alias("base"),
    )


def dns_hits(packets: DataFrame, limits: DnsLimits) -> DataFrame:
    """Every detection at every packet, before suppression. DNS messages are read once and kept for all of them."""
    messages = dns_messages(packets).persist(StorageLevel.MEMORY_AND_DISK)
    asks = (F.col("dns_qr") == 0) & F.col("qname").isNotNull()
    queries = messages.where(asks).drop("dns_qr", "dns_txt_sizes")
    name, size = F.col("qname"), F.length("qname")
    first = F.substring_index(name, ".", 1)
    entropy = label_entropy(first)
    kept = ["packet_id", "ts", "src", "dst"]

    def entry(sid: int, test, info):
        return F.when(test, F.struct(F.lit(sid).alias("sid"), info.alias("info")))

    long_info = F.when(
        size >= limits.length_high,
        F.format_string("DNS Tunnel: Unusually long domain name (%d chars): %s...", size, F.substring(name, 1, 50)),
    ).otherwise(F.format_string("DNS Tunnel: Long domain name (%d chars): %s", size, F.substring(name, 1, 60)))
    random_info = F.format_string(
        "DNS Tunnel: %s entropy subdomain (entropy=%.2f): %s",
        F.when(F.col("entropy") >= limits.entropy_high, "Very high").otherwise("High"),
        F.col("entropy"),
        first,
    )
    # The tests of a single name share one pass; each alert needs only one row of context.
    per_name = queries.withColumn("entropy", entropy).select(
        *kept,
        F.explode_outer(
            F.array_compact(
                F.array(
                    entry(1000090, size >= limits.length, long_info),
                    entry(1000091, F.col("entropy") >= limits.entropy, random_info),
                    entry(1000097, F.contains(name, F.lit("\x00")), F.lit("DNS Tunnel: Null bytes detected in DNS query")),
                )
            )
        ).alias("hit"),
    )
    singles = per_name.where("hit is not null").select(*kept, "hit.sid", "hit.info")

    paced = sliding_count(queries.select(*kept, "base"), ["src", "base"], limits.rate_window)
    rapid_info = F.format_string(
        f"DNS Tunnel: Rapid repeated queries to %s (%d in {limits.rate_window:g}s)", "base", "n"
    )
    rapid = paced.where(F.col("n") >= limits.rate).select(*kept, F.lit(1000092).alias("sid"), rapid_info.alias("info"))

    spread = cumulative_distinct(queries.select(*kept, "base", "qname"), ["base"], "qname")
    many_info = F.format_string("DNS Tunnel: Many subdomains under %s (%d unique subdomains)", "base", "n_distinct")
    many = spread.where(F.col("n_distinct") >= limits.subdomains).select(
        *kept, F.lit(1000095).alias("sid"), many_info.alias("info")
    )

    large = F.get(F.filter("dns_txt_sizes", lambda s: s >= limits.txt_size), F.lit(0))
    txt_info = F.format_string("DNS Tunnel: Large TXT record response (%d bytes) from %s", "large", "dst")
    answers = messages.where(~F.coalesce(asks, F.lit(False))).withColumn("large", large).where("large is not null")
    txt = answers.select(*kept, F.lit(1000094).alias("sid"), txt_info.alias("info"))
    return union_all([singles, rapid, many, txt])


def detect_dns_tunnel(packets: DataFrame, sensitivity: str = "moderate", limits: DnsLimits | None = None) -> DataFrame:
    hits = dns_hits(packets, limits or DNS_LIMITS[sensitivity])
    kept = cooldown(hits, ["src", "sid"], DNS_COOLDOWN, strict=True)
    return as_alerts(kept, "DNSTunnelDetector", F.col("sid"), F.col("info"), F.col("src"), F.col("dst"))
