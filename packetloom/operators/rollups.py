"""Counters, rates, listings and filters over the packet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions import net
from packetloom.functions.labels import THREAT_LEVELS, threat_rank
from packetloom.functions.text import hms
from packetloom.functions.timecols import SECOND, cell_of, from_micros, is_ntz, micros
from packetloom.operators import numbering

# The counted protocol labels and the keywords of the display filter.
PROTOCOL_BUCKETS = ["TCP", "UDP", "ICMP", "ARP", "HTTP", "DNS", "TLS", "SSH", "FTP", "SMTP", "OTHER"]
FILTER_PROTOCOLS = ["tcp", "udp", "icmp", "http", "dns"]
FILTER_TEXT_PATTERN = r"""^[\w\s.*:!\[\]\-><"'/]+$"""


def labelled(packets: DataFrame) -> DataFrame:
    label = net.protocol_label(
        F.col("arp_op").isNotNull(), net.is_tcp(), net.is_udp(), net.is_icmp(), F.col("src_port"), F.col("dst_port")
    )
    return packets.withColumn("proto", label)


# ---------------------------------------------------------------- listings and filters


def latest(df: DataFrame, k: int, by: str = "packet_id") -> DataFrame:
    return df.orderBy(F.col(by).desc()).limit(k)


def sort_packets(packets: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return packets.orderBy(key, F.col("packet_id"))


def numbered(report: DataFrame, column: str, ascending: bool = True, name: str = "rank") -> DataFrame:
    """Row numbers by ``column``, then packet id, over any number of rows."""
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return numbering.numbered(report, [key, F.col("packet_id").asc()], name)


def display_filter(typed: str) -> Column:
    """Filter of the packet list: text anywhere, ``port n``, or a keyword."""
    wanted = typed.lower()
    if not wanted:
        return F.lit(True)

    def holds(value: Column, part: str = wanted) -> Column:
        return F.coalesce(F.contains(value, F.lit(part)), F.lit(False))

    test = (
        holds(F.col("src_ip"))
        | holds(F.col("dst_ip"))
        | holds(F.lower("proto"))
        | holds(F.lower("info"))
        | holds(F.col("packet_id").cast("string"))
        | holds(F.lower("threat"))
    )
    if wanted.startswith("port "):
        number = wanted[5:]
        test = test | holds(F.coalesce(F.col("src_port").cast("string"), F.lit("")), number)
        test = test | holds(F.coalesce(F.col("dst_port").cast("string"), F.lit("")), number)
    if wanted in FILTER_PROTOCOLS:
        test = test | (F.col("proto") == wanted.upper())
    if wanted == "alert":
        test = test | F.col("is_alert")
    if wanted == "critical":
        test = test | (F.col("threat") == "CRITICAL")
    return test


def is_valid_filter(typed: Column) -> Column:
    return typed.rlike(FILTER_TEXT_PATTERN)


# ---------------------------------------------------------------- counters


def protocol_counts(packets: DataFrame) -> DataFrame:
    """Packets per label; every bucket appears and unknown labels count as OTHER."""
    bucket = F.when(F.col("proto").isin(PROTOCOL_BUCKETS), F.col("proto")).otherwise("OTHER")
    counts = packets.groupBy(bucket.alias("proto")).agg(F.count("*").alias("packets"))
    all_buckets = packets.sparkSession.createDataFrame([(p,) for p in PROTOCOL_BUCKETS], "proto string")
    return all_buckets.join(counts, "proto", "left").select("proto", F.coalesce("packets", F.lit(0)).alias("packets"))


def total_bytes(packets: DataFrame) -> DataFrame:
    return packets.agg(F.sum("length").alias("total_bytes"), F.count("*").alias("packets"))


def threat_counts(packets: DataFrame) -> DataFrame:
    counts = packets.groupBy("threat").agg(F.count("*").alias("packets"))
    levels = packets.sparkSession.createDataFrame([(t,) for t in THREAT_LEVELS], "threat string")
    return levels.join(counts, "threat", "left").select("threat", F.coalesce("packets", F.lit(0)).alias("packets"))


def capture_status(packets: DataFrame, is_alert: Column, active_detectors: int, ts: str = "ts") -> DataFrame:
    return (
        packets.withColumn("__us", micros(packets, ts))
        .agg(
            F.count("*").alias("packets"),
            F.count_if(is_alert).alias("alerts"),
            F.lit(active_detectors).alias("active_detectors"),
            F.floor((F.max("__us") - F.min("__us")) / SECOND).alias("__s"),
        )
        .withColumn("uptime", hms(F.col("__s")))
        .drop("__s")
    )


# ---------------------------------------------------------------- rates


def traffic_rate(packets: DataFrame, ts: str = "ts") -> DataFrame:
    """Packets and bytes of every second of the capture, quiet seconds included, with a running total.

    The packets shrink to one row per second before anything is ordered; the running total carries
    hourly sums, so its ordered part is the seconds of one hour.
    """
    ntz = is_ntz(packets, ts)
    per_second = (
        packets.withColumn("__us", micros(packets, ts))
        .groupBy(cell_of("__us", SECOND).alias("sec"))
        .agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    )
    span = per_second.agg(F.min("sec").alias("lo"), F.max("sec").alias("hi")).where("lo is not null")
    # seconds by hours: a stray time stamp stretches the result, but no row holds more than an hour
    first, last = F.floor(F.col("lo") / 3600), F.floor(F.col("hi") / 3600)
    grid = span.select("lo", "hi", F.explode(F.sequence(first, last)).alias("h")).repartition("h")
    grid = grid.select(F.explode(F.sequence(F.greatest("lo", F.col("h") * 3600), F.least("hi", F.col("h") * 3600 + 3599))).alias("sec"))
    filled = grid.join(per_second, "sec", "left").select(
        "sec",
        F.floor(F.col("sec") / 3600).alias("hour"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )
    hours = filled.groupBy("hour").agg(F.sum("n").alias("in_hour"))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carry = hours.select("hour", F.coalesce(F.sum("in_hour").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("hour").orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = filled.join(carry, "hour").withColumn("total", F.sum("n").over(inside) + F.col("carry"))
    return totals.withColumn("__at", F.col("sec") * SECOND).select(
        from_micros("__at", ntz).alias("second"),
        F.round(F.col("n") / 1.0, 1).alias("pps"),
        F.col("bytes").alias("bps"),
        "total",
    )


def mean_rate(rates: DataFrame, points: int = 5) -> DataFrame:
    """Mean byte rate of each second and the ``points - 1`` before it.

    Seconds are spread to the points they enter, then averaged by point: no global order.
    """
    step = F.expr("INTERVAL '1' SECOND")
    seconds = rates.select("second", "bps")
    spread = seconds.select(
        F.explode(F.sequence("second", F.col("second") + (points - 1) * step, step)).alias("second"), "bps"
    )
    means = spread.groupBy("second").agg(F.floor(F.avg("bps") + 0.5).alias("mean_bps"))
    return rates.join(means, "second")


# ---------------------------------------------------------------- positions


def _carry(ids: DataFrame, group: int = 10_000) -> DataFrame:
    """(``__b``, ``__carry``): rows in earlier blocks. Sums go over groups of blocks first, so the ordered part is a group."""
    blocks = ids.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__g", F.floor(F.col("__b") / group))
    earlier = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("__g").agg(F.sum("__n").alias("__t")).select("__g", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(tops, "__g").select("__b", (F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias("__carry"))


# ---------------------------------------------------------------- dominant source


def dominant_source(packets: DataFrame, *, window: int = 100, floor: int = 60, share: float = 0.6) -> DataFrame:
    """Sources of the last ``window`` packets and whether one of them dominates."""
    recent = latest(packets.select("packet_id", "src_ip"), window)
    counts = recent.groupBy("src_ip").agg(F.count("*").alias("n"))
    total = recent.agg(F.count("*").alias("total"))
    out = counts.crossJoin(F.broadcast(total))
    limit = F.greatest(F.lit(floor), F.floor(F.col("total") * share).cast("int"))
    return out.withColumn("dominant", F.col("n") > limit)


def dominant_source_running(
    packets: DataFrame, *, window: int = 100, floor: int = 60, share: float = 0.6, block: int = 100_000
) -> DataFrame:
    """Packets whose source holds more than ``max(floor, share)`` of the ``window`` packets ending there.

    Arrival order is ``packet_id``. Positions come from per-block counts; each block then sees the
    last ``window - 1`` packets of the block before it, so blocks are independent.
    """
    ids = packets.select("packet_id", "ts", "src_ip").withColumn("__b", F.floor(F.col("packet_id") / block))
    carry = _carry(ids)
    inside = Window.partitionBy("__b").orderBy("packet_id")
    placed = ids.withColumn("__row", F.row_number().over(inside)).join(carry, "__b")
    placed = placed.withColumn("pos", F.col("__row") + F.col("__carry"))
    home = F.floor((F.col("pos") - 1) / block)
    reach = F.floor((F.col("pos") + window - 2) / block)
    copies = placed.withColumn("__c", F.explode(F.sequence(home, reach))).withColumn("__own", F.col("__c") == home)
    seen = Window.partitionBy("__c", "src_ip").orderBy("pos").rangeBetween(1 - window, Window.currentRow)
    counted = copies.withColumn("n", F.count("*").over(seen)).where("__own")
    size = F.least(F.lit(window), F.col("pos"))
    limit = F.greatest(F.lit(floor), F.floor(size * share).cast("int"))
    return counted.where(F.col("n") > limit).select("packet_id", "ts", "src_ip", "n")


def dominant_source_alerts(running: DataFrame) -> DataFrame:
    return running.select(
        "ts",
        F.lit("DoS Attack").alias("type"),
        F.lit("CRITICAL").alias("threat"),
        F.col("src_ip").alias("src"),
        F.lit("multiple").alias("dst"),
        "packet_id",
        "n",
    )


def overall_level(alerts: DataFrame, *, last: int = 30, order: str = "packet_id", block: int = 100_000) -> DataFrame:
    """Worst threat of each alert and the ``last - 1`` before it, by position in the feed."""
    ids = alerts.withColumn("__b", F.floor(F.col(order) / block))
    carry = _carry(ids)
    placed = ids.withColumn("__row", F.row_number().over(Window.partitionBy("__b").orderBy(order))).join(carry, "__b")
    placed = placed.withColumn("__pos", F.col("__row") + F.col("__carry"))
    home = F.floor((F.col("__pos") - 1) / block)
    reach = F.floor((F.col("__pos") + last - 2) / block)
    copies = placed.withColumn("__c", F.explode(F.sequence(home, reach))).withColumn("__own", F.col("__c") == home)
    frame = Window.partitionBy("__c").orderBy("__pos").rangeBetween(1 - last, Window.currentRow)
    worst = F.max(threat_rank(F.col("threat"))).over(frame)
    levels = F.array(*[F.lit(t) for t in THREAT_LEVELS])
    out = copies.withColumn("level", F.get(levels, (worst - 1).cast("int"))).where("__own")
    return out.drop("__b", "__row", "__carry", "__pos", "__c", "__own")
