"""Alert sinks, the alert log format, and evidence kept with an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions.timecols import cell_of, micros, to_us
from packetloom.operators.sliding import cell_of_expr, default_slice

# Fixed value: one line of the alert log.
LOG_PATTERN = r"^\[ALERT\] (.*) \(SID:([0-9]+)\) (\S+) -> (\S+)$"


def log_line() -> Column:
    return F.format_string("[ALERT] %s (SID:%d) %s -> %s", "info", "sid", "src", "dst")


def log_lines(alerts: DataFrame) -> DataFrame:
    return alerts.select(log_line().alias("value"))


def write_alert_log(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Text lines in one folder per day."""
    lines = alerts.select(F.to_date("ts").alias("date"), log_line().alias("value"))
    lines.write.mode(mode).partitionBy("date").text(path)


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    alerts.withColumn("date", F.to_date("ts")).write.mode(mode).partitionBy("date").parquet(path)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Alerts from lines of the alert log; other lines are left out."""

    def part(i: int):
        return F.regexp_extract("value", LOG_PATTERN, i)

    return lines.where(F.col("value").rlike(LOG_PATTERN)).select(
        part(1).alias("info"), part(2).cast("int").alias("sid"), part(3).alias("src"), part(4).alias("dst")
    )


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def evidence(alerts: DataFrame, packets: DataFrame, *, per_alert: int = 8, within_seconds: int = 10) -> DataFrame:
    """The first packets of the alert's source in the seconds up to the alert.

    Packets and the starts of the alerts' windows are shuffled once, on (source, time slice), and read backwards in time: what
    an alert asks for are the ``per_alert`` packets read last before its start. A packet is also copied into the slice in which a
    window that holds it may start. So a flood's alerts and packets are never paired, and neither is a row made for a packet that
    an alert might ask for.
    """
    window, width = to_us(within_seconds), to_us(default_slice(within_seconds))
    us = F.col("__us")
    seen = packets.where(F.col("src_ip").isNotNull() & F.col("ts").isNotNull()).withColumn("__us", micros(packets, "ts")).select(
        "src_ip", "__us", F.explode(F.sequence(cell_of_expr(us - window, width), cell_of("__us", width))).alias("__slice"),
        F.col("packet_id").alias("__id"), F.struct("packet_id", "ts", "dst_ip").alias("__packet"),
    )
    asked = alerts.select(F.col("packet_id").alias("alert_id"), "sid", F.col("ts").cast(packets.schema["ts"].dataType).alias("alert_ts"), F.col("src").alias("src_ip"))
    asked = asked.where(F.col("src_ip").isNotNull()).withColumn("__us", micros(asked, "alert_ts") - window).where("__us is not null")
    both = seen.unionByName(asked.withColumn("__slice", cell_of("__us", width)), allowMissingColumns=True)
    # at one instant packets are read before starts, as they lie inside the window
    back = "OVER (PARTITION BY src_ip, __slice ORDER BY __us DESC, __packet IS NULL, __id DESC)"
    nearest = F.array(*[F.expr(f"lag(__packet, {k}) IGNORE NULLS {back}") for k in range(1, per_alert + 1)])
    placed = both.withColumn("__found", nearest).where("__packet is null")
    inside = F.filter("__found", lambda p: p["ts"] <= F.col("alert_ts"))
    kept = placed.select("alert_id", "sid", "src_ip", F.posexplode(inside).alias("__at", "__p"))
    return kept.select("alert_id", "sid", (F.col("__at") + 1).alias("position"), "__p.packet_id", "__p.ts", "src_ip", "__p.dst_ip")


def write_evidence(alerts: DataFrame, packets: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Evidence as a table in one folder per alert's signature and day."""
    rows = evidence(alerts, packets, **options).withColumn("date", F.to_date("ts"))
    rows.write.mode(mode).partitionBy("sid", "date").parquet(path)
