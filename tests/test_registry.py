"""Plug-ins: switching, isolation while planning and while running."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators.alerts import as_alerts
from packetloom.plans.registry import Registry, numbered_feed


def packets(spark):
    return spark.range(50).select(F.col("id").alias("packet_id"), F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"))


def every(sid):
    return lambda rows: as_alerts(rows, "Own", F.lit(sid), F.lit("SCAN - seen"), F.col("src_ip"), F.col("dst_ip"), "HIGH")


def failing(rows):
    seen = F.when(F.col("packet_id") == 33, F.raise_error(F.lit("unreadable")).cast("string")).otherwise(F.lit("SCAN - seen"))
    return as_alerts(rows, "Own", F.lit(3), seen, F.col("src_ip"), F.col("dst_ip"), "HIGH")


def registry():
    own = Registry()
    own.register("one", every(1))
    own.register("two", every(2), enabled=False)
    own.register("failing", failing)
    own.register("broken", lambda rows: rows.select("missing"))
    return own


def test_toggle(spark):
    own = registry()
    assert own.enabled() == ["one", "failing", "broken"]  # built-in detectors start disabled
    assert own.toggle("two", True) and own.toggle("one", False) and not own.toggle("unknown", True)
    assert own.enabled() == ["two", "failing", "broken"]
    listed = {r.id: r.enabled for r in own.metadata(spark).collect()}
    assert listed["two"] and not listed["one"] and not listed["DosDetector"] and len(listed) == 13


def test_failures_are_isolated(spark):
    own = registry()
    alerts, errors = own.run_isolated(packets(spark), ["one", "failing", "two", "broken"])
    assert sorted((r["sid"], r["count"]) for r in alerts.groupBy("sid").count().collect()) == [(1, 50), (2, 50)]
    assert sorted(r.detector for r in errors.collect()) == ["broken", "failing"]
    alerts, errors = own.run_shared(packets(spark), ["one", "failing"], isolate=True)
    assert alerts.count() == 50 and [r.detector for r in errors.collect()] == ["failing"]
    with pytest.raises(Exception, match="unreadable"):
        own.run(packets(spark), ["one", "failing"])[0].collect()


def test_feed_numbers_follow_time(spark):
    rows = every(7)(packets(spark)).unionByName(every(5)(packets(spark))).repartition(7)
    got = sorted((r.id, r.packet_id, r.sid) for r in numbered_feed(rows).collect())
    assert got == [(k + 1, k // 2, 5 if k % 2 == 0 else 7) for k in range(100)]
