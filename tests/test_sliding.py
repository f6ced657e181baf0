import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import sliding

S = 1_000_000


def rows_of(seed, n=300, keys=3, values=6, span=90):
    rng = random.Random(seed)
    # Whole half-seconds give equal instants and exact window edges.
    return [(i, rng.randrange(span * 2) * S // 2, f"k{min(rng.randrange(keys * 2), keys - 1)}", rng.randrange(values)) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "packet_id long, us long, k string, v int")
    return df.withColumn("ts", F.timestamp_micros("us"))


def visible(rows, row, window):
    return [r for r in rows if r[2] == row[2] and row[1] - window * S <= r[1] and (r[1], r[0]) <= (row[1], row[0])]


@pytest.mark.parametrize("slice_seconds", [None, 3.0, 7.0, 1000.0])
def test_windowed_operators_equal_brute_force(spark, slice_seconds):
    rows, w = rows_of(1), 5
    df = frame(spark, rows)
    got = {r.packet_id: r.n for r in sliding.sliding_count(df, ["k"], w, slice_seconds=slice_seconds).collect()}
    assert got == {r[0]: len(visible(rows, r, w)) for r in rows}
    got = {r.packet_id: r.n_distinct for r in sliding.sliding_distinct(df, ["k"], "v", w, slice_seconds=slice_seconds).collect()}
    assert got == {r[0]: len({x[3] for x in visible(rows, r, w)}) for r in rows}
    got = {r.packet_id for r in sliding.reaches_count(df, ["k"], w, 6, slice_seconds=slice_seconds).collect()}
    assert got == {r[0] for r in rows if len(visible(rows, r, w)) >= 6}


def test_only_rows_meeting_where_count(spark):
    rows, w = rows_of(2), 8
    df = frame(spark, rows)
    even = F.col("v") % 2 == 0
    got = {r.packet_id: r.n for r in sliding.sliding_count(df, ["k"], w, where=even).collect()}
    assert got == {r[0]: sum(x[3] % 2 == 0 for x in visible(rows, r, w)) for r in rows}
    got = {r.packet_id: r.n_distinct for r in sliding.sliding_distinct(df, ["k"], "v", w, where=even).collect()}
    assert got == {r[0]: len({x[3] for x in visible(rows, r, w) if x[3] % 2 == 0}) for r in rows}


@pytest.mark.parametrize("slice_seconds", [4.0, 1000.0])
def test_running_operators_equal_brute_force(spark, slice_seconds):
    rows = rows_of(3)
    df = frame(spark, rows)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    total, distinct, prev = {}, {}, {}
    sums, seen, last = {}, {}, {}
    for i, _, k, v in ordered:
        sums[k] = sums.get(k, 0) + v
        seen.setdefault(k, set()).add(v)
        total[i], distinct[i], prev[i] = sums[k], len(seen[k]), last.get(k)
        last[k] = v
    got = {r.packet_id: r.total for r in sliding.running_total(df, ["k"], F.col("v"), slice_seconds=slice_seconds).collect()}
    assert got == total
    got = {r.packet_id: r.n_distinct for r in sliding.cumulative_distinct(df, ["k"], "v", slice_seconds=slice_seconds).collect()}
    assert got == distinct
    got = {r.packet_id: r.previous for r in sliding.previous_value(df, ["k"], "v", slice_seconds=slice_seconds).collect()}
    assert got == prev


def test_window_edges_and_equal_instants(spark):
    w = 10
    rows = [(0, 0, "a", 1), (1, w * S, "a", 1), (2, w * S, "a", 1), (3, w * S + 1, "a", 1)]
    got = {r.packet_id: r.n for r in sliding.sliding_count(frame(spark, rows), ["k"], w).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3}


def test_ntz_and_no_keys(spark):
    rows = rows_of(4, keys=1)
    df = frame(spark, rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.packet_id: r.rank for r in sliding.running_rank(df, [], slice_seconds=5.0).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_one_hot_key_spreads_over_tasks(spark):
    df = frame(spark, rows_of(5, keys=1, span=600))
    sliced = sliding.slice_with_lookback(df, 5, "ts", None)
    assert sliced.select("k", "__slice").distinct().count() > 20
