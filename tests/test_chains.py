import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators import chains
from packetloom.operators.chains import cooldown, greedy_chain

S = 1_000_000


def brute(rows, seconds, strict):
    kept, last = set(), {}
    for i, us, k in sorted(rows, key=lambda r: (r[1], r[0])):
        gap = us - last[k] if k in last else None
        if gap is None or gap > seconds * S or (not strict and gap == seconds * S):
            kept.add(i)
            last[k] = us
    return kept


def frame(spark, rows):
    return spark.createDataFrame(rows, "packet_id long, us long, k string").withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize("strict", [True, False])
def test_boundaries(spark, strict):
    rows = [(i, t * S, "a") for i, t in enumerate([0, 10, 30, 31, 61, 62])]
    got = {r.packet_id for r in cooldown(frame(spark, rows), ["k"], 30, strict=strict).collect()}
    assert got == ({0, 3, 5} if strict else {0, 2, 4})


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("fold_limit", [0, 100, 10_000])
def test_equals_brute_force_on_both_paths(spark, strict, fold_limit):
    rng = random.Random(7)
    rows = [(i, rng.randrange(8000) * S // 4, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}") for i in range(600)]
    out = cooldown(frame(spark, rows), ["k"], 3, strict=strict, fold_limit=fold_limit)
    assert out.columns == ["packet_id", "us", "k", "ts"]
    got = [r.packet_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, strict)


@pytest.mark.parametrize("fold_limit", [0, 10_000])
def test_two_axes(spark, fold_limit):
    rng = random.Random(9)
    times = sorted(rng.randrange(4000) for _ in range(300))
    rows = [(i, t * S, i + 1) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "packet_id long, __pos long, __pos2 long").withColumn("k", F.lit("a"))
    got = {r.packet_id for r in greedy_chain(df, ["k"], 60 * S, gap2=7, fold_limit=fold_limit).collect()}
    want, last = set(), None
    for i, us, rank in rows:
        if last is None or (us - last[0] >= 60 * S and rank - last[1] >= 7):
            want.add(i)
            last = (us, rank)
    assert got == want


def test_tables_of_blocks_hold_what_can_be_entered(spark):
    """A block of packets one place apart is entered at its first rows only; the chain over such blocks stays the same."""
    width = 25 * chains.CELLS_PER_BLOCK
    block = pd.DataFrame({"k": 0, "__block": 3, "__pos": range(3 * width, 4 * width), "__pos2": 0, "packet_id": range(width)})
    assert len(chains._block_table(block, ["k"], 25, 0, "packet_id")) <= 25
    own = random.Random(4)
    for gaps in ([1], [1, 2, 40], [1, 1, 1, 1, 5000]):
        pos, at = [], 0
        for _ in range(6000):
            at += own.choice(gaps)
            pos.append(at)
        want, last = [], None
        for i, p in enumerate(pos):
            if last is None or p - last >= 25:
                want.append(i)
                last = p
        df = spark.createDataFrame(list(enumerate(pos)), "packet_id long, __pos long")
        got = chains.greedy_chain(df, [], 25, fold_limit=10)
        assert sorted(r.packet_id for r in got.collect()) == want
