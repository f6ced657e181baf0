import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from packetloom.operators.scan import keyed_scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT = T.StructType([T.StructField("packet_id", T.LongType()), T.StructField("size", T.LongType())])


class CollectTen:
    """Fires at every tenth distinct value, then forgets."""

    columns = ["us", "packet_id", "v"]

    def initial(self):
        return []

    def step(self, state, row):
        _, packet_id, v = row
        if v not in state:
            state.append(v)
        if len(state) < 10:
            return []
        state.clear()
        return [(packet_id, 10)]

    def finish(self, state):
        return [(-1, len(state))]


@pytest.mark.parametrize("segment_rows", [40, 10**9])
def test_segments_agree_with_one_pass(spark, segment_rows):
    rng = random.Random(3)
    rows = [(i, rng.randrange(10**9), "hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", rng.randrange(14)) for i in range(500)]
    want = []
    for k in {r[2] for r in rows}:
        state, program = [], CollectTen()
        for r in sorted((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0])):
            want += [(k, *o) for o in program.step(state, (r[1], r[0], r[3]))]
        want += [(k, *o) for o in program.finish(state)]
    df = spark.createDataFrame(rows, "packet_id long, us long, k string, v long")
    got = keyed_scan(df, ["k"], ["us", "packet_id"], CollectTen(), OUT, segment_rows=segment_rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
