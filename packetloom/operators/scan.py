"""Per-key state machines over an event stream, for detectors that reset their own state.

A program is a small object: ``columns`` (what it reads, event time in microseconds first),
``initial()`` (a JSON-able state), ``step(state, row)`` and ``finish(state)`` (lists of output
tuples). The same program runs here in batch and in ``packetloom.streaming`` per micro-batch.

Batch rows are shuffled by key, sorted, and streamed through the program: a task holds one Arrow
batch and one key's state. A key with more than ``segment_rows`` rows is cut into segments along
time instead. All segments run at once, each from a guessed entry state; segments whose guess
differs from what their predecessor left behind run again, until every guess is right. State that
fades with time makes the guess right almost everywhere after the second round.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from packetloom.functions.timecols import cell_of, to_us
from packetloom.operators.durable import checkpointed
from packetloom.operators.sliding import null_safe_join

SEGMENT_ROWS = 2_000_000


def dump_state(state) -> str:
    return json.dumps(state, sort_keys=True, separators=(",", ":"))


def keyed_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    program,
    out_schema: T.StructType,
    *,
    segment_rows: int = SEGMENT_ROWS,
    slice_seconds: float = 1.0,
) -> DataFrame:
    """Rows the program emits, as ``keys`` followed by ``out_schema``. ``order[0]`` is in microseconds."""
    wanted = list(dict.fromkeys([*keys, *order, *program.columns]))
    rows = df.select(*wanted).persist(StorageLevel.MEMORY_AND_DISK)
    result_schema = T.StructType([rows.schema[k] for k in keys] + list(out_schema.fields))
    long_keys = (
        rows.groupBy(*keys).agg(F.count("*").alias("__size")).where(F.col("__size") > segment_rows).drop("__size")
    )
    if not keys:
        long_keys = long_keys.select(F.lit(1).alias("__any"))
    if long_keys.isEmpty():
        return _stream_keys(rows, keys, order, program, result_schema)
    if not keys:
        return _relay_segments(rows, keys, order, program, out_schema, segment_rows, slice_seconds)
    short = _stream_keys(null_safe_join(rows, long_keys, keys, "left_anti"), keys, order, program, result_schema)
    hot = null_safe_join(rows, long_keys, keys, "left_semi")
    return short.unionByName(_relay_segments(hot, keys, order, program, out_schema, segment_rows, slice_seconds))


#: Keys of up to so many rows are folded in place, and lists of longer keys are broadcast up to this length.
FOLDED = 128
BROADCAST_KEYS = 10_000


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def fold_or_scan(df: DataFrame, keys: list[str], order: list[str], program, out_schema: T.StructType, fold=None, *, batched=None, **options) -> DataFrame:
    """As ``keyed_scan``, where ``fold`` says the same as ``program`` in one column expression over a key's rows in order.

    ``fold`` takes an array of (``order``, other columns of the program) and returns an array of rows of ``out_schema``. Keys of up to
    ``FOLDED`` rows are gathered and folded without Python; a count finds the longer ones, which go to the state machine.
    ``batched`` does so for the keys of an Arrow batch at once instead: from (bounds of the keys' rows, columns of the rows) it makes
    (number of the key, rows of ``out_schema`` as a record batch).
    """
    read = list(dict.fromkeys([*order, *program.columns]))
    rows = df.select(*keys, *read).persist(StorageLevel.MEMORY_AND_DISK)
    long_keys = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > FOLDED).drop("__n")
    many = long_keys.limit(BROADCAST_KEYS + 1).count()
    listed = F.broadcast(long_keys) if many <= BROADCAST_KEYS else long_keys
    short = null_safe_join(rows, listed, keys, "left_anti") if many else rows
    gathered = short.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*read))).alias("__rows"))
    if batched:
        out = _fold_batches(gathered, keys, out_schema, batched)
    else:
        out = gathered.select(*keys, F.explode(fold(F.col("__rows"))).alias("__out")).select(*keys, "__out.*")
        out = out.select(*keys, *[F.col(f.name).cast(f.dataType) for f in out_schema])
    if not many:
        return out
    return out.unionByName(keyed_scan(null_safe_join(rows, listed, keys, "left_semi"), keys, order, program, out_schema, **options))


def _fold_batches(gathered: DataFrame, keys: list[str], out_schema: T.StructType, batched) -> DataFrame:
    schema = T.StructType([gathered.schema[k] for k in keys] + list(out_schema.fields))
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            lists = batch.column("__rows")
            rows = lists.flatten()
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            of, out = batched(bounds, dict(zip(rows.type.names, rows.flatten(), strict=True)))
            heads = [batch.column(k).take(pa.array(of)) for k in keys]
            yield pa.RecordBatch.from_arrays([*heads, *out.columns], names=names)

    return gathered.mapInArrow(run, schema)


def _stream_keys(rows: DataFrame, keys, order, program, result_schema) -> DataFrame:
    names = result_schema.fieldNames()
    n_keys, read = len(keys), [rows.columns.index(c) for c in program.columns]
    key_at = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, started = None, None, False
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                here = tuple(row[i] for i in key_at)
                if not started or here != key:
                    if started:
                        out += [key + tuple(o) for o in program.finish(state)]
                    key, state, started = here, program.initial(), True
                out += [key + tuple(o) for o in program.step(state, tuple(row[i] for i in read))]
            yield pd.DataFrame(out, columns=names)
        if started:
            yield pd.DataFrame([key + tuple(o) for o in program.finish(state)], columns=names)

    placed = rows.repartition(*keys) if n_keys else rows.repartition(1)
    return placed.sortWithinPartitions(*keys, *order).mapInPandas(run, result_schema)


def _relay_segments(rows, keys, order, program, out_schema, segment_rows, slice_seconds) -> DataFrame:
    sliced = rows.withColumn("__slice", cell_of(order[0], to_us(slice_seconds)))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.count("*").alias("__size"))
        .withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .select(*keys, "__slice", F.floor(F.col("__before") / segment_rows).alias("__seg"))
    )
    placed = null_safe_join(sliced, segments, [*keys, "__slice"]).drop("__slice")
    fresh = dump_state(program.initial())
    at = [*keys, "__seg"]
    key_fields = [placed.schema[k] for k in keys]
    run_schema = T.StructType(
        key_fields
        + [T.StructField("__seg", T.LongType()), T.StructField("__entry", T.StringType()), T.StructField("__exit", T.StringType())]
        + list(out_schema.fields)
    )
    names, read, out_width = run_schema.fieldNames(), list(program.columns), len(out_schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = tuple(pdf[c].iloc[0] for c in at)
        entry = pdf["__entry"].iloc[0]
        state, out = json.loads(entry), []
        for row in pdf.sort_values(order)[read].itertuples(index=False, name=None):
            out += program.step(state, row)
        done = [head + (entry, None) + tuple(o) for o in out]
        done.append(head + (entry, dump_state(state)) + (None,) * out_width)
        return pd.DataFrame(done, columns=names)

    todo = placed.select(*at).distinct().withColumn("__entry", F.lit(fresh))
    latest, outputs, round_no = None, [], 0
    while True:
        ran = checkpointed(null_safe_join(placed, todo, at).groupBy(*at).applyInPandas(run, run_schema))
        ran = ran.withColumn("__round", F.lit(round_no))
        outputs.append(ran.where(F.col("__exit").isNull()))
        ends = ran.where(F.col("__exit").isNotNull()).select(*at, "__entry", "__exit", "__round")
        kept = ends if latest is None else null_safe_join(latest, ends, at, "left_anti").unionByName(ends)
        latest = checkpointed(kept)
        in_order = Window.partitionBy(*keys).orderBy("__seg")
        todo = (
            latest.withColumn("__want", F.lag("__exit").over(in_order))
            .where(F.col("__want") != F.col("__entry"))
            .select(*at, F.col("__want").alias("__entry"))
        )
        if todo.isEmpty():
            break
        round_no += 1
    emitted = outputs[0]
    for more in outputs[1:]:
        emitted = emitted.unionByName(more)
    emitted = null_safe_join(emitted, latest.select(*at, "__round"), [*at, "__round"], "left_semi")
    last_state = latest.groupBy(*keys).agg(F.max_by("__exit", "__seg").alias("__exit"))
    result_schema = T.StructType(key_fields + list(out_schema.fields))

    def finish(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                out += [tuple(row[:-1]) + tuple(o) for o in program.finish(json.loads(row[-1]))]
            yield pd.DataFrame(out, columns=result_schema.fieldNames())

    tail = last_state.select(*keys, "__exit").mapInPandas(finish, result_schema)
    return emitted.select(*result_schema.fieldNames()).unionByName(tail)
