"""Streams over landed packet files: rates, stateful detections, sinks.

Event time drives everything. Rows later than the watermark are dropped by Spark and counted in the
query's progress. A stopped query resumes from its checkpoint; a new checkpoint starts from nothing.
State machines see rows in event order, as in batch: rows wait until the watermark has passed them. A stream over input that
has ended is closed: a mark far beyond the last row moves the watermark over all that still waits.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from itertools import accumulate
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators.durable import fresh
from packetloom.operators.scan import dump_state
from packetloom.schema import PACKETS

WATERMARK = "1 minute"


def packet_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PACKETS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


#: Folders of closing marks carry this name, by which ``close`` finds them among a query's sources.
_MARKS = "closing-marks"
#: A closing mark lies so far behind the last row that every window and time limit has ended before it.
_BEYOND = timedelta(days=36525)


def with_event_time(packets: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """``packets`` with a watermark. Watermarks need TIMESTAMP; a zone-free time is read in the session zone.

    A stream also reads a folder of closing marks of its own, which stays empty until :func:`close` writes one. A mark counts for
    the watermark and goes no further. Rows without a time go, as no watermark ever passes them.
    """
    timed = packets.withColumn("ts", F.col("ts").cast("timestamp"))
    if not packets.isStreaming:
        return timed.withWatermark("ts", delay)
    spark = packets.sparkSession
    folder, kind = fresh(spark, _MARKS), T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("__mark", T.TimestampType())])
    spark.createDataFrame([], kind).write.parquet(folder)  # a source's folder has to exist
    marks = spark.readStream.schema(kind).parquet(folder)
    both = timed.withColumn("__mark", F.lit(None).cast("timestamp")).unionByName(marks, allowMissingColumns=True)
    # one comparison with the event time, so that it can't move below the watermark
    return both.withWatermark("ts", delay).where(~F.col("ts").eqNullSafe(F.col("__mark"))).drop("__mark")


# ---------------------------------------------------------------- declarative


def second_rates(packets: DataFrame, delay: str = WATERMARK) -> DataFrame:
    timed = with_event_time(packets, delay)
    counts = timed.groupBy(F.window("ts", "1 second")).agg(F.count("*").alias("pps"), F.sum("length").alias("bps"))
    return counts.select(F.col("window.start").alias("second"), "pps", "bps")


def hopping_counts(
    packets: DataFrame, keys: list[str], window: str, slide: str, threshold: int, distinct: str | None = None, delay: str = WATERMARK
) -> DataFrame:
    """Cheap approximation of the per-packet windows: counts over hopping windows."""
    timed = with_event_time(packets, delay)
    measure = F.approx_count_distinct(distinct) if distinct else F.count("*")
    counts = timed.groupBy(F.window("ts", window, slide), *keys).agg(measure.alias("n"))
    return counts.where(F.col("n") >= threshold).select(F.col("window.end").alias("ts"), *keys, "n")


def first_within_watermark(alerts: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Cheap approximation of suppression: one row per key within the watermark delay."""
    return with_event_time(alerts, delay).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- state machines


def pack_state(kept: list[tuple]) -> bytes:
    """The states of a group: waiting rows as columns, whole numbers as steps, compressed.

    Spark sends a group's state along with every Arrow batch of its rows, so a busy key's state has to be small.
    """

    def column(values: tuple) -> list:
        if not all(type(v) is int for v in values):
            return [0, list(values)]
        return [1, [values[0], *[b - a for a, b in zip(values, values[1:])]]]

    slim = [(key, {**whole, "wait": [column(c) for c in zip(*whole["wait"], strict=True)]}) for key, whole in kept]
    return zlib.compress(dump_state(slim).encode(), 1)


def unpack_state(packed: bytes) -> list[tuple]:
    """What :func:`pack_state` was given, with lists for tuples."""
    kept = json.loads(zlib.decompress(packed))
    for _, whole in kept:
        columns = [accumulate(values) if steps else values for steps, values in whole["wait"]]
        whole["wait"] = [list(row) for row in zip(*columns, strict=True)]
    return kept


def stream_scan(
    packets: DataFrame,
    keys: list[str],
    program,
    out_schema: T.StructType,
    *,
    delay: str = WATERMARK,
    ttl_seconds: float | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """The streaming form of ``keyed_scan``: the same program over the same order, so the same rows come out.

    A row waits in its key's state until the watermark has passed it; then rows are stepped by (time, packet id).
    Programs with a time limit (``due``) are called when the watermark passes it, without waiting for a packet. State
    goes once the watermark is ``ttl_seconds`` behind the key's last row (default: the time after which the program
    has forgotten all, its ``memory``; a program without one keeps its state), and what it still has to say is emitted.
    The state is the program's own plus the rows of the watermark's delay.

    A call of the state machine costs far more than a row. Where keys are many, short and soon over, as datagrams are, ``buckets`` keeps
    so many states for all keys instead of one for each; a state is read and written as a whole, so keys that stay should have their own.
    """
    timed = with_event_time(packets, delay).withColumn("us", F.unix_micros("ts"))
    rows = timed.select(*dict.fromkeys([*keys, "us", "packet_id", *program.columns]), "ts")
    schema = T.StructType([rows.schema[k] for k in keys] + list(out_schema.fields))
    names, read = schema.fieldNames(), list(dict.fromkeys(["us", "packet_id", *program.columns]))
    taken = itemgetter(*[read.index(c) for c in program.columns])  # programs read two columns at least
    memory = round(ttl_seconds * 1_000_000) if ttl_seconds else getattr(program, "memory", None)

    def turn(key: tuple, whole: dict, mark: int) -> tuple[list[tuple], bool, int | None]:
        """Step what the watermark has passed: what comes out, whether the key is done, and when it wants to be called again."""
        state, waiting, out, at = whole["of"], whole["wait"], [], 0
        waiting.sort(key=itemgetter(0, 1))
        while at < len(waiting) and waiting[at][0] <= mark:
            out += program.step(state, taken(waiting[at]))
            whole["last"] = waiting[at][0]
            at += 1
        whole["wait"] = waiting = waiting[at:]
        due = program.due(state) if hasattr(program, "due") else None
        if due is not None and due < mark and not (waiting and waiting[0][0] <= due):
            out += program.finish(state)
            whole["of"], due = program.initial(), None
        ends = whole["last"] + memory if memory is not None and whole["last"] is not None else None
        over = not waiting and due is None and ends is not None and ends < mark
        if over:
            out += program.finish(state)
        times = [t for t in (waiting[0][0] - 1 if waiting else None, due, ends if not waiting else None) if t is not None]
        return [key + tuple(o) for o in out], over, min(times, default=None)

    width = len(keys) if buckets else 0

    def run(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        # Plain Python values: the state must survive a round trip through JSON.
        kept = unpack_state(held.get[0]) if held.exists else []
        wholes = {tuple(key): whole for key, whole in kept}
        for batch in batches:
            for row in zip(*[batch[c].astype(object).where(batch[c].notna(), None).tolist() if c in keys else batch[c].tolist() for c in [*keys[:width], *read]], strict=True):
                key = tuple(row[:width])
                if key not in wholes:
                    wholes[key] = {"of": program.initial(), "wait": [], "last": None}
                wholes[key]["wait"].append(list(row[width:]))
        mark, out, left, times = max(held.getCurrentWatermarkMs(), 0) * 1000, [], [], []
        for key, whole in wholes.items():
            emitted, over, again = turn(key if width else tuple(group), whole, mark)
            out += emitted
            if not over:
                left.append((key, whole))
                times += [] if again is None else [again]
        if left:
            held.update((pack_state(left),))
            if times:
                held.setTimeoutTimestamp(max(min(times) // 1000, held.getCurrentWatermarkMs() + 1))
        else:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    grouped = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("__bucket") if buckets else rows.groupBy(*keys)
    return grouped.applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- running


def to_parquet(stream: DataFrame, path: str, checkpoint: str, *, once: bool = False, seconds: int = 5) -> StreamingQuery:
    """Append to a parquet folder through the exactly-once file sink."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def to_sinks(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False, seconds: int = 5) -> StreamingQuery:
    """Hand every micro-batch to ``write``, for example to feed the alert table and the log at once (see ``streaming.sinks``)."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def close(query: StreamingQuery) -> bool:
    """Write a closing mark for a query that has run (or runs), far behind its last row; False if it has no marks or saw no rows."""
    spark, last, folders = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active(), None, set()
    for progress in query.recentProgress:
        for source in progress["sources"]:
            if _MARKS in source["description"]:
                folders.add(source["description"].split("[", 1)[1].rstrip("]"))
        for name in ("max", "watermark"):
            at = (progress.get("eventTime") or {}).get(name)
            if at:
                at = datetime.fromisoformat(at.replace("Z", "+00:00"))
                last = at if last is None else max(last, at)
    if last is None or not folders:
        return False
    mark = spark.range(1).select(F.timestamp_micros(F.lit(round((last + _BEYOND).timestamp() * 1_000_000))).alias("ts"))
    for folder in folders:
        mark.withColumn("__mark", F.col("ts")).coalesce(1).write.mode("append").parquet(folder)
    return True


def _finished(query: StreamingQuery, timeout: float | None) -> StreamingQuery:
    if not (query.awaitTermination(timeout) if timeout else query.awaitTermination() or True):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout} s")
    return query


def run_available(stream: DataFrame, folder: str, timeout: float | None = None) -> StreamingQuery:
    """Process all input that is there now; rows that the watermark has not passed wait in the checkpoint below ``folder`` for the next run."""
    return _finished(to_parquet(stream, f"{folder}/out", f"{folder}/checkpoint", once=True), timeout)


def run_to_end(stream: DataFrame, folder: str, timeout: float | None = None) -> DataFrame:
    """Process all input that is there now, the last of it, and return all that was written.

    After the input the stream is closed and run once more from its checkpoint, so that what was waiting for the watermark comes
    out as well: the rows of the batch form. An earlier run below ``folder`` is resumed. ``timeout`` (seconds) stops a run that takes longer.
    """
    if close(run_available(stream, folder, timeout)):
        run_available(stream, folder, timeout)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_sinks(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, timeout: float | None = None) -> None:
    """As ``run_to_end``, with every micro-batch handed to ``write``."""
    if close(_finished(to_sinks(stream, write, checkpoint, once=True), timeout)):
        _finished(to_sinks(stream, write, checkpoint, once=True), timeout)
