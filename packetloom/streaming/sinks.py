"""Sinks that a repeated micro-batch leaves as they are: every batch has its own folder, which a repetition replaces."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from packetloom.operators.classify import rated, totals
from packetloom.operators.numbering import numbered
from packetloom.sources.alertlog import log_lines

Write = Callable[[DataFrame, int], None]


def put_batch(rows: DataFrame, folder: str, batch: int) -> DataFrame:
    """Store ``rows`` as the batch's part of the table in ``folder`` and return what was stored."""
    path = f"{folder}/batch={batch}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_batches(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """All batches of a table; ``columns`` declares its columns, so that an empty table can be read too."""
    return spark.read.schema(f"{columns}, batch long").parquet(folder)


def alert_sinks(folder: str) -> Write:
    """For ``to_sinks``: alerts go to a table and to a log below ``folder``, each exactly once.

    The table's part is written first and the log is made from it, so both hold the same rows even where a batch that failed between
    them comes again with its rows computed anew.
    """

    def write(alerts: DataFrame, batch: int) -> None:
        stored = put_batch(alerts, f"{folder}/alerts", batch)
        log_lines(stored).write.mode("overwrite").text(f"{folder}/log/batch={batch}")

    return write


def numbered_sink(folder: str, order: list[str]) -> Write:
    """For ``to_sinks``: rows go to ``folder``/feed with an ``id`` that runs on over the batches by ``order``.

    A batch starts after the rows of the batches with smaller numbers, whose sizes are kept beside the feed, so a repeated
    batch gets the same ids. Streams in event order (state machines, watermarked windows) are numbered in event order on the whole.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark, sizes = rows.sparkSession, f"{folder}/sizes"
        earlier = 0
        if batch:
            earlier = read_batches(spark, sizes, "rows long").where(F.col("batch") < batch).agg(F.sum("rows")).first()[0] or 0
        once = rows.persist(StorageLevel.MEMORY_AND_DISK)  # numbering reads the batch several times, each time through its state machines
        stored = put_batch(numbered(once, order, "id", earlier + 1), f"{folder}/feed", batch)
        put_batch(stored.agg(F.count("*").alias("rows")), sizes, batch)
        once.unpersist()

    return write


def classified_sink(folder: str, predict: Callable[[DataFrame], DataFrame], step: Column | None = None) -> Write:
    """For ``to_sinks``: flows are classified by ``predict`` and stored below ``folder`` with the batch's totals.

    With ``step``, an expression over the classified flows, totals are kept for each of its values, so that progress is as fine as the
    steps while a batch holds as many of them as have landed.
    """

    def write(flows: DataFrame, batch: int) -> None:
        stored = put_batch(predict(flows), f"{folder}/predictions", batch)
        sums = stored.agg(*totals()) if step is None else stored.groupBy(step.alias("step")).agg(*totals())
        put_batch(sums, f"{folder}/totals", batch)

    return write


def classified_progress(spark: SparkSession, folder: str, total_rows: int | None = None) -> DataFrame:
    """The summary after each batch (or step) of a :func:`classified_sink`, over all so far; ``batch`` numbers them from 0."""
    sums = spark.read.parquet(f"{folder}/totals")
    at = "step" if "step" in sums.columns else "batch"
    names = [c for c in sums.columns if c not in ("batch", "step")]
    sums = sums.groupBy(at).agg(*[F.sum(c).alias(c) for c in names])  # a step may lie in several batches
    running = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each batch or step
    number = F.row_number().over(Window.orderBy(at)) - 1 if at == "step" else F.col("batch")
    rows = sums.select(number.alias("batch"), *[F.sum(c).over(running).alias(c) for c in names])
    whole = F.lit(total_rows) if total_rows else F.col("total_rows")
    return rated(rows).withColumn("pct", F.round(F.least(F.col("total_rows") / whole * 100, F.lit(100.0)), 1))


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, in a table below ``folder``: (batch, query, operator, dropped).

    Add it to ``spark.streams`` before the query starts. A row counts where Spark drops it: at a state machine it is a row of the
    stream, at a windowed count a group of rows that Spark had already put together.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.seen = spark, folder, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = [(str(progress.id), k, o.numRowsDroppedByWatermark) for k, o in enumerate(progress.stateOperators) if o.numRowsDroppedByWatermark]
        if dropped:
            put_batch(self.spark.createDataFrame(dropped, "query string, operator int, dropped long"), self.folder, progress.batchId)
        self.seen[str(progress.id)] = progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.seen[str(event.id)] = None

    def table(self, query, wait: float = 60.0) -> DataFrame:
        """The counts of a query that has ended, once its last progress has arrived."""
        until = time.monotonic() + wait
        while self.seen.get(str(query.id), 0) is not None and time.monotonic() < until:
            time.sleep(0.1)
        empty = self.spark.createDataFrame([], "query string, operator int, dropped long")
        put_batch(empty, self.folder, -1)
        return read_batches(self.spark, self.folder, "query string, operator int, dropped long").where(F.col("query") == str(query.id))
