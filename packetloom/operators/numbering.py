"""Running numbers over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.operators.durable import checkpointed


def numbered(rows: DataFrame, order: list[str | Column], number: str = "row", first: int = 1) -> DataFrame:
    """``rows`` with ``number`` = ``first``, ``first`` + 1, .. by ``order`` (which should tell rows apart; equal ones are numbered in any order).

    Rows are dealt out by ranges of ``order`` and sorted inside each partition, where their place is known without a window; the
    partitions' sizes, a row each, move them. The placed rows are stored once in the checkpoint folder, so that a lost executor can't
    deal them out anew.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    moved = placed.join(F.broadcast(starts), part == F.col("__p"))  # as many rows as partitions
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return moved.withColumn(number, F.col("__before") + inside + F.lit(first)).drop("__at", "__p", "__before")
