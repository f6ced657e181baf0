"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.operators.durable import fresh as fresh_folder  # noqa: F401

#: ASCII white space, as the contracts of the word and line operators define it: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hand freed memory back to the system: worker processes live on from task to task, and allocators keep what they had."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that no table refers to any more. It does so when the driver's garbage is
    collected, which a driver with little to do may put off for half an hour, while many-round jobs leave files behind."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, handing freed memory back when its task ends."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that a join's own names can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def both_sides(df: DataFrame) -> DataFrame:
    """A small aggregated side, dealt anew so that a join deals out both of its sides and Spark can split a hot key."""
    return df.repartition(shuffle_partitions(df.sparkSession))


def numbered_within(rows: DataFrame, keys: list[str], ties: list[str], number: str = "__n", total: str = "__total", seed: int = 42) -> DataFrame:
    """``rows`` with 0, 1, 2 .. within each group of ``keys`` in a seeded order, and the group's number of rows.

    No group meets in one task: it is cut into salts by a hash of ``ties`` (which must identify a row up to exact
    repeats), each salt is numbered alone, and salts are placed by the counts of the ones before. Nulls form groups of
    their own. ``rows`` should be stored, since it is read twice.
    """
    spark = rows.sparkSession
    salts = 4 * shuffle_partitions(spark)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(seed), *ties), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__salt").alias("__s"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(*keys)).alias(total),
    )
    inside = Window.partitionBy(*keys, "__salt").orderBy(F.xxhash64(F.lit(seed + 1), *ties), *ties)
    same = F.col("__salt") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    placed = salted.withColumn("__in", F.row_number().over(inside) - 1).join(places, same)
    out = placed.withColumn(number, F.col("__before") + F.col("__in"))
    return out.drop("__salt", "__s", "__in", "__before", *[f"__k{i}" for i in range(len(keys))])
