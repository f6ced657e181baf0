"""Connected components of a link table by alternating star rounds, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import both_sides, let_go
from packetloom.operators.durable import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    """For each u the least of itself and its v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hooked = both.join(both_sides(_least(both)), F.col("u") == F.col("c")).where("v > u")
    return hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(both_sides(_least(down)), F.col("u") == F.col("c"))
    hooked = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    tops = _least(down).select(F.col("c").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(tops).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the smallest node that can be reached.

    Large-star and small-star rounds alternate until the table stops changing; each round is stored in the shared
    checkpoint folder, so a lost executor costs one round at most. A hub's rows are split by Spark, since both sides
    of each join are dealt out; least neighbours are pre-aggregated. Loops, repeats and nulls in ``links`` are ignored.
    """
    edges = checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        # a star forest stays as it is, so equal sums over two rounds mean the end
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (now["n"], now["s"]) == mark or not now["n"]:
            break
        mark = (now["n"], now["s"])
        edges = checkpointed(_small(_large(edges)))
        let_go(edges.sparkSession)
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
