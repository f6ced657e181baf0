"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import SPACES, both_sides, lower_ascii, whole_row


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``n_dropped`` added.

    Texts are split at line feeds (null and empty: one empty line). A line's key is the line without ASCII white space
    at its ends and with A-Z lower-cased. A key of at least ``min_chars`` code points that occurs in at least
    ``min_docs`` documents loses all its lines but those of the largest id that holds it; the others stay in their order.

    Lines are exploded with their position and a 128-bit hash of the key, documents are counted per hash, the positions to
    drop are gathered per document, and each text is put together from the positions that are left. Rows that share an
    id are one document for the counts and lose the same lines. Null ids count as one document that is smaller than any
    other. Columns of ``docs`` stay; ``n_lines`` and ``n_dropped`` of the input are replaced.
    """
    own, text = F.col(id_col), F.col(text_col)
    lines = (
        docs.select(own.alias("__id"), F.xxhash64(text).alias("__row"), F.posexplode(_lines(text)).alias("__pos", "__line"))
        .where(F.length("__line") >= min_chars)
        .withColumn("__key", lower_ascii(F.trim(F.col("__line"), F.lit(SPACES))))
        .where(F.length("__key") >= min_chars)
        .select("__id", "__row", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"))
    )
    holders = lines.groupBy("__h1", "__h2", "__id").agg(F.lit(1).alias("__one"))
    common = (
        holders.groupBy("__h1", "__h2")
        .agg(F.count("__one").alias("__docs"), F.max("__id").alias("__last"))
        .where(F.col("__docs") >= min_docs)
        .select(F.col("__h1").alias("__c1"), F.col("__h2").alias("__c2"), "__last")
    )
    hit = (F.col("__h1") == F.col("__c1")) & (F.col("__h2") == F.col("__c2"))
    dropped = (
        lines.join(both_sides(common), hit)
        .where(F.col("__id").isNull() | (F.col("__id") < F.col("__last")))
        .groupBy("__id", "__row")
        .agg(F.collect_set("__pos").alias("__drop"))
        .select(F.col("__id").alias("__did"), F.col("__row").alias("__drow"), "__drop")
    )
    rows = docs.select(whole_row(docs).alias("doc"), own.alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("__did")) & (F.col("row") == F.col("__drow")), "left")
    parts = joined.withColumn("parts", _lines(F.col("text"))).withColumn("drop", F.coalesce("__drop", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drop"))
    rebuilt = F.when(F.size("drop") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    counts = [F.size("parts").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped")]
    return parts.select(*[rebuilt.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in kept], *counts)
