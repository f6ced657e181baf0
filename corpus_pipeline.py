"""From raw documents to packed training sequences, one stored table per stage.

Language identification drops documents that it can't assign, lines shared by many documents go, one document of each
near-duplicate group stays, sources are mixed to their weights (a document may then come twice), and what is left is
packed into sequences. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import fresh_folder
from packetloom.llm.langid import predicted, train
from packetloom.llm.line_dedup import dedup_lines
from packetloom.llm.minhash import keep_one
from packetloom.llm.mixing import mixed_rows
from packetloom.llm.packing import pack_documents

#: A pooled probability below this says no more than that the text fits none of the learned languages.
LEAST_SCORE = 0.3


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``; a character count follows the text."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return changed.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language; null texts, texts without a letter and those that fit no language go."""
    tagger = train(docs)
    found = predicted(docs, tagger, pred_col="__lang", score_col="__score")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that at least three documents share; rows whose lines all go keep an empty text."""
    return _with_text(docs, dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, on five-word shingles at 0.8."""
    return keep_one(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, at most twice."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: The network, the packing and the seeded mix have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
