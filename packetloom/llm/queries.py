"""Registered queries of the corpus operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import sql
from packetloom.llm.common import fresh_folder

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        REGISTERED[name] = (fn, oracle)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_source_mix")
def op1_source_mix(spark, d):
    from packetloom.llm.mixing import mix

    return mix(table(spark, d, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op5_line_dedup", sql.LINE_DEDUP)
def op5_line_dedup(spark, d):
    from packetloom.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op8_minhash_near_dedup", sql.MINHASH)
def op8_minhash_near_dedup(spark, d):
    from packetloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, d, "documents"), words=2, percent=80)


@query("op9_token_files")
def op9_token_files(spark, d):
    from packetloom.llm.token_files import read_tokens, write_tokens

    folder = fresh_folder(spark, "tokens")
    write_tokens(table(spark, d, "documents"), folder)
    return read_tokens(spark, folder)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, d):
    from packetloom.llm.packing import pack_documents

    return pack_documents(table(spark, d, "documents"))


@query("op7_language_id")
def op7_language_id(spark, d):
    from packetloom.llm.langid import in_training, predicted, train

    docs = table(spark, d, "documents")
    tagger = train(docs)
    out = predicted(docs.select("doc_id", "text"), tagger)
    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op4_vector_near_dedup", sql.VECTOR_DEDUP)
def op4_vector_near_dedup(spark, d):
    from packetloom.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, d, "embeddings"))


@query("op6_exact_top_k", sql.TOP_K)
def op6_exact_top_k(spark, d):
    from packetloom.llm.topk import top_k

    return top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op2_license_scan", sql.license_scan())
def op2_license_scan(spark, d):
    from packetloom.llm.licenses import scan

    return scan(table(spark, d, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


@query("op3_secret_scan")
def op3_secret_scan(spark, d):
    from packetloom.llm.secrets import scan, written

    found = scan(table(spark, d, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op11_merkle_manifest", sql.MERKLE)
def op11_merkle_manifest(spark, d):
    from packetloom.llm.merkle import fold, hex_text, leaf, proofs, siblings

    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col("n_chars") + 1 if i == 3 else v for i, v in enumerate(values)]
    found = proofs(table(spark, d, "documents"), values, also={"tampered": F.when(odd, leaf(*changed))})
    folded = found.withColumn("folded", fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    proof = F.sha2(hex_text(siblings(F.col("steps"))), 256)
    digests = [hex_text(F.col(c)).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    return folded.select("doc_id", *digests, proof.alias("proof_sha256"), hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


@query("op12_benchmark_passages", sql.PASSAGES)
def op12_benchmark_passages(spark, d):
    from packetloom.llm.decontaminate import find_passages

    found = find_passages(table(spark, d, "documents"), table(spark, d, "benchmark"), keep=["doc_id"])
    listed = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_token_alignment")
def op13_token_alignment(spark, d):
    from packetloom.llm.alignment import align

    return align(table(spark, d, "documents"))


@query("pipeline")
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
