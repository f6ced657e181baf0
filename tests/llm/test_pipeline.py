"""Each stage of the pipeline on what the one before it kept, against brute-force versions."""

import os
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))

import test_documents as by_hand  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.dtypes, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.dtypes == columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        tables.append((before.collect(), docs.collect()))
    (raw, known), (_, lined), (_, single), (_, mixed), (_, packed) = tables
    # clean documents stay, those without letters go
    assert {r.doc_id for r in raw} - {r.doc_id for r in known} <= {r.doc_id for r in raw if len(r.text or "") < 30 or not any(c.isalpha() for c in r.text)}
    assert all(any(c.isalpha() for c in r.text) for r in known)
    want = by_hand.dedup_by_hand(known)
    assert Counter((r.doc_id, r.text) for r in lined) == Counter({(i, t): n for (i, _, _, t), n in want.items()})
    assert all(r.n_chars == len(r.text) for r in lined)
    groups = by_hand.groups_by_hand(lined, 5)
    assert {r.doc_id for r in single} == {i for i, (_, c) in groups.items() if i == c} and len(single) == len({r.doc_id for r in single})
    copies = Counter(r.doc_id for r in mixed)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in single:
        n = len(by_hand.split_words(r.text))
        assert copies[r.doc_id] <= 2
        sizes[r.source] += n
        taken[r.source] += n * copies[r.doc_id]
    for s, t in by_hand.targets_by_loop(sizes).items():
        assert abs(taken[s] - t) <= max(len(by_hand.split_words(r.text)) for r in single if r.source == s)
    tokens = sum(len(by_hand.encoded(r.text, 1)) for r in mixed)
    assert sum(r.length for r in packed) == tokens
    bins = Counter()
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096 and len(bins) <= -(-tokens // 4096) + 1


def test_run_and_odd_tables(spark, with_repeats, none, tmp_path):
    for name, docs in (("odd", with_repeats), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (out.count() > 0) == (name == "odd")
    extra = with_repeats.withColumn("lang_pred", F.lit(1)).withColumn("n_lines", F.lit("n"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, extra, "").columns == extra.columns
