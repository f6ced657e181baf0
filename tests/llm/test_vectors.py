"""Vector operators and the language network against brute-force versions."""

import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import langid, topk
from packetloom.llm.vector_dedup import first_bits_for, near_vectors, passes_for

VECTORS = "vec_id long, embedding array<double>, label int, rep string, rank int"


def odd_vectors(seed=1, n=400, size=12):
    own = np.random.default_rng(seed)
    x = own.normal(size=(n, size))
    x[100:180] = x[3] + 0.02 * own.normal(size=(80, size))  # a dense group
    for i in range(200, 260):  # pairs and chains
        x[i] = x[i - 1] + 0.15 * own.normal(size=size)
    x[300:310] = x[5]
    x[310] = 3 * x[5]
    rows = [(i, [float(v) for v in row], int(own.integers(0, 2)) if i < 390 else None, "r", 1) for i, row in enumerate(x)]
    odd = [None, [], [0.0] * size, [float("nan")] + [1.0] * (size - 1), [float("inf")] * size, [None] + [1.0] * (size - 1), [1.0, 2.0], [2.0, 4.0], [1e300] * size, [1e-300] * size]
    return rows + [(1000 + i, v, 0, "r", 1) for i, v in enumerate(odd)]


def usable(v):
    return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)


def links_by_hand(rows, threshold):
    ids = [r[0] for r in rows]
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = {}
    for i, v, *_ in rows:
        if usable(v):
            a = np.array(v) / np.abs(v).max()
            unit[i] = a / np.sqrt((a * a).sum())
    for k, (a, u, la, *_) in enumerate(rows):
        for b, v, lb, *_ in rows[:k]:
            if a in unit and b in unit and la is not None and la == lb and len(u) == len(v) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("window", [8, 256])
def test_near_vectors(spark, window):
    rows = odd_vectors()
    out = near_vectors(spark.createDataFrame(rows, VECTORS).repartition(4), window=window, passes=24).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    want = links_by_hand(rows, 0.98)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in got)
    if window == 256:  # both halves fit the window of some pass
        assert got == want
    else:
        assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())


def test_near_vectors_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 1, "r", 1), (1, [1.0, 0.0], 1, "r", 1), (None, [1.0, 0.0], 1, "r", 1), (2, [2.0, 0.0], 1, "r", 1), (3, [1.0, 0.0], None, "r", 1)]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, False), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_passes_keep_the_bound():
    for size in (1, 200, 40_000, 10**6, 10**7, 10**8, 10**12):
        bits = first_bits_for(size, 256)
        for threshold in (0.9, 0.98, 1.0):
            assert (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** passes_for(bits, threshold, 0.0001) <= 0.0001


def test_near_vectors_in_a_dense_label(spark):
    """Pairs just above the threshold in a label of 500 windows, whose vectors lie in one cone."""
    own = np.random.default_rng(3)
    x = own.normal(size=(4000, 32)) / math.sqrt(32) + np.eye(32)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = own.normal(size=x.shape)
    d -= (d * x).sum(axis=1, keepdims=True) * x
    x = np.concatenate([x, 0.9801 * x + math.sqrt(1 - 0.9801**2) * d / np.linalg.norm(d, axis=1, keepdims=True)])
    cos = x @ x.T >= 0.98
    want = {i: int(n) - 1 for i, n in enumerate(cos.sum(axis=1))}
    table = spark.createDataFrame([(i, v.tolist(), 1, "r", 1) for i, v in enumerate(x)], VECTORS)
    assert {r.vec_id: r.n_links for r in near_vectors(table, window=16).collect()} == want


def top_by_hand(rows, k):
    ints = [(i, [math.floor(64.0 * float(x)) for x in v]) for i, v, *_ in rows if usable(v + [1.0] if v else v) and all(math.isfinite(64 * float(x)) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in ints}:
        if q % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in ints if i != q and len(x) == len(y))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{"candidates": 64, "queries": 5, "lists": 16}, {}])
def test_top_k(spark, sizes):
    rows = odd_vectors()
    table = spark.createDataFrame(rows + rows[:3], VECTORS).repartition(3)
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, k=7, **sizes).collect()))
    assert got == top_by_hand(rows + rows[:3], 7)


@pytest.mark.parametrize("sizes", [{"candidates": 64, "queries": 5, "lists": 16}, {}])
def test_top_k_of_large_components(spark, sizes):
    """Components of 2^24 and far beyond hold the highest scores; products above 2^53 and 2^63 stay exact."""
    own = np.random.default_rng(12)
    rows = [(i, (own.normal(size=6) * 10.0 ** own.choice([0, 0, 0, 5, 7, 8, 9])).tolist(), 1, "r", 1) for i in range(300)]
    rows += [(400, [1e12] * 6, 1, "r", 1), (401, [-1e300, 1.0, 0.0, 0.0, 0.0, 0.0], 1, "r", 1), (420, [262144.0, 0.0, 0.0, 0.0, 0.0, 1.0], 1, "r", 1), (421, [1e308] * 6, 1, "r", 1)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, k=7, **sizes).collect()))
    assert got == top_by_hand(rows, 7)


def test_lists_are_left_early():
    """Where a few candidates stand out, bounds close before the lists end; elsewhere they are read to the end. Results are the same."""
    own = np.random.default_rng(13)
    queries = own.integers(1, 60, (40, 8)).astype(float)
    flat = own.integers(-40, 40, (2000, 8)).astype(float)
    skewed = flat.copy()
    skewed[:30] += 400
    for values, early in ((skewed, True), (flat, False)):
        reads: list[float] = []
        blocks = [topk.SortedLists(np.arange(a, a + 500), values[a : a + 500], np.float64) for a in range(0, 2000, 500)]
        best = topk.aggregate(np.full(40, -1), queries, iter(blocks), 10, reads)
        exact = queries @ values.T
        for (ids, scores), line in zip(best, exact):
            order = np.lexsort((np.arange(2000), -line))[:10]
            assert ids.tolist() == order.tolist() and scores.tolist() == line[order].tolist()
        assert len(reads) == 160
        if early:  # most queries and blocks stop at the first steps
            assert sum(r < 0.3 for r in reads) > 140


def test_top_k_small_tables(spark):
    rows = [(0, [1.0, 2.0], 1, "r", 1), (5, [0.5, -1.0], 1, "r", 1), (20, [1.0, 2.0], 1, "r", 1), (40, None, 1, "r", 1)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect()))
    assert got == top_by_hand(rows, 20)
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_close():
    own = np.random.default_rng(7)
    for kind in (np.float32, np.float64, np.int64):
        values, q = own.integers(-40, 40, (300, 9)), own.integers(-40, 40, (20, 9)).astype(kind)
        block = topk.SortedLists(np.arange(300), values, kind)
        exact, last = q @ values.T, None
        for depth in (1, 30, 150, 300):
            low, high = block.bounds(np.maximum(q, 0), np.minimum(q, 0), depth)
            assert (low <= exact).all() and (exact <= high).all()
            assert last is None or (high - low <= last).all()
            last = high - low
        assert (last == 0).all()
    assert topk.exact_type(np.array([[1 << 20]]), np.array([[1 << 20]])) is np.float64
    assert topk.exact_type(np.array([[1 << 24] * 64]), np.array([[1 << 24] * 64])) is np.int64


# ---------------------------------------------------------------- language


def test_gradients():
    own = np.random.default_rng(8)
    net = langid.ByteTagger(["a", "b", "c"], hidden=4)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64) + 0.1 * own.normal(size=net.w[k].shape)
    windows, wanted = own.integers(0, 5, (7, 6)).astype(np.uint8), own.integers(0, 3, 6)
    _, grads = net.gradients(windows, wanted)
    for k, w in net.w.items():
        at = tuple(int(own.integers(0, min(s, 5))) for s in w.shape)
        w[at] += 1e-5
        up, _ = net.gradients(windows, wanted)
        w[at] -= 2e-5
        down, _ = net.gradients(windows, wanted)
        w[at] += 1e-5
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def plain_probabilities(net, text, length):
    """Position by position, from the equations."""
    total = np.zeros(len(net.labels))
    for at in range(0, len(text), length):
        window = np.frombuffer(text[at : at + length], np.uint8)[:, None]
        logits = net.w["out"]
        for side in "fb":
            states = np.stack([k[6] for k in sorted(net._run(side, window), key=lambda k: k[0])])
            logits = logits + states @ net.w[f"{side}out"]
        p = np.exp(logits[:, 0])
        total += (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
    return total / len(text)


def test_pooling_reads_every_byte():
    net = langid.ByteTagger(["a", "b", "c"])
    own = np.random.default_rng(9)
    texts = [own.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 31, 32, 33, 500, 64)] + [b""]
    got = net.pooled(texts, length=32, batch=4)
    for t, p in zip(texts[:-1], got):
        assert p == pytest.approx(plain_probabilities(net, t, 32), abs=1e-5)
    assert got[-1] == pytest.approx([1 / 3] * 3)


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang_pred", F.lit("clash"))
    net = langid.train(docs)
    out = langid.predicted(docs, net)
    held = out.where(~langid.in_training(F.col("doc_id")))
    right = held.where("lang_pred = lang").count() / held.count()
    assert right >= 0.97
    assert [r.doc_id for r in held.limit(5).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2] == []
    assert out.where("lang_score < 0 OR lang_score > 1").count() == 0


def test_language_id_odd_tables(spark, with_repeats, none):
    net = langid.train(with_repeats, steps=5)
    rows = langid.predicted(with_repeats, net).collect()
    assert len(rows) == with_repeats.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or ""))
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.predicted(with_repeats, None).collect()} == {"und"}
    assert langid.predicted(none, net).count() == 0


def test_long_labels_are_told_apart(spark):
    a, b = "x" * 70 + "a", "x" * 70 + "b"
    rows = [(1, [1.0, 0.0], a, "r", 1), (2, [1.0, 0.0], b, "r", 1), (3, [1.0, 0.0], a, "r", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, source string, size int")
    assert sorted(map(tuple, near_vectors(table).collect())) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_number_signs_are_no_letters(spark):
    table = spark.createDataFrame([(1, "½ ² Ⅷ 12"), (2, "½ é"), (3, "ª"), (4, "日")], "doc_id long, text string")
    tagger = langid.ByteTagger(["a", "b"])
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predicted(table, tagger).collect()} == {1: True, 2: False, 3: False, 4: False}
