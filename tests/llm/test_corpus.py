"""Manifest, benchmark passages and token alignment against brute-force versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from packetloom.llm import alignment, decontaminate, merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TABLES = ["odd", "with_repeats", "none"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_by_hand(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_hand(leaves):
    """Levels from the leaves to the root, and for each leaf its siblings to the left and right."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    steps = []
    for k in range(len(leaves)):
        own = []
        for level in levels[:-1]:
            run = level[k // 2 * 2 : k // 2 * 2 + 2]
            own.append(("".join(run[: k % 2]), "".join(run[k % 2 + 1 :])))
            k //= 2
        steps.append(own)
    return levels[-1][0], steps


def manifest_by_hand(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[d.lang].append((d.doc_id is not None, d.doc_id or 0, leaf_by_hand([d[f] for f in FIELDS])))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = [tree_by_hand([leaf for _, _, leaf in sorted(groups[n])]) for n in names]
    root, upper = tree_by_hand([t[0] for t in trees]) if trees else (None, [])
    out = Counter()
    for n, (subroot, steps), more in zip(names, trees, upper):
        for (has_id, doc_id, leaf), own in zip(sorted(groups[n]), steps):
            out[doc_id if has_id else None, leaf, subroot, root, sha("".join(a + b for a, b in own + more))] += 1
    return out


@pytest.mark.parametrize("table", TABLES)
def test_manifest(table, request):
    docs = request.getfixturevalue(table)
    found = merkle.proofs(docs, [F.col(f) for f in FIELDS])
    text = lambda c: merkle.hex_text(F.col(c)).alias(c)
    proof = F.sha2(merkle.hex_text(merkle.siblings(F.col("steps"))), 256).alias("proof")
    rows = found.select("doc_id", text("leaf"), text("subroot"), text("root"), proof, (merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in rows)
    assert Counter(tuple(r)[:5] for r in rows) == manifest_by_hand(docs.collect())


@pytest.mark.parametrize("band", [1, 3])
def test_manifest_in_bands(spark, band, monkeypatch):
    """More levels than a band, group sizes around powers of two, a lone leaf, a null group, a name between others."""
    monkeypatch.setattr(merkle, "BAND", band)
    sizes = {"a": 1, "b": 2, "é": 3, None: 8, "z": 9, "": 17, "ab": 16}
    rows = [Row(doc_id=k * 3 + i, source=None, lang=n, n_chars=k, text=f"t{k}") for i, (n, c) in enumerate(sizes.items()) for k in range(c)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    found = merkle.proofs(docs, [F.col(f) for f in FIELDS], also={"changed": F.col("n_chars") + 1})
    proof = F.sha2(merkle.hex_text(merkle.siblings(F.col("steps"))), 256).alias("proof")
    got = found.select("doc_id", *[merkle.hex_text(F.col(c)) for c in ("leaf", "subroot", "root")], proof, (merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("ok"), "changed").collect()
    assert all(r.ok for r in got) and sorted(r.changed for r in got) == sorted(r.n_chars + 1 for r in rows)
    assert Counter(tuple(r)[:5] for r in got) == manifest_by_hand(rows)


def test_intervals(spark):
    """Nodes cover their leaves: intervals of a level tile the ranks, and a parent's interval is its children's."""
    leaves = spark.range(77).select(F.lit(5).cast("long").alias("tree"), F.col("id").alias("rank"), F.lit(77).cast("long").alias("size"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    nodes = [r for part in merkle.build(leaves).nodes for r in part.collect()]
    levels = defaultdict(list)
    for r in nodes:
        levels[r.level].append((r.lo, r.hi))
    assert sorted(levels) == list(range(7))
    for level, held in levels.items():
        held.sort()
        assert held[0][0] == 0 and held[-1][1] == 77 and all(a[1] == b[0] for a, b in zip(held, held[1:]))
        assert all(hi - lo == 2**level for lo, hi in held[:-1])


def test_tampering_is_seen(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf(F.col("doc_id"), F.col("n") + 1))
    found = merkle.proofs(docs, [F.col("doc_id"), F.col("n")], also={"tampered": changed})
    seen = found.select("doc_id", (merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in seen if not r.ok} == {k for k in range(40) if k % 2 == 0 and k % 5 > 0}


# ---------------------------------------------------------------- passages


def passages_by_hand(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: [(m.group(), m.span()) for m in word.finditer((t or "").translate(LOWER))]
    windows = defaultdict(set)
    for i in items:
        words = [w for w, _ in cut(i.text)]
        for k in range(max(len(words) - window, 0) + 1 if words else 0):
            windows[tuple(words[k : k + window])].add("" if i.item_id is None else str(i.item_id))
    out = []
    for d in docs:
        words, hit, of = cut(d.text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                names = windows.get(tuple(w for w, _ in words[k : k + n]))
                if names:
                    hit |= set(range(k, k + n))
                    of |= names
        spans = []
        for k in sorted(hit):
            if k - 1 in hit:
                spans[-1] = (spans[-1][0], words[k][1][1])
            else:
                spans.append(words[k][1])
        out.append((d.doc_id, len(words), len(hit), tuple(sorted(of)), tuple(spans)))
    return Counter(out)


def items_of(spark, docs, seed=3):
    """Items cut out of documents (other case and marks between words), short and empty ones, a null id, a repeated id."""
    own, rows = random.Random(seed), []
    texts = [d.text for d in docs if d.text and len(d.text) > 200]
    for k in range(12):
        words = re.findall(r"[^\W_]+", own.choice(texts).translate(LOWER))
        at = own.randrange(max(1, len(words) - 40))
        rows.append(Row(item_id=k % 10 + 5, text=" - ".join(words[at : at + own.choice([4, 10, 11, 30])]).upper()))
    rows += [Row(item_id=None, text="w1 w2"), Row(item_id=90, text=None), Row(item_id=91, text=" ?! "), Row(item_id=92, text="w7"), Row(item_id=93, text="nothing has this")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


@pytest.mark.parametrize("block_bytes", [2 << 20, 150])
@pytest.mark.parametrize("table", TABLES)
def test_passages(spark, table, block_bytes, request):
    docs = request.getfixturevalue(table)
    items, rows = items_of(spark, request.getfixturevalue("odd_rows"))
    out = decontaminate.find_passages(docs, items, block_bytes=block_bytes)
    assert out.columns == [*docs.columns, "n_words", "n_hit", "items", "spans"]
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), tuple((s.start, s.end) for s in r.spans)) for r in out.collect())
    assert got == passages_by_hand(docs.collect(), rows)


def test_passages_without_items(spark, odd, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.find_passages(odd, none, keep=["doc_id"]).collect()
    assert len(out) == len(odd_rows) and not any(r.n_hit or r["items"] or r.spans for r in out)


def test_long_text_is_read_in_pieces():
    own = random.Random(1)
    words = [own.choice("abc") for _ in range(3000)]
    items = [("1", "a b c"), ("2", " ".join(words[500:515])), ("3", "c")]
    passages = decontaminate.Passages(items, 10)
    text = "é ".join(words).upper()
    whole = passages.scan(" ".join(words))
    few = decontaminate.Passages([(n, t.replace(" ", "é ")) for n, t in items], 10).scan(text)
    assert few[0] == whole[0] == 3000
    assert [len(p) for p in decontaminate.word_pieces(" ".join(words), 40)][:2] != [3000]
    pieces = [w for p in decontaminate.word_pieces(" ".join(words), 40) for w in p]
    assert pieces == words
    cut = decontaminate.word_pieces
    try:
        decontaminate.word_pieces = lambda t: cut(t, 7)
        assert passages.scan(" ".join(words)) == whole
    finally:
        decontaminate.word_pieces = cut


# ---------------------------------------------------------------- alignment

ODD_TEXTS = ["hello world", "  two  spaces\n\tx", "日本 é", "a\x00b", " lead", "trail ", "ﬁ lig", "x\r\n\r\ny", "a\xa0b c", "\n", "\n\n  a", " ", "  "]
ODD_TEXTS += ["don't 'sfoo it's", "a \n b\n \nc", "<s> </s> <|endoftext|> <unk> <0x0A>", "é \U0001f600‍ x", "tab\t\tx \t y", "1234 56,78.9", "\x1c a\x85", "word" * 5000, "a▁b", "", None]


def tokens_by_hand(own, text):
    """Groups and links of one text, found by walking over the bytes."""
    if not text:
        return "", []
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    ends = []
    for ids, table in ((a, own.a_bytes), (b, own.b_bytes)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return "", []
        ends.append(np.cumsum([len(table[i]) for i in ids]).tolist())
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        for x in range(i, i2):
            for y in range(j, j2):
                if ends[0][x] > (ends[1][y - 1] if y else 0) and ends[1][y] > (ends[0][x - 1] if x else 0):
                    links.append((a[x], b[y]))
        i, j = i2, j2
    return ";".join(groups), links


def alignment_by_hand(docs):
    own = alignment.Aligner(*alignment.default_tokenizers())
    found = [(d, *tokens_by_hand(own, d.text)) for d in docs]
    holders = Counter(p for _, _, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = Counter()
    for d, groups, links in found:
        size = lambda k: sum(len(g.split("|")[k].split(",")) for g in groups.split(";")) if groups else 0
        best = sum(holders[p] == most[p[0]] for p in links)
        out[d.doc_id, size(0), size(1), len(groups.split(";")) if groups else 0, len(links), best, sum(holders[p] for p in links), sha(groups) if groups else "", groups] += 1
    return out


@pytest.mark.parametrize("block_chars", [8 << 20, 3000])
@pytest.mark.parametrize("table", TABLES)
def test_alignment(spark, table, block_chars, request):
    docs = request.getfixturevalue(table)
    if table == "odd":
        docs = docs.unionByName(spark.createDataFrame([Row(doc_id=1000 + k, text=t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    out = alignment.align(docs, with_groups=True, block_chars=block_chars)
    assert Counter(map(tuple, out.collect())) == alignment_by_hand(docs.collect())


def test_terminals():
    own = np.random.default_rng(4)
    for _ in range(300):
        n = int(own.integers(1, 60))
        cut = lambda: np.unique(np.append(own.integers(1, n + 1, int(own.integers(1, n + 1))), n))
        ends_a, ends_b = cut(), cut()
        last_a, last_b = alignment.terminals(ends_a, ends_b)
        common = np.intersect1d(ends_a, ends_b)
        want = lambda ends: np.searchsorted(ends_a, common[np.searchsorted(common, ends)])
        assert (last_a == want(ends_a)).all() and (last_b == want(ends_b)).all()


def test_aligner_memory_is_bounded():
    own = alignment.Aligner(*alignment.default_tokenizers(), limit=20_000)
    for k in range(30):
        own.texts([" ".join(f"q{k}x{i}" for i in range(200))])
        assert own.size < 20_000 + 200 * 1000
    assert len(own.memory) < 2000
