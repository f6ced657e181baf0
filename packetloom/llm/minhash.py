"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import both_sides, lean, let_go, numbered_within, whole_row
from packetloom.llm.components import components
from packetloom.operators.durable import checkpointed

_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


class ShingleHashes:
    """Distinct 64-bit hashes of the word shingles of texts, many texts at a time.

    Words lie between ASCII white space, A-Z count as a-z. A word's hash is a polynomial over random numbers for its
    bytes, taken from differences of one running sum over the buffer, so no word is touched singly.
    """

    def __init__(self, words: int, seed: int = 1):
        self.words = words
        own = np.random.default_rng(seed)
        letters = own.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        letters[65:91] = letters[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.letters = np.where(self.space, np.uint64(0), letters)
        self.base = np.uint64(int(own.integers(1 << 62, 1 << 63)) | 1)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._powers(2 * _CHUNK)

    def _powers(self, n: int) -> None:
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.back)]), dtype=np.uint64)

    def word_hashes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each word; ``data`` is the texts' bytes, each with a space behind it, ``ends`` their ends."""
        if len(data) >= len(self.up):
            self._powers(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.letters[data] * self.up[: len(data)], dtype=np.uint64)])
        gap = self.space[data]
        before = np.concatenate([[True], gap[:-1]])
        start = np.flatnonzero(~gap & before)
        end = np.flatnonzero(gap & ~before)
        value = _mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _STEP)
        return value, np.searchsorted(ends, start, side="right")

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text; a text with fewer words has the whole sequence as one."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size < _CHUNK):
                size += len(texts[to]) + 1
                to += 1
            part = texts[at:to]
            data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
            words, owner = self.word_hashes(data, np.cumsum([len(t) + 1 for t in part]))
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            for a, b in zip(bounds[:-1], bounds[1:]):
                own, k = words[a:b], min(self.words, b - a)
                if not k:
                    yield np.zeros(0, np.uint64)
                    continue
                value = np.full(len(own) - k + 1, np.uint64(k))
                for i in range(k):
                    value = _mixed(value * _STEP + own[i : len(own) - k + 1 + i])
                yield np.unique(value)
            at = to


class Collections:
    """Keys of ``count`` small collections, each made of ``size`` min-hashes of a set."""

    def __init__(self, count: int, size: int, seed: int = 2):
        own = np.random.default_rng(seed)
        self.count, self.size = count, size
        self.xor = own.integers(0, 1 << 63, count * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.times = own.integers(0, 1 << 63, count * size, dtype=np.uint64) | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.count * self.size, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(hashes), 4096):
            part = (hashes[at : at + 4096, None] ^ self.xor) * self.times
            least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
        value = np.arange(self.count, dtype=np.uint64)
        for i in range(self.size):
            value = _mixed(value * _STEP + least[i :: self.size])
        return value


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _name(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64).tolist())


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, count: int, size: int) -> DataFrame:
    """(doc_id, n, set1, set2, keys): set size, a 128-bit name of the set, and the collections' keys (null for empty sets)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, collections = ShingleHashes(words), Collections(count, size)
        for batch in batches:
            n, names, keys = [], [], []
            for own in hashes.sets(_texts(batch.column(1))):
                n.append(len(own))
                names.append(_name(own))
                keys.append(collections.keys(own).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                schema=kinds,
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), "doc_id long, n long, set1 long, set2 long, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, set1, set2, hashes) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShingleHashes(words)
        for batch in batches:
            own = list(hashes.sets(_texts(batch.column(1))))
            names = np.array([_name(s) for s in own], np.int64).reshape(-1, 2)
            held = pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), held], names=["doc_id", "set1", "set2", "hashes"])

    return docs.mapInArrow(lean(run), "doc_id long, set1 long, set2 long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("__x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("__y")), "b")
    shared = F.size(F.array_intersect("__x", "__y"))
    return both.where(100 * shared >= percent * (F.size("__x") + F.size("__y") - shared)).select("a", "b").distinct()


def _closest(pairs: DataFrame, keys_of: DataFrame, most: int) -> DataFrame:
    """Of the pairs (a, b) of each b the ``most`` whose collections agree most often."""
    left = pairs.join(keys_of.select(F.col("rep").alias("a"), F.col("keys").alias("x")), "a")
    both = left.join(keys_of.select(F.col("rep").alias("b"), F.col("keys").alias("y")), "b")
    agree = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda e: e))
    ranked = both.select("a", "b", agree.alias("s")).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("s", "a")), False).alias("best"))
    return ranked.select(F.explode(F.slice("best", 1, most)).alias("t"), "b").select("t.a", "b")


TILE = 256


def _across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components ``c`` of the buckets ``rows`` (table, rep, n, c, held): every pair is decided.

    No pair is written. Members of a bucket are gathered under the smallest component they meet, large components in tiles of
    their own, all tiles of bounded size, and pairs of tiles that share a bucket are compared as blocks; of the links
    between two components one is enough.
    """
    lows = rows.groupBy("table").agg(F.min("c").alias("low"))
    big = F.when(F.col("held") >= TILE, F.col("c"))
    anchored = rows.join(both_sides(lows), "table").groupBy("rep", "c", big.alias("g")).agg(F.min("low").alias("anchor"))
    placed = numbered_within(checkpointed(anchored), ["anchor", "g"], ["rep"])
    placed = checkpointed(placed.select("rep", "c", F.struct("anchor", "g", F.floor(F.col("__n") / TILE).alias("part")).alias("tile")))
    held = rows.select("table", "rep").join(both_sides(placed.select("rep", "tile")), "rep").select("table", "tile").distinct()
    held = checkpointed(held)
    met = held.select("table", F.col("tile").alias("x")).join(held.select("table", F.col("tile").alias("y")), "table").where("x <= y")
    apart = ~F.coalesce(F.col("x.g") == F.col("y.g"), F.lit(False))  # tiles of one large component have nothing to tell
    let_go(rows.sparkSession)
    met = checkpointed(met.where(apart).select("x", "y").distinct())
    sides = met.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    full = placed.join(sets, F.col("rep") == F.col("doc_id")).select("rep", "c", "tile", "hashes")
    dealt = full.join(both_sides(sides), "tile").select(
        F.xxhash64("x", "y").alias("x1"), F.xxhash64(F.lit(1), "x", "y").alias("y1"),
        (F.col("tile") == F.col("x")).alias("own"), (F.col("x") == F.col("y")).alias("one"), "rep", "c", "hashes",
    )
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        own, one = group.column("own").to_numpy(), group.column("one")[0].as_py()
        rep, comp = group.column("rep").to_numpy(), group.column("c").to_numpy()
        lists = group.column("hashes").combine_chunks()
        values, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        size = np.diff(bounds)
        left, right = (np.arange(len(rep)),) * 2 if one else (np.flatnonzero(own), np.flatnonzero(~own))
        _, word = np.unique(values, return_inverse=True)
        doc = np.repeat(np.arange(len(rep)), size)
        sides = [np.zeros(word.max(initial=-1) + 1, bool) for _ in range(2)]
        for side, at in zip(sides, (left, right)):
            chosen = np.zeros(len(rep), bool)
            chosen[at] = True
            side[word[chosen[doc]]] = True
        both = sides[0] & sides[1]
        place = np.cumsum(both) - 1
        use = both[word]
        word, doc = place[word[use]], doc[use]
        order = np.argsort(word, kind="stable")
        word, doc = word[order], doc[order]
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(both.sum()), 8192):  # words in blocks
            a, b = np.searchsorted(word, (at, at + 8192))
            block = np.zeros((len(rep), 8192), np.float32)
            block[doc[a:b], word[a:b] - at] = 1
            shared += block[left] @ block[right].T
        near = 100 * shared >= percent * (size[left][:, None] + size[right] - shared)
        i, j = np.nonzero(near & (comp[left][:, None] != comp[right]))
        i, j = left[i], right[j]
        low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        _, first = np.unique(np.stack([low, high]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, int))
        return pa.Table.from_arrays([pa.array(rep[i[first]], pa.int64()), pa.array(rep[j[first]], pa.int64())], schema=kinds)

    return dealt.groupBy("x1", "y1").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, count: int = 24, size: int = 4, rounds: int = 1, tries: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked when their sets of distinct ``words``-word shingles (A-Z lower-cased, ASCII white space between
    words; shorter texts are one shingle) share at least ``percent`` % of their union; a component is what links reach,
    named by its smallest id, which is the one kept. Null, empty and blank texts link with nothing. Null ids
    take no part (component null, not kept). Rows that repeat an id are documents of their own, all with that id.
    Other columns are ignored. An empty table gives an empty result.

    Tensored banding: ``count`` collections of ``size`` min-hashes are computed, and each pair of collections is
    a table, so 24 * 4 = 96 min-hashes serve 276 tables of 8. Two documents at exactly 80 % miss all tables only if at
    most one collection agrees, with a probability below 0.0001; every pair that meets is then decided on the full
    sets. Equal sets are one node from the start. Only collection keys that two nodes share are combined to tables.

    Nothing is paired all with all: a round checks the members of a bucket against a pivot, each member against the
    ``tries`` pivots of its buckets that it is likeliest to be linked with, and buckets whose members are in one component are
    done. What still differs after ``rounds`` rounds is compared across components, every pair, block by block
    (:func:`_across`), which is exact.
    """
    signed = checkpointed(signatures(docs, id_col, text_col, words, count, size))
    classes = checkpointed(
        signed.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("set1", "set2")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    keys = classes.select("rep", "n", F.posexplode("keys").alias("i", "key"))
    shared = keys.groupBy("i", "key").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").drop("__c")
    held = keys.join(both_sides(shared), ["i", "key"]).groupBy("rep", "n").agg(F.sort_array(F.collect_set(F.struct("i", "key"))).alias("k"))
    held = checkpointed(held.where(F.size("k") > 1))
    one = F.get("k", F.col("p"))
    pair = F.explode(F.transform(F.slice("k", F.col("p") + 2, F.size("k")), lambda y: F.xxhash64(one, y))).alias("table")
    tables = held.select("rep", "n", "k", F.explode(F.sequence(F.lit(0), F.size("k") - 2)).alias("p")).select("rep", "n", pair)
    busy = tables.groupBy("table").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("table")
    tables = checkpointed(tables.join(both_sides(busy), "table"))
    met = tables.select("rep").distinct()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = own.join(both_sides(met.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    of_class = classes.select(F.col("rep").alias("doc_id"), "set1", "set2")
    let_go(docs.sparkSession)
    sets = checkpointed(_sets(chosen, words).join(of_class, ["doc_id", "set1", "set2"], "left_semi").dropDuplicates(["doc_id", "set1", "set2"]))

    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    keys_of = classes.select("rep", "keys")
    links, named, tried = None, None, None
    for turn in range(rounds + 1):
        if named is None:
            rows = tables.withColumn("c", F.col("rep")).withColumn("held", F.lit(1).cast("long"))
        else:
            sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("held"))
            labels = named.join(both_sides(sizes), "component").select(F.col("node").alias("rep"), F.col("component").alias("c"), "held")
            rows = tables.join(both_sides(labels), "rep", "left")
            rows = rows.select("table", "rep", "n", F.coalesce("c", "rep").alias("c"), F.coalesce("held", F.lit(1)).alias("held"))
        # buckets within one component are done, now and in all later rounds
        mixed = rows.groupBy("table").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("table")
        rows = checkpointed(rows.join(both_sides(mixed), "table"))
        let_go(docs.sparkSession)
        if rows.isEmpty():
            break
        tables = rows.select("table", "rep", "n")
        if turn == rounds:
            found = checkpointed(_across(rows, sets, percent))
            links = found if links is None else links.unionByName(found)
            named = components(links)
            break
        # the smallest member at first, then a random one of the bucket's largest component
        first = F.struct((-F.col("rep")).alias("o"), "rep", "n", "c") if not turn else F.struct("held", F.xxhash64(F.lit(turn), F.pmod("table", F.lit(8)), "rep").alias("o"), "rep", "n", "c")
        pivots = rows.groupBy("table").agg(F.max(first).alias("p"))
        pivots = pivots.select("table", F.col("p.rep").alias("a"), F.col("p.n").alias("m"), F.col("p.c").alias("d"))
        pairs = rows.join(both_sides(pivots), "table").where("c <> d").where(near).select("a", F.col("rep").alias("b")).distinct()
        if not turn:
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        else:
            pairs = _closest(pairs, keys_of, tries)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = checkpointed(_verified(pairs, sets, percent))
        links = found if links is None else links.unionByName(found)
        named = components(links)
    if named is None:
        named = components(signed.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0))

    classed = signed.join(classes.select("set1", "set2", "rep"), ["set1", "set2"], "left")
    out = classed.join(both_sides(named), F.col("rep") == F.col("node"), "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    name = F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` less the near duplicates, columns unchanged: of each component the document with the smallest id stays, as do rows without an id."""
    found = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = found.select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(whole_row(docs).alias("doc"), F.col(id_col).cast("long").alias("id"))
    return rows.join(both_sides(gone), F.col("id") == F.col("gone"), "left_anti").select("doc.*")
