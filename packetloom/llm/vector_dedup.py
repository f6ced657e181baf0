"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from packetloom.llm.common import both_sides, shuffle_partitions
from packetloom.llm.components import components
from packetloom.operators.durable import checkpointed


def _classed(rows: DataFrame) -> DataFrame:
    """(vec_id, label, size, class, vec) of ``rows`` (vec_id, label, embedding); class is null for vectors that take no part.

    ``class`` names label and components.
    """
    kinds = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("class", pa.binary()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in kinds.names}
            for vec_id, label, given in zip(*(batch.column(i).to_pylist() for i in range(3))):
                vec = None
                if vec_id is not None and label is not None and given and None not in given:
                    vec = np.array(given, np.float64) + 0.0  # no negative zero
                    if not np.isfinite(vec).all() or not vec.any():
                        vec = None
                name = data = None
                if vec is not None:
                    data = vec.tobytes()
                    name = hashlib.blake2b(hashlib.blake2b(label.encode()).digest() + data, digest_size=16).digest()
                values = (vec_id, label, len(vec) if vec is not None else None, name, data)
                for n, v in zip(kinds.names, values):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return rows.mapInArrow(run, "vec_id long, label string, size int, class binary, vec binary")


def _keyed(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """(class, label, size, keys): 64 random-hyperplane bits of each class's vector per pass, the first the highest."""
    kinds = pa.schema([("class", pa.binary()), ("label", pa.string()), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = []
            for data in batch.column(3).to_pylist():
                vec = np.frombuffer(data, np.float64)
                if len(vec) not in planes:
                    planes[len(vec)] = np.random.default_rng([seed, len(vec)]).normal(size=(len(vec), 64 * passes))
                bits = (vec / np.abs(vec).max()) @ planes[len(vec)] >= 0
                keys.append(np.packbits(bits).view(">i8").astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(keys, pa.list_(pa.int64()))], schema=kinds)

    return classes.select("class", "label", "size", "vec").mapInArrow(run, "class binary, label string, size int, keys array<long>")


def first_bits_for(largest: int, window: int) -> int:
    """Bits that by chance only a few of the ``largest`` number of vectors that are compared with each other share."""
    return min(48, max(8, math.ceil(math.log2(max(largest, 1) / window + 1)) + 4))


def passes_for(first_bits: int, threshold: float, miss: float) -> int:
    """Passes, 12 at least, after which two vectors at ``threshold`` have shared no first bits with a probability of at most ``miss``."""
    shared = (1 - math.acos(threshold) / math.pi) ** first_bits
    return 12 if shared == 1 else max(12, math.ceil(math.log(miss) / math.log1p(-shared)))


def _rooted(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member index of each of ``count`` nodes' components under links (i, j), by repeated halving."""
    root = np.arange(count)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str | None = "label", vector_col: str = "embedding", threshold: float = 0.98, passes: int | None = None, window: int = 256, seed: int = 17, miss: float = 0.0001) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows``.

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least ``threshold``; a component is what links reach, named by its smallest id, which is kept.
    Vectors that are null, empty, zero, hold null or non-finite components, or have no label or no id, link with
    nothing. Equal vectors of a label are one class from the start and count each other; rows that repeat an id
    count as vectors of their own. Without ``label_col`` all rows are compared. An empty table gives an empty result.

    Each pass orders the vectors by label and a string of random-hyperplane bits and compares neighbours: those at
    most ``window`` ranks apart, and, so that a window never caps a dense group, all that share the first bits of the
    pass's key, however many. The number of these bits grows with the logarithm of the largest label, so by
    chance only a few vectors share them, and the number of passes grows with it, so that at any size and density
    a link is in none of them with a probability of at most ``miss``; ``passes`` sets their number instead. Ranks are cut into tiles; a tile meets the one before it, and a run of equal first bits
    that covers more tiles has its pairs of tiles dealt out as groups of their own. A link counts in the first pass
    that can see it, which each vector's ranks in the earlier passes tell, so no pair is ever written: groups
    return counts per vector and stars for the union.
    """
    spark = rows.sparkSession
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    vector = F.col(vector_col).cast(T.ArrayType(T.DoubleType()))
    classed = checkpointed(_classed(rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.alias("embedding"))))
    classes = classed.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("size").alias("size"), F.first("vec").alias("vec")
    )
    classes = checkpointed(classes)
    largest = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0
    first_bits = first_bits_for(largest, window)
    if passes is None:
        passes = passes_for(first_bits, threshold, miss)

    keys = _keyed(classes, passes, seed).select("class", "label", "size", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "label", "size", "key", "class"]
    placed = keys.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per shuffle partition
    starts = counts.select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    ranked = placed.join(F.broadcast(starts), part == F.col("p"))  # as many rows as shuffle partitions
    ranked = ranked.withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = ranked.withColumn("first", F.shiftright("key", 64 - first_bits)).withColumn("tile", F.floor(F.col("rank") / window))

    runs = ranked.groupBy("pass", "label", "size", "first").agg(F.min("tile").alias("lo"), F.max("tile").alias("hi")).where("hi >= lo + 2")
    far = runs.select("hi", F.explode(F.sequence("lo", F.col("hi") - 2)).alias("a")).select("a", F.explode(F.sequence(F.col("a") + 2, "hi")).alias("b")).distinct()
    far = far.select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(False).alias("own")), F.struct(F.col("b").alias("t"), F.lit(True).alias("own")))).alias("x"), "a", "b")
    far = checkpointed(far.select(F.col("x.t").alias("t"), F.col("x.own").alias("own"), "a", "b"))

    spots = ranked.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("pass", "rank", "first", "tile"))).alias("spots"))
    full = classes.join(spots, "class")
    full = full.withColumn("ranks", F.col("spots.rank")).withColumn("firsts", F.col("spots.first"))
    each = full.select("class", "rep", "n", "label", "size", "vec", "ranks", "firsts", F.explode("spots").alias("s")).select("*", "s.pass", "s.tile").drop("s")
    near = each.withColumn("g", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("tile").alias("b")), F.struct(F.lit(False).alias("own"), (F.col("tile") + 1).alias("b")))))
    near = near.select(*each.columns, F.col("g.own").alias("own"), (F.col("g.b") - 1).alias("a"), F.col("g.b").alias("b"))
    dealt = near.unionByName(each.join(far, F.col("tile") == F.col("t")).drop("t")).drop("tile")

    kinds = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("rep", pa.int64()), ("root", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        out = {n: [] for n in kinds.names}
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        own = np.array(group.column("own").to_pylist(), bool)
        turn = group.column("pass").to_numpy()
        # rows of other passes, labels or lengths may share a tile
        parts: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(turn.tolist(), group.column("label").to_pylist(), group.column("size").to_pylist())):
            parts.setdefault(k, []).append(i)
        names, n = group.column("class").to_pylist(), group.column("n").to_numpy()
        reps = group.column("rep").to_numpy()
        ranks, firsts = (np.array(group.column(c).to_pylist(), np.int64) for c in ("ranks", "firsts"))
        vecs = group.column("vec").to_pylist()
        for (p, _, _), at in parts.items():
            at = np.array(at)[np.argsort(reps[at], kind="stable")]
            x = np.stack([np.frombuffer(vecs[i], np.float64) for i in at])
            x = x / np.abs(x).max(axis=1, keepdims=True)  # the same direction, no overflow
            norm = np.sqrt((x * x).sum(axis=1))
            cos = (x @ x.T) / (norm[:, None] * norm)
            i, j = np.nonzero(np.triu(cos >= threshold, 1))
            mine = own[at]
            # the other tile's own pairs belong to its own group; in a group of two far tiles only pairs across count
            good = (mine[i] != mine[j]) | ((mine[i] & mine[j]) if b == a + 1 else False)
            i, j = i[good], j[good]
            r, f = ranks[at], firsts[at]
            close = (np.abs(r[i] - r[j]) <= window) | (f[i] == f[j])
            new = close[:, p] & ~close[:, :p].any(axis=1)
            i, j = i[new], j[new]
            if not len(i):
                continue
            weight = n[at]
            links = np.bincount(i, weight[j], len(at)) + np.bincount(j, weight[i], len(at))
            root = _rooted(len(at), i, j)
            for k in np.flatnonzero(links):
                for name, value in zip(kinds.names, (names[at[k]], int(links[k]), int(reps[at[k]]), int(reps[at[root[k]]]))):
                    out[name].append(value)
        return pa.Table.from_pydict(out, schema=kinds)

    found = checkpointed(dealt.groupBy("a", "b").applyInArrow(compare, "class binary, links long, rep long, root long"))
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    about = classes.select("class", "rep", "n").join(sums, "class", "left").join(named, F.col("rep") == F.col("node"), "left")
    about = about.select(F.col("class").alias("c"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = classed.select("vec_id", "class").join(both_sides(about), F.col("class") == F.col("c"), "left")
    name = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.coalesce(F.col("vec_id") == name, F.lit(False)).alias("kept"))
