"""Exact top-k inner products by no-random-access aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from packetloom.operators.durable import checkpointed

LONG = (1 << 63) - 1
#: A scaled component from here on makes its row large: such rows have blocks of their own.
LARGE = 1 << 24
#: How far the lists are read between two tests of the bounds, as parts of their length.
READS = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 1)


def exact_type(queries: np.ndarray, values: np.ndarray):
    """A number type in which no partial sum of an inner product is rounded; Python's integers where no other will do."""
    most = [int(np.abs(x).max(initial=0)) for x in (queries, values)]
    bound = most[0] * most[1] * queries.shape[1]
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < LONG else object


def _whole(x: np.ndarray, kind) -> np.ndarray:
    """Integral doubles as numbers of ``kind``."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


def _as_long(x: np.ndarray) -> np.ndarray:
    """The nearest longs of Python's integers; the order of what differs afterwards is kept."""
    return np.array([max(-LONG - 1, min(LONG, int(v))) for v in x.ravel()], np.int64).reshape(x.shape)


class SortedLists:
    """One list per dimension over a block of candidates (ids ascending), readable from either end."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, kind):
        self.ids, self.kind = ids, kind
        self.values = _whole(values, kind)  # (candidates, dimensions)
        self.sorted = np.sort(self.values, axis=0)

    def bounds(self, positive: np.ndarray, negative: np.ndarray, depth: int, among: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of the candidates ``among`` after ``depth`` entries of each list were read.

        A query reads a list from the top where its own component is positive, from the bottom where it is negative.
        What was read counts as it is. An entry not yet read lies between the last one read and the list's far end. Once the lists are
        read to their ends, both bounds are the score.
        """
        x, top, bottom = self.values[among], self.sorted[-depth], self.sorted[depth - 1]
        upper = positive @ np.maximum(x, top).T + negative @ np.minimum(x, bottom).T
        lower = positive @ np.where(x >= top, x, self.sorted[0]).T + negative @ np.where(x <= bottom, x, self.sorted[-1]).T
        return (_as_long(lower), _as_long(upper)) if self.kind is object else (lower, upper)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.partition(values, -k, axis=1)[:, -k]


def aggregate(query_ids: np.ndarray, queries: np.ndarray, blocks: Iterator[SortedLists], k: int, reads: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(ids, scores)] of the ``k`` best candidates of each query, ties to the smaller id, a query's own id left out.

    Blocks are read one after the other, and in each the lists in the steps of ``READS`` to their ends. After every step a query's
    outsiders are dropped: candidates whose upper bound is below the k-th best lower bound, or below the k-th best score of earlier
    blocks. A query stops reading once at most ``k`` candidates are left (or none), whose scores are then resolved; what is still
    left at the lists' ends has its score from them. Later steps look only at candidates that some query has not dropped.
    ``reads``, if given, takes for each query and block the part of the lists that was read.
    """
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    floor = np.full(len(query_ids), -LONG - 1)
    for block in blocks:
        q = _whole(queries, block.kind)
        positive, negative = (q > 0) * q, (q < 0) * q
        n = len(block.ids)
        reading, among = np.arange(len(q)), np.arange(n)
        left = block.ids != query_ids[:, None]
        for depth in sorted({max(1, round(part * n)) for part in READS}):
            lower, upper = block.bounds(positive[reading], negative[reading], depth, among)
            own = left[np.ix_(reading, among)]
            least = floor[reading].astype(lower.dtype)
            if len(among) >= k:  # a candidate that was dropped or is the query itself counts for less than all others
                worst = max(int(lower.min()) - 1, -LONG - 1)
                least = np.maximum(least, _kth(np.where(own, lower, lower.dtype.type(worst)), k))
            own &= upper >= least[:, None]
            left[np.ix_(reading, among)] = own
            done = (own.sum(axis=1) <= k) | (depth == n)
            for row in np.flatnonzero(done).tolist():
                i, at = int(reading[row]), among[own[row]]
                if reads is not None:
                    reads.append(depth / n)
                if len(at):
                    scores = lower[row][own[row]] if depth == n else block.values[at] @ q[i]
                    _merge(best, floor, i, block.ids[at], scores, k)
            reading = reading[~done]
            if not len(reading):
                break
            among = np.flatnonzero(left[reading].any(axis=0))
    return best


def _merge(best, floor, i, ids, scores, k) -> None:
    scores = _as_long(scores) if scores.dtype == object else scores.astype(np.int64)
    ids, scores = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], scores])
    order = _best(ids, scores, k)
    best[i] = ids[order], scores[order]
    if len(order) == k:
        floor[i] = scores[order[-1]]


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(size, block, ids, values): rows (id, size, large, v) of a block in one row, ids ascending; large rows have blocks of their own."""

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        values = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float64).reshape(len(ids), -1)[order]
        out = {"size": [values.shape[1]], name: [group.column(name)[0].as_py()], f"{name}_ids": [ids[order].tobytes()], f"{name}_v": [values.tobytes()]}
        return pa.Table.from_pydict(out, schema=pa.schema([("size", pa.int32()), (name, pa.int32()), (f"{name}_ids", pa.binary()), (f"{name}_v", pa.binary())]))

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("size", "large", name).applyInArrow(pack, f"size int, {name} int, {name}_ids binary, {name}_v binary")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, candidates: int = 8192, queries: int = 512, lists: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the ``k`` highest integer inner products.

    Components become ``floor(scale * x)`` with x as double. Candidates are all rows but those with the query's own id, of
    the same number of components; ties go to the smaller id; all candidates if there are fewer than ``k``. Null, empty
    vectors, those that hold null or non-finite components (also once scaled), and null ids take no part. A score beyond a long is the
    nearest long. Repeated rows are candidates each, and one query. An empty table gives an empty result.

    Candidates and queries are dealt out by a hash to blocks of bounded size, each pair of blocks is a task's row, and
    within it :func:`aggregate` reads sorted lists; a query's best of all blocks are ranked at the end. Products are exact: numbers
    are as wide as a pair of blocks needs, and rows with components of 2^24 and more have their own blocks, so that others stay fast.
    """
    kinds = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("large", pa.bool_()), ("v", pa.binary()), ("q", pa.bool_())])

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in kinds.names}
            for own, given, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own is None or not given or None in given:
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(scale * np.array(given, np.float64))
                if np.isfinite(scaled).all():
                    for n, v in zip(kinds.names, (own, len(given), bool(np.abs(scaled).max() >= LARGE), (scaled + 0.0).tobytes(), bool(asked))):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    vector = F.col(vector_col).cast(T.ArrayType(T.DoubleType()))
    given = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    held = checkpointed(given.mapInArrow(quantise, "id long, size int, large boolean, v binary, q boolean"))
    sizes = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    c_blocks, q_blocks = max(1, -(-sizes["n"] // candidates)), max(1, -(-(sizes["q"] or 0) // queries))
    left = _packed(held.select("id", "size", "large", "v"), c_blocks, "c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = _packed(held.where("q").select("id", "size", "large", "v").distinct(), q_blocks, "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    grid = left.join(right, ["size", "q", "c"]).select("c_ids", "c_v", "q_ids", "q_v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c_ids, c_v, q_ids, q_v in zip(*(batch.column(i) for i in range(4))):
                ids, asked = np.frombuffer(c_ids.as_buffer(), np.int64), np.frombuffer(q_ids.as_buffer(), np.int64)
                values = np.frombuffer(c_v.as_buffer(), np.float64).reshape(len(ids), -1)
                wanted = np.frombuffer(q_v.as_buffer(), np.float64).reshape(len(asked), -1)
                kind = exact_type(wanted, values)
                parts = (SortedLists(ids[a : a + lists], values[a : a + lists], kind) for a in range(0, len(ids), lists))
                best = aggregate(asked, wanted, parts, k)
                yield pa.RecordBatch.from_pydict(
                    {"query_id": np.repeat(asked, [len(b[0]) for b in best]), "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best])},
                    schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]),
                )

    found = grid.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
