"""Packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import lean, numbered_within
from packetloom.llm.tokens import default_tokenizer, word_ids
from packetloom.operators.durable import checkpointed

#: Pieces leave a task whenever their ids would fill so many bytes.
OUTPUT_BYTES = 1 << 20


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """[(length, copies)] of the combination with the least slack in ``capacity``: subset sums as the bits of one integer.

    The longest length is always in it, so every bin takes what is hardest to place. The others are folded in from long
    to short, their copies by powers of two, until a sum meets the space that is left; the sums before each
    step are kept for the way back.
    """
    lengths = sorted(counts, reverse=True)
    space = capacity - lengths[0]
    mask = (1 << (space + 1)) - 1
    sums, steps = 1, []
    for n in lengths:
        copies, part = min(counts[n] - (n == lengths[0]), space // n if n else 0), 1
        while copies > 0:
            part = min(part, copies)
            steps.append((n, part, sums))
            sums |= (sums << (part * n)) & mask
            copies -= part
            part *= 2
        if sums >> space:
            break
    best = sums.bit_length() - 1
    used = defaultdict(int, {lengths[0]: 1})
    for n, part, without in reversed(steps):
        if not without >> best & 1:
            used[n] += part
            best -= part * n
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, combination)]: the fullest combination is removed as often as the counts allow, then the next is sought.

    Each round uses up at least one length, so there are at most ``capacity`` rounds whatever the number of documents.
    """
    counts = {n: c for n, c in counts.items() if c}
    rounds = []
    while counts:
        combination = fullest(counts, capacity)
        bins = min(counts[n] // copies for n, copies in combination)
        for n, copies in combination:
            counts[n] -= bins * copies
            if not counts[n]:
                del counts[n]
        rounds.append((bins, combination))
    return rounds


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]): each whole text's ids and the end id, cut into pieces of ``capacity`` only where longer. Null texts are empty ones."""
    path = tokenizer or default_tokenizer()
    kinds = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    if with_ids:
        kinds = kinds.append(pa.field("ids", pa.list_(pa.int32())))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, out, size = word_ids(path), defaultdict(list), 0
        for batch in batches:
            for doc, row, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = memory.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    held = data[at : at + 4 * capacity]
                    for name, value in zip(kinds.names, (doc.as_py(), row.as_py(), piece, at // 4, len(held) // 4, zlib.crc32(held))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(held, "<i4"))
                size += len(data) + 256
                if size >= OUTPUT_BYTES:
                    yield pa.RecordBatch.from_pydict(out, schema=kinds)
                    out, size = defaultdict(list), 0
        if size:
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    columns = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)), F.col(text_col)).mapInArrow(lean(cut), columns)


def pack(pieces: DataFrame, ties: list[str], capacity: int = 4096, seed: int = 11) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Only the counts by length reach the driver, at most ``capacity`` numbers. From them :func:`plan` makes rounds of
    equal bins; pieces are numbered within their length in a seeded order of ``ties``, and a piece's number gives its bin
    and place by search in a table of at most one row per round and length (under ``capacity`` rounds of under
    ``sqrt(2 * capacity)`` lengths). ``pieces`` should be stored. Repeated rows are packed as often as they come.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for bins, combination in plan(counts, capacity):
        at = 0
        for n, copies in combination:
            runs[n].append((used[n], first, at, copies))
            used[n] += bins * copies
            at += copies * n
        first += bins
    tables = {n: np.array(r, np.int64) for n, r in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, length = batch.column("__n").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    n = int(length[part[0]])
                    table = tables[n]
                    start, bin_id, at, copies = table[np.searchsorted(table[:, 0], number[part], side="right") - 1].T
                    sequence[part] = bin_id + (number[part] - start) // copies
                    offset[part] = at + (number[part] - start) % copies * n
            kept = batch.select([n for n in batch.schema.names if n not in ("__n", "__total")])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    numbered = numbered_within(pieces, ["length"], ties, seed=seed)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name not in ("__n", "__total"))
    return numbered.mapInArrow(lean(place), f"{columns}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (see :func:`pieces_of`) with their sequence and place in it; other columns are ignored.

    Null ids and rows that repeat an id are packed like any other; an empty table gives an empty result.
    """
    pieces = checkpointed(pieces_of(docs, id_col, text_col, tokenizer, end_id, capacity, with_ids))
    return pack(pieces, ["doc_id", "row", "piece"], capacity).drop("row")
