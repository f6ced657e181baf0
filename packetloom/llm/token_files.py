"""Token ids in bit-packed binary files, and reading them back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import lean
from packetloom.llm.tokens import default_tokenizer, vocabulary_size, word_ids

# File format, one file per shard, little-endian; a shard holds documents in ascending id order and shards follow each
# other in that order too (their number is in the header):
#   magic "PLTOK1\0\0" | bits u32 | block u32 | shard u64 | documents u64 | tokens u64 | blocks u64
#   document ids i64 x documents (the least i64 stands for null) | document starts u64 x documents (+ the end)
#   block offsets u64 x blocks (+ the end), from the start of the payload | payload | line feed
# Block k holds ids k * block .. of the shard, each in ``bits`` bits, lowest bit first, padded to whole bytes.
MAGIC = b"PLTOK1\0\0"
HEAD = "<8sIIQQQQ"
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def write_shard(shard: int, doc_ids, ids: np.ndarray, starts: np.ndarray, bits: int, block: int) -> bytes:
    """One file's bytes. ``starts`` has one entry more than ``doc_ids``."""
    parts = [pack_bits(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.uint64)
    own = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    head = struct.pack(HEAD, MAGIC, bits, block, shard, len(own), len(ids), len(parts))
    return b"".join([head, own.tobytes(), starts.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *parts])


class Shard:
    """A file's bytes (or a memory map of them) with random access to any run of ids."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.number, docs, self.tokens, blocks = struct.unpack_from(HEAD, self.data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.frombuffer(self.data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` .. of the shard; only the blocks that hold them are unpacked."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        out = []
        for k in range(first, last + 1):
            held = min(self.block, self.tokens - k * self.block)
            piece = self.data[self.payload + self.offsets[k] : self.payload + self.offsets[k + 1]]
            out.append(unpack_bits(piece, held, self.bits))
        run = np.concatenate(out)
        return run[start - first * self.block :][:count]


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, block: int = 4096, shard_bytes: int = 8 << 20) -> int:
    """Write the ids of every whole text below ``folder``; returns the bits of an id.

    Texts (null: empty) are dealt out by ranges of the id, sorted, encoded and packed, one file per task of about
    ``shard_bytes`` of text, so a task holds one shard. Null ids come first; rows that repeat an id follow each other
    by their text. Spark's text sink writes the bytes, with its commit of finished tasks: a lost executor's files are
    written again, never twice. Other columns are ignored; an empty table writes no documents.
    """
    path = tokenizer or default_tokenizer()
    bits = bits_for(max(vocabulary_size(path), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    end = np.array([end_id], np.uint32)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memory, own, parts = word_ids(path), [], []
        for batch in batches:
            own += batch.column(0).to_pylist()
            for text in batch.column(1):
                parts.append(memory.encode(text.as_py()) + end.tobytes())
        starts = np.cumsum([0, *(len(p) // 4 for p in parts)])
        ids = np.frombuffer(b"".join(parts), np.uint32)
        data = write_shard(TaskContext.get().partitionId(), own, ids, starts, bits, block)
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    ordered = rows.repartitionByRange(shards, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    ordered.mapInArrow(lean(shard), "value binary").select(F.col("value").cast("string").alias("value")).write.text(folder)
    return bits


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of ``folder``; one file per task row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                s = Shard(content.as_buffer())
                yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "shard": [s.number], "tokens": [s.tokens]})

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        if with_ids:
            kinds = kinds.append(pa.field("ids", pa.list_(pa.int32())))
        for batch in batches:
            for content in batch.column(1):
                s = Shard(content.as_buffer())
                ids = s.read(0, s.tokens).astype("<u4")
                data = memoryview(ids.tobytes())
                n = np.diff(s.starts)
                out = {
                    "shard": [s.number] * len(n),
                    "doc_id": [None if d == NO_ID else d for d in s.doc_ids.tolist()],
                    "at": s.starts[:-1],
                    "n_tokens": n,
                    "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(s.starts[:-1].tolist(), s.starts[1:].tolist())],
                }
                if with_ids:
                    out["ids"] = [ids[a:b].astype(np.int32) for a, b in zip(s.starts[:-1], s.starts[1:])]
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    columns = "shard long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    held = files.mapInArrow(lean(documents), columns)
    totals = files.mapInArrow(sizes, "path string, shard long, tokens long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    places = totals.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("__before"))
    out = held.join(places, F.col("shard") == F.col("__shard"))
    return out.select("doc_id", (F.col("__before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
