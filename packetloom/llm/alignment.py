"""Alignment of two tokenizers' tokens over the same bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import fresh_folder, lean

#: A chunk is white space and what follows it. Neither tokenizer merges across its borders (checked for the piece model).
CHUNK = r"[ \t\n]*[^ \t\n]+|[ \t\n]+"
#: Other white space may lie in one token with its neighbours, so texts with it are encoded whole.
OTHER_SPACE = r"[^\S \t\n]"
#: Text that is worked on at once, in characters; a longer text is worked on alone.
SLICE = 1 << 20


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of two tilings of the same bytes (given by their tokens' ends) the last A token of its component.

    Every token points to the overlapping token that reaches farthest right; a token of A that ends where one of B does
    points to itself, and so does that B token to it. Doubling the successors of all tokens at once ends at the terminals.
    """
    n = len(ends_a)
    b_of_a, a_of_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    successor = np.concatenate([np.where(ends_b[b_of_a] == ends_a, np.arange(n), n + b_of_a), a_of_b]) if n else np.zeros(0, np.int64)
    while True:
        doubled = successor[successor]
        if (doubled == successor).all():
            return successor[:n], successor[n:]
        successor = doubled


def _by_rank(tokenizer):
    """The same byte-level model as ranks, which encodes short texts faster, if its merges are in the order of their ids; else None."""
    import json

    import tiktoken

    spec = json.loads(tokenizer.to_str())
    cut, model, byte_of = spec["pre_tokenizer"] or {}, spec["model"], byte_alphabet()
    vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    joined = [vocabulary.get(x + y, -1) for x, y in merges]
    plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and model["type"] == "BPE" and not model.get("ignore_merges")
    if not plain or joined != sorted(set(joined)) or len(vocabulary) != 256 + len(merges) or not set(byte_of) <= set(vocabulary) or max(vocabulary[c] for c in byte_of) > joined[0]:
        return None
    words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bytes", pat_str=words, mergeable_ranks={bytes(byte_of[c] for c in t): k for t, k in vocabulary.items()}, special_tokens={})


class Aligner:
    """Groups and links of texts, remembered per chunk up to ``limit`` bytes."""

    def __init__(self, byte_path: str, piece_path: str, limit: int = 96 << 20):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.limit, self.size, self.memory = limit, 0, {}
        self.ranked = _by_rank(self.a)
        byte_of, self.a_bytes = byte_alphabet(), [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        merged = [p for k, p in enumerate(pieces) if len(p) > 1 and not self.b.is_byte(k) and not self.b.is_control(k) and not self.b.is_unknown(k)]
        self.by_chunk = self.b.encode("\n", out_type=str)[:1] == ["▁"] and not any("▁" in p.lstrip("▁") or re.search(r"[\t\n ]", p) for p in merged)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.code = np.dtype("<u4" if len(self.a_bytes) * len(self.b_bytes) < 1 << 32 else "<u8")
        # ids as text, each with what may follow it
        self.a_names, self.b_names = (np.array([f"{k}{end}".encode() for k in range(n) for end in ends], object) for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")))

    def _encoded(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by both tokenizers of chunks of a text that starts with the space that was put before it."""
        if self.ranked is not None:
            a = list(map(self.ranked.encode_ordinary, chunks))
        else:
            a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        # the piece model puts a space before each text: the chunk's own, or one too many
        return a, [ids[1:] if c[0] != " " else ids if c != " " else [self.space] for c, ids in zip(chunks, b)]

    def records(self, chunks: list[str]) -> list[tuple[bytes, bytes, bytes] | None]:
        """(groups, links, counts) of each chunk, or None where the tokens' bytes are not the chunk's."""
        a_ids, b_ids = self._encoded(chunks)
        want = list(map(str.encode, chunks))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        ends = np.fromiter(map(len, want), np.int64, len(want)).cumsum()
        sizes = [table[ids].cumsum() for table, ids in ((self.a_sizes, a), (self.b_sizes, b))]
        whole = all(n.all() and len(size) and (size[n.cumsum() - 1] == ends).all() for n, size in ((n_a, sizes[0]), (n_b, sizes[1])))
        text = b"".join(want)
        if whole and all(b"".join([table[i] for i in ids.tolist()]) == text for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return self._aligned(a, b, n_a, n_b)
        same = [b"".join([self.a_bytes[i] for i in x]) == own == b"".join([self.b_bytes[i] for i in y]) for own, x, y in zip(want, a_ids, b_ids)]
        ids = [[x for x, ok in zip(ids, same) if ok] for ids in (a_ids, b_ids)]
        flat, counts = ([f(x) for x in ids] for f in (lambda x: np.array([i for y in x for i in y], np.int64), lambda x: np.array(list(map(len, x)), np.int64)))
        found = iter(self._aligned(*flat, *counts) if any(same) else ())
        return [next(found) if ok else None for ok in same]

    def _aligned(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        """Records of chunks that have ``n_a`` of the ids ``a`` and ``n_b`` of the ids ``b`` each, over the same bytes."""
        ends_a, ends_b = self.a_sizes[a].cumsum(), self.b_sizes[b].cumsum()
        last_a, last_b = terminals(ends_a, ends_b)
        group = (last_a == np.arange(len(a))).cumsum() - 1
        group_a, group_b = group[last_a], group[last_b]
        # every token of A overlaps a run of tokens of B
        low = np.searchsorted(ends_b, ends_a - self.a_sizes[a], side="right")
        many = np.searchsorted(ends_b, ends_a) - low + 1
        first = many.cumsum() - many
        links = np.repeat(a * len(self.b_bytes), many) + b[np.repeat(low - first, many) + np.arange(many.sum())]
        # written as a group's tokens of A, then its tokens of B
        names = np.empty(len(a) + len(b), object)
        groups = int(group[-1]) + 1
        till_a, till_b = np.bincount(group_a, minlength=groups).cumsum(), np.bincount(group_b, minlength=groups).cumsum()
        own_a, own_b = np.arange(len(a)) + np.concatenate([[0], till_b])[group_a], np.arange(len(b)) + till_a[group_b]
        names[own_a] = self.a_names[2 * a + (np.arange(len(a)) == till_a[group_a] - 1)]
        names[own_b] = self.b_names[2 * b + (np.arange(len(b)) == till_b[group_b] - 1)]

        at_a, at_b = n_a.cumsum(), n_b.cumsum()
        in_group = np.diff(np.concatenate([[0], group_a[at_a - 1] + 1]))
        counts = np.stack([n_a, n_b, in_group], axis=1).astype("<u4").tobytes()
        wide = self.code.itemsize
        tokens, ends = (at_a + at_b).tolist(), (wide * (first[at_a - 1] + many[at_a - 1])).tolist()
        links, names = links.astype(self.code).tobytes(), names.tolist()
        runs = zip([0, *tokens], tokens, [0, *ends], ends, range(0, len(counts), 12))
        return [(b"".join(names[t:u]), links[s:e], counts[k : k + 12]) for t, u, s, e, k in runs]

    def texts(self, texts: list[str | None]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
        """(groups, links, (tokens of A, of B, groups)) of each text; texts without tokens have none."""
        none = (b"", np.zeros(0, self.code), np.zeros(3, np.int64))
        find, odd = re.compile(CHUNK).findall, re.compile(OTHER_SPACE).search
        cut = [None if not t else find(" " + t) if self.by_chunk and not odd(t) else [" " + t] for t in texts]
        if self.size > self.limit:
            self.memory, self.size = {}, 0
        memory = self.memory
        new = list({c for chunks in cut if chunks for c in chunks if c not in memory})
        for chunk, record in zip(new, self.records(new) if new else ()):
            memory[chunk] = record
            self.size += 320 + 2 * len(chunk) + (len(record[0]) + len(record[1]) if record else 0)
        out = []
        for text, chunks in zip(texts, cut):
            held = [memory[c] for c in chunks or ()]
            if None in held and len(held) > 1:
                held = self.records([" " + text])  # its parts differ, so all of it decides
            if not held or None in held:
                out.append(none)
                continue
            counts = np.frombuffer(b"".join([h[2] for h in held]), "<u4").reshape(-1, 3).sum(axis=0, dtype=np.int64)
            out.append((b"".join([h[0] for h in held])[:-1], np.frombuffer(b"".join([h[1] for h in held]), self.code), counts))
        for chunk in new:  # a text that was encoded whole isn't worth keeping
            if len(chunk) > 256 and (record := memory.pop(chunk, None)):
                self.size -= 320 + 2 * len(chunk) + len(record[0]) + len(record[1])
        return out


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The worker process's own aligner, kept where the next task of the same worker finds it."""
    import os
    import sys
    import types

    held = sys.modules.setdefault("packetloom_worker_aligner", types.ModuleType("packetloom_worker_aligner")).__dict__
    if (byte_path, piece_path) not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return held[byte_path, piece_path]


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None, block_chars: int = 8 << 20, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every row of ``docs``.

    Each text, with a space before it, is encoded by a byte-level tokenizer (A) and by a piece model (B, which adds the space
    itself), special tokens' strings being plain text. Byte offsets where tokens of both end cut the tokens into groups,
    written ``a1,a2|b1;a3|b2,b3``; a link is a token of A and a token of B whose bytes overlap. An id pair's count is the
    number of rows that hold it linked; ``n_best`` counts a row's links whose count is the highest of their A id, ``count_sum`` adds up the
    counts of its links. Null and empty texts, and texts whose tokens' bytes are not the text's, have no tokens: zeros, and an
    empty string instead of a digest. Null and repeated ids are rows like any other; an empty table gives an empty result.

    Tokens become groups by pointer jumping (:func:`terminals`), once per different chunk of text in a worker. Rows are worked
    on in blocks of about ``block_chars``, which list their id pairs once each: pairs are counted over the blocks and come back as a list
    for the block's own pairs, so the shuffles hold a row for each pair of a block, not for each link, and no task needs all pairs.
    Blocks are written below the checkpoint folder, so a lost executor repeats its blocks only.
    """
    spark = docs.sparkSession
    byte_path, piece_path = tokenizers or default_tokenizers()
    about = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.int64())])
    if with_groups:
        about = about.append(pa.field("groups", pa.string()))
    kinds = pa.schema([("block", pa.int64()), ("b_ids", pa.int64()), ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())), ("rows", pa.binary()), ("uses", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = aligner(byte_path, piece_path)
        number, size = TaskContext.get().partitionId() << 32, 0
        held, codes, times = {n: [] for n in about.names}, [], []

        def block() -> pa.RecordBatch:
            each = np.concatenate(codes) if codes else np.zeros(0, own.code)
            pairs, place, holders = np.unique(each, return_inverse=True, return_counts=True)
            uses = pa.table({"place": place.astype(np.int32), "times": np.concatenate(times).astype(np.int32) if times else np.zeros(0, np.int32)})
            values = [[number], [len(own.b_bytes)], [pairs.astype(np.int64)], [holders.astype(np.int32)], [_ipc(pa.Table.from_pydict(held, schema=about))], [_ipc(uses)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.types)], schema=kinds)

        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < len(batch):
                some, chars = [], 0
                while at + len(some) < len(batch) and (not some or chars < SLICE):
                    some.append(texts[at + len(some)].as_py())
                    chars += len(some[-1] or "")
                for k, (groups, links, counts) in enumerate(own.texts(some)):
                    pairs, many = np.unique(links, return_counts=True)
                    codes.append(pairs)
                    times.append(many)
                    values = (ids[at + k].as_py(), *counts.tolist(), len(links), hashlib.sha256(groups).hexdigest() if groups else "", len(pairs), groups.decode())
                    for n, v in zip(about.names, values):
                        held[n].append(v)
                at += len(some)
                size += chars
                if size >= block_chars:
                    yield block()
                    number, size = number + 1, 0
                    held, codes, times = {n: [] for n in about.names}, [], []
        if held["doc_id"]:
            yield block()

    folder = fresh_folder(spark, "alignment")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    rows.mapInArrow(lean(blocks), "block long, b_ids long, codes array<long>, holders array<int>, rows binary, uses binary").write.parquet(folder)
    stored = spark.read.parquet(folder)

    each = stored.select("block", "b_ids", F.posexplode(F.arrays_zip("codes", "holders")).alias("place", "pair"))
    each = each.select("block", "place", F.col("pair.codes").alias("code"), F.col("pair.holders").alias("holders"), F.floor(F.col("pair.codes") / F.col("b_ids")).alias("a"))
    counts = each.groupBy("code", "a").agg(F.sum("holders").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most")).withColumnRenamed("a", "of")
    known = counts.join(most, F.col("a") == F.col("of")).select(F.col("code").alias("known"), "count", (F.col("count") == F.col("most")).alias("best"))
    back = each.select("block", "place", "code").join(known, F.col("code") == F.col("known"))
    lists = back.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("found"))
    lists = lists.select(F.col("block").alias("__block"), F.col("found.count").alias("counts"), F.col("found.best").alias("bests"))
    joined = stored.select("block", "rows", "uses").join(lists, F.col("block") == F.col("__block"), "left").select("rows", "uses", "counts", "bests")

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                table = pa.ipc.open_stream(batch.column(0)[k].as_buffer()).read_all()
                uses = pa.ipc.open_stream(batch.column(1)[k].as_buffer()).read_all()
                counts, bests = (batch.column(c)[k].values for c in (2, 3))
                counts = counts.to_numpy(zero_copy_only=False) if counts is not None else np.zeros(0, np.int64)
                bests = bests.to_numpy(zero_copy_only=False) if bests is not None else np.zeros(0, bool)
                place, times = (uses.column(c).to_numpy().astype(np.int64) for c in ("place", "times"))
                ends = table.column("pairs").to_numpy().cumsum()
                sums = [np.concatenate([[0], v.cumsum()]) for v in (times * bests[place], times * counts[place])]
                best, total = (s[ends] - s[ends - table.column("pairs").to_numpy()] for s in sums)
                measures = {"n_best": best.astype(np.int64), "count_sum": total.astype(np.int64)}
                out = {n: measures[n] if n in measures else table.column(n) for n in names}
                yield from pa.table(out).to_batches()

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return joined.mapInArrow(lean(result), ", ".join(f"{n} {'string' if n.startswith('groups') else 'long'}" for n in names))
