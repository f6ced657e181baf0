"""Benchmark passages in documents, found by one Aho-Corasick automaton over words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.durable import checkpointed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Longer texts are read in pieces of about so many characters; the automaton goes on from piece to piece.
PIECE = 1 << 20


def lowered(text: str) -> str:
    """A-Z lower-cased, every other character as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def word_pieces(text: str, size: int = PIECE) -> Iterator[list[str]]:
    """The words of ``text``, lower-cased, in lists; a text is cut only between words."""
    find, gap, at = re.compile(WORD).findall, re.compile(GAP), 0
    while at < len(text):
        end = len(text)
        if end - at > size and (cut := gap.search(text, at + size)):
            end = cut.start()
        yield find(lowered(text[at:end] if at or end < len(text) else text))
        at = end


class Passages:
    """The windows of some items: ``window`` consecutive words each, or all of an item that has fewer.

    Words become numbers, and a number its digits to base 128 with symbols of their own for each place, so no node of the
    automaton has more than 128 ways on, and a position in the digits gives a word's position.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        numbers: dict[str, int] = {}
        held: dict[tuple, set[str]] = {}
        for name, text in items:
            words = [numbers.setdefault(w, len(numbers)) for piece in word_pieces(text) for w in piece]
            for i in range(max(len(words) - window, 0) + 1 if words else 0):
                held.setdefault(tuple(words[i : i + window]), set()).add(name)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if held else None
        self.width = 1
        while 128**self.width < len(numbers):
            self.width += 1
        digits = lambda n: tuple(128 * k + n // 128**k % 128 + 1 for k in reversed(range(self.width)))
        self.digits = {w: digits(n) for w, n in numbers.items()}
        names_of = list(self.digits.values())
        for key, names in held.items():
            self.tree.add_word(tuple(chain.from_iterable([names_of[n] for n in key])), (len(key), tuple(names)))
        if held:
            self.tree.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, [(first, last word)] of every occurrence, names of the items) of one text."""
        n, found, names, search = 0, [], set(), None
        digits, width, other = self.digits.get, self.width, (0,) * self.width
        for words in word_pieces(text):
            if self.tree is not None and words:
                key = tuple(chain.from_iterable([digits(w, other) for w in words]))
                if search is None:
                    search = self.tree.iter(key)
                else:
                    search.set(key)
                for at, (length, of) in search:
                    end = at // width
                    found.append((end - length + 1, end))
                    names.update(of)
            n += len(words)
        return n, found, names


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed ranges as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def word_spans(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code points (end exclusive) in ``text`` of runs of words."""
    out, waiting, start = [], iter(runs), 0
    run = next(waiting, None)
    for k, word in enumerate(re.finditer(WORD, lowered(text))):
        if run is None:
            break
        if k == run[0]:
            start = word.start()
        if k == run[1]:
            out.append({"start": start, "end": word.end()})
            run = next(waiting, None)
    return out


def _held(token: str, items: list[tuple[str, str]], window: int) -> Passages:
    """The worker's automaton; only the latest one is kept."""
    import sys
    import types

    kept = sys.modules.setdefault("packetloom_worker_passages", types.ModuleType("packetloom_worker_passages")).__dict__
    if kept.get("token") != token:
        kept["passages"] = None
        kept["passages"], kept["token"] = Passages(items, window), token
    return kept["passages"]


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of at most ``block_bytes`` of text, or of one item that is longer; one list on the driver at a time."""
    block, size = [], 0
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")).where("text is not null")
    for row in named.toLocalIterator():
        own = len(row["text"].encode())
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["name"], row["text"]))
        size += own
    yield block


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    keep: list[str] | None = None,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``spans`` added: the passages of ``items`` in every whole text.

    Texts are lower-cased (A-Z) and cut into words of digits, letters and all that is not ASCII. ``window`` consecutive
    words of an item are a window; an item with fewer words, but not none, is one window. ``n_hit`` counts a document's words
    inside any occurrence of a window, ``items`` names (as strings, without repeats) the items with a window that occurs,
    ``spans`` are the maximal runs of words hit, as code points (end exclusive) of the original text.

    All windows of up to ``block_bytes`` of items make one automaton (about a hundred times that in a worker's memory), which
    reads a text once. Larger item tables take a pass for each block, and the passes' runs are united; the driver and
    the broadcast hold one block. Null and empty texts have no words; items without words occur nowhere; rows with the same
    item id are one item, a null id is named ''. ``keep`` lists the columns of ``docs`` to carry (default: all); columns named like
    an added one are replaced. Repeated rows stay repeated, and empty tables give no rows or no hits.
    """
    added = ("n_words", "n_hit", "items", "spans")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    run, span = T.StructType().add("first", "long").add("last", "long"), T.StructType().add("start", "long").add("end", "long")
    own = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = docs.select(own.alias("doc"), F.col(text_col).alias("text"), F.array().cast(T.ArrayType(run)).alias("runs"), F.array().cast("array<string>").alias("items"))
    base = T.StructType([rows.schema["doc"], rows.schema["text"]])
    schema = T.StructType([*base.fields, *T.StructType().add("runs", T.ArrayType(run)).add("items", T.ArrayType(T.StringType())).add("n_words", "long").add("spans", T.ArrayType(span)).fields])
    kinds = [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string()), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def reader(block: list[tuple[str, str]], final: bool):
        shared, token = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = _held(token, shared.value, window)
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for text, before, names in zip(batch.column(1), batch.column(2), batch.column(3)):
                    text = text.as_py() or ""
                    n, found, of = passages.scan(text)
                    runs = merged(found + [(r["first"], r["last"]) for r in before.as_py()]) if found or len(before) else []
                    values = ([{"first": a, "last": b} for a, b in runs], sorted(of | set(names.as_py())), n, word_spans(text, runs) if runs else [])
                    for column, value in zip(out, values):
                        column.append(value)
                text = pa.nulls(len(batch), pa.string()) if final else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), text, *(pa.array(v, k) for v, k in zip(out, kinds))], names=schema.fieldNames())

        return scan

    blocks = _blocks(items, item_col, item_text_col, block_bytes)
    block = next(blocks)
    while (after := next(blocks, None)) is not None:
        rows = checkpointed(rows.mapInArrow(reader(block, False), schema).select("doc", "text", "runs", "items"))
        block = after
    found = rows.mapInArrow(reader(block, True), schema)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"] + 1)
    return found.select(*[F.col("doc")[c].alias(c) for c in kept], "n_words", hit.alias("n_hit"), "items", "spans")
