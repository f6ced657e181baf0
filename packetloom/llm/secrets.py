"""Secrets in texts: fixed patterns, and guess costs of values in credential contexts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths are fixed by contract.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 and more; a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Where a value is taken for a credential: after a key and a sign, in a URL's user part, after an authorisation scheme.
CONTEXTS = (
    re.compile(
        r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|auth)["']?[ \t]*(?:[:=]|=>|:=)[ \t]*["']?([^\s"'<>,;]{6,})""",
        re.IGNORECASE | re.ASCII,
    ),
    re.compile(r"""(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*|[a-z][a-z0-9+.-]{1,15})://[^\s:/@"'<>]*:([^\s/@"'<>]{6,})@""", re.IGNORECASE | re.ASCII),
    re.compile(r"""authorization["']?[ \t]*[:=][ \t]*["']?(?:bearer|basic|token)[ \t]+([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII),
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "://")

# Words that guessers try first, the likeliest first.
WORDS = (
    "password pass admin root user login welcome letmein secret master test demo guest default changeme example sample "
    "qwerty dragon monkey football baseball princess sunshine shadow superman batman iloveyou hello love money freedom "
    "whatever trustno starwars computer internet server system manager oracle mysql postgres database public private "
    "access token key api value string number null none true false your my the this that here enter insert replace "
    "placeholder dummy foo bar baz temp tmp dev prod stage local host office company summer winter spring autumn monday "
    "friday january june july august october december green blue red black white orange silver gold star tiger lion eagle"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
# Rows of a keyboard and the two natural orders.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
STEPS = {pair for row in WALKS for pair in [*zip(row, row[1:]), *zip(row[1:], row)]}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")


def _letter(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def _walks(low: str) -> Iterator[tuple[int, int]]:
    """(start, end) of keyboard walks of 3 and more: each longest run, its beginnings and its endings."""
    start, n = 0, len(low)
    while start < n:
        end = start + 1
        while end < n and (low[end - 1], low[end]) in STEPS:
            end += 1
        yield from ((start, k) for k in range(start + 3, end + 1))
        yield from ((k, end) for k in range(start + 1, end - 2))
        start = end


def _repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, unit, times) of units of up to 16 that follow themselves: in each longest stretch with that period, from each of its
    first starts, any number of times (twice at least, single characters three times)."""
    n = len(value)
    for unit in range(1, min(16, n // 2) + 1):
        start = 0
        while start + unit < n:
            end = start
            while end + unit < n and value[end] == value[end + unit]:
                end += 1
            for first in range(start, min(start + unit, end - unit + 1)):
                yield from ((first, unit, times) for times in range(2 if unit > 1 else 3, (end + unit - first) // unit + 1))
            start = end + 1


def guess_cost(value: str, known: dict[str, float] | None = None) -> float:
    """Decimal logarithm of the guesses that the cheapest way of writing ``value`` needs.

    Dynamic programming over positions: the cheapest cover by words (by rank), dates, repeats of a unit (:func:`_repeats`), keyboard
    walks (:func:`_walks`) and brute-force characters. Each pattern costs a factor of 2 for the choice. Time grows with the length,
    since every place has a bounded number of patterns; a unit's own cost is found once.
    """
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    known = {} if known is None else known
    choice = math.log10(2)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for start, end in _walks(low):
        ends[start].append((end, math.log10(47 * 2 * (end - start))))
    for start, unit, times in _repeats(value):
        own = value[start : start + unit]
        if own not in known:
            known[own] = guess_cost(own, known)
        ends[start].append((start + unit * times, known[own] + math.log10(times)))
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + _letter(value[i]))
        for size in range(2, min(LONGEST, n - i) + 1):
            rank = RANK.get(low[i : i + size])
            if rank:
                shape = 0.0 if value[i : i + size] == low[i : i + size] else choice
                best[i + size] = min(best[i + size], here + choice + math.log10(rank) + shape)
        if value[i].isdigit():
            m = DATE.match(value, i)
            if m:
                best[m.end()] = min(best[m.end()], here + choice + math.log10(120 if m.end() - i == 4 else 365 * 120))
        for end, cost in ends[i]:
            best[end] = min(best[end], here + choice + cost)
    return best[n]


def spans_of(text: str, least: float = 8.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of ``text``, by start, then kind as listed in ``KINDS``."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        values = {}
        for context in CONTEXTS:
            for m in context.finditer(text):
                quoted = text[m.end(1) : m.end(1) + 1] in ('"', "'")
                value = m.group(1) if quoted else m.group(1).rstrip(".:!?)]}")
                if len(value) >= 6:
                    values[m.start(1)] = max(values.get(m.start(1), ""), value, key=len)
        found += [("guess", at, at + len(v)) for at, v in values.items() if guess_cost(v) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 8.0) -> DataFrame:
    """(doc_id, spans) of every row: spans are (kind, start, end) in code points, end exclusive, over the whole text.

    Kinds ``assign``, ``access`` and ``hex`` are leftmost matches that do not overlap within their kind. ``guess`` marks
    a value in a credential context (key and sign, URL user part, authorisation scheme) whose guess cost is at
    least 10 ** ``least``. Null texts are empty. Rows are independent, so repeats and null ids come out as they are.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t.as_py() or "", least)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
