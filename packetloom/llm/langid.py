"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import lean

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteTagger:
    """A gated recurrent layer in each direction over bytes; every position gets a probability per language.

    Bytes enter through one table per direction (256 x 3 gates), so the input needs no product. Weights are float32
    arrays in ``w``; ``f`` and ``b`` name the directions.
    """

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 5):
        own = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        draw = lambda *shape: own.normal(0, 0.3, shape).astype(np.float32)
        self.w = {"out": np.zeros(len(labels), np.float32)}
        for side in "fb":
            self.w |= {f"{side}in": draw(256, 3 * hidden), f"{side}u": draw(hidden, 3 * hidden), f"{side}c": draw(hidden), f"{side}out": draw(hidden, len(labels))}

    # ------------------------------------------------------------ training

    def _run(self, side: str, bytes_: np.ndarray):
        """States of one direction over (time, batch) with what the way back needs."""
        h, u, c = self.hidden, self.w[f"{side}u"], self.w[f"{side}c"]
        given = self.w[f"{side}in"][bytes_]
        state = np.zeros((bytes_.shape[1], h), np.float32)
        kept = []
        for t in range(len(bytes_)) if side == "f" else range(len(bytes_) - 1, -1, -1):
            a = state @ u
            gates = _sigmoid(given[t, :, : 2 * h] + a[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            inner = a[:, 2 * h :] + c
            n = np.tanh(given[t, :, 2 * h :] + r * inner)
            new = n + z * (state - n)
            kept.append((t, state, z, r, inner, n, new))
            state = new
        return kept

    def gradients(self, bytes_: np.ndarray, wanted: np.ndarray):
        """(mean cross entropy over all positions, gradients) for windows (time, batch) of languages (batch)."""
        length, batch = bytes_.shape
        h, grads, kept, states = self.hidden, {}, {}, {}
        for side in "fb":
            kept[side] = self._run(side, bytes_)
            states[side] = np.stack([k[6] for k in sorted(kept[side], key=lambda k: k[0])])
        logits = states["f"] @ self.w["fout"] + states["b"] @ self.w["bout"] + self.w["out"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        loss = -np.log(p[:, np.arange(batch), wanted] + 1e-9).mean()
        p[:, np.arange(batch), wanted] -= 1
        p /= length * batch
        grads["out"] = p.sum(axis=(0, 1))
        for side in "fb":
            w_out, u = self.w[f"{side}out"], self.w[f"{side}u"]
            grads[f"{side}out"] = np.tensordot(states[side], p, ([0, 1], [0, 1]))
            below = p @ w_out.T
            d_u, d_in = np.zeros_like(u), np.zeros((length, batch, 3 * h), np.float32)
            d_c, back = np.zeros(h, np.float32), np.zeros((batch, h), np.float32)
            for t, before, z, r, inner, n, _ in reversed(kept[side]):
                d = below[t] + back
                d_n = d * (1 - z) * (1 - n * n)
                d_z = d * (before - n) * z * (1 - z)
                d_r = d_n * inner * r * (1 - r)
                d_in[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                through = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_c += through[:, 2 * h :].sum(axis=0)
                d_u += before.T @ through
                back = d * z + through @ u.T
            flat, at = d_in.reshape(-1, 3 * h), bytes_.ravel()
            grads[f"{side}in"] = np.stack([np.bincount(at, flat[:, k], 256) for k in range(3 * h)], axis=1).astype(np.float32)
            grads[f"{side}u"], grads[f"{side}c"] = d_u, d_c
        return loss, grads

    def fit(self, texts: list[bytes], wanted: np.ndarray, steps: int = 300, batch: int = 192, length: int = 64, rate: float = 0.02, seed: int = 6) -> float:
        """Adam on random windows of ``texts``, the rate falling to zero; returns the mean loss of the last tenth."""
        own = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        by_label = [np.flatnonzero(wanted == k) for k in range(len(self.labels))]
        by_label = [x for x in by_label if len(x)]
        losses = []
        for step in range(1, steps + 1):
            rows = [own.choice(by_label[i]) for i in own.integers(0, len(by_label), batch)]
            window = np.full((batch, length), 32, np.uint8)
            for i, row in enumerate(rows):
                text = texts[row]
                at = int(own.integers(0, max(1, len(text) - length + 1)))
                piece = np.frombuffer(text[at : at + length], np.uint8)
                window[i, : len(piece)] = piece
            loss, grads = self.gradients(np.ascontiguousarray(window.T), wanted[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - (step - 1) / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    # ------------------------------------------------------------ prediction

    def _add_logits(self, side: str, bytes_: np.ndarray, held: np.ndarray | None, out: np.ndarray) -> None:
        """Add one direction's share to the logits ``out`` (time, language, batch); features are rows here."""
        h, w = self.hidden, self.w
        # logistic(x) is 1 / (1 + exp(-x)) and tanh(x) is 2 * logistic(2 * x) - 1: the factors go into the weights
        sign = np.repeat(np.array([-1, -2], np.float32), (2 * h, h))
        table = np.ascontiguousarray((w[f"{side}in"] * sign).T)
        u = np.ascontiguousarray((w[f"{side}u"] * sign).T)
        c, w_out = -2 * w[f"{side}c"][:, None], np.ascontiguousarray(w[f"{side}out"].T)
        batch = bytes_.shape[1]
        state = np.zeros((h, batch), np.float32)
        given, a, share = np.empty((3 * h, batch), np.float32), np.empty((3 * h, batch), np.float32), np.empty((out.shape[1], batch), np.float32)
        gates, z, r, n, inner = given[: 2 * h], given[:h], given[h : 2 * h], given[2 * h :], a[2 * h :]
        for t in range(len(bytes_)) if side == "f" else range(len(bytes_) - 1, -1, -1):
            np.take(table, bytes_[t], axis=1, out=given, mode="clip")
            np.matmul(u, state, out=a)
            gates += a[: 2 * h]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            inner += c
            inner *= r
            n += inner
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            state -= n
            state *= z
            state += n
            if held is not None:
                state *= held[t]
            np.matmul(w_out, state, out=share)
            out[t] += share

    def window_sums(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over each window's positions of the languages' probabilities; (windows, languages)."""
        bytes_ = np.ascontiguousarray(windows.T).astype(np.intp)
        held = None
        if (lengths < windows.shape[1]).any():
            held = (np.arange(windows.shape[1])[:, None] < lengths).astype(np.float32)
        logits = np.empty((len(bytes_), len(self.labels), len(windows)), np.float32)
        logits[:] = self.w["out"][:, None]
        for side in "fb":
            self._add_logits(side, bytes_, held, logits)
        np.clip(logits, -60, 60, out=logits)
        np.exp(logits, out=logits)
        share = 1 / logits.sum(axis=1)
        if held is not None:
            share *= held
        logits *= share[:, None]
        return logits.sum(axis=0, dtype=np.float64).T

    def pooled(self, texts: list[bytes], length: int = 128, batch: int = 1024) -> np.ndarray:
        """Mean probabilities over all positions of each whole text (empty: equal shares); (texts, languages).

        Texts are cut into windows of ``length`` bytes, each read from zero states; the last may be shorter.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // length)
        owner = np.repeat(np.arange(len(texts)), counts)
        sums = np.zeros((len(texts), len(self.labels)))
        if len(owner):
            data = np.frombuffer(b"".join(texts) + b" " * length, np.uint8)
            begin = np.repeat(np.cumsum(sizes) - sizes, counts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = begin + nth * length
            held = np.minimum(length, sizes[owner] - nth * length)
            order = np.argsort(-held, kind="stable")  # whole windows need no mask
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                windows = data[start[part][:, None] + np.arange(length)]
                np.add.at(sums, owner[part], self.window_sums(windows, held[part]))
        return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 1 / len(self.labels))


def in_training(id_col: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 4, is not 2."""
    return F.crc32(id_col.cast("string")) % 4 != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trainable: Column | None = None, per_language: int = 600, pieces: int = 4, piece_chars: int = 200, seed: int = 3, **fit) -> ByteTagger | None:
    """A tagger fitted on the rows of ``docs`` that are ``trainable`` (default: :func:`in_training`) with text and language.

    The sample is bounded: about ``per_language`` documents of each language by a seeded hash of the id, never
    more than twice that many on the whole, and ``pieces`` pieces of ``piece_chars`` characters at hashed places
    of each. None if no row has a text with a letter and a language.
    """
    allowed = in_training(F.col(id_col)) if trainable is None else trainable
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    place = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(1 << 40))
    cuts = [
        F.substr("text", (F.lit(1) + F.pmod(place(k), F.greatest(F.length("text") - piece_chars + 1, F.lit(1)))).cast("int"), F.lit(piece_chars))
        for k in range(1, pieces + 1)
    ]
    chosen = rows.where(place(0) < F.element_at(share, F.col("lang")) * float(1 << 40))
    sample = chosen.select("lang", place(0).alias("h"), F.array(*cuts).alias("pieces")).orderBy("h", "lang", "pieces").limit(2 * per_language * len(counts))
    held = sample.collect()
    labels = sorted(counts)
    texts = [p.encode() for r in held for p in r["pieces"]]
    wanted = np.array([labels.index(r["lang"]) for r in held for _ in r["pieces"]])
    tagger = ByteTagger(labels)
    if len(texts):
        tagger.fit(texts, wanted, **fit)
    return tagger


def predicted(docs: DataFrame, tagger: ByteTagger | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score in two added columns (which replace columns of those names).

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0, as is everything if there is
    no tagger. The score is the pooled probability of the predicted language; ties go to the smaller language. Repeated
    rows get equal predictions; an empty table gives an empty result.
    """
    kept = docs.select(*[c for c in docs.columns if c not in (pred_col, score_col)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if tagger is not None and t is not None and LETTER.search(t)]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            begin = 0
            while begin < len(known):  # about a megabyte at a time
                size, end = 0, begin
                while end < len(known) and (end == begin or size < 1 << 20):
                    size += len(texts[known[end]])
                    end += 1
                part = known[begin:end]
                for i, p in zip(part, tagger.pooled([texts[i].encode("utf-8", "replace") for i in part])):
                    k = int(p.argmax())
                    names[i], scores[i] = tagger.labels[k], min(1.0, max(0.0, float(p[k])))
                begin = end
            yield batch.append_column(pred_col, pa.array(names)).append_column(score_col, pa.array(scores))

    return kept.mapInArrow(lean(run), f"{fields}, `{pred_col}` string, `{score_col}` double")
