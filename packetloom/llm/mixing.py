"""Mixing sources to target weights by exact length counts (subset-sum budget fitting)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import both_sides, numbered_within, whole_row
from packetloom.operators.durable import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, nulls last, carry ``weights`` in turn. ``share`` times all words is dealt out by
    weight; a target above ``most`` times its source's size stops there and the excess is dealt out anew by weight, until
    none is above. That end has a closed form, so no loop is needed: a source is full once the amount a unit of weight
    gets reaches cap / weight, hence with sources sorted by cap / weight the full ones are a prefix.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    place = (F.row_number().over(ordered) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    caps = totals.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    level = left / F.sum("__w").over(after)
    # the first source that is not full fixes the level for itself and all after it
    leveled = caps.withColumn("__open", F.when(level * F.col("__w") <= F.col("__cap"), level))
    fixed = F.first("__open", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(fixed.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * fixed))
    return leveled.select("source", "source_size", target.alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, reach: int = 1 << 22) -> list[int]:
    """How many documents of each length to take, at most ``counts``, so that the words come close to ``budget`` from below.

    Lengths get their even part of the budget first (rounded down), then the longest ones that still fit as long as
    more is open than ``reach`` words and twice the longest length. The rest is a bounded knapsack over word counts in units of
    the lengths' common divisor: a bit set of sums into which each length's copies are folded by powers of two, long lengths first, until
    a sum meets what is open. Every 64th set is kept, and the others are made again on the way back from the fullest sum.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0 or not total:
        return [0] * len(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    reach = max(reach, 2 * lengths[order[0]])
    for i in order:
        if lengths[i] and left >= reach:
            more = min(counts[i] - taken[i], (left - reach) // lengths[i] + 1)
            taken[i] += more
            left -= more * lengths[i]
    steps = []
    for i in order:
        if 0 < lengths[i] <= left:
            copies, part = min(counts[i] - taken[i], left // lengths[i]), 1
            while copies > 0:
                part = min(part, copies)
                steps.append((i, part))
                copies -= part
                part *= 2
    unit = math.gcd(*(lengths[i] for i, _ in steps)) if steps else 1
    space = left // unit
    mask = (1 << (space + 1)) - 1
    fold = lambda sums, step: sums | (sums << (step[1] * lengths[step[0]] // unit)) & mask
    sums, marks, used = 1, [], 0
    while used < len(steps) and not sums >> space:
        if used % 64 == 0:
            marks.append(sums)
        sums = fold(sums, steps[used])
        used += 1
    best = sums.bit_length() - 1
    for k in reversed(range(len(marks))):
        part = steps[64 * k : min(64 * (k + 1), used)]
        before = [marks[k]]
        for step in part[:-1]:
            before.append(fold(before[-1], step))
        for (i, copies), without in zip(reversed(part), reversed(before)):
            if not without >> best & 1:
                taken[i] += copies
                best -= copies * lengths[i] // unit
    return taken


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, order: str | None = None) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, copies, taken): how often the mix takes each row of ``docs``.

    Sizes are words between ASCII white space; null texts have none and are taken 0 times, as are empty ones. Every
    document of a source is taken ``floor(target / source_size)`` times, and the remaining budget is fitted over
    the source's counts of documents by exact length (:func:`fit`, one task per source on at most its distinct lengths);
    of each length the wanted number is taken in a seeded order by id. Null sources are one source. Rows that
    repeat an id are separate documents; ``row`` (a hash of the text) tells them apart unless they are exact repeats, which
    get their copies in any order. An empty table gives an empty result. Other columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.col(text_col)).alias("row"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = checkpointed(sized)
    lengths = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = source_targets(totals, weights, share, most)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = int(target // size) if size else 0
        group = group.sort_values("size")
        extra = fit(group["size"].tolist(), group["docs"].tolist(), round(target) - rounds * size)
        return group[["source", "size", "source_size", "target"]].assign(rounds=rounds, extra=extra)

    named = [F.col("source").alias("__src")] + [c for c in targets.columns if c != "source"]
    planned = (
        lengths.join(targets.select(*named), F.col("source").eqNullSafe(F.col("__src")))
        .drop("__src")
        .groupBy("source")
        .applyInPandas(plan, "source string, size long, source_size long, target double, rounds int, extra long")
    )
    planned = planned.select(F.col("source").alias("__src"), F.col("size").alias("__len"), "source_size", "target", "rounds", "extra")
    numbered = numbered_within(sized, ["source", "size"], ["doc_id", "row"], seed=seed)
    out = numbered.join(both_sides(planned), F.col("source").eqNullSafe(F.col("__src")) & (F.col("size") == F.col("__len")))
    copies = F.when(F.col("size") > 0, F.col("rounds") + (F.col("__n") < F.col("extra")).cast("int")).otherwise(0)
    return out.select("doc_id", "source", "row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged."""
    spread = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    # exact repeats share one line here: their copies are added up and shared out again below
    plan = spread.groupBy("doc_id", "source", "row").agg(F.sort_array(F.collect_list("copies"), False).alias("copies"))
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("row").alias("p_row"), "copies")
    rows = docs.select(whole_row(docs).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("row"))
    same = F.col("id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("row") == F.col("p_row"))
    repeats = rows.join(plan, same)
    one = repeats.where(F.size("copies") == 1).withColumn("k", F.element_at("copies", 1))
    order = Window.partitionBy("id", "source", "row").orderBy(F.lit(0))
    many = repeats.where(F.size("copies") > 1).withColumn("nth", F.row_number().over(order))
    many = many.withColumn("k", F.coalesce(F.get("copies", F.col("nth") - 1), F.lit(0))).drop("nth")
    both = one.unionByName(many).where("k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "k")))
    return both.select("doc.*")
