"""Greedy suppression: keep a row only when it lies far enough after the last row kept.

The kept rows of a key form a chain in which each link depends on the one before. Keys with few
candidates are folded in place with a higher-order aggregate. A key with many candidates is cut
into time blocks instead: each block is reduced, independently, to a table "entering at this row
leads to leaving at that row"; the short tables are chained per key; then each block emits its
rows from its known entry point. The result is the same and no task holds more than one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from packetloom.functions.timecols import cell_of, micros, to_us
from packetloom.operators.sliding import null_safe_join

FOLD_LIMIT = 20_000
CELLS_PER_BLOCK = 64
FAR = -(2**62)


def cooldown(
    df: DataFrame,
    keys: list[str],
    seconds: float,
    *,
    strict: bool,
    ts: str = "ts",
    tie: str = "packet_id",
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Drop rows within ``seconds`` of the key's last kept row.

    ``strict`` keeps a row only when more than ``seconds`` have passed, otherwise exactly
    ``seconds`` is enough.
    """
    gap = to_us(seconds) + (1 if strict else 0)
    return greedy_chain(df.withColumn("__pos", micros(df, ts)), keys, gap, tie=tie, fold_limit=fold_limit).drop("__pos")


def greedy_chain(
    df: DataFrame,
    keys: list[str],
    gap: int,
    *,
    gap2: int = 0,
    tie: str = "packet_id",
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Keep the first row of each key, then every row at least ``gap`` in ``__pos`` and ``gap2`` in
    ``__pos2`` after the last kept one. Both columns rise along the key's order; ``__pos2`` is
    optional.

    The candidates are read four times (sizes, short keys, long keys, kept rows), so they are persisted. Chains are followed over
    positions alone; the rows they keep, which are few, then fetch their other columns.
    """
    if gap <= 0 and (gap2 <= 0 or "__pos2" not in df.columns):  # everything is kept, rows at the same place as well
        return df
    if not keys:
        whole = df.withColumn("__all", F.lit(0))
        return greedy_chain(whole, ["__all"], gap, gap2=gap2, tie=tie, fold_limit=fold_limit).drop("__all")
    two_axes = "__pos2" in df.columns
    rows = df if two_axes else df.withColumn("__pos2", F.lit(0).cast("long"))
    gap2 = gap2 if two_axes else 0
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    at = list(dict.fromkeys([*keys, "__pos", "__pos2", tie]))
    places = rows.select(*at)
    long_keys = rows.groupBy(*keys).agg(F.count("*").alias("__size")).where(F.col("__size") > fold_limit)
    short = _fold_short(null_safe_join(places, long_keys, keys, "left_anti"), keys, gap, gap2, tie)
    # Usually there is no long key; adaptive execution then drops this branch.
    long = _chain_blocks(null_safe_join(places, long_keys, keys, "left_semi"), keys, gap, gap2, tie)
    out = null_safe_join(rows, short.unionByName(long), at, "left_semi").dropDuplicates(at)
    return out if two_axes else out.drop("__pos2")


def _fold_short(rows: DataFrame, keys: list[str], gap: int, gap2: int, tie: str) -> DataFrame:
    at = ["__pos", "__pos2", tie]
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*at))).alias("__rows"))
    empty = F.struct(
        F.lit(None).cast("long").alias("pos"),
        F.lit(None).cast("long").alias("pos2"),
        F.slice(F.col("__rows"), 1, 0).alias("kept"),
    )

    def step(state, row):
        keep = state["pos"].isNull() | ((row["__pos"] - state["pos"] >= gap) & (row["__pos2"] - state["pos2"] >= gap2))
        return F.when(keep, F.struct(row["__pos"].alias("pos"), row["__pos2"].alias("pos2"), F.concat(state["kept"], F.array(row)).alias("kept"))).otherwise(state)

    return grouped.select(*keys, F.explode(F.aggregate("__rows", empty, step)["kept"]).alias("__k")).select(*keys, "__k.*")


def _successors(pos: np.ndarray, pos2: np.ndarray, gap: int, gap2: int) -> np.ndarray:
    """Index of the first row eligible after each row; len(pos) when the block holds none."""
    nxt = np.maximum(np.searchsorted(pos, pos + gap), np.searchsorted(pos2, pos2 + gap2))
    return np.maximum(nxt, np.arange(1, len(pos) + 1))


def _block_table(pdf: pd.DataFrame, keys: list[str], gap: int, gap2: int, tie: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["__pos", "__pos2", tie], kind="stable")
    pos, pos2 = pdf["__pos"].to_numpy(np.int64), pdf["__pos2"].to_numpy(np.int64)
    nxt = _successors(pos, pos2, gap, gap2)
    leave = np.where(nxt < len(pos), nxt, np.arange(len(pos)))
    while True:  # each pass doubles the number of links followed
        further = leave[leave]
        if np.array_equal(further, leave):
            break
        leave = further
    # Entries leading to the same exit are neighbours; the last of them is enough to look one up.
    last = np.append(leave[1:] != leave[:-1], True)
    if gap2 <= 0:
        # The row kept before lies before the block, so the first eligible one is sought less than a gap behind the block's start.
        start = int(pdf["__block"].iloc[0]) * max(gap, 1) * CELLS_PER_BLOCK
        at = np.flatnonzero(last)
        last[at[int(np.searchsorted(pos[at], start + gap - 1)) + 1 :]] = False
    head = {k: [pdf[k].iloc[0]] * int(last.sum()) for k in [*keys, "__block"]}
    return pd.DataFrame(
        {
            **head,
            "enter": pos[last],
            "enter2": pos2[last],
            "leave": pos[leave[last]],
            "leave2": pos2[leave[last]],
        }
    )


def _chain_tables(pdf: pd.DataFrame, keys: list[str], gap: int, gap2: int) -> pd.DataFrame:
    """Last position kept before each block of one key."""
    pos, pos2, out = FAR, FAR, []
    for block, table in pdf.sort_values(["__block", "enter", "enter2"]).groupby("__block", sort=True):
        out.append((block, pos, pos2))
        usable = ((table["enter"] - pos >= gap) & (table["enter2"] - pos2 >= gap2)).to_numpy()
        if usable.any():
            row = table.iloc[int(usable.argmax())]
            pos, pos2 = int(row["leave"]), int(row["leave2"])
    entries = pd.DataFrame(out, columns=["__block", "__from", "__from2"])
    for k in reversed(keys):
        entries.insert(0, k, [pdf[k].iloc[0]] * len(entries))
    return entries


def _emit_block(pdf: pd.DataFrame, gap: int, gap2: int, tie: str, columns: list[str]) -> pd.DataFrame:
    pdf = pdf.sort_values(["__pos", "__pos2", tie], kind="stable")
    pos, pos2 = pdf["__pos"].to_numpy(np.int64), pdf["__pos2"].to_numpy(np.int64)
    nxt = _successors(pos, pos2, gap, gap2)
    start, start2 = int(pdf["__from"].iloc[0]), int(pdf["__from2"].iloc[0])
    at = max(int(np.searchsorted(pos, start + gap)), int(np.searchsorted(pos2, start2 + gap2)))
    kept = []
    while at < len(pos):
        kept.append(at)
        at = int(nxt[at])
    return pdf.iloc[kept][columns]


def _chain_blocks(rows: DataFrame, keys: list[str], gap: int, gap2: int, tie: str) -> DataFrame:
    blocked = rows.withColumn("__block", cell_of("__pos", max(gap, 1) * CELLS_PER_BLOCK))
    schema = T.StructType([blocked.schema[c] for c in [*keys, "__block"]])
    table_schema = T.StructType(
        list(schema.fields) + [T.StructField(c, T.LongType()) for c in ("enter", "enter2", "leave", "leave2")]
    )
    entry_schema = T.StructType(list(schema.fields) + [T.StructField(c, T.LongType()) for c in ("__from", "__from2")])
    columns = rows.columns
    tables = (
        blocked.groupBy(*keys, "__block")
        .applyInPandas(lambda pdf: _block_table(pdf, keys, gap, gap2, tie), table_schema)
    )
    entries = tables.groupBy(*keys).applyInPandas(lambda pdf: _chain_tables(pdf, keys, gap, gap2), entry_schema)
    return (
        null_safe_join(blocked, entries, [*keys, "__block"])
        .groupBy(*keys, "__block")
        .applyInPandas(lambda pdf: _emit_block(pdf, gap, gap2, tie, columns), rows.schema)
    )
