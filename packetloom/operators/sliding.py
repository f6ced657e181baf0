"""Keyed sliding-window and running operators that stay parallel inside one hot key.

Every operator cuts a key's timeline into fixed time slices and shuffles on (key, slice), so a key
holding a large share of the rows spreads over as many tasks as it spans slices.

* Windowed operators copy the rows of the last ``window`` of a slice into the next one. The copies
  only give context and are dropped from the output, so results equal those of one ordered pass.
* Running operators add up each slice, then carry the sums of the earlier slices into it.

Frames are closed on both ends, ``[t - window, t]``, and rows are ordered by (event time, ``tie``):
a row sees the earlier rows of its own instant, not the later ones. Nothing here uses a moving
frame, whose cost grows with rows times frame size: counts are running sums over enter and exit
marks, thresholds look back a fixed number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.timecols import SECOND, cell_of, micros, to_us

_INTERNAL = ["__us", "__slice", "__own", "__add", "__at", "__mark", "__delta", "__prev", "__next"]


def default_slice(window_seconds: float) -> float:
    """Four windows per slice: a quarter of the rows at most is copied."""
    return max(4 * window_seconds, 20.0)


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in _INTERNAL if c in df.columns])


def _window_us(window_seconds: float | Column) -> Column:
    if isinstance(window_seconds, Column):
        return (window_seconds * SECOND).cast("long")
    return F.lit(to_us(window_seconds)).cast("long")


def slice_with_lookback(
    df: DataFrame,
    window_seconds: float | Column,
    ts: str,
    slice_seconds: float | None,
    adds: Column | None = None,
) -> DataFrame:
    """One row per (row, slice that can see it); ``__own`` marks the row's home slice.

    Rows for which ``adds`` is false never count for others, so they are not copied. The window may
    be a column that is constant within a key; ``slice_seconds`` is then required.
    """
    window_us, width = _window_us(window_seconds), to_us(slice_seconds or default_slice(window_seconds))
    adds = F.lit(True) if adds is None else F.coalesce(adds, F.lit(False))
    out = df.withColumn("__us", micros(df, ts)).withColumn("__add", adds)
    home = cell_of("__us", width)
    last = F.when(F.col("__add"), cell_of_expr(F.col("__us") + window_us, width)).otherwise(home)
    return out.withColumn("__slice", F.explode(F.sequence(home, last))).withColumn("__own", F.col("__slice") == home)


def cell_of_expr(us: Column, width: int) -> Column:
    return ((us - F.pmod(us, F.lit(width))) / width).cast("long")


def by_slice(sliced: DataFrame, keys: list[str]) -> DataFrame:
    """One exchange on (keys, slice) into all shuffle partitions.

    The number is named so that small ones are not merged: they would be, up to a size after compression, and slices of alike
    packets take many times that size once they are sorted.
    """
    partitions = int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sliced.repartition(partitions, *keys, "__slice")


def _marks(df: DataFrame, window_us: Column, enters: Column, exits: Column) -> DataFrame:
    """Each row enters at its own time and, where ``exits``, leaves right after its window."""
    enter = F.struct(
        F.col("__us").alias("at"), F.lit(0).alias("mark"), F.when(enters, 1).otherwise(0).alias("delta")
    )
    leave = F.struct((F.col("__us") + window_us).alias("at"), F.lit(1).alias("mark"), F.lit(-1).alias("delta"))
    both = F.when(exits, F.array(enter, leave)).otherwise(F.array(enter))
    kept = [c for c in df.columns if c not in ("__prev", "__next")]
    return df.select(*kept, F.explode(both).alias("__m")).select(
        *kept, F.col("__m.at").alias("__at"), F.col("__m.mark").alias("__mark"), F.col("__m.delta").alias("__delta")
    )


def _sum_of_marks(marks: DataFrame, keys: list[str], tie: str, name: str) -> DataFrame:
    order = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__at", "__mark", tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = marks.withColumn(name, F.sum("__delta").over(order))
    return _clean(summed.where((F.col("__mark") == 0) & F.col("__own")))


def sliding_count(
    df: DataFrame,
    keys: list[str],
    window_seconds: float | Column,
    name: str = "n",
    *,
    where: Column | None = None,
    ts: str = "ts",
    tie: str = "packet_id",
    slice_seconds: float | None = None,
) -> DataFrame:
    """Add the number of rows of the key in ``[t - window, t]``; only rows meeting ``where`` count."""
    sliced = slice_with_lookback(df, window_seconds, ts, slice_seconds, where)
    marks = _marks(by_slice(sliced, keys), _window_us(window_seconds), F.col("__add"), F.col("__add"))
    return _sum_of_marks(marks, keys, tie, name)


def reaches_count(
    df: DataFrame,
    keys: list[str],
    window_seconds: float,
    threshold: int,
    *,
    ts: str = "ts",
    tie: str = "packet_id",
    slice_seconds: float | None = None,
) -> DataFrame:
    """Rows at which the key has at least ``threshold`` rows in ``[t - window, t]``.

    True exactly when the row ``threshold - 1`` places earlier is still inside the window, which
    takes one look-back per row and no count.
    """
    if threshold <= 1:
        return df
    sliced = by_slice(slice_with_lookback(df, window_seconds, ts, slice_seconds), keys)
    order = Window.partitionBy(*keys, "__slice").orderBy("__us", tie)
    back = sliced.withColumn("__prev", F.lag("__us", threshold - 1).over(order))
    hit = F.col("__own") & (F.col("__us") - F.col("__prev") <= to_us(window_seconds))
    return _clean(back.where(hit))


def sliding_distinct(
    df: DataFrame,
    keys: list[str],
    value: str,
    window_seconds: float,
    name: str = "n_distinct",
    *,
    where: Column | None = None,
    ts: str = "ts",
    tie: str = "packet_id",
    slice_seconds: float | None = None,
) -> DataFrame:
    """Add the number of distinct ``value`` in ``[t - window, t]``; rows failing ``where`` only look.

    A value is present from an occurrence until ``window`` after it. Occurrences that extend a
    present value add nothing, so the running sum over enters and exits is the distinct count.
    """
    window_us = _window_us(window_seconds)
    sliced = slice_with_lookback(df, window_seconds, ts, slice_seconds, where)
    # One exchange on (keys, slice) serves both the per-value and the per-key pass.
    placed = by_slice(sliced, keys)
    occurrences = Window.partitionBy(*keys, "__slice", value, "__add").orderBy("__us", tie)
    near = placed.withColumn("__prev", F.lag("__us").over(occurrences)).withColumn(
        "__next", F.lead("__us").over(occurrences)
    )
    fresh = F.col("__prev").isNull() | (F.col("__us") - F.col("__prev") > window_us)
    final = F.col("__next").isNull() | (F.col("__next") - F.col("__us") > window_us)
    marks = _marks(near, window_us, F.col("__add") & fresh, F.col("__add") & final)
    return _sum_of_marks(marks, keys, tie, name)


def running_total(
    df: DataFrame,
    keys: list[str],
    amount: Column,
    name: str = "total",
    *,
    ts: str = "ts",
    tie: str = "packet_id",
    slice_seconds: float = 3600.0,
) -> DataFrame:
    """Add the sum of ``amount`` over the key's rows up to and including this one."""
    width = to_us(slice_seconds)
    sliced = (
        df.withColumn("__us", micros(df, ts))
        .withColumn("__delta", amount)
        .withColumn("__slice", cell_of("__us", width))
    )
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.sum("__delta").alias("__sum"))
        .select(*keys, "__slice", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carry"))
    )
    inside = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__us", tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.withColumn("__local", F.sum("__delta").over(inside))
    joined = null_safe_join(local, carried, [*keys, "__slice"])
    return _clean(joined.withColumn(name, F.col("__local") + F.col("__carry")).drop("__local", "__carry"))


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet, keeping the left columns once."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"__r_{c}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def running_rank(df: DataFrame, keys: list[str], name: str = "rank", **options) -> DataFrame:
    """Position of each row in its key's event order, from 1."""
    return running_total(df, keys, F.lit(1), name, **options)


def cumulative_distinct(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str = "n_distinct",
    *,
    ts: str = "ts",
    tie: str = "packet_id",
    slice_seconds: float = 3600.0,
) -> DataFrame:
    """Add the number of distinct ``value`` the key has shown so far; nothing ever ages out.

    First occurrences come from a map-side aggregate, so one endlessly repeated value costs nothing.
    """
    us = micros(df, ts)
    rows = df.withColumn("__at", us)
    firsts = (
        rows.groupBy(*keys, value)
        .agg(F.min(F.struct("__at", F.col(tie).alias("__tie"))).alias("__first"))
        .select(*keys, F.col("__first.__at").alias("__at"), F.col("__first.__tie").alias(tie), F.lit(1).alias("__new"))
    )
    both = rows.withColumn("__new", F.lit(0)).unionByName(firsts, allowMissingColumns=True)
    # A first occurrence sorts before the row it stands for.
    placed = both.withColumn("__order", F.struct(F.col(tie), (1 - F.col("__new")).alias("k")))
    width = to_us(slice_seconds)
    sliced = placed.withColumn("__slice", cell_of("__at", width))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.sum("__new").alias("__sum"))
        .select(*keys, "__slice", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carry"))
    )
    inside = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__at", "__order")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.withColumn("__local", F.sum("__new").over(inside)).where(F.col("__new") == 0)
    joined = null_safe_join(local, carried, [*keys, "__slice"])
    return _clean(
        joined.withColumn(name, F.col("__local") + F.col("__carry")).drop("__local", "__carry", "__new", "__order")
    )


def previous_value(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str = "previous",
    *,
    ts: str = "ts",
    tie: str = "packet_id",
    slice_seconds: float = 3600.0,
) -> DataFrame:
    """Add the value of the key's preceding row; the first row of a slice takes the last one before it."""
    width = to_us(slice_seconds)
    sliced = df.withColumn("__us", micros(df, ts)).withColumn("__slice", cell_of("__us", width))
    by_slice = Window.partitionBy(*keys).orderBy("__slice")
    carried = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct("__us", tie)).alias("__last"))
        .select(*keys, "__slice", F.lag("__last").over(by_slice)["v"].alias("__carry"))
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy("__us", tie)
    local = sliced.withColumn("__local", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    joined = null_safe_join(local, carried, [*keys, "__slice"])
    chosen = F.when(F.col("__local").isNull(), F.col("__carry")).otherwise(F.col("__local")["v"])
    return _clean(joined.withColumn(name, chosen).drop("__local", "__carry"))


def rolling_last(
    df: DataFrame, amounts: dict[str, Column], rows: int, *, keys: list[str] | None = None, order: list[str]
) -> DataFrame:
    """Aggregates over the last ``rows`` rows of the key, for series that are already rolled up."""
    frame = Window.partitionBy(*(keys or [])).orderBy(*order).rowsBetween(1 - rows, Window.currentRow)
    return df.withColumns({name: agg.over(frame) for name, agg in amounts.items()})
