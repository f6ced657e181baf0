"""Event time as integer microseconds, for both TIMESTAMP and TIMESTAMP_NTZ columns."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

SECOND = 1_000_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def micros(df: DataFrame, name: str = "ts") -> Column:
    """Microseconds since the epoch of a timestamp column."""
    if is_ntz(df, name):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{name}`)")
    return F.unix_micros(F.col(name))


def from_micros(us: str, ntz: bool) -> Column:
    """Timestamp from the column named ``us`` holding epoch microseconds."""
    if ntz:
        return F.expr(f"timestampadd(MICROSECOND, `{us}`, {_EPOCH})")
    return F.timestamp_micros(F.col(us))


def to_us(seconds: float) -> int:
    return round(seconds * SECOND)


def cell_of(us: str, width_us: int) -> Column:
    """Index of the fixed-width time cell holding ``us`` (floor division, also before 1970)."""
    return F.expr(f"(`{us}` - pmod(`{us}`, {width_us}L)) div {width_us}L")
