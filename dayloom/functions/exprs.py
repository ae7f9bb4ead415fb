"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

KEY = "calendarDate"


def has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def num(name: str | Column) -> Column:
    """Number or null: text that is no number and NaN become null."""
    c = F.col(name) if isinstance(name, str) else name
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def num_or_null(df: DataFrame, name: str) -> Column:
    return num(name) if name in df.columns else F.lit(None).cast("double")


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a typed null where the table lacks it."""
    return F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)


def coalesced(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    """First non-null of the columns that exist, or a typed null."""
    found = [F.col(n).try_cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def present(df: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def flag(df: DataFrame, name: str) -> Column:
    """A boolean that reads null and a missing column as false."""
    return F.coalesce(F.col(name).try_cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def as_date(name: str | Column) -> Column:
    """Dates, timestamps and ISO text (any time zone part is cut) as a date."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(c.try_cast("date"), F.try_to_timestamp(c.cast("string")).cast("date"))


def ratio(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total)


def row_sum(parts: Sequence[Column]) -> Column:
    """Sum that ignores nulls and is null only if every part is."""
    total = F.coalesce(parts[0], F.lit(0.0))
    for p in parts[1:]:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def within(left: Column, right: Column, tolerance: float) -> Column:
    """Null if either side is."""
    return F.abs(left - right) <= tolerance


def bands(value: Column, edges: Sequence[tuple[float, str]], top: str, unknown: str | None = None) -> Column:
    """The label of the first edge that the value is below, else ``top``."""
    out = F.when(value.isNull(), F.lit(unknown)) if unknown is not None else None
    for edge, label in edges:
        out = F.when(value < edge, label) if out is None else out.when(value < edge, label)
    return out.otherwise(top)


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def iso_weekday(day: Column) -> Column:
    return (F.weekday(day) + 1).cast("int")


def clock_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600


def wrapped_hour(hour: Column, evening: float = 18.0) -> Column:
    """Hours of the evening as negative, so that a night is one range around 0."""
    return F.when(hour >= evening, hour - 24).otherwise(hour)


def score_bucket(score: Column) -> Column:
    return bands(score, [(60, "poor"), (80, "fair"), (90, "good")], "excellent", "unknown")
