"""Tables behind the exploratory plots: gap-filled series, rolling means, distributions, segments,
calendar categories, missingness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from dayloom.functions.exprs import KEY, as_date, clock_hour, flag, num, num_or_null, ratio, row_sum, score_bucket, weekday_name
from dayloom.functions.positions import with_position
from dayloom.operators.features import keep_one_per_day, local_offset_seconds


def calendar(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last (of each entity)."""
    span = df.groupBy(*keys).agg(F.min(KEY).alias("__from"), F.max(KEY).alias("__to")).where("__from is not null")
    return span.select(*keys, F.explode(F.sequence("__from", "__to")).alias(KEY))


def fill_gaps(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The series over its calendar; days without a row have nulls."""
    rows = df.select(*keys, KEY, *columns)
    return calendar(rows, keys).join(rows, [*keys, KEY], "left")


def rolling_mean(df: DataFrame, column: str, window: int = 7, least: int | None = None, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Mean of the last ``window`` calendar days, null below ``least`` known values. The frame is a
    range of day numbers, so gaps need no filling and one window serves any number of entities."""
    least = max(3, window // 2) if least is None else least
    w = Window.partitionBy(*keys).orderBy(F.unix_date(KEY)).rangeBetween(-(window - 1), 0)
    v = num(column)
    return df.withColumn(out or f"{column}_mean{window}", F.when(F.count(v).over(w) >= least, F.avg(v).over(w)))


def gap_series(df: DataFrame, columns: Sequence[str], window: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """Gap-filled columns, each with its rolling mean (the table behind the series plots)."""
    out = fill_gaps(df, [c for c in columns if c in df.columns], keys)
    for c in columns:
        if c in df.columns:
            out = rolling_mean(out, c, window, keys=keys)
    return out


def entity_days(events: DataFrame, entity: str = "user_id") -> DataFrame:
    """Event counts and sums by entity and day, one column for each given event type."""
    day = F.col("ts").cast("date").alias(KEY)
    return events.groupBy(entity, day).agg(F.count("*").alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.count_distinct("event_type").alias("n_types"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("sum_k"))


def nights_table(df: DataFrame, anchor: float = 16.0, plausible_hours: float = 18.0) -> DataFrame:
    """Start and end of each night as hours from the evening on, and its score bucket."""
    offset = F.coalesce(local_offset_seconds(df, plausible_hours), F.lit(0.0))
    hour = lambda c: clock_hour(F.timestamp_seconds(F.floor(num(c) + offset)))
    shifted = lambda h: F.when(h < anchor, h + 24).otherwise(h)
    start, end = shifted(hour("sleepStartTimestampGMT")), shifted(hour("sleepEndTimestampGMT"))
    rows = df.select(as_date(KEY).alias(KEY), start.alias("start_h"), end.alias("e"), score_bucket(num_or_null(df, "sleepOverallScore")).alias("bucket"))
    return rows.where("start_h is not null and e is not null").select(KEY, "start_h", F.when(F.col("e") < F.col("start_h"), F.col("e") + 24).otherwise(F.col("e")).alias("end_h"), "bucket")


def stage_shares(df: DataFrame, stages: Sequence[str] = ("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds", "unmeasurableSeconds")) -> DataFrame:
    """Hours and shares of each sleep stage; nights without a positive total are left out."""
    known = [c for c in stages if c in df.columns]
    total = row_sum([num(c) for c in known])
    name = lambda c: c.replace("SleepSeconds", "").replace("Seconds", "")
    rows = df.withColumn("__total", total).where("__total > 0")
    return rows.select(KEY, *[(num(c) / 3600).alias(f"{name(c)}_hours") for c in known], *[ratio(F.coalesce(num(c), F.lit(0.0)), F.col("__total")).alias(f"{name(c)}_share") for c in known])


def stress_shares(df: DataFrame, context: str = "TOTAL") -> DataFrame:
    base = f"allDayStress_{context}_"
    parts = [c for c in ("restDuration", "lowDuration", "mediumDuration", "highDuration", "activityDuration", "uncategorizedDuration") if base + c in df.columns]
    return df.select(KEY, *[ratio(num(base + c), num(base + "totalDuration")).alias(c.replace("Duration", "_share")) for c in parts])


def month_coverage(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Percent of days with each flag, by month; months without a day have nulls."""
    months = df.groupBy(F.trunc(KEY, "MM").alias("month")).agg(*[F.round(F.avg(flag(df, f).cast("double")) * 100, 6).alias(f) for f in flags])
    span = df.agg(F.trunc(F.min(KEY), "MM").alias("a"), F.trunc(F.max(KEY), "MM").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(months, "month", "left")


def calendar_quality(df: DataFrame) -> DataFrame:
    """A category from 0 (nothing) to 4 (good), its place in a year's grid of weeks."""
    score, bad = F.coalesce(num_or_null(df, "quality_score"), F.lit(0.0)), flag(df, "corrupted_stress_only_day")
    label = F.col("day_quality_label_strict")
    category = F.when(bad, 1).when(score == 0, 0).when(label == "bad", 2).when(label == "partial", 3).otherwise(4)
    new_year = F.trunc(KEY, "YEAR")
    week = F.floor((F.date_diff(F.col(KEY), new_year) + F.weekday(new_year)) / 7).cast("int")
    return df.select(KEY, F.year(KEY).alias("year"), week.alias("week_of_year"), F.weekday(KEY).alias("weekday"), category.alias("category"))


def histogram(df: DataFrame, column: str, bins: int = 20, edges: Sequence[float] | None = None, upper: float | None = None) -> DataFrame:
    """Counts by bin. ``upper``: values above this quantile count in the last bin. Limits come from
    one aggregate; empty bins are kept."""
    v = num(column)
    rows = df.select(v.alias("v")).where("v is not null")
    if edges is None:
        low, high, n, top = rows.agg(F.min("v"), F.max("v"), F.count("*"), F.percentile("v", F.lit(upper or 1.0))).first()
        if not n:
            return rows.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
        high = top if upper is not None and n >= 10 else high
        step = (high - low) / bins or 1.0
        edges = [low + step * i for i in range(bins + 1)]
    count = len(edges) - 1
    at = F.lit(-1)
    for i in range(count):
        at = F.when(F.col("v") >= edges[i], i).otherwise(at)
    counts = rows.where(F.col("v") >= edges[0]).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    frame = rows.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(count)], "bin int, low double, high double")
    return frame.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def describe(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """count, mean, std, min, percentiles (interpolated) and max of each column, from one aggregate."""
    aggs = []
    for c in columns:
        v = num(c)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *[F.percentile(v, F.lit(s)).alias(f"p{round(s * 100):02d}") for s in shares], F.max(v).alias("max")).alias(f"c{len(aggs)}"))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*one.columns)))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """value, share: i / n over the sorted known values."""
    rows = df.select(num(column).alias("value")).where("value is not null")
    placed, n = with_position(rows, "value")
    return placed.select("value", (F.col("position") / F.lit(max(n, 1))).alias("share"))


def segments(df: DataFrame, column: str, segment: Column) -> DataFrame:
    v = num(column)
    return df.groupBy(segment.alias("segment")).agg(F.count(v).alias("n"), F.median(v).alias("median"), F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.95)).alias("p95"), F.avg(v).alias("mean"))


def by_weekday(df: DataFrame, column: str, shift: int = 0) -> DataFrame:
    return segments(df, column, weekday_name(F.date_add(KEY, shift)))


def by_weekpart(df: DataFrame, column: str) -> DataFrame:
    return segments(df, column, F.when(F.weekday(KEY) >= 5, "weekend").otherwise("weekday"))


def by_score_bucket(df: DataFrame, column: str, score: str = "sleepOverallScore") -> DataFrame:
    return segments(df, column, score_bucket(num(score)))


def missingness(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 20) -> DataFrame:
    """The columns with the most nulls; all in one aggregate."""
    names = list(columns or df.columns)
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(names)], *[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(names)])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("k"), F.col(f"u{i}").alias("n_unique")) for i, c in enumerate(names)])).alias("r"))
    out = rows.select("r.column", (F.col("n") - F.col("r.k")).alias("missing_count"), F.when(F.col("n") > 0, F.round((F.col("n") - F.col("r.k")) * F.lit(100.0).cast("double") / F.col("n"), 2)).otherwise(F.lit(0.0).cast("double")).alias("missing_pct"), "r.n_unique")
    return out.orderBy(F.desc("missing_pct"), "column").limit(top_n)


def row_range(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.lit(label).alias("slice"), F.count("*").alias("rows"), F.min(KEY).alias("first_day"), F.max(KEY).alias("last_day"))


def duplicate_days(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days (of each entity) that have more than one row, and how many."""
    return df.groupBy(*keys, as_date(KEY).alias(KEY)).agg(F.count("*").alias("rows")).where("rows > 1")


def positive_rates(df: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of rows below each threshold; unknown scores count as not below."""
    one = df.agg(*[F.avg(F.coalesce(num(score) < t, F.lit(False)).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("positive_rate")) for i, t in enumerate(thresholds)])))


def suspicious_union(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(KEY).union(second.select(KEY)).distinct()


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """The column's times as seconds, whatever unit they are in."""
    return num(column) / {"s": 1, "ms": 1_000, "ns": 1_000_000_000}[epoch_unit(df, column)]


def both_columns(df: DataFrame, first: str, second: str) -> DataFrame:
    """The known values of two columns as one series."""
    return df.select(F.explode(F.array(num(first), num(second))).alias("value")).where("value is not null")


def robust_limit(df: DataFrame, columns: Sequence[str], share: float = 0.99, margin: float = 1.05) -> DataFrame:
    """limit: a high percentile over all columns' values together, with a margin."""
    values = df.select(F.explode(F.array(*[num(c) for c in columns])).alias("value")).where("value is not null")
    return values.agg((F.percentile("value", F.lit(share)) * margin).alias("limit"))


def lookup_days(series: DataFrame, days: DataFrame, column: str) -> DataFrame:
    """The series' value on each of the days; null where it has none."""
    return days.select(KEY).join(series.select(KEY, column), KEY, "left")


def daily_differences(df: DataFrame) -> DataFrame:
    """rhr_delta: the day's own resting heart rate less the one in force; bb_net_balance: battery
    gained less spent."""
    new = {}
    if {"currentDayRestingHeartRate", "restingHeartRate"} <= set(df.columns):
        new["rhr_delta"] = num("currentDayRestingHeartRate") - num("restingHeartRate")
    if {"bodyBattery_chargedValue", "bodyBattery_drainedValue"} <= set(df.columns):
        new["bb_net_balance"] = num("bodyBattery_chargedValue") - num("bodyBattery_drainedValue")
    return df.withColumns(new) if new else df


def target_availability(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """target, available (known values), median; one aggregate."""
    one = df.agg(*[F.struct(F.lit(t).alias("target"), F.count(num(t)).alias("available"), F.median(num(t)).alias("median")).alias(f"t{i}") for i, t in enumerate(targets)])
    return one.select(F.inline(F.array(*one.columns)))


def best_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return keep_one_per_day(df, order, group)


def clipped(df: DataFrame, column: str, share: float = 0.98, least: int = 10) -> DataFrame:
    """The column with values above its upper quantile set to it, if there are enough values."""
    top, n = df.agg(F.percentile(num(column), F.lit(share)), F.count(num(column))).first()
    v = num(column)
    return df.withColumn(column, F.when(v > top, top).otherwise(v) if n >= least else v)


def epoch_unit(df: DataFrame, column: str) -> str:
    """s, ms or ns by the size of the median."""
    m = df.agg(F.percentile(F.abs(num(column)), F.lit(0.5))).first()[0] or 0
    return "ns" if m >= 1e14 else "ms" if m >= 1e11 else "s"
