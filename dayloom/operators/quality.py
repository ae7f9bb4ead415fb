"""Day-quality labels, suspicious-day rankings and the summary tables behind the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from dayloom.functions.exprs import KEY, flag, num_or_null, present, within

# Flag names and their order, labels, the artifact threshold in seconds
SCORED_FLAGS = ("has_steps", "has_hr", "has_stress_duration", "has_bodybattery_end", "has_sleep")
REASONS = (*SCORED_FLAGS, "full_day_stress")
LABELS = ("good", "partial", "bad")
ARTIFACT_SECONDS = 84_600
MATCH_SECONDS = 60
SUSPICIOUS_COLUMNS = (
    KEY, "quality_score", "day_quality_label_strict", "day_quality_label_loose", "corrupted_stress_only_day", "has_steps", "has_hr", "has_stress_duration",
    "has_bodybattery_start", "has_bodybattery_end", "has_bodybattery_any", "bodybattery_start_without_end", "has_sleep", "full_day_stress",
    "stressTotalDurationSeconds", "totalSteps", "minHeartRate", "maxHeartRate", "restingHeartRate", "bodyBatteryStartOfDay", "bodyBatteryEndOfDay", "suspicion_reasons",
)


@dataclass(frozen=True)
class QualityConfig:
    steps_min: int = 50
    stress_any_min_seconds: int = 21_600
    stress_full_min_seconds: int = 72_000
    strict_min_score: int = 4
    loose_min_score: int = 3
    top_n: int = 50


def _label(score: Column, least: int, corrupted: Column) -> Column:
    """A score of at most 1 is bad even where ``least`` is lower."""
    return F.when(corrupted | (score <= 1), "bad").when(score >= least, "good").otherwise("partial")


def label_days(df: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Adds the 18 quality columns: three projections that Catalyst folds into one."""
    at_least = lambda name, least: F.coalesce(num_or_null(df, name) >= least, F.lit(False))
    start, end = present(df, "bodyBatteryStartOfDay"), present(df, "bodyBatteryEndOfDay")
    match = lambda a, b: within(num_or_null(df, a), num_or_null(df, b), MATCH_SECONDS)
    out = df.withColumns({
        "has_steps": at_least("totalSteps", config.steps_min),
        "has_hr": present(df, "minHeartRate") | present(df, "maxHeartRate") | present(df, "restingHeartRate"),
        "has_stress_duration": at_least("stressTotalDurationSeconds", config.stress_any_min_seconds),
        "full_day_stress": at_least("stressTotalDurationSeconds", config.stress_full_min_seconds),
        "has_bodybattery_start": start,
        "has_bodybattery_end": end,
        "has_bodybattery_any": start | end,
        "bodybattery_start_without_end": start & ~end,
        "has_sleep": present(df, "sleepStartTimestampGMT") & present(df, "sleepEndTimestampGMT"),
        "stress_duration_matches_allDayStress_TOTAL": match("stressTotalDurationSeconds", "allDayStress_TOTAL_totalDuration"),
        "stress_awake_matches_allDayStress_AWAKE": match("stressAwakeDurationSeconds", "allDayStress_AWAKE_totalDuration"),
    })
    score = sum((F.col(f).cast("bigint") for f in SCORED_FLAGS), F.lit(0).cast("bigint"))
    lonely = ~(F.col("has_hr") | F.col("has_sleep") | F.col("has_bodybattery_end") | F.col("has_steps"))
    artifact = F.coalesce(num_or_null(df, "stressTotalDurationSeconds") >= ARTIFACT_SECONDS, F.lit(False)) & lonely
    out = out.withColumns({"quality_score": score, "corrupted_stress_only_day": artifact})
    q, bad = F.col("quality_score"), F.col("corrupted_stress_only_day")
    reasons = [F.when(bad, F.lit("corrupted_stress_only_day")), *[F.when(~F.col(f), F.lit(f)) for f in REASONS]]
    return out.withColumns({
        "day_quality_label_strict": _label(q, config.strict_min_score, bad),
        "day_quality_label_loose": _label(q, config.loose_min_score, bad),
        "valid_day_strict": (q >= config.strict_min_score) & ~bad,
        "valid_day_loose": (q >= config.loose_min_score) & ~bad,
        "suspicion_reasons": F.concat_ws(",", *reasons),
    })


def _listed(df: DataFrame, order: list[Column], top_n: int) -> DataFrame:
    tie = [F.col(KEY).asc_nulls_last()] if KEY in df.columns else []
    return df.orderBy(*order, *tie).limit(top_n).select(*[c for c in SUSPICIOUS_COLUMNS if c in df.columns])


def suspicious_days(labelled: DataFrame, top_n: int = 50) -> DataFrame:
    """Sparsest days first; the day breaks ties."""
    stress = F.coalesce(num_or_null(labelled, "stressTotalDurationSeconds"), F.lit(-1.0))
    return _listed(labelled, [F.col("quality_score").asc(), stress.asc(), flag(labelled, "has_sleep").asc()], top_n)


def artifact_days(labelled: DataFrame, top_n: int = 50) -> DataFrame:
    """Days that look like sensor artifacts first: much stress time and nothing to support it."""
    stress = F.coalesce(num_or_null(labelled, "stressTotalDurationSeconds"), F.lit(-1.0))
    missing = sum(((~flag(labelled, f)).cast("int") for f in ("has_hr", "has_sleep", "has_bodybattery_end", "has_steps")), F.lit(0))
    order = [flag(labelled, "corrupted_stress_only_day").desc(), flag(labelled, "full_day_stress").desc(), missing.desc(), stress.desc(), F.col("quality_score").asc()]
    return _listed(labelled, order, top_n)


def label_table(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each label, also of those that no day has."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == x).alias(x) for x in LABELS])
    rows = counts.select("total", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("count")) for x in LABELS])).alias("r"))
    pct = F.when(F.col("total") > 0, F.round(F.col("r.count") * F.lit(100.0).cast("double") / F.col("total"), 2)).otherwise(F.lit(0.0).cast("double"))
    return rows.select("r.label", F.col("r.count").alias("count"), pct.alias("pct"))


def flag_coverage(df: DataFrame, flags: tuple[str, ...] = SCORED_FLAGS) -> DataFrame:
    """Share of days on which each flag holds, in percent; all flags in one aggregate."""
    one = df.agg(*[F.avg(flag(df, f).cast("double") * 100).alias(f) for f in flags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("pct")) for f in flags])).alias("r")).select("r.flag", F.round("r.pct", 2).alias("pct"))


def pattern_table(df: DataFrame, first: str = "has_bodybattery_start", second: str = "has_bodybattery_end") -> DataFrame:
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    counts = df.groupBy(flag(df, first).alias(first), flag(df, second).alias(second)).agg(F.count("*").alias("count"))
    return counts.withColumn("pct", F.round(F.col("count") * F.lit(100.0).cast("double") / total, 2))


def start_without_end(df: DataFrame) -> DataFrame:
    c = flag(df, "bodybattery_start_without_end")
    return df.agg(F.count_if(c).alias("days"), F.round(F.avg(c.cast("double")) * 100, 2).alias("pct"))


def stress_hours_summary(df: DataFrame, limits: tuple[int, ...] = (1, 6, 12, 20)) -> DataFrame:
    hours = num_or_null(df, "stressTotalDurationSeconds") / 3600
    return df.agg(F.round(F.min(hours), 2).alias("min_hours"), F.round(F.median(hours), 2).alias("median_hours"), F.round(F.max(hours), 2).alias("max_hours"), *[F.count_if(hours < x).alias(f"days_below_{x}h") for x in limits])


def match_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    n = F.count(c)
    share = lambda x: F.when(n > 0, F.round(F.count_if(x) * F.lit(100.0).cast("double") / n, 2))
    return df.agg(n.alias("compared"), share(c).alias("pct_true"), share(~c).alias("pct_false"))


def corrupted_summary(df: DataFrame) -> DataFrame:
    c = flag(df, "corrupted_stress_only_day")
    return df.agg(F.count_if(c).alias("days"), F.round(F.avg(c.cast("double")) * 100, 2).alias("pct"), F.min(F.when(c, F.col(KEY))).alias("first_day"), F.max(F.when(c, F.col(KEY))).alias("last_day"))


def reason_table(df: DataFrame, mask: Column | None = None) -> DataFrame:
    """How often each reason occurs, and its share of the rows looked at. The number of rows
    comes from the same scan: every row also counts once under an empty reason."""
    rows = df if mask is None else df.where(F.coalesce(mask, F.lit(False)))
    said = F.filter(F.transform(F.split(F.coalesce("suspicion_reasons", F.lit("")), ","), F.trim), lambda x: x != "")
    counts = rows.select(F.explode(F.concat(F.array(F.lit("")), said)).alias("reason")).groupBy("reason").agg(F.count("*").alias("count"))
    total = F.max(F.when(F.col("reason") == "", F.col("count"))).over(Window.partitionBy(F.lit(1)))
    out = counts.withColumn("pct_of_rows", F.round(F.col("count") * F.lit(100.0).cast("double") / total, 2))
    return out.where("reason <> ''").orderBy(F.desc("count"), "reason")
