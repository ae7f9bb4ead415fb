"""The SQL mart: three facts, three views and the query pack, as DataFrame plans and as Spark SQL
over temporary views. Missing columns of a fact become typed nulls when the plan is built."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.functions.exprs import KEY, as_date, bands, coalesced, iso_weekday, optional, weekday_name
from dayloom.functions.positions import rolling_rows, tile, with_position

# The columns a fallback fact takes from the daily table
SLEEP_FALLBACK = (
    "sleepStartTimestampGMT", "sleepEndTimestampGMT", "deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds", "averageRespiration", "avgSleepStress",
    "sleepOverallScore", "sleepQualityScore", "sleepDurationScore", "sleepRecoveryScore", "sleepAverageStressLevel", "sleep_start_hour_local", "sleep_start_hour_local_wrapped", "sleep_opportunity_hours",
)
QUALITY_FALLBACK = ("quality_score", "day_quality_label_strict", "day_quality_label_loose", "valid_day_strict", "valid_day_loose", "has_sleep", "corrupted_stress_only_day")
STAGES = ("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds")
LOW_RECOVERY = 75


def fact(df: DataFrame) -> DataFrame:
    """The date first and typed, the other columns as they are."""
    return df.select(as_date(KEY).alias(KEY), *[c for c in df.columns if c != KEY])


def fallback(daily: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A fact cut from the daily table; it has a row for every day, measured or not."""
    return daily.select(KEY, *[c for c in names if c in daily.columns])


def build_facts(daily: DataFrame, sleep: DataFrame | None = None, quality: DataFrame | None = None) -> dict[str, DataFrame]:
    d = fact(daily)
    return {"fact_daily": d, "fact_sleep": fact(sleep) if sleep is not None else fallback(d, SLEEP_FALLBACK), "fact_quality": fact(quality) if quality is not None else fallback(d, QUALITY_FALLBACK)}


def day_to_next_sleep(daily: DataFrame, sleep: DataFrame, quality: DataFrame) -> DataFrame:
    """Each day with its quality and the night that follows it. The next night is an equi-join on
    a computed key, so that large inputs hash-partition on dates and small ones broadcast."""
    d = daily.select(
        F.col(KEY).alias("day_date"), optional(daily, "totalSteps", "double").alias("day_total_steps"), optional(daily, "totalDistanceMeters", "double").alias("day_total_distance_meters"),
        optional(daily, "activeKilocalories", "double").alias("day_active_kilocalories"), coalesced(daily, ("awakeAverageStressLevel", "allDayStress_AWAKE_averageStressLevel"), "double").alias("day_awake_average_stress"),
        optional(daily, "maxHeartRate", "double").alias("day_max_heart_rate"), optional(daily, "bodyBatteryLowest", "double").alias("day_body_battery_lowest"),
    )
    q = quality.select(F.col(KEY).alias("q_date"), optional(quality, "day_quality_label_strict", "string").alias("day_quality_label_strict"), optional(quality, "valid_day_strict", "boolean").alias("valid_day_strict"), optional(quality, "corrupted_stress_only_day", "boolean").alias("corrupted_stress_only_day"))
    s = sleep.select(
        F.col(KEY).alias("next_sleep_date"), optional(sleep, "sleepRecoveryScore", "double").alias("nextsleep_recovery_score"), optional(sleep, "sleepOverallScore", "double").alias("nextsleep_overall_score"),
        optional(sleep, "sleepQualityScore", "double").alias("nextsleep_quality_score"), coalesced(sleep, ("avgSleepStress", "sleepAverageStressLevel"), "double").alias("nextsleep_avg_sleep_stress"),
        optional(sleep, "sleepStartTimestampGMT", "double").alias("nextsleep_start_ts_gmt"), optional(sleep, "sleepEndTimestampGMT", "double").alias("nextsleep_end_ts_gmt"),
    )
    return d.join(q, F.col("q_date") == F.col("day_date"), "left").drop("q_date").join(s, F.col("next_sleep_date") == F.date_add("day_date", 1), "left")


def sleep_nights(sleep: DataFrame) -> DataFrame:
    start, end = optional(sleep, "sleepStartTimestampGMT", "double"), optional(sleep, "sleepEndTimestampGMT", "double")
    stages = sum((F.coalesce(optional(sleep, c, "double"), F.lit(0.0)) for c in STAGES), F.lit(0.0)) / 3600
    by_stage = stages if any(c in sleep.columns for c in STAGES) else F.lit(None).cast("double")
    return sleep.select(
        F.col(KEY).alias("sleep_date"), start.alias("sleep_start_ts_gmt"), end.alias("sleep_end_ts_gmt"), optional(sleep, "sleepOverallScore", "double").alias("sleep_overall_score"), optional(sleep, "sleepQualityScore", "double").alias("sleep_quality_score"),
        coalesced(sleep, ("avgSleepStress", "sleepAverageStressLevel"), "double").alias("sleep_avg_stress"), optional(sleep, "sleepRecoveryScore", "double").alias("sleep_recovery_score"),
        F.when(end > start, (end - start) / 3600).otherwise(by_stage).alias("sleep_hours"),
    )


def weekday_profiles(aligned: DataFrame) -> DataFrame:
    day = F.col("day_date")
    return aligned.groupBy(iso_weekday(day).alias("iso_weekday"), weekday_name(day).alias("weekday_name")).agg(
        F.count("*").alias("days_total"), F.count_if("valid_day_strict").alias("strict_good_days"), F.avg("day_total_steps").alias("avg_steps"), F.median("day_total_steps").alias("median_steps"),
        F.avg("day_awake_average_stress").alias("avg_awake_stress"), F.median("nextsleep_recovery_score").alias("median_nextsleep_recovery"),
    )


def strict(aligned: DataFrame, *needed: str) -> DataFrame:
    """Valid, not corrupted days on which all of ``needed`` are known; null flags do not pass."""
    out = aligned.where(F.col("valid_day_strict") & ~F.coalesce("corrupted_stress_only_day", F.lit(False)))
    return out.dropna(subset=list(needed)) if needed else out


def _hundred(part, total):
    return F.round(F.lit(100.0).cast("double") * part / total, 2)


def quality_mix(quality: DataFrame) -> DataFrame:
    counts = quality.groupBy(optional(quality, "day_quality_label_strict", "string").alias("strict_label")).agg(F.count("*").alias("days"))
    return counts.withColumn("pct_days", _hundred(F.col("days"), F.sum("days").over(Window.partitionBy(F.lit(1))))).orderBy(F.desc("days"), F.col("strict_label").asc_nulls_last())


def weekday_report(aligned: DataFrame) -> DataFrame:
    return weekday_profiles(aligned).select("iso_weekday", "weekday_name", "days_total", "strict_good_days", F.round("avg_steps", 1).alias("avg_steps"), F.round("median_steps", 1).alias("median_steps"), F.round("avg_awake_stress", 2).alias("avg_awake_stress"), F.round("median_nextsleep_recovery", 2).alias("median_nextsleep_recovery")).orderBy("iso_weekday")


def top_stress_days(aligned: DataFrame, top_n: int = 20) -> DataFrame:
    days = strict(aligned, "day_awake_average_stress").select("day_date", "day_awake_average_stress", "day_total_steps", "nextsleep_recovery_score", "day_quality_label_strict")
    return days.orderBy(F.desc("day_awake_average_stress"), "day_date").limit(top_n)


def stress_quartiles(aligned: DataFrame, buckets: int = 4) -> DataFrame:
    """In the order of value and day, so that ties fall into the same bucket every time."""
    rows, n = with_position(strict(aligned, "day_awake_average_stress", "nextsleep_recovery_score"), "day_awake_average_stress", ("day_date",))
    return rows.groupBy(tile(F.col("position"), n, buckets).alias("stress_quartile")).agg(
        F.count("*").alias("days"), F.round(F.avg("day_awake_average_stress"), 2).alias("avg_awake_stress"), F.round(F.avg("nextsleep_recovery_score"), 2).alias("avg_next_recovery"), F.round(F.median("nextsleep_recovery_score"), 2).alias("median_next_recovery")
    ).orderBy("stress_quartile")


def next_recovery_rolling(aligned: DataFrame, rows_back: int = 6) -> DataFrame:
    rows = strict(aligned, "nextsleep_recovery_score").select("day_date", "nextsleep_recovery_score", F.unix_date("day_date").alias("__day"))
    return rolling_rows(rows, "__day", rows_back, lambda w: F.round(F.avg("nextsleep_recovery_score").over(w), 2), "next_recovery_7d_ma").drop("__day")


def recovery_risk(aligned: DataFrame) -> DataFrame:
    stress = F.col("day_awake_average_stress")
    return strict(aligned, "day_awake_average_stress", "nextsleep_recovery_score").select(
        "day_date", "day_awake_average_stress", "day_max_heart_rate", "day_body_battery_lowest", "nextsleep_recovery_score",
        F.when(stress >= 60, "high_stress").when(stress >= 50, "mid_stress").otherwise("lower_stress").alias("stress_band"), (F.col("nextsleep_recovery_score") < LOW_RECOVERY).cast("int").alias("low_recovery_flag"),
    )


def sleep_bands(nights: DataFrame) -> DataFrame:
    band = bands(F.col("sleep_hours"), [(6, "<6h"), (7.5, "6-7.5h"), (9, "7.5-9h")], ">=9h")
    out = nights.where("sleep_hours > 0").groupBy(band.alias("sleep_band")).agg(F.count("*").alias("nights"), F.round(F.avg("sleep_hours"), 2).alias("avg_sleep_hours"), F.round(F.median("sleep_overall_score"), 2).alias("median_overall_score"), F.round(F.avg("sleep_avg_stress"), 2).alias("avg_sleep_stress"))
    return out.orderBy("avg_sleep_hours")


def alignment_coverage(aligned: DataFrame) -> DataFrame:
    valid = F.coalesce("valid_day_strict", F.lit(False))
    both = valid & F.col("next_sleep_date").isNotNull()
    strict_rows = F.count_if(valid)
    return aligned.agg(
        F.count("*").alias("day_rows"), F.count("next_sleep_date").alias("rows_with_next_sleep"), _hundred(F.count("next_sleep_date"), F.nullif(F.count("*"), F.lit(0))).alias("next_sleep_coverage_pct"),
        strict_rows.alias("strict_day_rows"), F.count_if(both).alias("strict_rows_with_next_sleep"), _hundred(F.count_if(both), F.nullif(strict_rows, F.lit(0))).alias("strict_next_sleep_coverage_pct"),
    )


def weekday_stress_rank(aligned: DataFrame) -> DataFrame:
    rank = F.dense_rank().over(Window.orderBy(F.col("avg_awake_stress").desc_nulls_last()))
    return weekday_profiles(aligned).select("iso_weekday", "weekday_name", F.round("avg_awake_stress", 2).alias("avg_awake_stress"), rank.alias("stress_rank_desc")).orderBy("stress_rank_desc", "iso_weekday")


def feature_extract(aligned: DataFrame) -> DataFrame:
    needed = ("day_awake_average_stress", "day_max_heart_rate", "day_body_battery_lowest", "nextsleep_recovery_score")
    return strict(aligned, *needed).select("day_date", *needed[:3], "day_total_steps", needed[3], (F.col(needed[3]) < LOW_RECOVERY).cast("int").alias("target_low_recovery"))


def build_mart(spark: SparkSession, daily: DataFrame, sleep: DataFrame | None = None, quality: DataFrame | None = None, persist: bool = False) -> dict[str, int]:
    """Registers facts and views (or writes the facts as tables) and returns their row counts."""
    facts = build_facts(daily, sleep, quality)
    for name, df in facts.items():
        if persist:
            df.write.mode("overwrite").saveAsTable(name)
            facts[name] = spark.table(name)
        else:
            df.createOrReplaceTempView(name)
    aligned = day_to_next_sleep(facts["fact_daily"], facts["fact_sleep"], facts["fact_quality"])
    views = {"vw_day_to_next_sleep": aligned, "vw_sleep_nights": sleep_nights(facts["fact_sleep"]), "vw_weekday_profiles": weekday_profiles(aligned)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return {name: df.count() for name, df in {**facts, **views}.items()}


def write_mart(daily: DataFrame, path: str, sleep: DataFrame | None = None, quality: DataFrame | None = None, overwrite: bool = False) -> None:
    """The facts as Parquet tables under ``path``, where ``open_mart`` finds them again."""
    for name, df in build_facts(daily, sleep, quality).items():
        try:
            df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise ValueError(f"{path}/{name} exists; overwrite it by asking for it") from e


def open_mart(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The facts of a written mart; its facts and views are registered and counted."""
    try:
        facts = {name: spark.read.parquet(f"{path}/{name}") for name in ("fact_daily", "fact_sleep", "fact_quality")}
    except AnalysisException as e:
        raise FileNotFoundError(f"no mart in {path}") from e
    return facts, build_mart(spark, facts["fact_daily"], facts["fact_sleep"], facts["fact_quality"])


#: The query pack over the mart: name -> (what it reads, plan).
PACK = {
    "01_quality_mix": ("fact_quality", quality_mix),
    "02_weekday_profiles": ("aligned", weekday_report),
    "03_top_awake_stress_days": ("aligned", top_stress_days),
    "04_stress_quartile_vs_next_recovery": ("aligned", stress_quartiles),
    "05_next_recovery_rolling": ("aligned", next_recovery_rolling),
    "06_recovery_risk_flags": ("aligned", recovery_risk),
    "07_sleep_duration_bands": ("nights", sleep_bands),
    "08_alignment_coverage": ("aligned", alignment_coverage),
    "09_weekday_stress_rank": ("aligned", weekday_stress_rank),
    "10_stage3_feature_extract": ("aligned", feature_extract),
}


def run_pack(facts: dict[str, DataFrame], out_dir: str | None = None) -> dict[str, DataFrame]:
    """Runs every query of the pack; with ``out_dir`` writes each as CSV."""
    inputs = {"aligned": day_to_next_sleep(facts["fact_daily"], facts["fact_sleep"], facts["fact_quality"]), "nights": sleep_nights(facts["fact_sleep"]), "fact_quality": facts["fact_quality"]}
    out = {name: plan(inputs[source]) for name, (source, plan) in PACK.items()}
    if out_dir:
        for name, df in out.items():
            df.coalesce(1).write.mode("overwrite").csv(f"{out_dir}/{name}", header=True)
    return out


def run_sql_directory(spark: SparkSession, query_dir: str, out_dir: str | None = None) -> dict[str, tuple[int, int]]:
    """Runs the folder's ``*.sql`` files in name order against the registered views; returns rows
    and columns of each. The folder is the caller's own and small."""
    from pathlib import Path

    files = sorted(Path(query_dir).glob("*.sql"))
    if not files:
        raise FileNotFoundError(f"no .sql files in {query_dir}")
    found = {}
    for f in files:
        df = spark.sql(f.read_text().strip().rstrip(";"))
        if out_dir:
            df.coalesce(1).write.mode("overwrite").csv(f"{out_dir}/{f.stem}", header=True)
        found[f.stem] = (df.count(), len(df.columns))
    return found
