"""Slices, derived features, targets and the frames for analysis and modelling. Every feature is
an expression that is added only where its inputs exist; a chain of them is one projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.exprs import KEY, as_date, clock_hour, flag, has, num, ratio, row_sum, weekday_name, wrapped_hour

# Names of columns, features and tiers
STAGES = ("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds")
STRESS_ALIASES = {
    "stress_total_avg_level": "averageStressLevel", "stress_total_total_duration_s": "totalDuration", "stress_total_stress_duration_s": "stressDuration", "stress_total_rest_s": "restDuration", "stress_total_low_s": "lowDuration",
    "stress_total_med_s": "mediumDuration", "stress_total_high_s": "highDuration", "stress_total_activity_s": "activityDuration", "stress_total_uncat_s": "uncategorizedDuration",
}
DURATIONS = {"Activity": "activityDuration", "LowStress": "lowDuration", "MediumStress": "mediumDuration", "HighStress": "highDuration", "Rest": "restDuration", "Uncat": "uncategorizedDuration"}
CONTEXTS = {"AWAKE": "awake", "ASLEEP": "sleep", "TOTAL": "total"}
NEXT_SLEEP = ("sleepRecoveryScore", "sleepOverallScore", "sleepQualityScore", "avgSleepStress", "sleep_start_hour_local_wrapped", "sleep_opportunity_hours")
NEXT_SLEEP_STATS = ("sleepRecoveryScore", "sleepAverageStressLevel", "avgSleepStress", "sleepOverallScore", "sleepQualityScore", "sleep_start_hour_local_wrapped", "sleep_opportunity_hours")
TARGETS = ("sleepRecoveryScore", "sleepOverallScore", "sleepQualityScore", "avgSleepStress")
LOW_RECOVERY = 70.0
_AWAKE = "allDayStress_AWAKE_"
TIERS: dict[str, tuple[str, ...]] = {
    "tier1": ("totalSteps", "totalDistanceMeters", "activeKilocalories", "activeSeconds", "highlyActiveSeconds", "active_hours", "highly_active_hours", "restingHeartRate", "minHeartRate", "maxHeartRate", "bodyBatteryLowest",
              "bodyBatteryHighest", "bodyBattery_chargedValue", "bodyBattery_drainedValue", "bodyBatteryNetBalance", "floorsAscendedInMeters", "floorsDescendedInMeters", "dayofweek", "day_of_week", "weekday_name", "is_weekend"),
    "tier2_compact": ("awakeAverageStressLevel", "awakeActivityHours", "awakeMeasuredHours", "awakeHighStressShare", "awakeRestShare"),
    "tier2": ("awakeAverageStressLevel", *[f"awake{s}Hours" for s in DURATIONS], "awakeMeasuredHours", *[f"awake{s}Share" for s in DURATIONS],
              *[_AWAKE + s for s in ("activityDuration", "averageStressLevel", "highDuration", "lowDuration", "mediumDuration", "restDuration", "stressDuration", "maxStressLevel", "totalDuration", "uncategorizedDuration")]),
    "tier3": tuple(_AWAKE + s for s in ("averageStressLevelIntensity", "stressIntensityCount", "stressOffWristCount", "stressTooActiveCount", "totalStressCount", "totalStressIntensity")),
}
SCHEDULE = ("nextsleep_sleep_start_hour_local_wrapped", "nextsleep_sleep_opportunity_hours")


def require_unique_days(df: DataFrame, label: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """An error naming up to five days that occur more than once; one aggregate."""
    twice = [r[0] for r in df.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(5).collect()]
    if twice:
        raise ValueError(f"{label}: duplicate {KEY}: {', '.join(map(str, twice))}")
    return df


def load_days(df: DataFrame, label: str) -> DataFrame:
    """Key present, a date, and unique."""
    if KEY not in df.columns:
        raise KeyError(f"{label} is missing {KEY}")
    return require_unique_days(df.withColumn(KEY, as_date(KEY)), label)


def join_quality(daily: DataFrame, quality: DataFrame) -> DataFrame:
    """Only the quality columns that the daily table lacks."""
    extra = [c for c in quality.columns if c not in daily.columns]
    left, right = daily.withColumn(KEY, as_date(KEY)), quality.select(as_date(KEY).alias(KEY), *extra)
    return left.join(right, KEY, "left")


def strict_slice(df: DataFrame) -> DataFrame:
    return df.where(flag(df, "valid_day_strict") & ~flag(df, "corrupted_stress_only_day"))


def loose_slice(df: DataFrame) -> DataFrame:
    return df.where(flag(df, "valid_day_loose") & ~flag(df, "corrupted_stress_only_day"))


def sleep_slice(df: DataFrame) -> DataFrame:
    return df.where(flag(df, "has_sleep") & ~flag(df, "corrupted_stress_only_day"))


def analysis_slices(daily: DataFrame, quality: DataFrame) -> dict[str, DataFrame]:
    joined = join_quality(daily, quality)
    for c in ("valid_day_strict", "corrupted_stress_only_day", "has_sleep"):
        if c not in joined.columns:
            raise KeyError(f"missing quality column {c}")
    return {"df_all": joined, "df_strict": strict_slice(joined), "df_sleep": sleep_slice(joined)}


def readiness(joined: DataFrame) -> DataFrame:
    """Rows of each slice and their shares, from one scan."""
    ok, bad, slept = flag(joined, "valid_day_strict"), flag(joined, "corrupted_stress_only_day"), flag(joined, "has_sleep")
    n = F.count("*")
    share = lambda c: F.when(n > 0, F.count_if(c) * F.lit(100.0).cast("double") / n).otherwise(F.lit(0.0).cast("double"))
    return joined.agg(n.alias("rows_all"), F.count_if(ok & ~bad).alias("rows_strict"), F.count_if(slept & ~bad).alias("rows_sleep"), F.round(share(ok & ~bad), 6).alias("strict_good_pct"), F.round(share(slept & ~bad), 6).alias("sleep_present_pct"), F.round(F.avg(bad.cast("double")) * 100, 6).alias("corrupted_pct"))


def calendar_parts(df: DataFrame) -> DataFrame:
    day = F.col(KEY)
    return df.withColumn(KEY, as_date(KEY)).withColumns({"date": day, "year": F.year(day), "month": F.month(day), "week": F.weekofyear(day), "dayofweek": F.weekday(day)})


def derived_features(df: DataFrame) -> DataFrame:
    if KEY not in df.columns:
        raise KeyError(f"missing {KEY}")
    out = calendar_parts(df)
    new = {alias: F.col(f"allDayStress_TOTAL_{s}") for alias, s in STRESS_ALIASES.items() if has(df, f"allDayStress_TOTAL_{s}") and not has(df, alias)}
    for name, source, unit in (("stress_hours", "stressTotalDurationSeconds", 3600), ("awake_stress_hours", "stressAwakeDurationSeconds", 3600), ("steps_k", "totalSteps", 1000), ("distance_km", "totalDistanceMeters", 1000), ("active_hours", "activeSeconds", 3600)):
        if has(df, source):
            new[name] = num(source) / unit
    if has(df, "bodyBatteryEndOfDay", "bodyBatteryStartOfDay"):
        new["bb_delta"] = num("bodyBatteryEndOfDay") - num("bodyBatteryStartOfDay")
    stages = [c for c in STAGES if has(df, c)]
    if stages:
        total, core = row_sum([num(c) for c in stages]), [num(c) for c in stages if c != "awakeSleepSeconds"]
        new |= {"sleep_total_seconds": total, "sleep_total_hours": total / 3600, "sleep_efficiency": ratio(row_sum(core), total) if core else F.lit(None).cast("double")}
        new |= {c.replace("SleepSeconds", "_pct"): ratio(num(c), total) for c in stages}
    if has(df, "latestSpo2Value", "lowestSpo2Value"):
        new["spo2_gap"] = num("latestSpo2Value") - num("lowestSpo2Value")
    return out.withColumns(new)


def stress_context(df: DataFrame, context: str, prefix: str) -> DataFrame:
    base, new = f"allDayStress_{context}_", {}
    if has(df, base + "averageStressLevel"):
        new[f"{prefix}AverageStressLevel"] = num(base + "averageStressLevel")
    total = num(base + "totalDuration") / 3600 if has(df, base + "totalDuration") else None
    if total is not None:
        new[f"{prefix}MeasuredHours"] = total
    for stem, source in DURATIONS.items():
        if has(df, base + source):
            hours = num(base + source) / 3600
            new[f"{prefix}{stem}Hours"] = hours
            if total is not None:
                new[f"{prefix}{stem}Share"] = ratio(hours, total)
    return df.withColumns(new) if new else df


def local_offset_seconds(df: DataFrame, plausible_hours: float | None = None):
    """Local less GMT from the first pair of columns that has both; implausible ones are null."""
    found = []
    for gmt, local in (("wellnessStartTimeGmt", "wellnessStartTimeLocal"), ("wellnessEndTimeGmt", "wellnessEndTimeLocal")):
        if has(df, gmt, local):
            found.append(F.unix_micros(F.try_to_timestamp(F.col(local).cast("string"))) / 1e6 - F.unix_micros(F.try_to_timestamp(F.col(gmt).cast("string"))) / 1e6)
    if not found:
        return F.lit(None).cast("double")
    offset = F.coalesce(*found)
    return offset if plausible_hours is None else F.when(F.abs(offset) <= plausible_hours * 3600, offset)


def sleep_schedule(df: DataFrame) -> DataFrame:
    new = {}
    if has(df, "sleepStartTimestampGMT") and not has(df, "sleep_start_hour_local"):
        seconds = num("sleepStartTimestampGMT") + F.coalesce(local_offset_seconds(df), F.lit(0.0))
        new["sleep_start_hour_local"] = clock_hour(F.timestamp_seconds(F.floor(seconds)))
    if has(df, "sleepStartTimestampGMT", "sleepEndTimestampGMT") and not has(df, "sleep_opportunity_hours"):
        hours = (num("sleepEndTimestampGMT") - num("sleepStartTimestampGMT")) / 3600
        new["sleep_opportunity_hours"] = F.when(hours > 0, hours)
    out = df.withColumns(new) if new else df
    return out.withColumn("sleep_start_hour_local_wrapped", wrapped_hour(num("sleep_start_hour_local"))) if has(out, "sleep_start_hour_local") else out


def modeling_features(df: DataFrame) -> DataFrame:
    out = derived_features(df)
    new = {}
    if has(out, "totalSteps", "totalDistanceMeters") and not has(out, "step_length_m"):
        new["step_length_m"] = F.when(num("totalSteps") >= 1000, num("totalDistanceMeters") / num("totalSteps"))
    if has(out, "highlyActiveSeconds") and not has(out, "highly_active_hours"):
        new["highly_active_hours"] = num("highlyActiveSeconds") / 3600
    for alias, source in (("bodyBatteryCharged", "bodyBattery_chargedValue"), ("bodyBatteryDrained", "bodyBattery_drainedValue")):
        if has(out, source) and not has(out, alias):
            new[alias] = num(source)
    out = out.withColumns(new) if new else out
    if has(out, "bodyBatteryCharged", "bodyBatteryDrained") and not has(out, "bodyBatteryNetBalance"):
        out = out.withColumn("bodyBatteryNetBalance", num("bodyBatteryCharged") - num("bodyBatteryDrained"))
    for context, prefix in CONTEXTS.items():
        out = stress_context(out, context, prefix)
    day = F.col(KEY)
    return sleep_schedule(out).withColumns({"day_of_week": F.weekday(day), "weekday_name": weekday_name(day), "is_weekend": F.weekday(day) >= 5})


def sleep_onset(df: DataFrame) -> DataFrame:
    """The evening a night began on: the day before its wake-up date."""
    day = F.date_sub(as_date(KEY), 1)
    return df.withColumns({"sleep_onset_date": day, "sleep_onset_day_of_week": F.weekday(day), "sleep_onset_weekday_name": weekday_name(day)})


def next_sleep(days: DataFrame, sleep: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join of the night that follows, its columns prefixed."""
    kept = [c for c in columns if c in sleep.columns]
    right = sleep.dropna(subset=[KEY]).select(F.date_sub(as_date(KEY), 1).alias(KEY), *[F.col(c).alias(f"nextsleep_{c}") for c in kept])
    return days.withColumn(KEY, as_date(KEY)).dropna(subset=[KEY]).join(right, KEY, "left")


def threshold_target(df: DataFrame, source: str, target: str, threshold: float, direction: str = "lt") -> DataFrame:
    v = num(source)
    tests = {"lt": v < threshold, "le": v <= threshold, "gt": v > threshold, "ge": v >= threshold}
    if direction not in tests:
        raise ValueError(f"unknown direction {direction!r}: one of {', '.join(tests)}")
    if source not in df.columns:
        raise KeyError(source)
    return df.withColumn(target, tests[direction].cast("bigint"))


def quantile_target(df: DataFrame, source: str, target: str, quantile: float, tail: str = "upper", inclusive: bool = True) -> tuple[DataFrame, float]:
    """The cutoff is the interpolated quantile of the known values; also returned."""
    if not 0 < quantile < 1:
        raise ValueError(f"no quantile: {quantile}")
    if tail not in ("lower", "upper"):
        raise ValueError(f"unknown tail {tail!r}: lower or upper")
    cutoff = df.agg(F.percentile(num(source), F.lit(quantile))).first()[0]
    return threshold_target(df, source, target, float("nan") if cutoff is None else cutoff, {"lower": ("lt", "le"), "upper": ("gt", "ge")}[tail][inclusive]), cutoff


def feature_columns(df: DataFrame, tiers: Iterable[str] = ("tier1",), schedule: bool = False) -> list[str]:
    wished: list[str] = []
    for t in tiers:
        if t not in TIERS:
            raise KeyError(f"unknown tier {t}")
        wished += TIERS[t]
    return [c for c in dict.fromkeys([*wished, *(SCHEDULE if schedule else ())]) if c in df.columns]


def recovery_frame(daily: DataFrame, quality: DataFrame, day_quality: str = "strict", low_recovery: float = LOW_RECOVERY, schedule: bool = True) -> DataFrame:
    """Day D with features, the night after it, and targets from that night."""
    if day_quality not in ("strict", "loose"):
        raise ValueError("day_quality must be 'strict' or 'loose'")
    joined = join_quality(daily, quality)
    for c in ("corrupted_stress_only_day", "has_sleep", f"valid_day_{day_quality}"):
        if c not in joined.columns:
            raise KeyError(f"missing quality column {c}")
    featured = modeling_features(joined)
    columns = [c for c in NEXT_SLEEP if schedule or c not in NEXT_SLEEP[-2:]]
    out = next_sleep((strict_slice if day_quality == "strict" else loose_slice)(featured), sleep_slice(featured), columns)
    new = {f"target_{c}_next_night": num(f"nextsleep_{c}") for c in TARGETS if has(out, f"nextsleep_{c}")}
    if has(out, "nextsleep_sleepRecoveryScore"):
        new["target_low_recovery_next_night"] = (num("nextsleep_sleepRecoveryScore") < low_recovery).cast("bigint")
    return out.withColumns(new | {"model_row_current_quality": F.lit(day_quality)})


def stat_frames(daily: DataFrame, quality: DataFrame) -> dict[str, DataFrame]:
    slices = analysis_slices(daily, quality)
    days, sleep = modeling_features(slices["df_strict"]), modeling_features(slices["df_sleep"])
    return {"day_strict": days, "sleep_onset": sleep_onset(sleep), "day_nextsleep": next_sleep(days, sleep, NEXT_SLEEP_STATS)}


def keep_one_per_day(df: DataFrame, order: Sequence, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """The first row of each day in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
