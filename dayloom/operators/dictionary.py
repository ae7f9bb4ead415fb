"""The data dictionary: counts, statistics, coverage, units, groups and notes of every column, from
two aggregates over the table (chunks of columns keep generated code within its limits)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.exprs import KEY, as_date

# Curated columns, and rules of units and groups in the order they are tried
QUALITY_COLUMNS = ("totalSteps", "minHeartRate", "maxHeartRate", "restingHeartRate", "stressTotalDurationSeconds", "bodyBatteryEndOfDay", "sleepStartTimestampGMT", "sleepEndTimestampGMT")
KEY_COLUMNS = (
    "totalSteps", "totalDistanceMeters", "activeKilocalories", "restingHeartRate", "minHeartRate", "maxHeartRate", "stressTotalDurationSeconds", "stressAwakeDurationSeconds", "bodyBatteryStartOfDay", "bodyBatteryEndOfDay", "sleepStartTimestampGMT",
    "sleepEndTimestampGMT", "deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds", "averageRespiration", "avgSleepStress", "sleepOverallScore", "sleepQualityScore", "sleepDurationScore", "sleepRecoveryScore",
)
GROUPS = (("stress", ("stress",)), ("body_battery", ("bodybattery",)), ("respiration", ("respiration",)), ("hydration", ("^hydration",)), ("flags_includes", ("^includes",)), ("sleep", ("sleep",)), ("spo2", ("spo2",)), ("heart_rate", ("heartrate",)), ("calories", ("calories",)), ("steps_distance", ("steps", "distance", "meters")), ("timestamps", ("timestamp", "date")))
FEATURE_GROUPS = ("stress", "body_battery", "heart_rate", "steps_distance", "calories", "sleep", "spo2", "respiration", "hydration")
MEDIUM_GROUPS = ("stress", "sleep", "body_battery", "heart_rate", "steps_distance", "spo2")
ISO = r"^\d{4}-\d{2}-\d{2}T"
CHUNK = 40


def group_of(name: str) -> str:
    low = name.lower()
    return next((g for g, marks in GROUPS if any(low.startswith(m[1:]) if m[0] == "^" else m in low for m in marks)), "other")


def is_time(name: str) -> bool:
    return any(m in name.lower() for m in ("timestamp", "timegmt", "timelocal"))


def unit_of(name: str, stats: dict) -> str:
    low, top, least = name.lower(), stats["max"], stats["min"]
    if is_time(name):
        if stats["iso"]:
            return "datetime"
        if top is not None and top >= 1e9:
            return "ms" if top >= 1e12 else "s"
    rules = (
        ("version" in low, ""), ("meters" in low, "Meters"), ("durationinmilliseconds" in low, "Milliseconds"), ("seconds" in low, "Seconds"), ("hydration" in low and "ml" in low, "mL"), ("calories" in low, "Kilocalories"),
        ("heartrate" in low, "bpm"), (low.endswith("hr") or "averagehr" in low, "bpm"), ("respiration" in low, "brpm"), ("spo2" in low, "percent"), ("value" in low and top is not None and 0 <= least and top <= 100, "percent"),
    )
    return next((unit for found, unit in rules if found), "")


def note_of(name: str, stats: dict) -> str:
    low, top = name.lower(), stats["max"]
    if "uuid" in low or "userprofilepk" in low:
        return "likely identifier"
    if is_time(name):
        if stats["iso"]:
            return "ISO datetime string"
        if top is not None and top >= 1e9:
            return "epoch millis" if top >= 1e12 else "epoch seconds timestamp"
    if top is not None and top >= 1e9 and ("timestamp" in low or "date" in low):
        return "epoch millis timestamp" if top >= 1e12 else "epoch seconds timestamp"
    return "ISO datetime string" if stats["iso"] else ""


def annotations(name: str) -> dict:
    group, low = group_of(name), name.lower()
    used = not (name == KEY or name.endswith("_" + KEY) or low.startswith(("version", "source")) or "userprofilepk" in low or "uuid" in low)
    priority = "high" if name in (*KEY_COLUMNS, *QUALITY_COLUMNS) else "medium" if group in MEDIUM_GROUPS else "low"
    return {"used_in_quality": name in QUALITY_COLUMNS, "used_in_eda": used, "candidate_model_feature": used and group in FEATURE_GROUPS, "analysis_priority": priority}


NUMBERS = ("min", "p05", "p25", "median", "p75", "p95", "max", "mean", "std")
SCHEMA = (
    "column string, dtype string, non_null_count long, non_null_pct double, missing_count long, missing_pct double, n_unique long, is_constant boolean, zero_pct double, first_non_null_date date, last_non_null_date date, coverage_span_days int, "
    "coverage_within_span_pct double, example_values string, " + ", ".join(f"{n} double" for n in NUMBERS) + ", inferred_unit string, inferred_group string, notes string, used_in_quality boolean, used_in_eda boolean, candidate_model_feature boolean, analysis_priority string"
)


def profile(df: DataFrame) -> list[dict]:
    """Counts and statistics of every column; a row a column on the driver."""
    day = as_date(KEY) if KEY in df.columns else F.lit(None).cast("date")
    df = df.withColumn("__day", day)
    out = []
    fields = [f for f in df.schema.fields if f.name != "__day"]
    for at in range(0, len(fields), CHUNK):
        part, aggs = fields[at : at + CHUNK], [F.count(F.lit(1)).alias("total")]
        for i, f in enumerate(part):
            c, known = F.col(f.name), F.col(f.name).isNotNull()
            numeric = isinstance(f.dataType, T.NumericType)
            v = c.cast("double") if numeric else F.lit(None).cast("double")
            text = isinstance(f.dataType, T.StringType)
            aggs += [F.count(c).alias(f"k{i}"), F.count_distinct(c).alias(f"u{i}"), F.count_if(v == 0).alias(f"z{i}"), F.min(F.when(known, F.col("__day"))).alias(f"a{i}"), F.max(F.when(known, F.col("__day"))).alias(f"b{i}"), (F.count_if(c.rlike(ISO)) if text else F.lit(0)).alias(f"i{i}")]
            if numeric:
                aggs += [F.min(v).alias(f"n{i}"), F.max(v).alias(f"x{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.percentile(v, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias(f"p{i}")]
        r = df.agg(*aggs).first().asDict()
        for i, f in enumerate(part):
            numeric = isinstance(f.dataType, T.NumericType)
            p = (r.get(f"p{i}") or [None] * 5) if numeric else [None] * 5
            stats = dict(zip(NUMBERS, (r.get(f"n{i}"), *p, r.get(f"x{i}"), r.get(f"m{i}"), r.get(f"s{i}")), strict=True)) if numeric else dict.fromkeys(NUMBERS)
            out.append({"name": f.name, "dtype": f.dataType.simpleString(), "total": r["total"], "known": r[f"k{i}"], "unique": r[f"u{i}"], "zero": r[f"z{i}"] if numeric else None, "first": r[f"a{i}"], "last": r[f"b{i}"], "stats": stats | {"iso": bool(r[f"i{i}"])}})
    return out


def coverage_within(df: DataFrame, spans: dict[str, tuple]) -> dict[str, int]:
    """Rows whose day lies between each column's first and last known day."""
    if not spans:
        return {}
    names = list(spans)
    found = df.agg(*[F.count_if(as_date(KEY).between(F.lit(a), F.lit(b))).alias(f"c{i}") for i, (a, b) in enumerate(spans.values())]).first()
    return dict(zip(names, found, strict=True))


def examples(df: DataFrame, names: list[str], most: int) -> dict[str, str]:
    """The first distinct values of each column by day, as JSON. One row a (column, value), its
    smallest day, so that only ``most`` rows a column are kept after partial aggregation."""
    if not names or not most:
        return dict.fromkeys(names, "[]")
    day = as_date(KEY) if KEY in df.columns else F.lit(None).cast("date")
    long = df.select(day.alias("__day"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])).alias("e")).where("e.value is not null")
    first = long.groupBy("e.name", "e.value").agg(F.min("__day").alias("day"))
    from pyspark.sql import Window

    top = first.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.col("day").asc_nulls_last(), "value"))).where(F.col("r") <= most)
    said: dict[str, list] = {n: [] for n in names}
    for r in top.orderBy("name", "r").collect():
        said[r["name"]].append(r["value"])
    return {n: json.dumps(v, ensure_ascii=False) for n, v in said.items()}


def build_dictionary(df: DataFrame, max_sample_values: int = 5) -> DataFrame:
    """30 attributes of every column, one row a column."""
    rows, out = profile(df), []
    inside = coverage_within(df, {r["name"]: (r["first"], r["last"]) for r in rows if r["first"] is not None})
    shown = examples(df, [r["name"] for r in rows], max_sample_values)
    for r in rows:
        n, total, name = r["known"], r["total"], r["name"]
        share = 100.0 * n / total if total else 0.0
        span = (r["last"] - r["first"]).days + 1 if r["first"] is not None else None
        within = 100.0 * n / inside[name] if inside.get(name) else None
        said = annotations(name)
        out.append((name, r["dtype"], n, share, total - n, 100.0 - share if total else 0.0, r["unique"], r["unique"] <= 1 if n else None, 100.0 * r["zero"] / n if r["zero"] is not None and n else None, r["first"], r["last"], span, within, shown[name], *[r["stats"][k] for k in NUMBERS], unit_of(name, r["stats"]), group_of(name), note_of(name, r["stats"]), *said.values()))
    return df.sparkSession.createDataFrame(out, SCHEMA)


def priority_counts(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("analysis_priority").count().orderBy(F.desc("count"), "analysis_priority")


def low_coverage(dictionary: DataFrame, below: float = 85.0) -> DataFrame:
    return dictionary.where(F.col("non_null_pct") < below).orderBy(F.desc("missing_pct"), "column")


def quality_coverage(dictionary: DataFrame) -> DataFrame:
    """The quality columns, those with most missing first."""
    return dictionary.where(F.col("column").isin(*QUALITY_COLUMNS)).select("column", "non_null_pct", "missing_pct").orderBy(F.desc("missing_pct"), "column")


def coverage_summary(dictionary: DataFrame) -> DataFrame:
    """Least and median coverage of the quality columns."""
    return quality_coverage(dictionary).agg(F.min("non_null_pct").alias("least_pct"), F.median("non_null_pct").alias("median_pct"))
