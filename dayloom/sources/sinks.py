"""Sinks: Parquet and CSV through Spark; reports (small, from collected tables) as text; JDBC."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.exprs import KEY, as_date, coalesced, optional
from dayloom.operators import dictionary, quality
from dayloom.operators.features import keep_one_per_day


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    (df if files is None else df.coalesce(files)).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    (df if files is None else df.coalesce(files)).write.mode("overwrite").csv(path, header=True)


def write_json_report(report: dict[str, Any], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report | {"generated_at_utc": datetime.now(UTC).isoformat(timespec="seconds")}, indent=2, sort_keys=True, default=str))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A table of a small result; ``most`` bounds what reaches the driver. A last line says how many
    rows are left out."""
    show = lambda v: "" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    rows = df.limit(most).collect()
    left_out = df.count() - most if len(rows) == most else 0
    more = [f"\n{left_out} more rows."] if left_out > 0 else []
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows], *more])


def quality_report(labelled: DataFrame) -> str:
    parts = [
        ("Strict labels", quality.label_table(labelled, "day_quality_label_strict")), ("Loose labels", quality.label_table(labelled, "day_quality_label_loose")), ("Signal coverage", quality.flag_coverage(labelled)),
        ("Body battery patterns", quality.pattern_table(labelled)), ("Start without end", quality.start_without_end(labelled)), ("Stress hours", quality.stress_hours_summary(labelled)),
        ("Total stress agrees", quality.match_summary(labelled, "stress_duration_matches_allDayStress_TOTAL")), ("Awake stress agrees", quality.match_summary(labelled, "stress_awake_matches_allDayStress_AWAKE")),
        ("Corrupted days", quality.corrupted_summary(labelled)), ("Reasons, all days", quality.reason_table(labelled)), ("Reasons, strictly bad days", quality.reason_table(labelled, F.col("day_quality_label_strict") == "bad")),
    ]
    return "# Day quality\n\n" + "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts) + "\n"


def write_quality(labelled: DataFrame, out_dir: str, parquet: str | None = None, top_n: int = 50) -> None:
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    (Path(out_dir) / "quality_summary.md").write_text(quality_report(labelled))
    write_csv(quality.suspicious_days(labelled, top_n), f"{out_dir}/suspicious_days", 1)
    write_csv(quality.artifact_days(labelled, top_n), f"{out_dir}/suspicious_days_artifacts", 1)
    if parquet:
        write_parquet(labelled, parquet)


def dictionary_report(table: DataFrame, mode: str = "summary") -> str:
    parts = [("Priorities", dictionary.priority_counts(table)), ("Most missing", table.select("column", "missing_pct", "inferred_group").orderBy(F.desc("missing_pct"), "column").limit(20)), ("Low coverage", dictionary.low_coverage(table).select("column", "non_null_pct"))]
    order = F.array_position(F.array(*[F.lit(c) for c in dictionary.KEY_COLUMNS]), F.col("column"))
    parts.insert(1, ("Key signals", table.where(order > 0).orderBy(order).select("column", "non_null_pct", "median", "inferred_unit")))
    if mode == "full":
        parts.append(("All columns", table.orderBy("inferred_group", "column").drop("example_values")))
    return "# Data dictionary\n\n" + "\n\n".join(f"## {title}\n\n{markdown_table(df, max(200, table.count()))}" for title, df in parts) + "\n"


def write_dictionary(df: DataFrame, out_dir: str, max_sample_values: int = 5, mode: str = "both") -> DataFrame:
    if mode not in ("full", "summary", "both"):
        raise ValueError("mode must be full, summary or both")
    table = dictionary.build_dictionary(df, max_sample_values)
    write_csv(table, f"{out_dir}/data_dictionary", 1)
    for m, name in (("full", "data_dictionary.md"), ("summary", "data_dictionary_summary.md")):
        if mode in (m, "both"):
            (Path(out_dir) / name).write_text(dictionary_report(table, m))
    return table


# ---------------------------------------------------------------- relational extract

EXTRACT: dict[str, Sequence[tuple[str, Sequence[str], str]]] = {
    "daily": [("total_steps", ["totalSteps"], "bigint"), ("total_distance_meters", ["totalDistanceMeters"], "double"), ("active_kilocalories", ["activeKilocalories"], "double"), ("awake_average_stress", ["awakeAverageStressLevel", "allDayStress_AWAKE_averageStressLevel"], "double"), ("max_heart_rate", ["maxHeartRate"], "double"), ("body_battery_lowest", ["bodyBatteryLowest"], "double")],
    "sleep": [("sleep_recovery_score", ["sleepRecoveryScore"], "double"), ("sleep_overall_score", ["sleepOverallScore"], "double"), ("avg_sleep_stress", ["avgSleepStress", "sleepAverageStressLevel"], "double")],
    "quality": [("day_quality_label_strict", ["day_quality_label_strict"], "string"), ("valid_day_strict", ["valid_day_strict"], "boolean"), ("corrupted_stress_only_day", ["corrupted_stress_only_day"], "boolean")],
}


def relational_extract(df: DataFrame, kind: str) -> DataFrame:
    """A typed, snake-case table with one row a day (the first by its values)."""
    cols = [(coalesced(df, names, t) if len(names) > 1 else optional(df, names[0], t)).alias(name) for name, names, t in EXTRACT[kind]]
    rows = df.select(as_date(KEY).alias("calendar_date"), *cols).where("calendar_date is not null")
    return keep_one_per_day(rows, [F.col(n).asc_nulls_last() for n, _, _ in EXTRACT[kind]], ["calendar_date"])


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Replaces a table's rows, keeping its definition. Needs the database's driver on the classpath."""
    df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode("overwrite").save()


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the tables that exists, through Spark's own file systems."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
