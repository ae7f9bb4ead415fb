"""Registered queries, and for those that SQL can express the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayloom.operators import quality
from dayloom.plans import mart, testbed
from dayloom.plans.testbed import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, plan: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = plan
    if sql is not None:
        ORACLES[name] = sql


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = testbed.facts(spark, sf_dir)
    return mart.day_to_next_sleep(f["fact_daily"], f["fact_sleep"], f["fact_quality"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.facts(spark, sf_dir)["fact_quality"]


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.sleep_nights(testbed.fact_sleep(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.weekday_report(aligned(spark, sf_dir))


# ---------------------------------------------------------------- the mart's facts, views and query pack

_REPORTED = {"avg_steps": 1, "median_steps": 1, "avg_awake_stress": 2, "median_nextsleep_recovery": 2}
_STRESS_KNOWN = "day_awake_average_stress + nextsleep_recovery_score IS NOT NULL"
_LOW = "CAST(nextsleep_recovery_score < 75 AS INTEGER)"

register("d_fact_daily", testbed.fact_daily, oracle("SELECT * FROM fact_daily"))
register("d_fact_sleep", testbed.fact_sleep, oracle("SELECT * FROM fact_sleep"))
register("q_quality_labels", labelled, oracle("SELECT * FROM fact_quality"))
register("j3_day_to_next_sleep", aligned, oracle("SELECT * FROM aligned"))
register("d_sleep_nights", nights, oracle("SELECT * FROM nights"))
register("a2_weekday_profiles", lambda s, d: mart.weekday_profiles(aligned(s, d)), oracle("SELECT * FROM weekdays"))
register("sql01_quality_mix", lambda s, d: mart.quality_mix(labelled(s, d)), oracle("SELECT day_quality_label_strict AS strict_label, COUNT(*) AS days, ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS pct_days FROM fact_quality GROUP BY 1"))
register("sql02_weekday_profiles", flagship, oracle(" SELECT iso_weekday, weekday_name, days_total, strict_good_days, " + ", ".join(f"ROUND({c}, {n}) AS {c}" for c, n in _REPORTED.items()) + " FROM weekdays"))
register("sql03_top_awake_stress_days", lambda s, d: mart.top_stress_days(aligned(s, d)), oracle(", r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY day_awake_average_stress DESC NULLS LAST, day_date) AS place FROM strict_days) SELECT day_date, day_awake_average_stress, day_total_steps, nextsleep_recovery_score, day_quality_label_strict FROM r WHERE place <= 20 AND day_awake_average_stress IS NOT NULL"))
register("sql04_stress_quartiles", lambda s, d: mart.stress_quartiles(aligned(s, d)), oracle("""
    , r AS (SELECT *, CAST(NTILE(4) OVER (ORDER BY day_awake_average_stress, day_date) AS INTEGER) AS stress_quartile FROM strict_days WHERE day_awake_average_stress IS NOT NULL AND nextsleep_recovery_score IS NOT NULL)
    SELECT stress_quartile, COUNT(*) AS days, ROUND(AVG(day_awake_average_stress), 2) AS avg_awake_stress, ROUND(AVG(nextsleep_recovery_score), 2) AS avg_next_recovery, ROUND(MEDIAN(nextsleep_recovery_score), 2) AS median_next_recovery FROM r GROUP BY 1""").replace("\n    , r AS", ", r AS"))
register("sql05_next_recovery_rolling", lambda s, d: mart.next_recovery_rolling(aligned(s, d)), oracle(", r AS (SELECT day_date, nextsleep_recovery_score AS v, ROW_NUMBER() OVER (ORDER BY day_date) AS n FROM strict_days WHERE nextsleep_recovery_score IS NOT NULL) SELECT a.day_date, a.v AS nextsleep_recovery_score, ROUND(AVG(b.v), 2) AS next_recovery_7d_ma FROM r a JOIN r b ON b.n BETWEEN a.n - 6 AND a.n GROUP BY a.day_date, a.v"))
register("sql06_recovery_risk", lambda s, d: mart.recovery_risk(aligned(s, d)), oracle(f", r AS (SELECT * FROM strict_days WHERE {_STRESS_KNOWN}) SELECT day_date, day_awake_average_stress, day_max_heart_rate, day_body_battery_lowest, nextsleep_recovery_score, (['lower_stress', 'mid_stress', 'high_stress'])[1 + CAST(day_awake_average_stress >= 50 AS INTEGER) + CAST(day_awake_average_stress >= 60 AS INTEGER)] AS stress_band, {_LOW} AS low_recovery_flag FROM r"))
register("sql07_sleep_bands", lambda s, d: mart.sleep_bands(nights(s, d)), oracle("SELECT CASE WHEN sleep_hours < 6 THEN '<6h' WHEN sleep_hours < 7.5 THEN '6-7.5h' WHEN sleep_hours < 9 THEN '7.5-9h' ELSE '>=9h' END AS sleep_band, COUNT(*) AS nights, ROUND(AVG(sleep_hours), 2) AS avg_sleep_hours, ROUND(MEDIAN(sleep_overall_score), 2) AS median_overall_score, ROUND(AVG(sleep_avg_stress), 2) AS avg_sleep_stress FROM nights WHERE sleep_hours > 0 GROUP BY 1"))
register("sql08_alignment_coverage", lambda s, d: mart.alignment_coverage(aligned(s, d)), oracle(", f AS (SELECT CAST(next_sleep_date IS NOT NULL AS INTEGER) AS has_next, CAST(valid_day_strict IS TRUE AS INTEGER) AS ok FROM aligned), t AS (SELECT CAST(COUNT(*) AS BIGINT) AS day_rows, CAST(SUM(has_next) AS BIGINT) AS rows_with_next_sleep, CAST(SUM(ok) AS BIGINT) AS strict_day_rows, CAST(SUM(ok * has_next) AS BIGINT) AS strict_rows_with_next_sleep FROM f) SELECT *, ROUND(100.0::DOUBLE * rows_with_next_sleep / day_rows, 2) AS next_sleep_coverage_pct, ROUND(100.0::DOUBLE * strict_rows_with_next_sleep / NULLIF(strict_day_rows, 0), 2) AS strict_next_sleep_coverage_pct FROM t"))
register("sql09_weekday_stress_rank", lambda s, d: mart.weekday_stress_rank(aligned(s, d)), oracle("SELECT iso_weekday, weekday_name, ROUND(avg_awake_stress, 2) AS avg_awake_stress, CAST(DENSE_RANK() OVER (ORDER BY avg_awake_stress DESC NULLS LAST) AS INTEGER) AS stress_rank_desc FROM weekdays"))
register("sql10_feature_extract", lambda s, d: mart.feature_extract(aligned(s, d)), oracle(f", r AS (SELECT * FROM strict_days WHERE {_STRESS_KNOWN} AND day_max_heart_rate + day_body_battery_lowest IS NOT NULL) SELECT day_date, day_awake_average_stress, day_max_heart_rate, day_body_battery_lowest, day_total_steps, nextsleep_recovery_score, {_LOW} AS target_low_recovery FROM r"))

# ---------------------------------------------------------------- quality tables and rankings

_LIST = ", ".join(f'"{c}"' for c in quality.SUSPICIOUS_COLUMNS)
register("t1_suspicious_days", lambda s, d: quality.suspicious_days(labelled(s, d)), oracle(f'SELECT {_LIST} FROM fact_quality ORDER BY quality_score, coalesce("stressTotalDurationSeconds", -1), has_sleep, "calendarDate" LIMIT 50'))
register("t2_artifact_days", lambda s, d: quality.artifact_days(labelled(s, d)), oracle(f'SELECT {_LIST} FROM fact_quality ORDER BY corrupted_stress_only_day DESC, full_day_stress DESC, CAST(NOT has_hr AS INT) + CAST(NOT has_sleep AS INT) + CAST(NOT has_bodybattery_end AS INT) + CAST(NOT has_steps AS INT) DESC, coalesce("stressTotalDurationSeconds", -1) DESC, quality_score, "calendarDate" LIMIT 50'))
for _kind in ("strict", "loose"):
    register(f"a7_label_table_{_kind}", lambda s, d, k=_kind: quality.label_table(labelled(s, d), f"day_quality_label_{k}"), oracle(f"SELECT l.label, COUNT(q.\"calendarDate\") AS count, ROUND(COUNT(q.\"calendarDate\") * 100.0::DOUBLE / (SELECT COUNT(*) FROM fact_quality), 2) AS pct FROM (VALUES ('good'), ('partial'), ('bad')) l(label) LEFT JOIN fact_quality q ON q.day_quality_label_{_kind} = l.label GROUP BY 1"))
register("a8_flag_coverage", lambda s, d: quality.flag_coverage(labelled(s, d)), oracle(" UNION ALL ".join(f"SELECT '{f}' AS flag, ROUND(AVG(CAST({f} AS DOUBLE) * 100), 2) AS pct FROM fact_quality" for f in quality.SCORED_FLAGS)))
register("a9_pattern_table", lambda s, d: quality.pattern_table(labelled(s, d)), oracle("SELECT has_bodybattery_start, has_bodybattery_end, COUNT(*) AS count, ROUND(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (), 2) AS pct FROM fact_quality GROUP BY 1, 2"))
register("a10_start_without_end", lambda s, d: quality.start_without_end(labelled(s, d)), oracle("SELECT COUNT(*) FILTER (WHERE bodybattery_start_without_end) AS days, ROUND(AVG(CAST(bodybattery_start_without_end AS DOUBLE)) * 100, 2) AS pct FROM fact_quality"))
register("a11_stress_hours", lambda s, d: quality.stress_hours_summary(labelled(s, d)), oracle('SELECT ROUND(MIN(h), 2) AS min_hours, ROUND(MEDIAN(h), 2) AS median_hours, ROUND(MAX(h), 2) AS max_hours, COUNT(*) FILTER (WHERE h < 1) AS days_below_1h, COUNT(*) FILTER (WHERE h < 6) AS days_below_6h, COUNT(*) FILTER (WHERE h < 12) AS days_below_12h, COUNT(*) FILTER (WHERE h < 20) AS days_below_20h FROM (SELECT CAST("stressTotalDurationSeconds" AS DOUBLE) / 3600 AS h FROM fact_quality)'))
for _kind in ("stress_duration_matches_allDayStress_TOTAL", "stress_awake_matches_allDayStress_AWAKE"):
    register(f"a12_{_kind}", lambda s, d, k=_kind: quality.match_summary(labelled(s, d), k), oracle(f'SELECT COUNT(m) AS compared, ROUND(COUNT(*) FILTER (WHERE m) * 100.0::DOUBLE / NULLIF(COUNT(m), 0), 2) AS pct_true, ROUND(COUNT(*) FILTER (WHERE NOT m) * 100.0::DOUBLE / NULLIF(COUNT(m), 0), 2) AS pct_false FROM (SELECT "{_kind}" AS m FROM fact_quality)'))
register("a13_corrupted_summary", lambda s, d: quality.corrupted_summary(labelled(s, d)), oracle('SELECT COUNT(*) FILTER (WHERE corrupted_stress_only_day) AS days, ROUND(AVG(CAST(corrupted_stress_only_day AS DOUBLE)) * 100, 2) AS pct, MIN("calendarDate") FILTER (WHERE corrupted_stress_only_day) AS first_day, MAX("calendarDate") FILTER (WHERE corrupted_stress_only_day) AS last_day FROM fact_quality'))
register("a14_reason_table", lambda s, d: quality.reason_table(labelled(s, d)), oracle("SELECT reason, COUNT(*) AS count, ROUND(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM fact_quality), 2) AS pct_of_rows FROM (SELECT trim(unnest(string_split(suspicion_reasons, ','))) AS reason FROM fact_quality) WHERE reason <> '' GROUP BY 1"))

from dayloom.plans import catalog_explore, catalog_ingest  # noqa: E402,F401  register the other queries
