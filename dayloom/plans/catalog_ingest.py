"""Queries of ingest, sinks, reports and smaller operators. Export documents are made from the day
facts as JSON text, in the shapes that exports come in, and read back by the library's own parsers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.exprs import KEY
from dayloom.operators import dictionary, explore, features, modeling, sanitize, stats
from dayloom.plans import catalog_explore, mart, testbed
from dayloom.plans.catalog import aligned, register
from dayloom.plans.catalog_explore import joined, rounded
from dayloom.plans.testbed import oracle
from dayloom.sources import ingest, sinks

# ---------------------------------------------------------------- documents


def _day() -> Column:
    return F.date_format(KEY, "yyyy-MM-dd")


def _k() -> Column:
    return F.unix_date(KEY)


def _shaped(rows: DataFrame, record, lists: tuple[str, ...], single: bool) -> DataFrame:
    """One document a day: a list, a list under one of the known names, or (for some) the bare record."""
    rec = F.to_json(record)
    wrapped = F.concat(F.lit('{"note": 1, "'), F.element_at(F.array(*[F.lit(n) for n in lists]), F.pmod(_k(), F.lit(len(lists))) + 1), F.lit('": ['), rec, F.lit(', 5, "junk"]}'))
    listed = F.concat(F.lit("["), rec, F.lit("]"))
    text = F.when(_k() % 3 == 0, listed).when((_k() % 3 == 1) & F.lit(single), rec).otherwise(wrapped)
    return rows.select(F.concat(F.lit("file-"), _day()).alias("file"), F.try_parse_json(text).alias("doc"))


def activity_documents(s: SparkSession, d: str) -> DataFrame:
    """Some days name their date ``calendarDateStr``; battery and stress stand under nested records."""
    stat = lambda kind, c: F.struct(F.lit(kind).alias("bodyBatteryStatType"), F.col(c).alias("statsValue"))
    total = lambda kind, c, level: F.struct(F.lit(kind).alias("type"), F.col(c).alias("totalDuration"), F.col(level).alias("averageStressLevel"))
    record = F.struct(
        F.when(_k() % 4 != 0, _day()).alias(KEY), F.when(_k() % 4 == 0, _day()).alias("calendarDateStr"), F.col("totalSteps"), F.col("totalDistanceMeters").alias("totalDistance"), "restingHeartRate", (_k() % 2 == 0).alias("includesWellnessData"),
        F.when(_k() % 50 == 0, F.lit("n/a")).otherwise(F.col("activeKilocalories").cast("string")).alias("activeKilocalories"),
        F.struct(F.col("bodyBatteryStartOfDay").alias("startOfDay"), F.array(stat("ENDOFDAY", "bodyBatteryEndOfDay"), stat("LOWEST", "bodyBatteryLowest")).alias("bodyBatteryStatList")).alias("bodyBattery"),
        F.struct(F.array(total("TOTAL", "allDayStress_TOTAL_totalDuration", "awakeAverageStressLevel"), total("AWAKE", "allDayStress_AWAKE_totalDuration", "awakeAverageStressLevel")).alias("aggregatorList")).alias("allDayStress"),
    )
    return _shaped(testbed.fact_daily(s, d), record, ingest.ACTIVITY_LISTS, True)


def sleep_documents(s: SparkSession, d: str) -> DataFrame:
    """Start times are ISO texts on some days; scores stand in a nested record."""
    start = F.col("sleepStartTimestampGMT")
    iso = F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd'T'HH:mm:ss.0")
    record = F.struct(
        _day().alias(KEY), F.when(_k() % 7 == 0, iso).otherwise(start.cast("string")).alias("sleepStartTimestampGMT"), "sleepEndTimestampGMT", "deepSleepSeconds", "lightSleepSeconds", F.col("remSleepSeconds").cast("string").alias("remSleepSeconds"), "avgSleepStress",
        (F.col("awakeSleepSeconds") + F.when(_k() % 2 == 0, 0.5).otherwise(0.0)).alias("awakeSleepSeconds"), (_k() % 3 == 0).alias("retro"), F.struct(F.col("sleepOverallScore").alias("overallScore"), F.col("sleepRecoveryScore").alias("recoveryScore"), F.lit("GOOD").alias("feedback")).alias("sleepScores"),
    )
    return _shaped(testbed.fact_sleep(s, d), record, ingest.SLEEP_LISTS, False)


_K_SQL = "date_diff('day', DATE '1970-01-01', \"calendarDate\")"
_FROM_ACTIVITY = f"""
, u AS (SELECT *, {_K_SQL} AS k FROM fact_daily),
a AS (SELECT "calendarDate", "totalSteps", "totalDistanceMeters", CASE WHEN k % 50 <> 0 THEN "activeKilocalories" END AS "activeKilocalories", "restingHeartRate", "bodyBatteryStartOfDay", "bodyBatteryEndOfDay", "bodyBatteryLowest",
"allDayStress_AWAKE_totalDuration" AS "stressAwakeDurationSeconds", "allDayStress_TOTAL_totalDuration" AS "stressTotalDurationSeconds", "awakeAverageStressLevel" AS "allDayStress_TOTAL_averageStressLevel", "bodyBatteryStartOfDay" AS "bodyBattery_startOfDay",
"bodyBatteryEndOfDay" AS "bodyBatteryStat_ENDOFDAY", k % 2 = 0 AS "includesWellnessData", "totalDistanceMeters" AS "totalDistance" FROM u)"""
_ACTIVITY = [KEY, "totalSteps", "totalDistanceMeters", "activeKilocalories", "restingHeartRate", "bodyBatteryStartOfDay", "bodyBatteryEndOfDay", "bodyBatteryLowest", "stressAwakeDurationSeconds", "stressTotalDurationSeconds",
             "allDayStress_TOTAL_averageStressLevel", "bodyBattery_startOfDay", "bodyBatteryStat_ENDOFDAY", "includesWellnessData", "totalDistance"]
_FROM_SLEEP = f"""
, u AS (SELECT *, {_K_SQL} AS k FROM fact_sleep),
b AS (SELECT "calendarDate", "sleepStartTimestampGMT", "sleepEndTimestampGMT", "deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", CASE WHEN k % 2 <> 0 THEN "awakeSleepSeconds" END AS "awakeSleepSeconds", CAST("avgSleepStress" AS DOUBLE) AS "avgSleepStress", k % 3 = 0 AS retro,
"sleepOverallScore", "sleepRecoveryScore", 'GOOD' AS "sleepFeedback" FROM u)"""
_SLEEP = [KEY, "sleepStartTimestampGMT", "sleepEndTimestampGMT", "deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds", "avgSleepStress", "retro", "sleepOverallScore", "sleepRecoveryScore", "sleepFeedback"]

register("s9_parse_activity", lambda s, d: ingest.parse_activity(activity_documents(s, d)).select(*_ACTIVITY), oracle(f"{_FROM_ACTIVITY} SELECT * FROM a"))
register("s10_parse_sleep", lambda s, d: ingest.parse_sleep(sleep_documents(s, d)).select(*_SLEEP), oracle(f"{_FROM_SLEEP} SELECT * FROM b"))


def _records(documents: DataFrame, lists: tuple[str, ...], single: bool) -> DataFrame:
    return ingest.records(documents, lists, single).groupBy("pos").agg(F.count("*").alias("records"))


register("s7_activity_records", lambda s, d: _records(activity_documents(s, d), ingest.ACTIVITY_LISTS, True), oracle(" SELECT CAST(0 AS INTEGER) AS pos, COUNT(*) AS records FROM fact_daily"))
register("s8_sleep_records", lambda s, d: _records(sleep_documents(s, d), ingest.SLEEP_LISTS, False), oracle(" SELECT CAST(0 AS INTEGER) AS pos, COUNT(*) AS records FROM fact_sleep"))

_LONG = ("totalSteps", "restingHeartRate", "bodyBatteryEndOfDay", "stressTotalDurationSeconds", "allDayStress_AWAKE_totalDuration", "bodyBatteryStat_LOWEST")
_LONG_OF = ("totalSteps", "restingHeartRate", "bodyBatteryEndOfDay", "allDayStress_TOTAL_totalDuration", "allDayStress_AWAKE_totalDuration", "bodyBatteryLowest")


def _flattened(s: SparkSession, d: str) -> DataFrame:
    long = ingest.activity_long(ingest.records(activity_documents(s, d), ingest.ACTIVITY_LISTS, True))
    return long.where(F.col("name").isin(*_LONG) & F.col("value").isNotNull()).select("day", "name", "value")


register("p4_flattened", _flattened, oracle(" " + " UNION ALL ".join(f'SELECT "calendarDate" AS day, \'{n}\' AS name, CAST("{c}" AS VARCHAR) AS value FROM fact_daily WHERE "{c}" IS NOT NULL' for n, c in zip(_LONG, _LONG_OF, strict=True))))


def _types(s: SparkSession, d: str) -> DataFrame:
    found = ingest.column_types(ingest.activity_long(ingest.records(activity_documents(s, d), ingest.ACTIVITY_LISTS, True)))
    return s.createDataFrame([(n, t) for n, t in sorted(found.items()) if n in (*_LONG, "activeKilocalories", "includesWellnessData", "calendarDateStr")], "name string, type string")


register("p10_column_types", _types, "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'bigint')" for n in (*_LONG, "activeKilocalories")) + ", ('includesWellnessData', 'boolean'), ('calendarDateStr', 'string')) t(name, type)")


def _column_order(s: SparkSession, d: str) -> DataFrame:
    names = ingest.ordered(["zeta", "totalSteps", KEY, "bodyBatteryLowest", "alpha", "maxHeartRate", "stressTotalDurationSeconds"])
    return s.createDataFrame(list(enumerate(names)), "place int, name string")


register("p11_column_order", _column_order, "SELECT CAST(place AS INTEGER) AS place, name FROM (VALUES (0, 'calendarDate'), (1, 'totalSteps'), (2, 'maxHeartRate'), (3, 'bodyBatteryLowest'), (4, 'stressTotalDurationSeconds'), (5, 'alpha'), (6, 'zeta')) t(place, name)")
register("s29_schema_inspector", lambda s, d: ingest.inspect_schema(ingest.records(sleep_documents(s, d), ingest.SLEEP_LISTS, False)).where("key in ('calendarDate', 'sleepScores', 'sleepScores.overallScore', 'sleepScores.feedback', 'deepSleepSeconds')").select("key", "count", "pct"), oracle("""
, c AS (SELECT COUNT(*) AS n, COUNT("sleepOverallScore") AS o, COUNT("deepSleepSeconds") AS p FROM fact_sleep),
r AS (SELECT 'calendarDate' AS key, n AS count FROM c UNION ALL SELECT 'sleepScores', n FROM c UNION ALL SELECT 'sleepScores.feedback', n FROM c UNION ALL SELECT 'sleepScores.overallScore', o FROM c UNION ALL SELECT 'deepSleepSeconds', p FROM c)
SELECT key, count, ROUND(count * 100.0::DOUBLE / (SELECT n FROM c), 2) AS pct FROM r"""))


def _scrubbed(s: SparkSession, d: str) -> DataFrame:
    record = F.struct(F.lit(7).alias("userProfilePK"), _day().alias(KEY), "totalSteps", F.struct(F.lit("x,y").alias("uuid"), F.lit(5).alias("deviceId")).alias("device"))
    rows = ingest.scrubbed(ingest.records(_shaped(testbed.fact_daily(s, d), record, ingest.ACTIVITY_LISTS, True), ingest.ACTIVITY_LISTS, True))
    return rows.select(F.get_json_object("json", f"$.{KEY}").alias("day"), F.rlike("json", F.lit("userProfilePK|uuid|deviceId|x,y")).alias("leaks"), F.get_json_object("json", "$.totalSteps").cast("bigint").alias("steps"))


register("s28_scrubbed", _scrubbed, oracle(' SELECT CAST("calendarDate" AS VARCHAR) AS day, FALSE AS leaks, "totalSteps" AS steps FROM fact_daily'))


def _demo(s: SparkSession, d: str) -> DataFrame:
    texts = testbed.fact_sleep(s, d).select(KEY, F.date_format(F.timestamp_seconds("sleepStartTimestampGMT"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sleepStartTimestampGMT"), F.coalesce(F.col("deepSleepSeconds").cast("string"), F.lit("")).alias("deepSleepSeconds"))
    return ingest.normalise_demo(texts.withColumn(KEY, _day()))


register("s22_demo_table", _demo, oracle(' SELECT "calendarDate", "sleepStartTimestampGMT", CAST("deepSleepSeconds" AS DOUBLE) AS "deepSleepSeconds" FROM fact_sleep'))
register("j1_build_daily", lambda s, d: ingest.build_daily(testbed.fact_daily(s, d), testbed.fact_sleep(s, d)), oracle(" SELECT * FROM merged"))


def _fallback(s: SparkSession, d: str) -> DataFrame:
    raw = testbed.fact_sleep(s, d)
    lost = raw.withColumns({c: F.lit(None).cast("bigint") for c in ingest.SLEEP_TIMES[:2]})
    return ingest.pick_sanitised(lost, raw).select(KEY, *ingest.SLEEP_TIMES[:2])


register("s21_stale_fallback", _fallback, oracle(' SELECT "calendarDate", "sleepStartTimestampGMT", "sleepEndTimestampGMT" FROM fact_sleep'))

# ---------------------------------------------------------------- sinks and the mart


def _folder(s: SparkSession) -> str:
    """Where round trips write: the shared folder, or on one machine a temporary one."""
    found = s.conf.get("spark.checkpoint.dir", None)
    if not found and not s.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(found or tempfile.gettempdir()).rstrip('/')}/dayloom-{s.sparkContext.applicationId}"


def _parquet(s: SparkSession, d: str) -> DataFrame:
    sinks.write_parquet(testbed.fact_daily(s, d), f"{_folder(s)}/daily.parquet")
    return s.read.parquet(f"{_folder(s)}/daily.parquet")


def _csv(s: SparkSession, d: str) -> DataFrame:
    table = testbed.fact_sleep(s, d).select(KEY, "sleepOverallScore", "avgSleepStress")
    sinks.write_csv(table, f"{_folder(s)}/sleep.csv")
    return s.read.option("header", True).schema(table.schema).csv(f"{_folder(s)}/sleep.csv")


def _mart_counts(s: SparkSession, d: str) -> DataFrame:
    counts = mart.build_mart(s, *testbed.facts(s, d).values())
    return s.createDataFrame(sorted(counts.items()), "name string, rows long")


def _portfolio(s: SparkSession, d: str) -> DataFrame:
    """Every query of the pack over the same facts, by its number of columns."""
    found = mart.run_pack(mart.build_facts(*testbed.facts(s, d).values()))
    return s.createDataFrame([(n, len(df.columns)) for n, df in found.items()], "query string, columns int")


register("s13_parquet_round_trip", _parquet, oracle(" SELECT * FROM fact_daily"))
register("s15_csv_round_trip", _csv, oracle(' SELECT "calendarDate", "sleepOverallScore", "avgSleepStress" FROM fact_sleep'))
register("s18_mart_counts", _mart_counts, oracle(" SELECT 'fact_daily' AS name, COUNT(*) AS rows FROM fact_daily UNION ALL SELECT 'fact_quality', COUNT(*) FROM fact_quality UNION ALL SELECT 'fact_sleep', COUNT(*) FROM fact_sleep UNION ALL SELECT 'vw_day_to_next_sleep', COUNT(*) FROM aligned UNION ALL SELECT 'vw_sleep_nights', COUNT(*) FROM nights UNION ALL SELECT 'vw_weekday_profiles', COUNT(*) FROM weekdays"))
register("s19_portfolio", _portfolio, "SELECT query, CAST(columns AS INTEGER) AS columns FROM (VALUES ('01_quality_mix', 3), ('02_weekday_profiles', 8), ('03_top_awake_stress_days', 5), ('04_stress_quartile_vs_next_recovery', 5), ('05_next_recovery_rolling', 3), ('06_recovery_risk_flags', 7), ('07_sleep_duration_bands', 5), ('08_alignment_coverage', 6), ('09_weekday_stress_rank', 4), ('10_stage3_feature_extract', 7)) t(query, columns)")
register("p19_fallback_facts", lambda s, d: mart.build_facts(joined(s, d))["fact_sleep"].select(KEY, "sleepRecoveryScore", "deepSleepSeconds"), oracle(' SELECT "calendarDate", "sleepRecoveryScore", "deepSleepSeconds" FROM merged'))

# ---------------------------------------------------------------- features and frames

_STAGES_SQL = '"calendarDate", "allDayStress_TOTAL_totalDuration" AS stress_total_total_duration_s'
register("g2_stress_aliases", lambda s, d: features.derived_features(testbed.fact_daily(s, d)).select(KEY, "stress_total_total_duration_s"), oracle(f" SELECT {_STAGES_SQL} FROM fact_daily"))
register("g8_spo2_gap", lambda s, d: features.derived_features(testbed.fact_daily(s, d).select(KEY, F.col("maxHeartRate").alias("latestSpo2Value"), F.col("minHeartRate").alias("lowestSpo2Value"))).select(KEY, "spo2_gap"), oracle(' SELECT "calendarDate", CAST("maxHeartRate" - "minHeartRate" AS DOUBLE) AS spo2_gap FROM fact_daily'))


def _battery(s: SparkSession, d: str) -> DataFrame:
    return testbed.fact_daily(s, d).select(KEY, "restingHeartRate", F.col("minHeartRate").alias("currentDayRestingHeartRate"), F.col("bodyBatteryStartOfDay").alias("bodyBattery_chargedValue"), F.col("bodyBatteryEndOfDay").alias("bodyBattery_drainedValue"))


register("g11_battery_balance", lambda s, d: features.modeling_features(_battery(s, d)).select(KEY, "bodyBatteryCharged", "bodyBatteryDrained", "bodyBatteryNetBalance"), oracle(' SELECT "calendarDate", CAST("bodyBatteryStartOfDay" AS DOUBLE) AS "bodyBatteryCharged", CAST("bodyBatteryEndOfDay" AS DOUBLE) AS "bodyBatteryDrained", CAST("bodyBatteryStartOfDay" - "bodyBatteryEndOfDay" AS DOUBLE) AS "bodyBatteryNetBalance" FROM fact_daily'))
register("g19_daily_differences", lambda s, d: explore.daily_differences(_battery(s, d)).select(KEY, "rhr_delta", "bb_net_balance"), oracle(' SELECT "calendarDate", CAST("minHeartRate" - "restingHeartRate" AS DOUBLE) AS rhr_delta, CAST("bodyBatteryStartOfDay" - "bodyBatteryEndOfDay" AS DOUBLE) AS bb_net_balance FROM fact_daily'))
register("g18_stress_shares", lambda s, d: rounded(explore.stress_shares(testbed.fact_daily(s, d).select(KEY, "allDayStress_TOTAL_totalDuration", F.col("allDayStress_AWAKE_totalDuration").alias("allDayStress_TOTAL_restDuration")))), oracle(' SELECT "calendarDate", CASE WHEN "allDayStress_TOTAL_totalDuration" > 0 THEN ROUND("allDayStress_AWAKE_totalDuration" / CAST("allDayStress_TOTAL_totalDuration" AS DOUBLE), 9) END AS rest_share FROM fact_daily'))
register("g17_shifted_weekdays", lambda s, d: rounded(explore.by_weekday(testbed.fact_sleep(s, d), "avgSleepStress", -1), 6), oracle(' SELECT dayname("calendarDate" - INTERVAL 1 DAY) AS segment, COUNT("avgSleepStress") AS n, MEDIAN(CAST("avgSleepStress" AS DOUBLE)) AS median, ROUND(quantile_cont(CAST("avgSleepStress" AS DOUBLE), 0.05), 6) AS p05, ROUND(quantile_cont(CAST("avgSleepStress" AS DOUBLE), 0.95), 6) AS p95, ROUND(AVG("avgSleepStress"), 6) AS mean FROM fact_sleep GROUP BY 1'))


def _feature_columns(s: SparkSession, d: str) -> DataFrame:
    wide = testbed.fact_daily(s, d).select(KEY, "totalSteps", "totalDistanceMeters", "maxHeartRate", "awakeAverageStressLevel", "bodyBatteryLowest")
    return s.createDataFrame(list(enumerate(features.feature_columns(wide, ("tier2_compact", "tier1", "tier2")))), "place int, name string")


register("g24_feature_columns", _feature_columns, "SELECT CAST(place AS INTEGER) AS place, name FROM (VALUES (0, 'awakeAverageStressLevel'), (1, 'totalSteps'), (2, 'totalDistanceMeters'), (3, 'maxHeartRate'), (4, 'bodyBatteryLowest')) t(place, name)")


def _frames(s: SparkSession, d: str, make) -> DataFrame:
    f = testbed.facts(s, d)
    frames = make(testbed.merged(f["fact_daily"], f["fact_sleep"]), f["fact_quality"].select(KEY, *[c for c in f["fact_quality"].columns if c.startswith(("valid", "corrupted", "has_"))]))
    out = None
    for name, df in frames.items():
        one = explore.row_range(df, name)
        out = one if out is None else out.union(one)
    return out


_RANGE = "COUNT(*) AS rows, MIN(\"calendarDate\") AS first_day, MAX(\"calendarDate\") AS last_day FROM fact_quality"
_STRICT, _SLEPT = "WHERE valid_day_strict AND NOT corrupted_stress_only_day", "WHERE has_sleep AND NOT corrupted_stress_only_day"
register("g25_analysis_frames", lambda s, d: _frames(s, d, features.analysis_slices), oracle(f" SELECT 'df_all' AS slice, {_RANGE} UNION ALL SELECT 'df_strict', {_RANGE} {_STRICT} UNION ALL SELECT 'df_sleep', {_RANGE} {_SLEPT}"))
register("g26_validation_frames", lambda s, d: _frames(s, d, features.stat_frames), oracle(f" SELECT 'day_strict' AS slice, {_RANGE} {_STRICT} UNION ALL SELECT 'sleep_onset', {_RANGE} {_SLEPT} UNION ALL SELECT 'day_nextsleep', {_RANGE} {_STRICT}"))
register("j2_quality_columns", lambda s, d: features.join_quality(testbed.fact_daily(s, d), joined(s, d).withColumn("totalSteps", F.lit(-1))).select(KEY, "totalSteps", "quality_score", "has_sleep"), oracle(' SELECT d."calendarDate", d."totalSteps", q.quality_score, q.has_sleep FROM fact_daily d LEFT JOIN fact_quality q USING ("calendarDate")'))
register("j4_next_sleep", lambda s, d: features.next_sleep(testbed.fact_daily(s, d).select(KEY, "totalSteps"), testbed.fact_sleep(s, d), ("sleepRecoveryScore", "no_such")), oracle(' SELECT d."calendarDate", d."totalSteps", s."sleepRecoveryScore" AS "nextsleep_sleepRecoveryScore" FROM fact_daily d LEFT JOIN fact_sleep s ON s."calendarDate" = CAST(d."calendarDate" + INTERVAL 1 DAY AS DATE)'))
register("j7_point_lookup", lambda s, d: explore.lookup_days(testbed.fact_daily(s, d), testbed.fact_sleep(s, d).where("sleepOverallScore < 60"), "totalSteps"), oracle(' SELECT s."calendarDate", d."totalSteps" FROM fact_sleep s LEFT JOIN fact_daily d USING ("calendarDate") WHERE s."sleepOverallScore" < 60'))

# ---------------------------------------------------------------- rows kept, unions, limits


def _orders(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("date").alias(KEY), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


_ORDERS_SQL = 'SELECT CAST(o_orderdate AS DATE) AS "calendarDate", o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders'
register("w7_keep_last_per_day", lambda s, d: features.keep_one_per_day(_orders(s, d), [F.desc("o_orderkey")]), f"SELECT * FROM ({_ORDERS_SQL}) QUALIFY ROW_NUMBER() OVER (PARTITION BY \"calendarDate\" ORDER BY o_orderkey DESC) = 1")
register("w8_keep_first_per_day", lambda s, d: features.keep_one_per_day(_orders(s, d), [F.asc("o_orderkey")]), f"SELECT * FROM ({_ORDERS_SQL}) QUALIFY ROW_NUMBER() OVER (PARTITION BY \"calendarDate\" ORDER BY o_orderkey) = 1")
register("w9_best_rows", lambda s, d: explore.best_rows(_orders(s, d).withColumn("month", F.month(KEY)), ["month"], [F.desc("cents"), F.asc("o_orderkey")]).select("month", "cents", "o_orderkey"), f"SELECT CAST(month(\"calendarDate\") AS INTEGER) AS month, cents, o_orderkey FROM ({_ORDERS_SQL}) QUALIFY ROW_NUMBER() OVER (PARTITION BY month(\"calendarDate\") ORDER BY cents DESC, o_orderkey) = 1")
register("u2_two_columns", lambda s, d: explore.both_columns(testbed.fact_daily(s, d), "minHeartRate", "maxHeartRate"), oracle(' SELECT CAST("minHeartRate" AS DOUBLE) AS value FROM fact_daily WHERE "minHeartRate" IS NOT NULL UNION ALL SELECT CAST("maxHeartRate" AS DOUBLE) FROM fact_daily WHERE "maxHeartRate" IS NOT NULL'))
register("u3_suspicious_union", lambda s, d: explore.suspicious_union(joined(s, d).where("quality_score <= 1"), joined(s, d).where("full_day_stress")), oracle(' SELECT "calendarDate" FROM fact_quality WHERE quality_score <= 1 OR full_day_stress'))
register("f10_label_year", lambda s, d: joined(s, d).where((F.col("day_quality_label_strict") == "good") & (F.year(KEY) == 1995)).select(KEY, "quality_score"), oracle(" SELECT \"calendarDate\", quality_score FROM fact_quality WHERE day_quality_label_strict = 'good' AND year(\"calendarDate\") = 1995"))
register("f11_clipped", lambda s, d: rounded(explore.clipped(testbed.fact_daily(s, d).select(KEY, "totalSteps"), "totalSteps")), oracle(' SELECT "calendarDate", ROUND(CASE WHEN "totalSteps" IS NOT NULL THEN LEAST(CAST("totalSteps" AS DOUBLE), (SELECT quantile_cont(CAST("totalSteps" AS DOUBLE), 0.98) FROM fact_daily)) END, 9) AS "totalSteps" FROM fact_daily'))
register("f12_robust_limit", lambda s, d: rounded(explore.robust_limit(testbed.fact_daily(s, d), ["minHeartRate", "maxHeartRate"]), 6), oracle(' , v AS (SELECT "minHeartRate" AS value FROM fact_daily UNION ALL SELECT "maxHeartRate" FROM fact_daily) SELECT ROUND(quantile_cont(CAST(value AS DOUBLE), 0.99) * 1.05, 6) AS "limit" FROM v WHERE value IS NOT NULL'))

# ---------------------------------------------------------------- counts, coverage, units


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    return dictionary.build_dictionary(testbed.merged(testbed.fact_daily(s, d), testbed.fact_sleep(s, d)), 0)


_QUALITY = [c for c in dictionary.QUALITY_COLUMNS]
_PCT = oracle(" , q AS (" + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", COUNT("{c}") * 100.0::DOUBLE / COUNT(*) AS p FROM merged' for c in _QUALITY) + ") SELECT ")
_WIDE = [*testbed.DAILY, "stressTotalDurationSeconds", *testbed.SLEEP, "sleepStartTimestampGMT", "sleepEndTimestampGMT"]
register("a15_profile_counts", lambda s, d: _dictionary(s, d).where(F.col("column") != KEY).select("column", "non_null_count", "n_unique", F.round("zero_pct", 6).alias("zero_pct"), F.round("mean", 6).alias("mean")), oracle(" " + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", COUNT("{c}") AS non_null_count, COUNT(DISTINCT "{c}") AS n_unique, ROUND(COUNT(*) FILTER (WHERE "{c}" = 0) * 100.0::DOUBLE / NULLIF(COUNT("{c}"), 0), 6) AS zero_pct, ROUND(AVG("{c}"), 6) AS mean FROM merged' for c in _WIDE)))
register("t6_quality_columns", lambda s, d: rounded(dictionary.quality_coverage(_dictionary(s, d)).select("column", "non_null_pct"), 6), _PCT + '"column", ROUND(p, 6) AS non_null_pct FROM q')
register("a23_coverage_summary", lambda s, d: rounded(dictionary.coverage_summary(_dictionary(s, d)), 6), _PCT + "ROUND(MIN(p), 6) AS least_pct, ROUND(MEDIAN(p), 6) AS median_pct FROM q")
register("f14_low_coverage", lambda s, d: rounded(dictionary.low_coverage(_dictionary(s, d)).select("column", "non_null_pct"), 6), oracle(" , q AS (" + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", COUNT("{c}") * 100.0::DOUBLE / COUNT(*) AS p FROM merged' for c in _WIDE) + ') SELECT "column", ROUND(p, 6) AS non_null_pct FROM q WHERE p < 85'))
register("a22_priority_counts", lambda s, d: dictionary.priority_counts(_dictionary(s, d)), "SELECT analysis_priority, COUNT(*) AS count FROM (VALUES " + ", ".join(f"('{dictionary.annotations(c)['analysis_priority']}')" for c in [KEY, *_WIDE]) + ") t(analysis_priority) GROUP BY 1")
register("a34_target_availability", lambda s, d: explore.target_availability(testbed.fact_sleep(s, d), ["sleepRecoveryScore", "avgSleepStress"]), oracle(" " + " UNION ALL ".join(f'SELECT \'{c}\' AS target, COUNT("{c}") AS available, MEDIAN(CAST("{c}" AS DOUBLE)) AS median FROM fact_sleep' for c in ("sleepRecoveryScore", "avgSleepStress"))))
register("a36_epoch_units", lambda s, d: s.createDataFrame([(u, explore.epoch_unit(testbed.fact_sleep(s, d).withColumn("t", F.col("sleepStartTimestampGMT") * m), "t")) for u, m in (("s", 1), ("ms", 1000), ("ns", 1_000_000_000))], "made string, found string"), "SELECT * FROM (VALUES ('s', 's'), ('ms', 'ms'), ('ns', 'ns')) t(made, found)")


def _scaled(s: SparkSession, d: str) -> DataFrame:
    late = testbed.fact_sleep(s, d).select(KEY, (F.col("sleepStartTimestampGMT") * 1000).alias("t"))
    return late.select(KEY, explore.epoch_seconds(late, "t").alias("seconds"))


register("c24_epoch_scaling", _scaled, oracle(' SELECT "calendarDate", CAST("sleepStartTimestampGMT" AS DOUBLE) AS seconds FROM fact_sleep'))


def _ratios(s: SparkSession, d: str) -> DataFrame:
    texts = testbed.fact_daily(s, d).select(*[F.when(_k() % n == 0, F.lit("n/a")).otherwise(_k().cast("string")).alias(f"c{n}") for n in (3, 50)])
    return s.createDataFrame([(c, round(ingest.numeric_share(texts, c)[0], 9), ingest.numeric_share(texts, c)[1]) for c in texts.columns], "name string, share double, numeric boolean")


register("a37_numeric_share", _ratios, oracle(" " + " UNION ALL ".join(f"SELECT 'c{n}' AS name, ROUND(COUNT(*) FILTER (WHERE {_K_SQL} % {n} <> 0) / CAST(COUNT(*) AS DOUBLE), 9) AS share, COUNT(*) FILTER (WHERE {_K_SQL} % {n} <> 0) >= 0.8 * COUNT(*) AS numeric FROM fact_daily" for n in (3, 50))))

# ---------------------------------------------------------------- sanitising and statistics


def _guids(s: SparkSession, d: str) -> DataFrame:
    """A GUID by value and one by name go, a nested date goes unless kept, a listed column goes."""
    guid = F.regexp_replace(F.md5(F.date_format(KEY, "yyyyMMdd")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    raw = testbed.fact_daily(s, d).select(KEY, "totalSteps", "maxHeartRate", guid.alias("opaque"), F.lit(1).alias("userProfilePK"), F.col(KEY).cast("string").alias("kept_calendarDate"), F.col(KEY).cast("string").alias("other_calendarDate"))
    return sanitize.sanitize(raw, keep=["kept_calendarDate", "userProfilePK"], drop=["maxHeartRate"])[0]


register("v2_guids_and_precedence", _guids, oracle(' SELECT "calendarDate", "totalSteps", CAST("calendarDate" AS VARCHAR) AS "kept_calendarDate" FROM fact_daily'))


def _report(s: SparkSession, d: str) -> DataFrame:
    raw = testbed.fact_sleep(s, d).withColumns({"avgSleepStress": F.col("avgSleepStress") * 4 - 20, "uuid": F.lit("x")})
    report = sanitize.sanitize(raw)[1]
    return s.createDataFrame([(k, int(v)) for k, v in report["value_replacements"]["replaced_to_null_by_column"].items()], "name string, replaced long")


register("v7_report", _report, oracle(" SELECT 'avgSleepStress' AS name, COUNT(*) FILTER (WHERE \"avgSleepStress\" * 4 - 20 NOT BETWEEN 0 AND 100) AS replaced FROM fact_sleep"))


def _delta(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(round(stats.cliffs_delta(catalog_explore._weekend(s, d), "totalSteps", "part", "weekend", "weekday"), 9),)], "delta double")


_PARTS = "p AS (SELECT CAST(\"totalSteps\" AS DOUBLE) AS v, isodow(\"calendarDate\") >= 6 AS w FROM fact_daily WHERE \"totalSteps\" IS NOT NULL)"
register("x4_cliffs_delta", _delta, oracle(f", {_PARTS} SELECT ROUND(AVG(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v < b.v THEN -1.0 ELSE 0.0 END), 9) AS delta FROM (SELECT v FROM p WHERE w) a, (SELECT v FROM p WHERE NOT w) b"))


def _kruskal(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(round(float(stats.kruskal(testbed.fact_daily(s, d).withColumn("w", F.weekday(KEY)), "totalSteps", "w")["h"]), 6),)], "h double")


register("x8_kruskal", _kruskal, oracle(""", v AS (SELECT isodow("calendarDate") AS g, "totalSteps" AS x FROM fact_daily WHERE "totalSteps" IS NOT NULL),
r AS (SELECT g, x, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM v),
t AS (SELECT CAST(SUM(c * c * c - c) AS DOUBLE) AS ties, CAST(SUM(c) AS DOUBLE) AS n FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM v GROUP BY x)),
s AS (SELECT SUM(q) AS q FROM (SELECT SUM(r) * SUM(r) / COUNT(*) AS q FROM r GROUP BY g))
SELECT ROUND((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h FROM s, t"""))


def _split_sizes(s: SparkSession, d: str) -> DataFrame:
    return modeling.time_split(testbed.fact_daily(s, d)).groupBy("split").agg(F.count("*").alias("n"), F.min(KEY).alias("first_day"), F.max(KEY).alias("last_day"))


register("m14_split_sizes", _split_sizes, oracle(""" , o AS (SELECT "calendarDate", ROW_NUMBER() OVER (ORDER BY "calendarDate") AS n, COUNT(*) OVER () AS t FROM fact_daily),
l AS (SELECT "calendarDate", CASE WHEN n <= floor(t * 0.6) THEN 'train' WHEN n <= floor(t * 0.6) + floor(t * 0.2) THEN 'valid' ELSE 'test' END AS split FROM o)
SELECT split, COUNT(*) AS n, MIN("calendarDate") AS first_day, MAX("calendarDate") AS last_day FROM l GROUP BY 1"""))
