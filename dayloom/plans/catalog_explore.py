"""Queries of the analysis layers: features, series, distributions, dictionary, sanitising,
statistics, modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.exprs import KEY, score_bucket
from dayloom.operators import dictionary, explore, features, modeling, sanitize, stats
from dayloom.plans import testbed
from dayloom.plans.catalog import register
from dayloom.plans.testbed import oracle


def joined(s: SparkSession, d: str) -> DataFrame:
    return testbed.facts(s, d)["fact_quality"]


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- slices, features, alignment

register("j1_merged_days", lambda s, d: testbed.merged(testbed.fact_daily(s, d), testbed.fact_sleep(s, d)), oracle("SELECT * FROM merged"))
for _name, _cut, _sql in (("strict", features.strict_slice, "valid_day_strict"), ("loose", features.loose_slice, "valid_day_loose"), ("sleep", features.sleep_slice, "has_sleep")):
    register(f"f_slice_{_name}", lambda s, d, f=_cut: f(joined(s, d)).select(KEY, "quality_score", "suspicion_reasons"), oracle(f'SELECT "calendarDate", quality_score, suspicion_reasons FROM fact_quality WHERE {_sql} AND NOT corrupted_stress_only_day'))
register("a21_readiness", lambda s, d: features.readiness(joined(s, d)), oracle("SELECT COUNT(*) AS rows_all, COUNT(*) FILTER (WHERE valid_day_strict AND NOT corrupted_stress_only_day) AS rows_strict, COUNT(*) FILTER (WHERE has_sleep AND NOT corrupted_stress_only_day) AS rows_sleep, ROUND(COUNT(*) FILTER (WHERE valid_day_strict AND NOT corrupted_stress_only_day) * 100.0::DOUBLE / COUNT(*), 6) AS strict_good_pct, ROUND(COUNT(*) FILTER (WHERE has_sleep AND NOT corrupted_stress_only_day) * 100.0::DOUBLE / COUNT(*), 6) AS sleep_present_pct, ROUND(AVG(CAST(corrupted_stress_only_day AS DOUBLE)) * 100, 6) AS corrupted_pct FROM fact_quality"))
_FEATURES = [KEY, "year", "month", "week", "dayofweek", "stress_hours", "awake_stress_hours", "steps_k", "distance_km", "active_hours", "bb_delta", "sleep_total_seconds", "sleep_efficiency", "deep_pct", "rem_pct", "light_pct", "awake_pct"]
_TOTAL = 'CASE WHEN coalesce("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds") IS NOT NULL THEN CAST(coalesce("deepSleepSeconds", 0) + coalesce("lightSleepSeconds", 0) + coalesce("remSleepSeconds", 0) + coalesce("awakeSleepSeconds", 0) AS DOUBLE) END'
_CORE = 'CASE WHEN coalesce("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds") IS NOT NULL THEN CAST(coalesce("deepSleepSeconds", 0) + coalesce("lightSleepSeconds", 0) + coalesce("remSleepSeconds", 0) AS DOUBLE) END'
register("g1_derived_features", lambda s, d: rounded(features.derived_features(joined(s, d)).select(*_FEATURES)), oracle(f"""
, t AS (SELECT *, {_TOTAL} AS tot, {_CORE} AS core FROM fact_quality)
SELECT "calendarDate", CAST(year("calendarDate") AS INTEGER) AS year, CAST(month("calendarDate") AS INTEGER) AS month, CAST(week("calendarDate") AS INTEGER) AS week, CAST(isodow("calendarDate") - 1 AS INTEGER) AS dayofweek,
ROUND("stressTotalDurationSeconds" / 3600.0::DOUBLE, 9) AS stress_hours, ROUND("stressAwakeDurationSeconds" / 3600.0::DOUBLE, 9) AS awake_stress_hours, ROUND("totalSteps" / 1000.0::DOUBLE, 9) AS steps_k, ROUND("totalDistanceMeters" / 1000.0::DOUBLE, 9) AS distance_km, ROUND("activeSeconds" / 3600.0::DOUBLE, 9) AS active_hours,
CAST("bodyBatteryEndOfDay" - "bodyBatteryStartOfDay" AS DOUBLE) AS bb_delta, tot AS sleep_total_seconds, CASE WHEN tot > 0 THEN ROUND(core / tot, 9) END AS sleep_efficiency, CASE WHEN tot > 0 THEN ROUND("deepSleepSeconds" / tot, 9) END AS deep_pct, CASE WHEN tot > 0 THEN ROUND("remSleepSeconds" / tot, 9) END AS rem_pct, CASE WHEN tot > 0 THEN ROUND("lightSleepSeconds" / tot, 9) END AS light_pct, CASE WHEN tot > 0 THEN ROUND("awakeSleepSeconds" / tot, 9) END AS awake_pct FROM t"""))
_MODEL = [KEY, "step_length_m", "highly_active_hours", "awakeMeasuredHours", "totalMeasuredHours", "sleep_start_hour_local", "sleep_start_hour_local_wrapped", "sleep_opportunity_hours", "day_of_week", "weekday_name", "is_weekend"]
_H = "(hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE)"
register("g9_modeling_features", lambda s, d: rounded(features.modeling_features(joined(s, d)).select(*_MODEL)), oracle(f"""
, t AS (SELECT *, CAST(to_timestamp("sleepStartTimestampGMT") AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts FROM fact_quality)
SELECT "calendarDate", CASE WHEN "totalSteps" >= 1000 THEN ROUND("totalDistanceMeters" / CAST("totalSteps" AS DOUBLE), 9) END AS step_length_m, ROUND("highlyActiveSeconds" / 3600.0::DOUBLE, 9) AS highly_active_hours, ROUND("allDayStress_AWAKE_totalDuration" / 3600.0::DOUBLE, 9) AS "awakeMeasuredHours", ROUND("allDayStress_TOTAL_totalDuration" / 3600.0::DOUBLE, 9) AS "totalMeasuredHours",
ROUND({_H}, 9) AS sleep_start_hour_local, ROUND(CASE WHEN {_H} >= 18 THEN {_H} - 24 ELSE {_H} END, 9) AS sleep_start_hour_local_wrapped, CASE WHEN "sleepEndTimestampGMT" > "sleepStartTimestampGMT" THEN ROUND(("sleepEndTimestampGMT" - "sleepStartTimestampGMT") / 3600.0::DOUBLE, 9) END AS sleep_opportunity_hours,
CAST(isodow("calendarDate") - 1 AS INTEGER) AS day_of_week, dayname("calendarDate") AS weekday_name, isodow("calendarDate") >= 6 AS is_weekend FROM t"""))
register("g16_sleep_onset", lambda s, d: features.sleep_onset(testbed.fact_sleep(s, d)).select(KEY, "sleep_onset_date", "sleep_onset_day_of_week", "sleep_onset_weekday_name"), oracle('SELECT "calendarDate", CAST("calendarDate" - INTERVAL 1 DAY AS DATE) AS sleep_onset_date, CAST(isodow("calendarDate" - INTERVAL 1 DAY) - 1 AS INTEGER) AS sleep_onset_day_of_week, dayname("calendarDate" - INTERVAL 1 DAY) AS sleep_onset_weekday_name FROM fact_sleep'))


def _recovery(s: SparkSession, d: str) -> DataFrame:
    f = testbed.facts(s, d)
    return features.recovery_frame(testbed.merged(f["fact_daily"], f["fact_sleep"]), f["fact_quality"].select(KEY, *[c for c in f["fact_quality"].columns if c.startswith(("valid", "corrupted", "has_"))]))


_TARGET_COLUMNS = [KEY, "totalSteps", *[f"target_{c}_next_night" for c in features.TARGETS], "target_low_recovery_next_night", "model_row_current_quality"]
register("g23_recovery_frame", lambda s, d: _recovery(s, d).select(*_TARGET_COLUMNS), oracle("SELECT d.\"calendarDate\", d.\"totalSteps\", " + ", ".join(f'CAST(n."{c}" AS DOUBLE) AS "target_{c}_next_night"' for c in features.TARGETS) + """, CAST(n."sleepRecoveryScore" < 70 AS BIGINT) AS target_low_recovery_next_night, 'strict' AS model_row_current_quality
FROM fact_quality d LEFT JOIN fact_quality n ON n."calendarDate" = CAST(d."calendarDate" + INTERVAL 1 DAY AS DATE) AND n.has_sleep AND NOT n.corrupted_stress_only_day WHERE d.valid_day_strict AND NOT d.corrupted_stress_only_day"""))
register("g21_threshold_target", lambda s, d: features.threshold_target(testbed.fact_sleep(s, d), "sleepRecoveryScore", "low", 70, "lt").select(KEY, "low"), oracle('SELECT "calendarDate", CAST("sleepRecoveryScore" < 70 AS BIGINT) AS low FROM fact_sleep'))
register("g22_quantile_target", lambda s, d: features.quantile_target(testbed.fact_sleep(s, d), "avgSleepStress", "high", 0.75)[0].select(KEY, "high"), oracle('SELECT "calendarDate", CAST("avgSleepStress" >= (SELECT quantile_cont(CAST("avgSleepStress" AS DOUBLE), 0.75) FROM fact_sleep) AS BIGINT) AS high FROM fact_sleep'))

# ---------------------------------------------------------------- series, distributions, segments

register("j6_gap_filled", lambda s, d: explore.fill_gaps(testbed.fact_daily(s, d), ["totalSteps"]), oracle('SELECT CAST(c.day AS DATE) AS "calendarDate", f."totalSteps" FROM (SELECT unnest(generate_series((SELECT MIN("calendarDate") FROM fact_daily), (SELECT MAX("calendarDate") FROM fact_daily), INTERVAL 1 DAY)) AS day) c LEFT JOIN fact_daily f ON f."calendarDate" = CAST(c.day AS DATE)'))
register("w5_rolling_mean", lambda s, d: rounded(explore.rolling_mean(testbed.fact_daily(s, d), "totalSteps").select(KEY, "totalSteps_mean7"), 6), oracle('SELECT "calendarDate", CASE WHEN COUNT("totalSteps") OVER w >= 3 THEN ROUND(AVG("totalSteps") OVER w, 6) END AS "totalSteps_mean7" FROM fact_daily WINDOW w AS (ORDER BY "calendarDate" RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)'))
_EVENTS = "e AS (SELECT user_id, CAST(ts AS DATE) AS \"calendarDate\", COUNT(*) AS n_events, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents, COUNT(DISTINCT event_type) AS n_types, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1, 2)"
register("d_entity_days", lambda s, d: explore.entity_days(s.read.parquet(f"{d}/events.parquet")), f"WITH {_EVENTS} SELECT * FROM e")
register("w5_entity_rolling", lambda s, d: rounded(explore.rolling_mean(explore.entity_days(s.read.parquet(f"{d}/events.parquet")), "n_events", keys=["user_id"]).select("user_id", KEY, "n_events_mean7"), 6), f"WITH {_EVENTS} SELECT user_id, \"calendarDate\", CASE WHEN COUNT(n_events) OVER w >= 3 THEN ROUND(AVG(n_events) OVER w, 6) END AS n_events_mean7 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY \"calendarDate\" RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)")
register("a27_month_coverage", lambda s, d: explore.month_coverage(joined(s, d), ["has_steps", "has_sleep"]), oracle("SELECT CAST(date_trunc('month', \"calendarDate\") AS DATE) AS month, ROUND(AVG(CAST(has_steps AS DOUBLE)) * 100, 6) AS has_steps, ROUND(AVG(CAST(has_sleep AS DOUBLE)) * 100, 6) AS has_sleep FROM fact_quality GROUP BY 1"))
register("a28_calendar_quality", lambda s, d: explore.calendar_quality(joined(s, d)), oracle("SELECT \"calendarDate\", CAST(year(\"calendarDate\") AS INTEGER) AS year, CAST((date_diff('day', date_trunc('year', \"calendarDate\"), \"calendarDate\") + isodow(date_trunc('year', \"calendarDate\")) - 1) // 7 AS INTEGER) AS week_of_year, CAST(isodow(\"calendarDate\") - 1 AS INTEGER) AS weekday, CASE WHEN corrupted_stress_only_day THEN 1 WHEN quality_score = 0 THEN 0 WHEN day_quality_label_strict = 'bad' THEN 2 WHEN day_quality_label_strict = 'partial' THEN 3 ELSE 4 END AS category FROM fact_quality"))
register("a29_histogram", lambda s, d: explore.histogram(testbed.fact_daily(s, d), "totalSteps", edges=[0, 2500, 5000, 7500, 10000, 15000]), oracle('SELECT b.bin, b.low, b.high, COUNT(f."totalSteps") AS count FROM (VALUES (0, 0::DOUBLE, 2500::DOUBLE), (1, 2500, 5000), (2, 5000, 7500), (3, 7500, 10000), (4, 10000, 15000)) b(bin, low, high) LEFT JOIN fact_daily f ON f."totalSteps" >= b.low AND (f."totalSteps" < b.high OR b.bin = 4) GROUP BY ALL'))
register("a32_describe", lambda s, d: rounded(explore.describe(testbed.fact_daily(s, d), ["totalSteps", "maxHeartRate"]), 6), oracle(" UNION ALL ".join(f'SELECT \'{c}\' AS "column", COUNT("{c}") AS count, ROUND(AVG("{c}"), 6) AS mean, ROUND(stddev_samp("{c}"), 6) AS std, CAST(MIN("{c}") AS DOUBLE) AS min, ' + ", ".join(f'ROUND(quantile_cont(CAST("{c}" AS DOUBLE), {q}), 6) AS p{round(q * 100):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + f', CAST(MAX("{c}") AS DOUBLE) AS max FROM fact_daily' for c in ("totalSteps", "maxHeartRate"))))
register("w12_ecdf", lambda s, d: rounded(explore.ecdf(testbed.fact_sleep(s, d), "sleepOverallScore")), oracle('SELECT CAST("sleepOverallScore" AS DOUBLE) AS value, ROUND(ROW_NUMBER() OVER (ORDER BY "sleepOverallScore") / CAST(COUNT(*) OVER () AS DOUBLE), 9) AS share FROM fact_sleep WHERE "sleepOverallScore" IS NOT NULL'))
_SEG = 'COUNT({c}) AS n, MEDIAN(CAST({c} AS DOUBLE)) AS median, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.05), 6) AS p05, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.95), 6) AS p95, ROUND(AVG({c}), 6) AS mean'
register("a30_by_weekday", lambda s, d: rounded(explore.by_weekday(testbed.fact_daily(s, d), "totalSteps"), 6), oracle(f'SELECT dayname("calendarDate") AS segment, {_SEG.format(c=chr(34) + "totalSteps" + chr(34))} FROM fact_daily GROUP BY 1'))
register("a30_by_weekpart", lambda s, d: rounded(explore.by_weekpart(testbed.fact_daily(s, d), "totalSteps"), 6), oracle(f"SELECT CASE WHEN isodow(\"calendarDate\") >= 6 THEN 'weekend' ELSE 'weekday' END AS segment, {_SEG.format(c=chr(34) + 'totalSteps' + chr(34))} FROM fact_daily GROUP BY 1"))
_BUCKET = "CASE WHEN \"sleepOverallScore\" IS NULL THEN 'unknown' WHEN \"sleepOverallScore\" < 60 THEN 'poor' WHEN \"sleepOverallScore\" < 80 THEN 'fair' WHEN \"sleepOverallScore\" < 90 THEN 'good' ELSE 'excellent' END"
register("a30_by_score_bucket", lambda s, d: rounded(explore.by_score_bucket(testbed.fact_sleep(s, d), "avgSleepStress"), 6), oracle(f"SELECT {_BUCKET} AS segment, {_SEG.format(c=chr(34) + 'avgSleepStress' + chr(34))} FROM fact_sleep GROUP BY 1"))
register("a31_bucket_counts", lambda s, d: testbed.fact_sleep(s, d).groupBy(score_bucket(F.col("sleepOverallScore")).alias("bucket")).agg(F.count("*").alias("nights")), oracle(f"SELECT {_BUCKET} AS bucket, COUNT(*) AS nights FROM fact_sleep GROUP BY 1"))
register("a33_positive_rates", lambda s, d: rounded(explore.positive_rates(testbed.fact_sleep(s, d), "sleepRecoveryScore", [60, 70, 75])), oracle(" UNION ALL ".join(f'SELECT {t}::DOUBLE AS threshold, ROUND(AVG(CAST(coalesce("sleepRecoveryScore" < {t}, FALSE) AS DOUBLE)), 9) AS positive_rate FROM fact_sleep' for t in (60, 70, 75))))
register("a24_row_range", lambda s, d: explore.row_range(testbed.fact_daily(s, d), "df_all"), oracle("SELECT 'df_all' AS slice, COUNT(*) AS rows, MIN(\"calendarDate\") AS first_day, MAX(\"calendarDate\") AS last_day FROM fact_daily"))
register("g20_stage_shares", lambda s, d: rounded(explore.stage_shares(testbed.fact_sleep(s, d)).select(KEY, "deep_hours", "deep_share", "awake_share")), oracle(f', t AS (SELECT *, {_TOTAL} AS tot FROM fact_sleep) SELECT "calendarDate", ROUND("deepSleepSeconds" / 3600.0::DOUBLE, 9) AS deep_hours, ROUND(coalesce("deepSleepSeconds", 0) / tot, 9) AS deep_share, ROUND(coalesce("awakeSleepSeconds", 0) / tot, 9) AS awake_share FROM t WHERE tot > 0'))
register("c20_night_intervals", lambda s, d: rounded(explore.nights_table(testbed.fact_sleep(s, d))), oracle(f"""
, t AS (SELECT "calendarDate", {_BUCKET} AS bucket, CAST(to_timestamp("sleepStartTimestampGMT") AT TIME ZONE 'UTC' AS TIMESTAMP) AS a, CAST(to_timestamp("sleepEndTimestampGMT") AT TIME ZONE 'UTC' AS TIMESTAMP) AS b FROM fact_sleep),
h AS (SELECT "calendarDate", bucket, hour(a) + minute(a) / 60.0::DOUBLE + second(a) / 3600.0::DOUBLE AS a, hour(b) + minute(b) / 60.0::DOUBLE + second(b) / 3600.0::DOUBLE AS b FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (SELECT "calendarDate", bucket, CASE WHEN a < 16 THEN a + 24 ELSE a END AS a, CASE WHEN b < 16 THEN b + 24 ELSE b END AS b FROM h)
SELECT "calendarDate", ROUND(a, 9) AS start_h, ROUND(CASE WHEN b < a THEN b + 24 ELSE b END, 9) AS end_h, bucket FROM g"""))
register("a35_duplicate_days", lambda s, d: explore.duplicate_days(s.read.parquet(f"{d}/orders.parquet").withColumn(KEY, F.col("o_orderdate"))), 'SELECT CAST(o_orderdate AS DATE) AS "calendarDate", COUNT(*) AS rows FROM orders GROUP BY 1 HAVING COUNT(*) > 1')
_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
register("a25_missingness", lambda s, d: explore.missingness(s.read.parquet(f"{d}/lineitem.parquet"), _LINEITEM), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 2) AS missing_pct, COUNT(DISTINCT {c}) AS n_unique FROM lineitem" for c in _LINEITEM) + ")")

# ---------------------------------------------------------------- dictionary and sanitising

_DICT = ("column", "non_null_count", "missing_count", "n_unique", "is_constant", "min", "p25", "median", "max", "first_non_null_date", "last_non_null_date", "coverage_span_days")
_DICT_COLUMNS = ("totalSteps", "maxHeartRate", "stressTotalDurationSeconds", "sleepOverallScore")
register("k1_dictionary", lambda s, d: dictionary.build_dictionary(testbed.merged(testbed.fact_daily(s, d), testbed.fact_sleep(s, d)).select(KEY, *_DICT_COLUMNS)).where(F.col("column") != KEY).select(*_DICT, "inferred_unit", "inferred_group", "analysis_priority"), oracle(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", COUNT("{c}") AS non_null_count, COUNT(*) - COUNT("{c}") AS missing_count, COUNT(DISTINCT "{c}") AS n_unique, COUNT(DISTINCT "{c}") <= 1 AS is_constant, CAST(MIN("{c}") AS DOUBLE) AS min, quantile_cont(CAST("{c}" AS DOUBLE), 0.25) AS p25, MEDIAN(CAST("{c}" AS DOUBLE)) AS median, CAST(MAX("{c}") AS DOUBLE) AS max,
MIN("calendarDate") FILTER (WHERE "{c}" IS NOT NULL) AS first_non_null_date, MAX("calendarDate") FILTER (WHERE "{c}" IS NOT NULL) AS last_non_null_date, CAST(date_diff('day', MIN("calendarDate") FILTER (WHERE "{c}" IS NOT NULL), MAX("calendarDate") FILTER (WHERE "{c}" IS NOT NULL)) + 1 AS INTEGER) AS coverage_span_days, '{u}' AS inferred_unit, '{g}' AS inferred_group, 'high' AS analysis_priority FROM merged""" for c, u, g in (("totalSteps", "", "steps_distance"), ("maxHeartRate", "bpm", "heart_rate"), ("stressTotalDurationSeconds", "Seconds", "stress"), ("sleepOverallScore", "", "sleep")))))
register("k1_dictionary_customer", lambda s, d: dictionary.build_dictionary(s.read.parquet(f"{d}/customer.parquet")).select("column", "non_null_count", "n_unique", "inferred_group"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT({c}) AS non_null_count, COUNT(DISTINCT {c}) AS n_unique, 'other' AS inferred_group FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
register("v3_stress_sentinels", lambda s, d: sanitize.null_stress_levels(testbed.fact_sleep(s, d).withColumn("avgSleepStress", F.col("avgSleepStress") * 4 - 20), count=False)[0].select(KEY, "avgSleepStress"), oracle('SELECT "calendarDate", CASE WHEN "avgSleepStress" * 4 - 20 BETWEEN 0 AND 100 THEN "avgSleepStress" * 4 - 20 END AS "avgSleepStress" FROM fact_sleep'))


def _sanitised(s: SparkSession, d: str) -> DataFrame:
    raw = testbed.fact_daily(s, d).select(KEY, "totalSteps", F.lit("x").alias("uuid"), F.lit(1).alias("userProfilePK"), F.lit("v1").alias("version"), F.lit("2020").alias("a_calendarDate"))
    return sanitize.sanitize(raw)[0]


register("v1_sanitise", _sanitised, oracle('SELECT "calendarDate", "totalSteps" FROM fact_daily'))

# ---------------------------------------------------------------- statistics

_PAIRS = "pairs AS (SELECT day_awake_average_stress AS x, nextsleep_recovery_score AS y FROM aligned WHERE day_awake_average_stress IS NOT NULL AND nextsleep_recovery_score IS NOT NULL)"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    from dayloom.plans.catalog import aligned

    return aligned(s, d).select(F.col("day_awake_average_stress").alias("x"), F.col("nextsleep_recovery_score").alias("y")).dropna()


def _spearman(s: SparkSession, d: str) -> DataFrame:
    ranked = stats.average_ranks(stats.average_ranks(_pairs(s, d), "x", "a"), "y", "b")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 9).alias("rho"))


register("x7_spearman", _spearman, oracle(f", {_PAIRS}, r AS (SELECT RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM pairs) SELECT COUNT(*) AS n, ROUND(corr(a, b), 9) AS rho FROM r"))
register("x9_pearson", lambda s, d: rounded(stats.pearson(_pairs(s, d), "x", "y")), oracle(f", {_PAIRS} SELECT COUNT(*) AS n, ROUND(corr(x, y), 9) AS r FROM pairs"))


def _weekend(s: SparkSession, d: str) -> DataFrame:
    return testbed.fact_daily(s, d).select(F.when(F.weekday(KEY) >= 5, "weekend").otherwise("weekday").alias("part"), "totalSteps")


register("x5_rank_sums", lambda s, d: stats.rank_sums(_weekend(s, d), "totalSteps", "part").drop("ties"), oracle("""
, r AS (SELECT CASE WHEN isodow("calendarDate") >= 6 THEN 'weekend' ELSE 'weekday' END AS "group", CAST("totalSteps" AS DOUBLE) AS v, RANK() OVER (ORDER BY "totalSteps") + (COUNT(*) OVER (PARTITION BY "totalSteps") - 1) / 2.0::DOUBLE AS r FROM fact_daily WHERE "totalSteps" IS NOT NULL)
SELECT "group", COUNT(*) AS n, SUM(r) AS rank_sum, MEDIAN(v) AS median FROM r GROUP BY 1"""))


def _tests(s: SparkSession, d: str) -> DataFrame:
    mw = stats.mann_whitney(_weekend(s, d), "totalSteps", "part", "weekend", "weekday")
    sp, kw = stats.spearman(_pairs(s, d), "x", "y"), stats.kruskal(testbed.fact_daily(s, d).withColumn("w", F.weekday(KEY)), "totalSteps", "w")
    rows = [(n, None if v is None else float(v), None if p is None else float(p), ok) for (n, p, ok), v in zip(stats.decisions([("mann_whitney", mw["p"]), ("spearman", sp["p"]), ("kruskal", kw["p"])]), (mw["u"], sp["rho"], kw["h"]), strict=True)]
    return s.createDataFrame(rows, "test string, statistic double, p double, supported boolean")


register("x10_decisions", _tests)


def _bootstrap(s: SparkSession, d: str) -> DataFrame:
    a = stats.bootstrap_median_difference(_weekend(s, d), "totalSteps", "part", "weekend", "weekday")
    b = stats.bootstrap_spearman(_pairs(s, d), "x", "y")
    return s.createDataFrame([("median_difference", a["low"], a["high"]), ("spearman", b["low"], b["high"])], "estimate string, low double, high double")


register("x3_bootstrap", _bootstrap)

# ---------------------------------------------------------------- modelling


def _scored(s: SparkSession, d: str) -> DataFrame:
    """A given score, so that the metrics can be checked: the day's stress against a poor next night."""
    return _pairs(s, d).select((F.col("y") < 70).cast("int").alias("label"), (F.col("x") / 100).alias("score"))


_SCORED = f"{_PAIRS}, sc AS (SELECT CAST(y < 70 AS INT) AS label, x / 100 AS score FROM pairs)"
register("m7_confusion", lambda s, d: rounded(modeling.confusion(_scored(s, d), "label", "score", 0.5)), oracle(f", {_SCORED}, c AS (SELECT COUNT(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn, COUNT(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, COUNT(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, COUNT(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM sc) SELECT *, ROUND(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 9) AS precision, ROUND(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS recall, ROUND(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 9) AS specificity FROM c"))
register("m5_ranking_metrics", lambda s, d: rounded(modeling.ranking_metrics(_scored(s, d), "label", "score")), oracle(f", {_SCORED}, g AS (SELECT score, SUM(label) AS p, COUNT(*) - SUM(label) AS q FROM sc GROUP BY 1), h AS (SELECT p, q, SUM(p) OVER (ORDER BY score DESC) AS cp, SUM(q) OVER (ORDER BY score DESC) AS cq FROM g) SELECT ROUND(CAST(SUM(q * (cp - p) + q * p / 2.0::DOUBLE) AS DOUBLE) / (SUM(p) * SUM(q)), 9) AS roc_auc, ROUND(SUM(p * cp / CAST(cp + cq AS DOUBLE)) / SUM(p), 9) AS average_precision FROM h"))
register("m8_threshold_table", lambda s, d: rounded(modeling.threshold_table(_scored(s, d), "label", "score", [0.25, 0.5, 0.75])), oracle(f", {_SCORED}, c AS (SELECT t.threshold, COUNT(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, COUNT(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, COUNT(*) FILTER (WHERE label = 1 AND score < threshold) AS fn, COUNT(*) FILTER (WHERE label = 0 AND score < threshold) AS tn FROM sc, (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(threshold) GROUP BY 1) SELECT *, ROUND((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 9) AS balanced_accuracy, ROUND(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM c"))
register("m6_regression_metrics", lambda s, d: rounded(modeling.regression_metrics(_pairs(s, d), "y", "x"), 6), oracle(f", {_PAIRS} SELECT COUNT(*) AS n, ROUND(AVG(abs(y - x)), 6) AS mae, ROUND(sqrt(AVG((y - x) * (y - x))), 6) AS rmse, ROUND(1 - SUM((y - x) * (y - x)) / (var_pop(y) * COUNT(*)), 6) AS r2, MIN(x) AS prediction_min, MAX(x) AS prediction_max FROM pairs"))
register("w10_time_split", lambda s, d: modeling.time_split(testbed.fact_daily(s, d)).select(KEY, "split"), oracle("""SELECT "calendarDate", CASE WHEN n <= floor(t * 0.6) THEN 'train' WHEN n <= floor(t * 0.6) + floor(t * 0.2) THEN 'valid' ELSE 'test' END AS split FROM (SELECT "calendarDate", ROW_NUMBER() OVER (ORDER BY "calendarDate") AS n, COUNT(*) OVER () AS t FROM fact_daily)"""))


def _classifiers(s: SparkSession, d: str) -> DataFrame:
    frame = _recovery(s, d)
    rows = modeling.evaluate_classifiers(frame, features.feature_columns(frame), "target_low_recovery_next_night", tune="balanced_accuracy")
    names = ("model", "split", "threshold", "n", "accuracy", "balanced_accuracy", "roc_auc")
    return s.createDataFrame([tuple(r[n] for n in names) for r in rows], "model string, split string, threshold double, n long, accuracy double, balanced_accuracy double, roc_auc double")


def _regressors(s: SparkSession, d: str) -> DataFrame:
    frame = _recovery(s, d)
    rows = modeling.evaluate_regressors(frame, features.feature_columns(frame), "target_sleepRecoveryScore_next_night")
    return s.createDataFrame([(r["model"], r["split"], r["n"], r["mae"], r["rmse"]) for r in rows], "model string, split string, n long, mae double, rmse double")


register("m10_classifiers", _classifiers)
register("m11_regressors", _regressors)
