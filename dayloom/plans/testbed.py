"""Day facts made from the bundled tables, by integer arithmetic only, so that other engines
get the same values bit for bit.

Orders by day give the activity facts, line items by day the sleep facts; c is the day's money
in cents and k the day's number since 1970-01-01. ``FACTS_SQL`` is the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.exprs import KEY
from dayloom.operators.quality import label_days

# name: (value, k modulus at which it is null); c % m + least
DAILY = {
    "totalSteps": (0, 15_000, 17), "awakeAverageStressLevel": (20, 61, 13), "maxHeartRate": (100, 80, 19), "minHeartRate": (40, 20, 29), "restingHeartRate": (45, 25, 11), "bodyBatteryLowest": (5, 40, 7),
    "bodyBatteryStartOfDay": (50, 51, 31), "bodyBatteryEndOfDay": (5, 50, 9), "totalDistanceMeters": (0, 12_000, 37), "activeKilocalories": (100, 900, 41), "highlyActiveSeconds": (0, 3_600, 43), "activeSeconds": (0, 14_400, 47),
    "stressAwakeDurationSeconds": (0, 60_000, 15), "allDayStress_TOTAL_totalDuration": (0, 90_100, 21), "allDayStress_AWAKE_totalDuration": (0, 60_000, 25),
}
SLEEP = {
    "sleepRecoveryScore": (40, 61, 53), "sleepOverallScore": (40, 59, 59), "sleepQualityScore": (30, 70, 61), "avgSleepStress": (0, 45, 23), "deepSleepSeconds": (0, 9_000, 27), "lightSleepSeconds": (3_600, 14_400, 33),
    "remSleepSeconds": (0, 7_200, 35), "awakeSleepSeconds": (0, 3_600, 39),
}


def _columns(spec: dict) -> list:
    return [F.when(F.col("k") % null != 0, F.col("c") % m + F.lit(least).cast("bigint")).alias(n) for n, (least, m, null) in spec.items()]


def _by_day(df: DataFrame, day: str, money: str) -> DataFrame:
    cents = F.sum(F.round(F.col(money) * 100).cast("bigint"))
    return df.groupBy(F.col(day).cast("date").alias(KEY)).agg(cents.alias("c")).withColumn("k", F.unix_date(KEY).cast("bigint"))


def fact_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _by_day(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_totalprice")
    stress = F.when(F.col("k") % 23 == 0, F.lit(86_000).cast("bigint")).otherwise(F.col("c") % 90_000)
    lonely = F.col("k") % 46 == 0  # days on which nothing supports the stress
    out = days.select(KEY, "k", *_columns(DAILY), stress.alias("stressTotalDurationSeconds"))
    gone = {c: F.when(~lonely, F.col(c)) for c in ("totalSteps", "minHeartRate", "maxHeartRate", "restingHeartRate", "bodyBatteryEndOfDay")}
    return out.withColumns(gone).drop("k")


def fact_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _by_day(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", "l_extendedprice").where("k % 5 <> 0")
    start = F.when(F.col("k") % 12 != 0, F.col("k") * 86_400 - 7_200 + F.col("c") % 14_400)
    end = F.when(F.col("k") % 18 != 0, F.col("k") * 86_400 + 18_000 + F.col("c") % 18_000)
    return days.select(KEY, *_columns(SLEEP), start.alias("sleepStartTimestampGMT"), end.alias("sleepEndTimestampGMT"))


def merged(daily: DataFrame, sleep: DataFrame) -> DataFrame:
    return daily.join(sleep, KEY, "left")


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    daily, sleep = fact_daily(spark, sf_dir), fact_sleep(spark, sf_dir)
    return {"fact_daily": daily, "fact_sleep": sleep, "fact_quality": label_days(merged(daily, sleep))}


def _sql(spec: dict) -> str:
    return ", ".join(f"CASE WHEN k % {null} <> 0 THEN c % {m} + {least} END AS {n}" for n, (least, m, null) in spec.items())


# Names of the views' columns, and the facts' columns that they show
_OF_DAY = {"total_steps": "totalSteps", "total_distance_meters": "totalDistanceMeters", "active_kilocalories": "activeKilocalories", "awake_average_stress": "awakeAverageStressLevel", "max_heart_rate": "maxHeartRate", "body_battery_lowest": "bodyBatteryLowest"}
_NIGHT = {"recovery_score": "sleepRecoveryScore", "overall_score": "sleepOverallScore", "quality_score": "sleepQualityScore", "avg_sleep_stress": "avgSleepStress", "start_ts_gmt": "sleepStartTimestampGMT", "end_ts_gmt": "sleepEndTimestampGMT"}


def _as_doubles(names: dict[str, str], prefix: str) -> str:
    return ", ".join(f'CAST("{c}" AS DOUBLE) AS {prefix}{n}' for n, c in names.items())


_LONELY = ("totalSteps", "minHeartRate", "maxHeartRate", "restingHeartRate", "bodyBatteryEndOfDay")
_DAY = "date_diff('day', DATE '1970-01-01', \"calendarDate\")"
FACTS_SQL = f"""
d0 AS (SELECT CAST(o_orderdate AS DATE) AS "calendarDate", CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY 1),
d1 AS (SELECT *, {_DAY} AS k FROM d0),
d2 AS (SELECT "calendarDate", k, {_sql(DAILY)}, CASE WHEN k % 23 = 0 THEN 86000 ELSE c % 90000 END AS "stressTotalDurationSeconds" FROM d1),
fact_daily AS (SELECT * EXCLUDE (k) REPLACE ({', '.join(f'CASE WHEN k % 46 <> 0 THEN "{c}" END AS "{c}"' for c in _LONELY)}) FROM d2),
s0 AS (SELECT CAST(l_shipdate AS DATE) AS "calendarDate", CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY 1),
s1 AS (SELECT *, {_DAY} AS k FROM s0),
fact_sleep AS (SELECT "calendarDate", {_sql(SLEEP)}, CASE WHEN k % 12 <> 0 THEN k * 86400 - 7200 + c % 14400 END AS "sleepStartTimestampGMT", CASE WHEN k % 18 <> 0 THEN k * 86400 + 18000 + c % 18000 END AS "sleepEndTimestampGMT" FROM s1 WHERE k % 5 <> 0),
merged AS (SELECT d.*, s.* EXCLUDE ("calendarDate") FROM fact_daily d LEFT JOIN fact_sleep s USING ("calendarDate")),
q0 AS (SELECT *,
  coalesce("totalSteps" >= 50, FALSE) AS has_steps,
  ("minHeartRate" IS NOT NULL OR "maxHeartRate" IS NOT NULL OR "restingHeartRate" IS NOT NULL) AS has_hr,
  coalesce("stressTotalDurationSeconds" >= 21600, FALSE) AS has_stress_duration,
  coalesce("stressTotalDurationSeconds" >= 72000, FALSE) AS full_day_stress,
  "bodyBatteryStartOfDay" IS NOT NULL AS has_bodybattery_start,
  "bodyBatteryEndOfDay" IS NOT NULL AS has_bodybattery_end,
  ("bodyBatteryStartOfDay" IS NOT NULL OR "bodyBatteryEndOfDay" IS NOT NULL) AS has_bodybattery_any,
  ("bodyBatteryStartOfDay" IS NOT NULL AND "bodyBatteryEndOfDay" IS NULL) AS bodybattery_start_without_end,
  ("sleepStartTimestampGMT" IS NOT NULL AND "sleepEndTimestampGMT" IS NOT NULL) AS has_sleep,
  abs("stressTotalDurationSeconds" - "allDayStress_TOTAL_totalDuration") <= 60 AS "stress_duration_matches_allDayStress_TOTAL",
  abs("stressAwakeDurationSeconds" - "allDayStress_AWAKE_totalDuration") <= 60 AS "stress_awake_matches_allDayStress_AWAKE"
  FROM merged),
q1 AS (SELECT *,
  CAST(CAST(has_steps AS BIGINT) + CAST(has_hr AS BIGINT) + CAST(has_stress_duration AS BIGINT) + CAST(has_bodybattery_end AS BIGINT) + CAST(has_sleep AS BIGINT) AS BIGINT) AS quality_score,
  (coalesce("stressTotalDurationSeconds" >= 84600, FALSE) AND NOT (has_hr OR has_sleep OR has_bodybattery_end OR has_steps)) AS corrupted_stress_only_day FROM q0),
fact_quality AS (SELECT *,
  CASE WHEN corrupted_stress_only_day OR quality_score <= 1 THEN 'bad' WHEN quality_score >= 4 THEN 'good' ELSE 'partial' END AS day_quality_label_strict,
  CASE WHEN corrupted_stress_only_day OR quality_score <= 1 THEN 'bad' WHEN quality_score >= 3 THEN 'good' ELSE 'partial' END AS day_quality_label_loose,
  (quality_score >= 4 AND NOT corrupted_stress_only_day) AS valid_day_strict,
  (quality_score >= 3 AND NOT corrupted_stress_only_day) AS valid_day_loose,
  concat_ws(',', CASE WHEN corrupted_stress_only_day THEN 'corrupted_stress_only_day' END, CASE WHEN NOT has_steps THEN 'has_steps' END, CASE WHEN NOT has_hr THEN 'has_hr' END,
    CASE WHEN NOT has_stress_duration THEN 'has_stress_duration' END, CASE WHEN NOT has_bodybattery_end THEN 'has_bodybattery_end' END, CASE WHEN NOT has_sleep THEN 'has_sleep' END, CASE WHEN NOT full_day_stress THEN 'full_day_stress' END) AS suspicion_reasons
  FROM q1),
following AS (SELECT "calendarDate" AS next_sleep_date, CAST("calendarDate" - INTERVAL 1 DAY AS DATE) AS day_date, {_as_doubles(_NIGHT, "nextsleep_")} FROM fact_sleep),
labels_of_days AS (SELECT "calendarDate" AS day_date, day_quality_label_strict, valid_day_strict, corrupted_stress_only_day FROM fact_quality),
days AS (SELECT "calendarDate" AS day_date, {_as_doubles(_OF_DAY, "day_")} FROM fact_daily),
aligned AS (SELECT * FROM days LEFT JOIN labels_of_days USING (day_date) LEFT JOIN following USING (day_date)),
timed AS (SELECT *, "sleepEndTimestampGMT" - "sleepStartTimestampGMT" AS span, {" + ".join(f'coalesce("{c}", 0)' for c in ("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds"))} AS staged FROM fact_sleep),
nights AS (SELECT "calendarDate" AS sleep_date, {_as_doubles({n: c for n, c in _NIGHT.items() if n != "avg_sleep_stress"} | {"avg_stress": "avgSleepStress"}, "sleep_")}, (CASE WHEN span > 0 THEN span ELSE staged END) / 3600.0::DOUBLE AS sleep_hours FROM timed),
weekdays AS (SELECT CAST(isodow(day_date) AS INTEGER) AS iso_weekday, any_value(dayname(day_date)) AS weekday_name, COUNT(*) AS days_total, COUNT(CASE WHEN valid_day_strict THEN 1 END) AS strict_good_days,
  {", ".join(f"{f}({c}) AS {n}" for f, c, n in (("AVG", "day_total_steps", "avg_steps"), ("MEDIAN", "day_total_steps", "median_steps"), ("AVG", "day_awake_average_stress", "avg_awake_stress"), ("MEDIAN", "nextsleep_recovery_score", "median_nextsleep_recovery")))} FROM aligned GROUP BY isodow(day_date)),
strict_days AS (SELECT * FROM aligned WHERE valid_day_strict IS TRUE AND corrupted_stress_only_day IS NOT TRUE)
"""


def oracle(select: str) -> str:
    """A query after the common tables; one that begins with a comma adds tables of its own."""
    return f"WITH {FACTS_SQL.strip()}{select if select.lstrip().startswith(',') else ' ' + select}"
