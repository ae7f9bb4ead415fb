"""Literal fixtures of the day-grain operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.functions import special
from dayloom.functions.exprs import KEY
from dayloom.operators import dictionary, explore, features, modeling, quality, sanitize, stats
from dayloom.plans import mart

DAYS = "calendarDate string, totalSteps long, minHeartRate long, maxHeartRate long, restingHeartRate long, stressTotalDurationSeconds long, stressAwakeDurationSeconds long, allDayStress_TOTAL_totalDuration long, allDayStress_AWAKE_totalDuration long, bodyBatteryStartOfDay long, bodyBatteryEndOfDay long, sleepStartTimestampGMT long, sleepEndTimestampGMT long"


def test_quality_rows(spark):
    rows = [
        ("2025-01-01", 5000, 45, 170, 52, 80000, 50000, 80020, 50040, 80, 25, 1, 2),
        ("2025-01-02", 300, None, None, None, 2000, 1000, 3000, 1300, 70, None, None, None),
        ("2025-01-03", *[None] * 12),
        ("2025-01-04", 2000, 50, None, None, 30000, None, None, None, None, 20, None, None),
        ("2024-02-26", None, None, None, None, 86400, None, None, None, None, None, None, None),
    ]
    labelled = quality.label_days(spark.createDataFrame(rows, DAYS)).cache()
    a, b, c, d, e = (labelled.where(F.col(KEY) == r[0]).first() for r in rows)
    assert (a.quality_score, a.day_quality_label_strict, a.day_quality_label_loose, a.stress_duration_matches_allDayStress_TOTAL) == (5, "good", "good", True)
    assert (b.quality_score, b.day_quality_label_strict, b.stress_duration_matches_allDayStress_TOTAL, b.bodybattery_start_without_end) == (1, "bad", False, True)
    assert (c.quality_score, c.day_quality_label_loose) == (0, "bad") and c.stress_duration_matches_allDayStress_TOTAL is None
    assert (d.quality_score, d.day_quality_label_strict) == (4, "good") and "has_sleep" in d.suspicion_reasons
    assert e.corrupted_stress_only_day and (e.day_quality_label_loose, e.valid_day_loose) == ("bad", False) and e.suspicion_reasons.startswith("corrupted_stress_only_day")
    assert quality.artifact_days(labelled, 3).first()[KEY] == "2024-02-26" and quality.suspicious_days(labelled, 1).first()[KEY] == "2025-01-03"
    assert {(r.label, r["count"], r.pct) for r in quality.label_table(labelled, "day_quality_label_strict").collect()} == {("good", 2, 40.0), ("partial", 0, 0.0), ("bad", 3, 60.0)}
    assert quality.reason_table(labelled, F.col("corrupted_stress_only_day")).first().pct_of_rows == 100.0
    assert quality.reason_table(labelled.limit(0)).collect() == []


def test_quality_without_columns(spark):
    r = quality.label_days(spark.createDataFrame([("2025-01-01",)], "calendarDate string")).first()
    assert r.quality_score == 0 and r.has_sleep is False and r.stress_awake_matches_allDayStress_AWAKE is None


def test_sanitise(spark):
    row = [("2025-01-01", 1, "a" * 32, 5, 6, "1", "x", "01234567-89ab-cdef-0123-456789abcdef")]
    df = spark.createDataFrame(row, "calendarDate string, totalSteps int, uuid string, userProfilePK int, allDayStress_userProfilePK int, version string, source string, someGuidLike string")
    out, report = sanitize.sanitize(df)
    assert out.columns == [KEY, "totalSteps"] and report["rules_applied"][:2] == ["drop_sensitive_columns_by_name", "drop_guid_like_value_columns"]
    assert "source" in sanitize.sanitize(df, keep=["source", "uuid"])[0].columns and "uuid" not in sanitize.sanitize(df, keep=["source", "uuid"])[0].columns
    allowed = sanitize.sanitize(df, allow_identifiers=True)[0].columns
    assert {"uuid", "userProfilePK"} <= set(allowed) and "source" not in allowed
    both = sanitize.sanitize(df, keep=["source"], drop=["source", KEY])[0].columns
    assert "source" not in both and both[0] == KEY
    levels = spark.createDataFrame([("d", -2.0, -1.0, 12.5, -10), ("d", 18.0, 35.0, -3.0, 0), ("d", 42.0, 55.0, 52.2, 5), ("d", 101.0, 70.0, 200.0, 12)], "calendarDate string, allDayStress_ASLEEP_averageStressLevel double, allDayStress_AWAKE_averageStressLevelIntensity double, avgSleepStress double, bodyBatteryNetBalance int")
    out, counts = sanitize.null_stress_levels(levels)
    assert counts == {"allDayStress_ASLEEP_averageStressLevel": 2, "allDayStress_AWAKE_averageStressLevelIntensity": 1, "avgSleepStress": 2}
    assert [r.bodyBatteryNetBalance for r in out.collect()] == [-10, 0, 5, 12]


def test_dictionary(spark):
    df = spark.createDataFrame([("2025-01-01", 1000, 0, 5, 1685138400000, "2025-01-01T00:00:00.0"), ("2025-01-02", 2000, 100, 5, 1685138400000, None), ("2025-01-03", None, None, None, None, None)], "calendarDate string, totalDistanceMeters long, stepsMaybeZero long, constantMetric long, restingHeartRateTimestamp long, wellnessStartTimeGmt string")
    d = {r.column: r for r in dictionary.build_dictionary(df).collect()}
    m = d["totalDistanceMeters"]
    assert (round(m.non_null_pct, 2), m.min, m.p05, m.p25, m.p75, m.p95, m.max, m.inferred_unit, m.zero_pct) == (66.67, 1000, 1050, 1250, 1750, 1950, 2000, "Meters", 0)
    assert (m.first_non_null_date, m.last_non_null_date, m.coverage_span_days, m.coverage_within_span_pct) == (dt.date(2025, 1, 1), dt.date(2025, 1, 2), 2, 100.0)
    assert d["stepsMaybeZero"].zero_pct == 50 and d["constantMetric"].is_constant and d["restingHeartRateTimestamp"].inferred_unit == "ms" and d["wellnessStartTimeGmt"].inferred_unit == "datetime"
    assert m.example_values == '["1000", "2000"]' and len(dictionary.build_dictionary(df).columns) == 30
    for name, unit in {"deepSleepSeconds": "Seconds", "averageSPO2": "percent", "durationInMilliseconds": "Milliseconds", "hydration_valueInML": "mL", "respiration_avgWakingRespirationValue": "brpm", "spo2SleepAverageHR": "bpm", "respiration_algorithmVersion": ""}.items():
        assert dictionary.unit_of(name, {"max": 5.0, "min": 1.0, "iso": False}) == unit
    assert dictionary.build_dictionary(spark.createDataFrame([(1,)], "a int")).first().first_non_null_date is None


def test_slices_and_features(spark):
    q = spark.createDataFrame([(f"2025-01-0{i + 1}", v, c, s) for i, (v, c, s) in enumerate([(True, False, True), (True, True, False), (False, False, True)])], "calendarDate string, valid_day_strict boolean, corrupted_stress_only_day boolean, has_sleep boolean")
    d = spark.createDataFrame([(f"2025-01-0{i}", i) for i in (1, 2, 3)], "calendarDate string, totalSteps int")
    cut = features.analysis_slices(d, q)
    assert [cut[k].count() for k in ("df_all", "df_strict", "df_sleep")] == [3, 1, 2]
    one = spark.createDataFrame([("2025-01-01", 7200, 3600, 4000, 3000, 1800, 80, 30, 3600, 7200, 1800, 600, 97, 92, 10)], "calendarDate string, stressTotalDurationSeconds int, stressAwakeDurationSeconds int, totalSteps int, totalDistanceMeters int, activeSeconds int, bodyBatteryStartOfDay int, bodyBatteryEndOfDay int, deepSleepSeconds int, lightSleepSeconds int, remSleepSeconds int, awakeSleepSeconds int, latestSpo2Value int, lowestSpo2Value int, allDayStress_TOTAL_restDuration int")
    r = features.derived_features(one).first()
    assert (r.stress_hours, r.awake_stress_hours, r.steps_k, r.distance_km, r.active_hours, r.bb_delta, r.sleep_total_seconds, r.spo2_gap, r.stress_total_rest_s) == (2.0, 1.0, 4.0, 3.0, 0.5, -50, 13200, 5, 10)
    assert r.sleep_efficiency == pytest.approx(12600 / 13200)
    with pytest.raises(ValueError, match="duplicate calendarDate"):
        features.load_days(d.union(d), "daily")


def test_modeling_frame(spark):
    parts = {"low": 7200, "medium": 3600, "high": 1800, "rest": 14400, "activity": 1800, "uncategorized": 3600, "total": 32400}
    schema = "calendarDate string, " + ", ".join(f"allDayStress_AWAKE_{p}Duration int" for p in parts) + ", bodyBattery_chargedValue int, bodyBattery_drainedValue int, sleepStartTimestampGMT long, sleepEndTimestampGMT long, wellnessStartTimeGmt string, wellnessStartTimeLocal string"
    r = features.modeling_features(spark.createDataFrame([("2025-01-01", *parts.values(), 52, 40, 1735776000, 1735804800, "2025-01-01T00:00:00.0", "2025-01-01T02:00:00.0")], schema)).first()
    assert (r.awakeLowStressHours, r.awakeHighStressHours, r.bodyBatteryNetBalance, r.sleep_opportunity_hours, r.sleep_start_hour_local) == (2.0, 0.5, 12, 8.0, 2.0) and r.awakeRestShare == pytest.approx(4 / 9)
    days = spark.createDataFrame([(f"2025-01-0{i + 1}", v, 80 + i, 90 + i, 12.5, True, False, True) for i, v in enumerate([72, 81, 65])], "calendarDate string, sleepRecoveryScore int, sleepOverallScore int, sleepQualityScore int, avgSleepStress double, valid_day_strict boolean, corrupted_stress_only_day boolean, has_sleep boolean")
    rows = features.recovery_frame(days.drop("valid_day_strict", "corrupted_stress_only_day", "has_sleep"), days.select(KEY, "valid_day_strict", "corrupted_stress_only_day", "has_sleep")).orderBy(KEY).collect()
    assert [r.target_sleepRecoveryScore_next_night for r in rows] == [81, 65, None] and [r.target_low_recovery_next_night for r in rows] == [0, 1, None]
    s = spark.createDataFrame([(10,), (20,), (30,), (None,)], "score int")
    assert [r.t for r in features.threshold_target(s, "score", "t", 20, "lt").collect()] == [1, 0, 0, None]
    assert [r.t for r in features.threshold_target(s, "score", "t", 20, "ge").collect()] == [0, 1, 1, None]
    four = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "v int")
    out, cutoff = features.quantile_target(four, "v", "t", 0.75)
    assert cutoff == 32.5 and [r.t for r in out.collect()] == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        features.threshold_target(s, "score", "t", 1, "eq")
    assert [r.sleep_onset_weekday_name for r in features.sleep_onset(spark.createDataFrame([("2025-01-06",), ("2025-01-07",)], "calendarDate string")).collect()] == ["Sunday", "Monday"]


def test_mart_counts_and_variants(spark):
    day = dt.date(2025, 1, 1)
    n = 14
    daily = spark.createDataFrame([(str(day + dt.timedelta(i)), 3000 + 400 * i, 42 + 3 * (i % 7), 120 + 4 * (i % 5), 25 + i % 6) for i in range(n)], "calendarDate string, totalSteps int, awakeAverageStressLevel int, maxHeartRate int, bodyBatteryLowest int")
    sleep = spark.createDataFrame([(str(day + dt.timedelta(i + 1)), 70 + i % 8, 72 + i % 7, 12 + i % 5, 1735776000 + 86400 * i, 1735804800 + 86400 * i) for i in range(n)], "calendarDate string, sleepRecoveryScore int, sleepOverallScore int, avgSleepStress int, sleepStartTimestampGMT long, sleepEndTimestampGMT long")
    q = spark.createDataFrame([(str(day + dt.timedelta(i)), ["good", "good", "partial", "good", "bad", "good", "good"][i % 7], i % 5 != 4, i % 11 == 0) for i in range(n)], "calendarDate string, day_quality_label_strict string, valid_day_strict boolean, corrupted_stress_only_day boolean")
    counts = mart.build_mart(spark, daily, sleep, q)
    assert [counts[k] for k in ("fact_daily", "fact_sleep", "fact_quality", "vw_day_to_next_sleep")] == [n] * 4
    r = spark.table("vw_day_to_next_sleep").orderBy("day_date").first()
    assert (str(r.day_date), str(r.next_sleep_date), r.nextsleep_recovery_score) == ("2025-01-01", "2025-01-02", 70.0)
    assert all(len(df.columns) and df.collect() is not None for df in mart.run_pack(mart.build_facts(daily, sleep, q)).values())
    alone = mart.build_facts(daily.withColumnRenamed("awakeAverageStressLevel", "allDayStress_AWAKE_averageStressLevel"))
    assert all(df.collect() is not None for df in mart.run_pack(alone).values())
    assert mart.day_to_next_sleep(*alone.values()).where("day_awake_average_stress is not null").count() == n


def test_series(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, d), v) for d, v in ((1, 1.0), (2, 2.0), (4, 3.0), (9, 4.0))], "calendarDate date, v double")
    filled = explore.gap_series(df, ["v"]).orderBy(KEY).collect()
    assert len(filled) == 9 and [r.v_mean7 for r in filled][:4] == [None, None, None, 2.0] and filled[-1].v_mean7 is None
    h = explore.histogram(df, "v", bins=3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 2]
    assert explore.epoch_unit(df.withColumn("v", F.lit(1.7e12)), "v") == "ms"


def grouped(spark, **groups):
    return spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")


def test_statistics(spark):
    df = grouped(spark, x=[5, 6, 7], y=[1, 2, 3])
    r = stats.mann_whitney(df, "v", "g", "x", "y", "greater")
    assert (r["u"], r["cliffs_delta"], r["p"]) == (9.0, 1.0, pytest.approx(0.05))
    a, b = [10, 11, 12, 13, 11], [1, 2, 3, 2, 1]
    df = grouped(spark, x=a, y=b)
    m = stats.mann_whitney(df, "v", "g", "x", "y")
    assert m["median_difference"] == 9 and m["p"] < 0.1
    boot = stats.bootstrap_median_difference(df, "v", "g", "x", "y", n_boot=200)
    assert 0 < boot["low"] <= 9 <= boot["high"]
    pairs = spark.createDataFrame([(float(i), float(i * 10)) for i in range(1, 6)], "x double, y double")
    assert stats.spearman(pairs, "x", "y")["rho"] > 0.99 and stats.spearman(pairs.withColumn("y", -F.col("y")), "x", "y")["rho"] < -0.99
    assert stats.bootstrap_spearman(pairs.withColumn("y", -F.col("y")), "x", "y", n_boot=100)["high"] < 0
    k = stats.kruskal(grouped(spark, a=[1, 2, 3], b=[4, 5, 6], c=[7, 8, 9]), "v", "g")
    assert k["h"] == pytest.approx(7.2) and k["p"] == pytest.approx(0.02732, abs=1e-4) and k["groups"]["b"]["median"] == 5
    x, y = [1, 2, 2, 3, 3, 3, 4, 5, 6], [2, 3, 4, 4, 5, 6, 7, 8, 9]
    tied = stats.mann_whitney(grouped(spark, x=x, y=y), "v", "g", "x", "y")
    assert tied["u"] == sum((p > q) + 0.5 * (p == q) for p in x for q in y) and 0.04 < tied["p"] < 0.07
    assert stats.cliffs_delta(df, "v", "g", "x", "none") is None
    with pytest.raises(ValueError):
        stats.kruskal(grouped(spark, a=[1]), "v", "g")


def test_special_functions():
    assert special.t_sf(2.0, 10) == pytest.approx(0.03669401738537018, abs=1e-12) and special.t_sf(-2.0, 10) == pytest.approx(0.9633059826146299, abs=1e-12)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12) and special.chi2_sf(20, 5) == pytest.approx(0.0012497305630313, abs=1e-12)
    assert special.normal_sf(1.959963984540054) == pytest.approx(0.025) and special.mann_whitney_exact_sf(0, 3, 4) == 1.0
    brute = [sum(x > y for x in a for y in set(range(6)) - set(a)) for a in __import__("itertools").combinations(range(6), 2)]
    assert all(special.mann_whitney_exact_sf(u, 2, 4) == pytest.approx(np.mean(np.array(brute) >= u)) for u in range(9))


def test_models(spark):
    day = dt.date(2025, 1, 1)
    rows = [(day + dt.timedelta(i), 4000 + 300 * i, 58 - i % 4, i - 12, ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"][i % 5], int(i % 3 == 0), 58.0 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "calendarDate date, totalSteps int, restingHeartRate int, bodyBatteryNetBalance int, weekday_name string, target int, score double")
    split = modeling.TimeSplit(0.5, 0.25)
    assert {r.split: r["count"] for r in modeling.time_split(df, split).groupBy("split").count().collect()} == {"train": 10, "valid": 5, "test": 5}
    with pytest.raises(ValueError):
        modeling.split_sizes(2, split)
    names = ["totalSteps", "restingHeartRate", "weekday_name"]
    out = modeling.evaluate_classifiers(df, names, "target", ["dummy", "logistic"], split, tune="balanced_accuracy")
    assert len(out) == 6 and {r["n"] for r in out} == {10, 5}
    model = modeling.fit(df, names, "target", "logistic")
    assert len(modeling.importance(model, 3)) == 3 and len(modeling.permutation_importance(model, df, "target", repeats=1)) == 3
    reg = modeling.evaluate_regressors(df, ["totalSteps"], "score", ["dummy_median", "ridge"], split)
    assert [r["mae"] for r in reg if r["model"] == "ridge" and r["split"] == "train"][0] < 1
    steps = modeling.forward_select(df, ["totalSteps", "restingHeartRate"], "target", split=split, most=1)
    assert len(steps) == 1 and steps[0]["feature"] in ("totalSteps", "restingHeartRate")
    with pytest.raises(KeyError):
        modeling.fit(df, names, "target", "nonsense")
    s = spark.createDataFrame([(0, 0.1), (0, 0.7), (1, 0.6), (1, 0.9)], "y int, s double")
    c = modeling.confusion(s, "y", "s").first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1, 1, 0, 2)
    r = modeling.ranking_metrics(s, "y", "s").first()
    assert r.roc_auc == 0.75 and r.average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert modeling.tune_threshold(s, "y", "s")[0] == 0.5
