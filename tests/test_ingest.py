import json

import pytest

from dayloom.functions.exprs import KEY
from dayloom.sources import ingest as g

UDS = [{"calendarDate": "2025-01-15", "totalSteps": 12345, "totalDistanceMeters": 8900, "activeKilocalories": 650, "bmrKilocalories": 1700, "totalKilocalories": 2350, "restingHeartRate": 52, "minHeartRate": 45, "maxHeartRate": 165, "bodyBattery": {"startOfDay": 78, "endOfDay": 32, "lowest": 25, "highest": 85}, "stressSummary": {"awakeDuration": 3600, "sleepDuration": 21600, "totalDuration": 25200}}]
SLEEP = {"calendarDate": "2025-01-15", "sleepStartTimestampGMT": 1736899200, "sleepEndTimestampGMT": 1736928000, "deepSleepSeconds": 7200, "lightSleepSeconds": 14400, "awakeSleepSeconds": 1200, "unmeasurableSeconds": 600, "averageRespiration": 12.3, "lowestRespiration": 9.8, "highestRespiration": 16.4, "avgSleepStress": 18, "sleepScores": {"overallScore": 82}}


def write(folder, name, payload):
    (folder / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))
    return str(folder)


def test_activity_core(spark, tmp_path):
    out = g.ingest_activity(spark, write(tmp_path, "UDSFile_1.json", UDS))
    assert set(g.CORE) | set(g.DERIVED) <= set(out.columns) and out.columns[0] == KEY
    r = out.first()
    assert (r.totalSteps, r.bodyBatteryStartOfDay, r.bodyBatteryEndOfDay, r.bodyBatteryLowest, r.bodyBatteryHighest) == (12345, 78, 32, 25, 85)
    assert (r.stressAwakeDurationSeconds, r.stressAsleepDurationSeconds, r.stressTotalDurationSeconds) == (3600, 21600, 25200)


def test_activity_variants(spark, tmp_path):
    listed = {"calendarDateStr": "2025-01-16", "flag": True, "totalDistance": 7, "bodyBattery": {"chargedValue": 5, "bodyBatteryStatList": [{"bodyBatteryStatType": "STARTOFDAY", "statsValue": None}, {"bodyBatteryStatType": "STARTOFDAY", "statsValue": 61, "note": "x"}, {"bodyBatteryStatType": "LOWEST", "statsValue": 9}]}, "allDayStress": {"version": 2, "aggregatorList": [{"type": "AWAKE", "totalDuration": 100, "nested": {"a": 1}}, {"type": "TOTAL", "totalDuration": 300, "averageStressLevel": 33.5}, "junk"]}, "stress": {}}
    write(tmp_path, "UDSFile_1.json", {"dailySummaries": [listed, 5, {"calendarDate": "nonsense", "totalSteps": 1}]})
    write(tmp_path, "UDSFile_2.json", {"calendarDate": "2025-01-17", "totalSteps": 10})
    write(tmp_path, "UDSFile_3.json", [{"calendarDate": "2025-01-17", "totalSteps": 20}])
    write(tmp_path, "UDSFile_4.json", "no json")
    rows = {str(r[KEY]): r for r in g.ingest_activity(spark, str(tmp_path)).collect()}
    assert set(rows) == {"2025-01-16", "2025-01-17"} and rows["2025-01-17"].totalSteps == 20
    r = rows["2025-01-16"]
    assert (r.bodyBatteryStartOfDay, r.bodyBatteryLowest, r.bodyBattery_chargedValue, r.bodyBatteryStat_STARTOFDAY, r.bodyBatteryStat_STARTOFDAY_note) == (61, 9, 5, 61, "x")
    assert (r.stressAwakeDurationSeconds, r.stressTotalDurationSeconds, r.allDayStress_TOTAL_averageStressLevel, r.flag, r.totalDistanceMeters) == (100, 300, 33.5, True, 7)


def test_numeric_share(spark, tmp_path):
    rows = [{"calendarDate": f"2025-01-{i + 1:02d}", "most": "x" if i == 0 else i, "few": "x" if i < 3 else i, "none": None} for i in range(25)]
    out = g.ingest_activity(spark, write(tmp_path, "UDSFile_1.json", rows))
    kinds = dict(out.dtypes)
    assert kinds["most"] == "bigint" and kinds["few"] == "string" and kinds["none"] == "string"
    assert out.where("most is null").count() == 1


def test_sleep(spark, tmp_path):
    other = SLEEP | {"calendarDate": "2025-01-16", "sleepStartTimestampGMT": "2025-01-15T23:00:00.0", "awakeCount": 1.5, "retro": False}
    write(tmp_path, "a_sleepData.json", [SLEEP])
    write(tmp_path, "b_sleepData.json", {"dailySleep": [other]})
    out = g.ingest_sleep(spark, str(tmp_path))
    rows = {str(r[KEY]): r for r in out.collect()}
    assert len(out.columns) == 35 and rows["2025-01-15"].sleepOverallScore == 82 and rows["2025-01-15"].averageRespiration == 12.3
    r = rows["2025-01-16"]
    assert (r.sleepStartTimestampGMT, r.awakeCount, r.retro) == (1736982000, None, False)


def test_build_daily(spark):
    a = spark.createDataFrame([(f"2025-01-0{i}", i * 1000) for i in (1, 2, 3)], "calendarDate string, totalSteps long")
    s = spark.createDataFrame([("2025-01-01", 80, 1), ("2025-01-03", 75, 2)], "calendarDate string, sleepOverallScore long, totalSteps int")
    rows = {str(r[KEY]): r for r in g.build_daily(a, s).collect()}
    assert len(rows) == 3 and rows["2025-01-02"].sleepOverallScore is None and rows["2025-01-03"].totalSteps_sleep == 2
    with pytest.raises(ValueError, match="duplicate calendarDate"):
        g.build_daily(a.union(a.limit(1)), s)
    with pytest.raises(ValueError, match="invalid"):
        g.build_daily(a, spark.createDataFrame([("x", 1)], "calendarDate string, sleepOverallScore int"))


def test_inspect_and_scrub(spark, tmp_path):
    write(tmp_path, "UDSFile_1.json", [{"calendarDate": "2025-01-15", "uuid": "a,b", "n": {"deviceId": 5, "k": 1}}, {"calendarDate": "2025-01-16"}])
    recs = g.records(g.read_documents(spark, str(tmp_path), g.ACTIVITY_FILES), g.ACTIVITY_LISTS, True)
    assert {(r.key, r["count"], r.pct) for r in g.inspect_schema(recs).collect()} == {("calendarDate", 2, 100.0), ("uuid", 1, 50.0), ("n", 1, 50.0), ("n.deviceId", 1, 50.0), ("n.k", 1, 50.0)}
    assert [json.loads(r.json) for r in g.scrubbed(recs).orderBy("pos").collect()][0] == {"calendarDate": "2025-01-15", "n": {"k": 1}}
    assert [(r.type, r.size_bytes > 0) for r in g.inventory(spark, str(tmp_path)).collect()] == [("activity", True)]


def test_demo_and_fallback(spark):
    df = spark.createDataFrame([("2025-01-06", "12", "2025-01-05T23:00:00Z"), ("2025-01-09", "", None)], "calendarDate string, totalSteps string, sleepStartTimestampGMT string")
    rows = g.normalise_demo(df).orderBy(KEY).collect()
    assert (rows[0].totalSteps, rows[0].sleepStartTimestampGMT, rows[1].totalSteps) == (12.0, 1736118000, None)
    raw, clean = df, df.withColumn("sleepStartTimestampGMT", g.F.lit(None).cast("string"))
    assert g.pick_sanitised(clean, raw) is raw and g.pick_sanitised(raw, clean) is raw


def test_inspect_lists_and_demo_writer(spark, tmp_path):
    write(tmp_path, "UDSFile_1.json", [{"calendarDate": "2025-01-15", "l": [{"a": 1}, {"a": 2}, 3, {"b": "x"}]}, {"calendarDate": "2025-01-16", "l": []}])
    recs = g.records(g.read_documents(spark, str(tmp_path), g.ACTIVITY_FILES), g.ACTIVITY_LISTS, True)
    assert {(r.key, r.kind, r["count"]) for r in g.inspect_schema(recs).collect()} == {("calendarDate", "STRING", 2), ("l", "ARRAY", 2), ("l[].a", "BIGINT", 1), ("l[].b", "STRING", 1)}
    (tmp_path / "demo.csv").write_text("calendarDate,totalSteps,sleepStartTimestampGMT\n2025-01-06,12,2025-01-05T23:00:00Z\n2025-01-07,x,\n")
    rows = g.write_demo(spark, str(tmp_path / "demo.csv"), str(tmp_path / "demo.parquet")).orderBy(KEY).collect()
    assert [(r.totalSteps, r.sleepStartTimestampGMT) for r in rows] == [(12.0, 1736118000), (None, None)]
    assert g.numeric_share(spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "v string"), "v") == (pytest.approx(2 / 3), False)
