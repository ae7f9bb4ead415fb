"""Raw JSON exports to day tables. Documents become VARIANT values, records are exploded, flattened
to (name, value) rows and typed; nothing but the list of column names and types reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from dayloom.functions.exprs import KEY, as_date
from dayloom.operators.features import keep_one_per_day, require_unique_days

# Fixed values of the export format
ACTIVITY_FILES, SLEEP_FILES = "UDSFile_*.json", "*_sleepData.json"
ACTIVITY_FOLDER, SLEEP_FOLDER = "DI-Connect-Aggregator", "DI-Connect-Wellness"
ACTIVITY_LISTS, SLEEP_LISTS = ("dailySummaries", "entries", "summaries", "records"), ("sleepData", "dailySleep", "sleep")
CORE = (KEY, "totalSteps", "totalDistanceMeters", "activeKilocalories", "bmrKilocalories", "totalKilocalories", "restingHeartRate", "minHeartRate", "maxHeartRate")
DERIVED = ("bodyBatteryStartOfDay", "bodyBatteryEndOfDay", "bodyBatteryLowest", "bodyBatteryHighest", "stressAwakeDurationSeconds", "stressAsleepDurationSeconds", "stressTotalDurationSeconds")
BATTERY_NAMES = ("bodyBattery", "bodyBatteryValues", "bodyBatterySummary", "bodyBatteryStats")
BATTERY = {"bodyBatteryStartOfDay": (("startOfDay", "bodyBatteryStartOfDay", "start"), "STARTOFDAY"), "bodyBatteryEndOfDay": (("endOfDay", "bodyBatteryEndOfDay", "end"), "ENDOFDAY"), "bodyBatteryLowest": (("lowest", "bodyBatteryLowest", "low"), "LOWEST"), "bodyBatteryHighest": (("highest", "bodyBatteryHighest", "high"), "HIGHEST")}
STRESS_NAMES = ("stressSummary", "stress", "stressSummaryDto", "stressSummaryData")
STRESS = {
    "stressAwakeDurationSeconds": (("awakeDuration", "awakeStressDuration", "awakeStressDurationSeconds", "awakeStressDurationInSeconds"), "AWAKE"),
    "stressAsleepDurationSeconds": (("sleepDuration", "asleepDuration", "asleepStressDuration", "sleepStressDuration", "sleepStressDurationSeconds", "sleepStressDurationInSeconds"), "ASLEEP"),
    "stressTotalDurationSeconds": (("totalDuration", "totalStressDuration", "totalStressDurationSeconds", "totalStressDurationInSeconds"), "TOTAL"),
}
SLEEP_PLAIN = ("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds", "unmeasurableSeconds", "averageRespiration", "lowestRespiration", "highestRespiration", "avgSleepStress", "awakeCount", "restlessMomentCount", "retro", "sleepWindowConfirmationType")
SLEEP_SPO2 = {"spo2SleepMeasurementStartTimestampGMT": "sleepMeasurementStartGMT", "spo2SleepMeasurementEndTimestampGMT": "sleepMeasurementEndGMT", "spo2SleepAverageSPO2": "averageSPO2", "spo2SleepAverageHR": "averageHR", "spo2SleepLowestSPO2": "lowestSPO2"}
SLEEP_SCORES = {
    "sleepOverallScore": ("overallScore", "score", "overall"), "sleepQualityScore": ("qualityScore",), "sleepDurationScore": ("durationScore",), "sleepRecoveryScore": ("recoveryScore",), "sleepDeepScore": ("deepScore",), "sleepRemScore": ("remScore",),
    "sleepLightScore": ("lightScore",), "sleepAwakeningsCountScore": ("awakeningsCountScore",), "sleepAwakeTimeScore": ("awakeTimeScore",), "sleepCombinedAwakeScore": ("combinedAwakeScore",), "sleepRestfulnessScore": ("restfulnessScore",),
    "sleepInterruptionsScore": ("interruptionsScore",), "sleepFeedback": ("feedback",), "sleepInsight": ("insight",),
}
SLEEP_FLOATS = ("averageRespiration", "lowestRespiration", "highestRespiration", "avgSleepStress", "spo2SleepAverageSPO2", "spo2SleepAverageHR")
SLEEP_TIMES = ("sleepStartTimestampGMT", "sleepEndTimestampGMT", "spo2SleepMeasurementStartTimestampGMT", "spo2SleepMeasurementEndTimestampGMT")
SLEEP_TEXTS = ("sleepWindowConfirmationType", "sleepFeedback", "sleepInsight")
NUMERIC_SHARE = 0.95
PARTS = "array<struct<name:string,value:string,tag:string>>"


def read_documents(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """One row a file: file, doc (null where the text is no JSON)."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder)
    return files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """type, path, size_bytes, modified_utc of the export's files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    kind = F.when(F.col("path").rlike(r"/UDSFile_[^/]*\.json$"), "activity").when(F.col("path").rlike(r"_sleepData\.json$"), "sleep")
    return files.select(kind.alias("type"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_utc")).where("type is not null").orderBy("type", "path")


def _tag(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return _tag(v).startswith("OBJECT")


def _is_list(v: Column) -> Column:
    return _tag(v).startswith("ARRAY")


def _is_scalar(v: Column) -> Column:
    return ~(_is_object(v) | _is_list(v))


def _at(v: Column, *names: str) -> Column:
    """First of the fields with a non-null scalar, as text."""
    return F.coalesce(*[F.when(_is_scalar(F.try_variant_get(v, f"$.{n}", "variant")), F.try_variant_get(v, f"$.{n}", "string")) for n in names])


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _first_true(v: Column, names: Sequence[str]) -> Column:
    """First field that holds anything: null, false, zero and empty values do not count."""
    return F.coalesce(*[F.when(~F.coalesce(F.to_json(_field(v, n)).isin("null", "{}", "[]", '""', "0", "0.0", "false"), F.lit(True)), _field(v, n)) for n in names])


def _items(v: Column) -> Column:
    """The objects of a list."""
    empty = F.expr("cast(array() as array<variant>)")
    return F.when(_is_list(v), F.filter(v.cast("array<variant>"), _is_object)).otherwise(empty)


def _pairs(v: Column) -> Column:
    empty = F.expr("cast(map() as map<string,variant>)")
    return F.map_entries(F.when(_is_object(v), v.cast("map<string,variant>")).otherwise(empty))


def _scalars(v: Column, prefix: Column | None, without: Sequence[str] = ()) -> Column:
    """Scalar fields as (name, value, tag)."""
    kept = F.filter(_pairs(v), lambda e: _is_scalar(e["value"]) & ~e["key"].isin(*without, "") if without else _is_scalar(e["value"]))
    name = lambda e: e["key"] if prefix is None else F.concat(prefix, F.lit("_"), e["key"])
    return F.transform(kept, lambda e: F.struct(name(e).alias("name"), e["value"].cast("string").alias("value"), _tag(e["value"]).alias("tag")))


def _listed(items: Column, type_name: str, prefix: str, without: Sequence[str]) -> Column:
    """Scalar fields of a list's objects, named by each object's type."""
    kind = lambda i: F.try_variant_get(i, f"$.{type_name}", "string")
    typed = F.filter(items, lambda i: (_tag(_field(i, type_name)) == "STRING") & (kind(i) != ""))
    return F.flatten(F.transform(typed, lambda i: _scalars(i, F.concat(F.lit(prefix + "_"), kind(i)), without)))


def records(documents: DataFrame, lists: Sequence[str], single: bool) -> DataFrame:
    """file, pos, rec: the records of a list, of a list under a known name, or the one record."""
    doc = F.col("doc")
    wrapped = F.coalesce(*[F.when(_is_list(_field(doc, n)), _field(doc, n)) for n in lists])
    alone = (_field(doc, KEY).isNotNull() | _field(doc, f"{KEY}Str").isNotNull()) if single else F.lit(False)
    as_list = F.when(_is_list(doc), doc.cast("array<variant>")).when(_is_object(doc) & alone, F.array(doc)).when(wrapped.isNotNull(), wrapped.cast("array<variant>"))
    return documents.select("file", F.posexplode(as_list).alias("pos", "rec")).where(_is_object(F.col("rec")))


def _day(rec: Column) -> Column:
    return F.coalesce(F.when(_at(rec, KEY) != "", _at(rec, KEY)), _at(rec, f"{KEY}Str"))


def activity_long(recs: DataFrame) -> DataFrame:
    """file, pos, day, name, value, tag: one row for each scalar of a record; later ones win."""
    rec = F.col("rec")
    one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"), F.when(value.isNull(), "VOID").otherwise("STRING").alias("tag"))
    battery, stress, all_day = _first_true(rec, BATTERY_NAMES), _first_true(rec, STRESS_NAMES), _field(rec, "allDayStress")
    stats, totals = _items(_field(battery, "bodyBatteryStatList")), _items(_field(all_day, "aggregatorList"))

    def from_list(items: Column, type_name: str, wanted: str, value: str) -> Column:
        found = F.transform(F.filter(items, lambda i: F.try_variant_get(i, f"$.{type_name}", "string") == wanted), lambda i: F.try_variant_get(i, f"$.{value}", "string"))
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    stat_value = F.filter(stats, lambda i: _is_scalar(_field(i, "statsValue")) & _field(i, "statsValue").isNotNull())
    derived = [one(n, F.coalesce(F.when(_is_object(battery), _at(battery, *simple)), from_list(stats, "bodyBatteryStatType", kind, "statsValue"))) for n, (simple, kind) in BATTERY.items()]
    derived += [one(n, F.coalesce(F.when(_is_object(stress), _at(stress, *simple)), from_list(totals, "type", kind, "totalDuration"))) for n, (simple, kind) in STRESS.items()]
    distance = F.when(F.try_variant_get(rec, "$.totalDistanceMeters", "variant").isNull(), _at(rec, "totalDistance"))
    parts = F.concat(
        F.filter(F.array(one("totalDistanceMeters", distance)), lambda p: p["value"].isNotNull()),
        _scalars(rec, None),
        *[_scalars(_field(rec, f), F.lit(f)) for f in ("hydration", "respiration", "stressSummary")],
        _scalars(all_day, F.lit("allDayStress")),
        _listed(totals, "type", "allDayStress", ("type",)),
        _scalars(battery, F.lit("bodyBattery")),
        F.transform(stat_value, lambda i: F.struct(F.concat(F.lit("bodyBatteryStat_"), F.try_variant_get(i, "$.bodyBatteryStatType", "string")).alias("name"), F.try_variant_get(i, "$.statsValue", "string").alias("value"), _tag(_field(i, "statsValue")).alias("tag"))),
        _listed(stats, "bodyBatteryStatType", "bodyBatteryStat", ("bodyBatteryStatType", "statsValue")),
        F.array(*derived),
    )
    rows = recs.select("file", "pos", as_date(_day(rec)).alias("day"), F.posexplode(parts.cast(PARTS)).alias("n", "p")).where("day is not null")
    rows = rows.where(F.col("p.name").isNotNull() & (F.col("p.name") != KEY))
    return rows.groupBy("file", "pos", "day", F.col("p.name").alias("name")).agg(F.max_by("p.value", "n").alias("value"), F.max_by("p.tag", "n").alias("tag"))


def column_types(long: DataFrame) -> dict[str, str]:
    """boolean if all values are; else number if 95 of 100 known values read as one (whole numbers
    as bigint); else text. One aggregate over all names."""
    number = F.col("value").try_cast("double")
    number = F.when(F.col("tag") != "BOOLEAN", number)
    known = F.col("value").isNotNull()
    rows = long.groupBy("name").agg(F.count_if(known).alias("n"), F.count_if(known & (F.col("tag") == "BOOLEAN")).alias("b"), F.count(number).alias("x"), F.count_if(number % 1 != 0).alias("f")).collect()
    return {r.name: "boolean" if r.n and r.b == r.n else ("double" if r.f else "bigint") if r.x and r.x >= NUMERIC_SHARE * r.n else "string" for r in rows}


def ordered(names: Sequence[str]) -> list[str]:
    first = [c for c in (*CORE, *DERIVED) if c in names]
    return first + sorted(set(names) - set(first))


def parse_activity(documents: DataFrame) -> DataFrame:
    """The day table: core and derived columns first, then every other scalar by name."""
    long = activity_long(records(documents, ACTIVITY_LISTS, single=True)).cache()
    types = {c: "string" for c in (*CORE, *DERIVED) if c != KEY} | column_types(long)
    names = [c for c in types]
    wide = long.groupBy("file", "pos", F.col("day").alias(KEY)).pivot("name", names).agg(F.first("value")) if names else long
    typed = wide.select("file", "pos", KEY, *[(F.col(c).try_cast("double").cast("bigint") if k == "bigint" else F.col(c).try_cast(k)).alias(c) for c, k in types.items()])
    one = keep_one_per_day(typed, [F.desc("file"), F.desc("pos")])
    return one.select(*ordered([KEY, *names]))


def _whole(v: Column) -> Column:
    d = v.try_cast("double")
    return F.when(d % 1 == 0, d.cast("bigint"))


def _epoch(v: Column) -> Column:
    """Whole seconds, or an ISO time read as UTC (fractions are cut)."""
    return F.coalesce(_whole(v), F.when(v.try_cast("double").isNull(), F.unix_seconds(F.try_to_timestamp(v))))


def parse_sleep(documents: DataFrame) -> DataFrame:
    """The fixed table of nights, keyed by the wake-up date."""
    rec = F.col("rec")
    recs = records(documents, SLEEP_LISTS, single=False)
    scores, spo2 = _field(rec, "sleepScores"), _field(rec, "spo2SleepSummary")
    raw = {"sleepStartTimestampGMT": _at(rec, "sleepStartTimestampGMT"), "sleepEndTimestampGMT": _at(rec, "sleepEndTimestampGMT")}
    raw |= {c: _at(rec, c) for c in SLEEP_PLAIN} | {c: F.when(_is_object(spo2), _at(spo2, n)) for c, n in SLEEP_SPO2.items()} | {c: F.when(_is_object(scores), _at(scores, *n)) for c, n in SLEEP_SCORES.items()}

    def typed(c: str, v: Column) -> Column:
        if c in SLEEP_TIMES:
            return _epoch(v)
        if c in SLEEP_FLOATS:
            return v.try_cast("double")
        return v if c in SLEEP_TEXTS else v.try_cast("boolean") if c == "retro" else _whole(v)

    rows = recs.select("file", "pos", as_date(_day(rec)).alias(KEY), *[v.alias(c) for c, v in raw.items()]).dropna(subset=[KEY])
    rows = rows.select("file", "pos", KEY, *[typed(c, F.col(c)).alias(c) for c in raw])
    return keep_one_per_day(rows, [F.desc("file"), F.desc("pos")]).drop("file", "pos")


def ingest_activity(spark: SparkSession, folder: str) -> DataFrame:
    return parse_activity(read_documents(spark, folder, ACTIVITY_FILES))


def ingest_sleep(spark: SparkSession, folder: str) -> DataFrame:
    return parse_sleep(read_documents(spark, folder, SLEEP_FILES))


def build_daily(activity: DataFrame, sleep: DataFrame) -> DataFrame:
    """Activity with its night; every day valid and unique on both sides, else an error."""
    sides = []
    for name, df in (("activity", activity), ("sleep", sleep)):
        typed = df.withColumn(KEY, as_date(KEY))
        bad = typed.where(F.col(KEY).isNull()).limit(1).count()
        if bad:
            raise ValueError(f"{name}: invalid {KEY}")
        sides.append(require_unique_days(typed, name))
    left, right = sides
    clash = {c: f"{c}_sleep" for c in right.columns if c in left.columns and c != KEY}
    return left.join(right.withColumnsRenamed(clash), KEY, "left")


def pick_sanitised(sanitised: DataFrame | None, raw: DataFrame | None) -> DataFrame:
    """The sanitised table, unless it lost the sleep times that the raw one has."""
    if sanitised is None or raw is None:
        found = sanitised if sanitised is not None else raw
        if found is None:
            raise FileNotFoundError("neither a sanitised nor a raw table")
        return found
    known = lambda df: df.agg(*[F.count(c) for c in SLEEP_TIMES[:2] if c in df.columns] or [F.lit(0)]).first()
    return raw if not any(known(sanitised)) and any(known(raw)) else sanitised


def numeric_share(df: DataFrame, column: str, least: float = 0.8) -> tuple[float, bool]:
    """Share of the known values that read as a number, and whether it is enough to take them all so."""
    v = F.col(column).cast("string")
    share = df.agg(F.count(v.try_cast("double")) / F.nullif(F.count(v), F.lit(0))).first()[0] or 0.0
    return share, share >= least


def write_demo(spark: SparkSession, csv: str, out: str) -> DataFrame:
    """The demo CSV as a typed Parquet table, a row a day in order."""
    table = require_unique_days(normalise_demo(spark.read.option("header", True).csv(csv)), "demo")
    table.sortWithinPartitions(KEY).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def normalise_demo(df: DataFrame) -> DataFrame:
    """The demo CSV: a date, two ISO times to epoch seconds, everything else numbers."""
    kinds = {KEY: as_date(KEY)} | {c: _epoch(F.col(c).cast("string")) for c in SLEEP_TIMES[:2] if c in df.columns}
    return df.select(*[(kinds[c] if c in kinds else F.col(c).try_cast("double")).alias(c) for c in df.columns])


def inspect_schema(recs: DataFrame) -> DataFrame:
    """Keys of records: in how many they occur, their share, and the kinds of value seen. Keys of nested
    objects are ``outer.inner``, those of objects in lists ``outer[].inner`` (once a record each)."""
    kind = lambda v: F.regexp_extract(_tag(v), "^[A-Z]+", 0)
    said = lambda path, v: F.struct(path.alias("key"), kind(v).alias("kind"))
    inner = lambda e: F.transform(_pairs(e["value"]), lambda x: said(F.concat(e["key"], F.lit("."), x["key"]), x["value"]))
    listed = lambda e: F.flatten(F.transform(_items(e["value"]), lambda i: F.transform(_pairs(i), lambda x: said(F.concat(e["key"], F.lit("[]."), x["key"]), x["value"]))))
    own = F.transform(_pairs(F.col("rec")), lambda e: F.concat(F.array(said(e["key"], e["value"])), inner(e), listed(e)))
    keys = F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("kind"))), F.array_distinct(F.flatten(own)))
    counts = recs.select(F.explode(keys).alias("e")).groupBy("e.key", "e.kind").agg(F.count("*").alias("count"))
    total = counts.where("key = ''").select(F.col("count").alias("records"))
    return counts.where("key <> ''").join(F.broadcast(total)).select("key", "kind", "count", F.round(F.col("count") * F.lit(100.0).cast("double") / F.col("records"), 2).alias("pct")).orderBy("key", "kind")  # total: one row


def scrubbed(recs: DataFrame, private: Sequence[str] = ("userProfilePK", "userProfilePk", "uuid", "deviceId")) -> DataFrame:
    """Records as JSON text without identifier fields, at whatever depth they are."""
    names = "|".join(private)
    text = F.to_json("rec")
    for pattern in (rf'"(?:{names})":(?:"(?:[^"\\]|\\.)*+"|[^,{{}}\[\]"]++),', rf',?"(?:{names})":(?:"(?:[^"\\]|\\.)*+"|[^,{{}}\[\]"]++)'):
        text = F.regexp_replace(text, pattern, "")
    return recs.select("file", "pos", text.alias("json"))
