import json

from dayloom import cli
from dayloom.functions.exprs import KEY
from dayloom.sources import sinks
from dayloom.streaming import incremental
from test_ingest import SLEEP, UDS


def test_commands_end_to_end(spark, tmp_path, capsys):
    export, data, out = tmp_path / "export", tmp_path / "data", tmp_path / "reports"
    export.mkdir()
    (export / "UDSFile_1.json").write_text(json.dumps([UDS[0] | {"uuid": "x"}, UDS[0] | {"calendarDate": "2025-01-16"}]))
    (export / "a_sleepData.json").write_text(json.dumps([SLEEP]))
    go = lambda *args: cli.main(["--data", str(data), *args])
    assert go("build-daily") == 1
    for command in ("discover", "ingest-activity", "ingest-sleep"):
        assert go(command, str(export)) == 0
    assert go("build-daily") == go("sanitize") == 0
    assert json.loads((data / "sanitize_report.json").read_text())["dropped_columns"] == ["uuid"]
    assert go("data-dictionary", "--out-dir", str(out)) == go("quality", "--out-dir", str(out)) == 0
    assert "## Strict labels" in (out / "quality_summary.md").read_text() and "## All columns" in (out / "data_dictionary.md").read_text()
    assert go("build-sql-mart") == go("run-sql-portfolio", "--out-dir", str(out / "sql")) == 0
    assert go("build-sql-mart") == 1 and go("build-sql-mart", "--overwrite", "--db-path", str(tmp_path / "m"), "--daily", str(data / "daily")) == 0
    assert go("run-sql-portfolio", "--db-path", str(tmp_path / "none")) == 1 and spark.read.parquet(str(tmp_path / "m" / "fact_daily")).count() == 2
    assert go("sanitize", "--inplace") == 0 and "uuid" not in spark.read.parquet(str(data / "daily")).columns and not (data / "daily_new").exists()
    assert go("quality", "--out-dir", str(out), "--output-parquet", str(tmp_path / "labelled")) == 0 and spark.read.parquet(str(tmp_path / "labelled")).count() == 2
    queries = tmp_path / "q"
    queries.mkdir()
    (queries / "a.sql").write_text("SELECT COUNT(*) AS n FROM vw_day_to_next_sleep;")
    assert go("run-sql-portfolio", "--query-dir", str(queries), "--out-dir", str(out / "sql2")) == 0 and "(1, 1)" in capsys.readouterr().out
    assert go("ingest-sleep", str(queries)) == 1
    assert sinks.relational_extract(spark.read.parquet(str(data / "daily")), "daily").count() == 2


def test_incremental(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "t", "c"))
    (tmp_path / "in").mkdir()
    for i, score in enumerate((50, 60)):
        (tmp_path / "in" / f"{i}_sleepData.json").write_text(json.dumps([SLEEP | {"sleepScores": {"overallScore": score}}, SLEEP | {"calendarDate": f"2025-02-0{i + 1}"}]))
        incremental.stream_sleep(spark, folder, table, checkpoint).awaitTermination(120)
    rows = {str(r[KEY]): r.sleepOverallScore for r in incremental.latest(spark, table).collect()}
    assert rows == {"2025-01-15": 60, "2025-02-01": 82, "2025-02-02": 82}


def test_versions_beyond_any_bound_and_rows_left_out(spark, tmp_path):
    for n in (2, 30_000):
        spark.createDataFrame([(f"2025-01-0{n % 7 + 1}", n)], f"{KEY} string, n long").write.parquet(str(tmp_path / f"v={n}"))
    assert incremental.versions(spark, str(tmp_path)) == [2, 30_000] and incremental.latest(spark, str(tmp_path)).first().n == 30_000
    text = sinks.markdown_table(spark.range(7), 5)
    assert text.endswith("2 more rows.") and "more rows" not in sinks.markdown_table(spark.range(5), 5)
