"""Commands: python -m dayloom.cli COMMAND ...; an error ends with exit code 1."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from dayloom.operators.quality import QualityConfig, label_days
from dayloom.operators.sanitize import sanitize
from dayloom.plans import mart
from dayloom.session import get_session
from dayloom.sources import ingest, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dayloom")
    p.add_argument("--data", default=os.environ.get("DAYLOOM_DATA", "data"), help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("discover", "ingest-activity", "ingest-sleep"):
        sub.add_parser(name).add_argument("export")
    sub.add_parser("build-daily")
    c = sub.add_parser("sanitize")
    c.add_argument("--input", default="daily")
    c.add_argument("--output")
    c.add_argument("--report")
    c.add_argument("--allow-identifiers", action="store_true")
    c.add_argument("--inplace", action="store_true", help="write over the input")
    c = sub.add_parser("data-dictionary")
    c.add_argument("--input", default="daily_sanitized")
    c.add_argument("--out-dir", default="reports")
    c.add_argument("--max-sample-values", type=int, default=5)
    c.add_argument("--markdown-mode", choices=("full", "summary", "both"), default="both")
    c = sub.add_parser("quality")
    c.add_argument("--input", default="daily_sanitized")
    c.add_argument("--out-dir", default="reports")
    c.add_argument("--no-parquet", action="store_true")
    c.add_argument("--output-parquet", help="where the labelled days go")
    c.add_argument("--steps-min", type=int, default=50)
    c.add_argument("--stress-any-hours", type=float, default=6)
    c.add_argument("--stress-full-hours", type=float, default=20)
    c.add_argument("--strict-min-score", type=int, default=4)
    c.add_argument("--loose-min-score", type=int, default=3)
    c.add_argument("--top-n", type=int, default=50)
    c = sub.add_parser("build-sql-mart")
    c.add_argument("--db-path", help="folder of the mart's tables")
    c.add_argument("--overwrite", action="store_true")
    for name in ("daily", "sleep", "quality"):
        c.add_argument(f"--{name}", help=f"the {name} table, instead of the one in the data folder")
    c = sub.add_parser("run-sql-portfolio")
    c.add_argument("--db-path", help="folder of a mart that was built before")
    c.add_argument("--query-dir")
    c.add_argument("--out-dir", default="reports/sql")
    return p


def facts(spark, data: str, daily: str | None = None, sleep: str | None = None, quality: str | None = None) -> dict:
    daily = sinks.read_first(spark, *([daily] if daily else [f"{data}/daily_sanitized", f"{data}/daily"]))
    optional = []
    for given, names in ((sleep, ("sleep_sanitized", "sleep")), (quality, ("daily_quality",))):
        try:
            optional.append(sinks.read_first(spark, *([given] if given else [f"{data}/{n}" for n in names])))
        except FileNotFoundError:
            if given:
                raise
            optional.append(None)
    return {"daily": daily, "sleep": optional[0], "quality": optional[1]}


def run(a: argparse.Namespace, spark) -> str:
    data = a.data
    path = lambda name: name if "/" in name else f"{data}/{name}"
    if a.command == "discover":
        sinks.write_csv(ingest.inventory(spark, a.export), f"{data}/inventory", 1)
    elif a.command in ("ingest-activity", "ingest-sleep"):
        activity = a.command == "ingest-activity"
        docs = ingest.read_documents(spark, a.export, ingest.ACTIVITY_FILES if activity else ingest.SLEEP_FILES)
        if not docs.limit(1).count():
            raise FileNotFoundError("no export files")
        sinks.write_parquet((ingest.parse_activity if activity else ingest.parse_sleep)(docs), f"{data}/{'daily_activity' if activity else 'sleep'}")
    elif a.command == "build-daily":
        sinks.write_parquet(ingest.build_daily(sinks.read_first(spark, f"{data}/daily_activity"), sinks.read_first(spark, f"{data}/sleep")), f"{data}/daily")
    elif a.command == "sanitize":
        out, report = sanitize(sinks.read_first(spark, path(a.input)), allow_identifiers=a.allow_identifiers)
        if a.inplace:  # a table can't be written while it is read
            beside = path(a.input).rstrip("/") + "_new"
            sinks.write_parquet(out, beside)
            sinks.write_parquet(spark.read.parquet(beside), path(a.input))
            sinks.remove(spark, beside)
        else:
            sinks.write_parquet(out, path(a.output or f"{a.input}_sanitized"))
        sinks.write_json_report(report, a.report or f"{data}/sanitize_report.json")
    elif a.command == "data-dictionary":
        os.makedirs(a.out_dir, exist_ok=True)
        sinks.write_dictionary(sinks.read_first(spark, path(a.input), f"{data}/daily"), a.out_dir, a.max_sample_values, a.markdown_mode)
    elif a.command == "quality":
        config = QualityConfig(a.steps_min, int(a.stress_any_hours * 3600), int(a.stress_full_hours * 3600), a.strict_min_score, a.loose_min_score, a.top_n)
        labelled = label_days(sinks.read_first(spark, path(a.input), f"{data}/daily"), config)
        sinks.write_quality(labelled, a.out_dir, None if a.no_parquet else path(a.output_parquet or "daily_quality"), a.top_n)
    elif a.command == "build-sql-mart":
        f = facts(spark, data, a.daily, a.sleep, a.quality)
        where = a.db_path or f"{data}/mart"
        mart.write_mart(f["daily"], where, f["sleep"], f["quality"], a.overwrite)
        return str(mart.open_mart(spark, where)[1])
    else:
        found = mart.open_mart(spark, a.db_path or f"{data}/mart")[0]
        if a.query_dir:
            return str(mart.run_sql_directory(spark, a.query_dir, a.out_dir))
        mart.run_pack(found, a.out_dir)
    return "done"


def main(argv: Sequence[str] | None = None) -> int:
    try:
        print(run(parser().parse_args(argv), get_session()))
    except (FileNotFoundError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
