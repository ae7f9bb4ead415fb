"""The driver contract: entry, and that every query has a plan that SQL agrees with at sf0.001."""

import duckdb
import pytest

from dayloom.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ["sql02_weekday_profiles", "sql04_stress_quartiles", "q_quality_labels", "a14_reason_table", "w5_entity_rolling", "g23_recovery_frame", "x7_spearman", "m8_threshold_table", "s9_parse_activity", "s10_parse_sleep", "s29_schema_inspector", "v2_guids_and_precedence", "f11_clipped", "v7_report", "s15_csv_round_trip"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in ("orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = catalog.QUERIES[name](spark, SF)
    theirs = c.sql(catalog.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    names = sorted(ours.columns)
    key = lambda row: tuple(str(x) for x in row)
    a = sorted((tuple(r) for r in ours.select(*names).collect()), key=key)
    b = sorted(c.sql("select " + ", ".join(f'"{n}"' for n in names) + f" from ({catalog.ORACLES[name]})").fetchall(), key=key)
    assert a == b
