"""Places, ranks and rolling windows by blocks against plain Python."""

import random

from pyspark.sql import functions as F

from dayloom.functions import positions as p


def test_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(p, "ROLLING_ROWS", 10)
    rng = random.Random(3)
    rows = [(i, float(rng.choice([0, 1, 2, 5, rng.random() * 100]))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    placed, n = p.with_position(df, "x", ("id",))
    assert n == 500 and {r.id: r.position for r in placed.collect()} == {i: k + 1 for k, (i, _) in enumerate(order)}
    ranks = {r.x: (r.n, r["rank"]) for r in p.value_ranks(df, "x").collect()}
    for x, (count, rank) in ranks.items():
        places = [k + 1 for k, (_, v) in enumerate(order) if v == x]
        assert count == len(places) and rank == sum(places) / len(places)
    rolled = p.rolling_rows(df, "id", 6, lambda w: F.sum("x").over(w), "s").collect()
    for r in rolled:
        assert abs(r.s - sum(v for _, v in rows[max(0, r.id - 6) : r.id + 1])) < 1e-9
    assert len(rolled) == 500


def test_tiles_and_empty(spark):
    for n, k in ((10, 4), (3, 4), (8, 4), (1, 4), (401, 4)):
        tiles = [r.t for r in spark.range(1, n + 1).select(p.tile(F.col("id"), n, k).alias("t"), "id").orderBy("id").collect()]
        theirs = [r.t for r in spark.range(1, n + 1).selectExpr(f"ntile({k}) over (order by id) as t", "id").orderBy("id").collect()]
        assert tiles == theirs
    empty = spark.createDataFrame([], "x double")
    assert p.with_position(empty, "x")[0].collect() == [] and p.value_ranks(empty, "x").collect() == []
    assert p.rolling_rows(empty, "x", 6, lambda w: F.sum("x").over(w), "s").collect() == []
