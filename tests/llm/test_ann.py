import numpy as np

from dayloom.llm import ann


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, float))
    out = {}
    for i in good:
        if i % every == 0:
            s = sorted((-float(ann.cosine(good[i][None], v[None])[0]), j) for j, v in good.items() if j != i)[:k]
            out[i] = [(j, -c) for c, j in s]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(3000 + i, rows[0][1]) for i in range(500)]  # one vector that many rows share
    rows += [(10, rows[10][1]), (5000, None), (5010, [0.0] * 8), (5020, [None] + [1.0] * 7), (5030, [float("nan")] * 8), (5040, [1.0] * 3), (None, [1.0] * 8), (5050, [float("inf")] * 8), (5060, [])]
    report = {}
    out = ann.nearest(table(spark, rows), ann.F.col("vec_id") % 10 == 0, 5, report=report).collect()
    truth = brute(rows, 10, 5)
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(truth) and all(len(v) == 5 for v in got.values())
    hits = [len({j for j, _ in got[i]} & {j for j, _ in truth[i]}) / 5 for i in truth]
    assert np.mean(hits) >= 0.9 and report["visits"] <= report["leaves"]
    assert got[0] == truth[0] and got[3000] == truth[3000]  # ties by id
    scores = {i: dict(v) for i, v in truth.items()}
    assert all(abs(s - scores[i][j]) < 1e-12 for i, v in got.items() for j, s in v if j in scores[i])


def test_small_and_empty(spark):
    rows = [(0, [1.0] + [0.0] * 7), (1, [1.0] * 8), (2, [2.0] * 8)]
    out = ann.nearest(table(spark, rows), ann.F.col("vec_id") % 2 == 0, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 2), (2, 1, 1), (2, 2, 0)]
    assert ann.nearest(table(spark, []), ann.F.col("vec_id") % 2 == 0).collect() == []
    assert ann.nearest(table(spark, [(0, [1.0, 2.0])]), ann.F.col("vec_id") == 0).collect() == []


def test_outliers_get_all_their_rows(spark):
    """Tight clusters need one visit; an outlier that is a leaf of its own still gets k rows."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 8))
    rows = [(i, (centers[i % 20] + 0.01 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, (-3 * centers[:5].sum(axis=0) + 4 * rng.normal(size=8)).tolist()) for i in range(12)]
    report = {}
    out = ann.nearest(table(spark, rows), (ann.F.col("vec_id") % 5 == 0) | (ann.F.col("vec_id") >= 2000), 5, report=report).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = [i for i, _ in rows if i % 5 == 0 or i >= 2000]
    assert report["visits"] < report["leaves"]
    assert set(got) == set(queries) and all(len(v) == 5 and i not in v for i, v in got.items())


def test_walk_widens():
    tree = ann.Tree(np.eye(3), np.eye(3), np.arange(3, dtype=np.int32))
    sizes, unit = {0: 1, 1: 2, 2: 50}, np.array([0.9, 0.4, 0.1])
    assert tree.visits(unit, 1) == [0] and tree.visits(unit, 1, sizes, 3) == [0, 1] and tree.visits(unit, 1, sizes, 6) == [0, 1, 2]
    assert tree.visits(unit, 1, sizes, 900) == [0, 1, 2] and tree.visits(unit, 2, sizes, 2) == [0, 1]


def test_repeated_ids_with_different_vectors(spark):
    """One vector an id: the first in the order of arrays, whatever the rows' order."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    twice = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in (0, 1, 7)]
    one = {}
    for i, v in rows + twice:
        one[i] = min(one.get(i, v), v)
    truth = brute(list(one.items()), 10, 5)
    for order in (rows + twice, (rows + twice)[::-1]):
        got = {}
        for r in sorted(ann.nearest(table(spark, order), ann.F.col("vec_id") % 10 == 0, 5).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert all(len(set(v)) == 5 for v in got.values()) and got == {i: [j for j, _ in v] for i, v in truth.items()}
