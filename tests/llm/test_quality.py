import binascii

import numpy as np

from dayloom.llm import quality as q

GOOD = "The quiet river moved past the old mill and the children counted boats until evening came number {}."
BAD = ["BUY!! NOW!! CHEAP!! {}!!", "a | b | c | {} | d | e", "x%%% y*** z### {}$$$ w&&&", "spam spam spam spam spam spam spam {}"]


def tables(spark, n=300):
    docs = [(i, (BAD[i % 4] if i % 3 == 0 else GOOD).format(i), "clash") for i in range(n)] + [(n, None, "c"), (n + 1, "", "c"), (None, GOOD, "c"), (n + 2, "word " * 30_000, "c"), (1, GOOD.format(1), "c")]
    labels = [(i, int(i % 3 != 0)) for i in range(0, n, 2)] + [(2, 0), (None, 1), (4, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learns_from_positives_only(spark):
    docs, labels = tables(spark)
    shapes = q.with_features(docs).cache()
    model = q.fit_pu(shapes, labels)
    assert 0.4 < model.prior < 0.9
    rows = q.score_documents(docs, model).collect()
    assert len(rows) == 305 and all(0 <= r.score <= 1 for r in rows)
    right = [(r.score >= q.THRESHOLD) == (r.doc_id % 3 != 0) for r in rows if r.doc_id is not None and r.doc_id < 300]
    assert np.mean(right) > 0.97
    assert len({r.score for r in rows if r.text == GOOD.format(1)}) == 1
    by_sql = {r.doc_id: r.s for r in shapes.select("doc_id", q.score_column(q.F.col("shape"), model.weights).alias("s")).collect()}
    assert all(abs(by_sql[r.doc_id] - r.score) < 1e-5 for r in rows if r.doc_id not in (None, 1))


def test_moments_and_edges(spark):
    docs, labels = tables(spark, 30)
    shapes = q.with_features(docs)
    x = np.stack([q.text_features(r.text) for r in docs.collect()]).astype(float)
    found = q.moments(shapes.withColumn("trusted", q.F.lit(False)))
    assert found[0][0] == len(x) and np.allclose(found[0][1], x.T @ x) and found[1][0] == 0
    assert q.fit_pu(shapes, labels.where("quality = 0")).score(x[:2].astype(np.float32)).tolist() == [0.5, 0.5]
    assert q.score_documents(docs.limit(0), q.PuModel(np.zeros(q.FEATURES), 0.5, 0)).collect() == []
    assert q.fit_pu(shapes.limit(0), labels.limit(0)).prior == 0.5


def test_fold(spark):
    got = [r.h for r in spark.range(50).select(q.held_out(q.F.col("id"), 5, 0).alias("h")).collect()]
    assert got == [binascii.crc32(str(i).encode()) % 5 == 0 for i in range(50)]


def test_risk_of_negatives_stays_above_zero():
    """With an overestimated prior the unbiased risk of the negatives is below 0; the steps that the
    method takes then bring it back, and the bounded risk is no worse than that of the unbiased fit."""
    rng = np.random.default_rng(5)
    p = np.column_stack([np.ones(40), rng.normal(2, 0.3, 40), rng.normal(0, 1, (40, 6))])
    u = np.column_stack([np.ones(400), np.concatenate([rng.normal(2, 0.3, 100), rng.normal(-2, 0.3, 300)]), rng.normal(0, 1, (400, 6))])
    mp, mu, prior = p.T @ p / len(p), u.T @ u / len(u), 0.6  # a quarter of u is positive

    def negatives(w):
        part = lambda m, s: (1 - 2 * s * (m[0] @ w) + w @ m @ w) / 4
        return part(mu, -1) - prior * part(mp, -1), prior * part(mp, 1)

    unbiased = np.linalg.solve(mu + 1e-4 * np.eye(8), 2 * prior * mp[0] - mu[0])
    w, risk = q.minimise(mp, mu, prior)
    low, plus = negatives(unbiased)
    got, got_plus = negatives(w)
    assert low < -0.01 and got > low + 0.01 and got > -0.005
    assert abs(risk - (got_plus + max(0.0, got))) < 1e-12 and risk <= plus + 0.05
