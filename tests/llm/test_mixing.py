import numpy as np
import pytest

from dayloom.llm import mixing as m

EN, DE = "the river and the boat went down to the old mill ", "der Fluss und das Boot fuhren hinab zur alten Mühle "


def tables(spark):
    rows = [(i, EN * (1 + i % 3), "en", 1.0) for i in range(60)] + [(100 + i, DE * 2, "de", 1.0) for i in range(20)] + [(200 + i, EN * 20 + DE * 20, "en", 1.0) for i in range(5)]
    rows += [(300, None, "en", 1.0), (301, "", "de", 1.0), (302, EN * 3000, None, 1.0), (None, DE, "de", 1.0), (0, EN, "en", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rate double"), spark.createDataFrame([(i,) for i in range(0, 120, 2)] + [(None,), (0,)], "doc_id long")


def slow_fit(n, p, wished, scale, ridge, least):
    r = np.ones(len(n))
    a = p * n[:, None]
    big = np.linalg.norm((a * np.sqrt(scale)).T @ (p * np.sqrt(scale)), 2) + ridge
    for _ in range(4000):
        g = scale * (r @ a - wished)
        r = np.maximum(least, r - (p @ g + ridge * (r - 1)) / big)
    return r


def test_rates_meet_targets(spark):
    docs, labels = tables(spark)
    model = m.fit_domains(docs, labels, "lang")
    assert model.domains == ["de", "en"] and model.posterior(EN)[1] > 0.9 and model.posterior(DE)[0] > 0.9
    both = model.posterior(EN * 20 + DE * 20)
    assert 0.3 < both[0] < 0.7 and abs(both.sum() - 1) < 1e-6
    members = m.memberships(docs.where("doc_id < 300").select("doc_id", "text"), model).cache()
    mix = m.fit_rates(members, model.domains, {"de": 0.5, "en": 0.5})
    rows = m.with_rates(members, mix).collect()
    n, p, r = np.array([x.n_tokens for x in rows], float), np.array([x.posterior for x in rows]), np.array([x.rate for x in rows])
    got = (n * r) @ p
    assert np.allclose(got / got.sum(), 0.5, atol=2e-3) and (r >= 0).all()
    scale = 1 / np.diag((p * n[:, None]).T @ p)
    slow = slow_fit(n, p, mix.targets, scale, m.RIDGE, 0.0)
    assert np.allclose((n * slow) @ p, got, rtol=5e-3)
    assert all(np.floor(x.rate) <= x.copies <= np.floor(x.rate) + 1 for x in rows)


def test_extreme_target_hits_the_bound(spark):
    docs, labels = tables(spark)
    model = m.fit_domains(docs, labels, "lang")
    members = m.memberships(docs.where("doc_id < 200").select("doc_id", "text"), model)
    mix = m.fit_rates(members, model.domains, {"de": 1.0}, total=300)
    rows = m.with_rates(members, mix).collect()
    assert min(r.rate for r in rows) >= 0 and mix.totals[1] < 0.1 * 2000


def test_documents_stay_and_edges(spark):
    docs, labels = tables(spark)
    out = m.mix_documents(docs, labels, least=1.0).collect()
    have = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(r.doc_id, r.text) for r in out} == set(have) and len(out) >= len(have)
    assert m.mix_documents(docs.limit(0), labels).collect() == []
    assert len(m.mix_documents(docs, labels.limit(0)).collect()) == len(have)


def test_every_labelled_domain_is_learned(spark, monkeypatch):
    """More than 64 domains, one with 3 of 600 labelled rows: none is dropped, its target is met."""
    monkeypatch.setattr(m, "LEAST_ROWS", 4)
    word = lambda d: f"{chr(97 + d // 26)}{chr(97 + d % 26)}{chr(122 - d // 26)}{chr(122 - d % 26)} "
    rows = [(1000 * d + i, word(d) * (20 + i), f"d{d:02}") for d in range(70) for i in range(8)] + [(90_000 + i, "§§ µµ " * 30, "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = m.fit_domains(docs, docs.select("doc_id"), "lang", sample=100)
    assert len(model.domains) == 71 and "rare" in model.domains
    assert model.domains[model.posterior("§§ µµ " * 30).argmax()] == "rare"
    monkeypatch.setattr(m, "CELLS", 1)  # long texts go by blocks
    text = "§§ µµ " * 200 + word(3) * 300
    small = model.posterior(text)
    monkeypatch.setattr(m, "CELLS", 1 << 22)
    assert np.allclose(small, model.posterior(text), atol=1e-6)
    members = m.memberships(docs.select("doc_id", "text"), model)
    mix = m.fit_rates(members, model.domains, {d: 2.0 if d == "rare" else 1.0 for d in model.domains})
    assert mix.targets[model.domains.index("rare")] == 2 * mix.targets[0]
    with pytest.raises(ValueError, match="nowhere"):
        m.fit_rates(members, model.domains, {"rare": 0.5, "nowhere": 0.5})


def test_infeasible_targets_are_reported(spark):
    docs, labels = tables(spark)
    with pytest.raises(ValueError, match="times the corpus"):
        m.mix_documents(docs, labels, least=1.0, targets={"de": 0.9999, "en": 0.0001})
    model = m.fit_domains(docs, labels, "lang")
    members = m.memberships(docs.where("doc_id between 200 and 204").select("doc_id", "text"), model).cache()  # half and half each
    with pytest.warns(UserWarning, match="targets missed"):
        mix = m.fit_rates(members, model.domains, {"de": 0.999, "en": 0.001})
    assert set(mix.missed()) == {"de", "en"}


def test_each_domain_meets_its_target(spark):
    """A domain of a hundredth of the tokens comes as near to its target as a large one."""
    docs, labels = tables(spark)
    model = m.fit_domains(docs, labels, "lang")
    members = m.memberships(docs.where("doc_id < 200").select("doc_id", "text"), model).cache()
    mix = m.fit_rates(members, model.domains, {"de": 0.01, "en": 0.99})
    assert np.abs(mix.totals / mix.targets - 1).max() <= m.MISSED and not mix.missed()


def test_long_texts_by_blocks(monkeypatch):
    weights = np.log(np.random.default_rng(0).dirichlet(np.ones(3), m.PAIRS).astype(np.float32) + 1e-3)
    model, text = m.DomainModel(["a", "b", "c"], weights), (EN + DE) * 200
    whole = model.posterior(text)
    monkeypatch.setattr(m, "CELLS", 5000)
    assert np.allclose(model.posterior(text), whole, atol=1e-9)


def test_clashing_names(spark):
    docs, labels = tables(spark)
    for name in ("__rate", "__copy", "__id", "__d", "__of"):
        docs = docs.withColumn(name, docs["doc_id"] + 1)
    out = m.mix_documents(docs, labels)
    assert out.columns == docs.columns and {r["__rate"] for r in out.collect()} == {r["__rate"] for r in docs.collect()}
