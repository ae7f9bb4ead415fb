from dayloom.operators import modeling, stats
from dayloom.plans import catalog, catalog_explore

SF = "/root/testdata/sf0.001"


def test_queries_take_the_operators_defaults(spark, monkeypatch):
    """No query asks for fewer replicates or models than its operator runs; what they compute is left out here."""
    assert catalog
    said = []

    def asked(module, name, out):
        monkeypatch.setattr(module, name, lambda *a, **b: (said.append((name, len(a), set(b))), out)[1])

    for name in ("bootstrap_median_difference", "bootstrap_spearman"):
        asked(stats, name, {"low": 0.0, "high": 1.0})
    for name in ("evaluate_classifiers", "evaluate_regressors"):
        asked(modeling, name, [])
    for query in (catalog_explore._bootstrap, catalog_explore._classifiers, catalog_explore._regressors):
        query(spark, SF)
    assert len(said) == 4 and not any({"n_boot", "models"} & b for _, _, b in said)
    assert all(n == 3 for name, n, _ in said if name.startswith("evaluate"))
