"""Rank statistics, their tests and bootstrap intervals.

Ranks come from counts by value and running sums over them; everything after are sums. Spark gives U, H and rho; the driver turns these few numbers into probabilities. Bootstrap
replicates are dealt to executors in chunks; the data of a test (a column of day values) go along
with each chunk, up to MOST_BOOTSTRAP values, as resampling needs all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.exprs import num
from dayloom.functions.positions import value_ranks
from dayloom.functions.special import chi2_sf, mann_whitney_exact_sf, normal_sf, t_sf

MOST_BOOTSTRAP = 1_000_000


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank from 1 of a column without nulls; ties share the mean of theirs."""
    return df.join(value_ranks(df, column).select(column, F.col("rank").alias(out)), column)


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, n, rank_sum, median, and ties: the sum of t^3 - t over groups of ties, by group of their
    members (they add up over groups). Ranks are of values, not of rows."""
    rows = df.select(F.col(group).alias("group"), num(value).alias("v")).dropna()
    ranks = value_ranks(rows, "v").select("v", "rank", (F.col("n") * F.col("n") - 1).cast("double").alias("t"))
    counts = rows.groupBy("group", "v").agg(F.count("*").alias("n")).join(ranks, "v")
    sums = counts.groupBy("group").agg(F.sum(F.col("n") * F.col("rank")).alias("rank_sum"), F.sum(F.col("n") * F.col("t")).alias("ties"))
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.median("v").alias("median")).join(sums, "group").select("group", "n", "rank_sum", "median", "ties")


def mann_whitney(df: DataFrame, value: str, group: str, first, second, alternative: str = "two-sided") -> dict:
    """U of ``first``, its probability (exact for small samples without ties, else the normal
    approximation with corrections for ties and continuity), medians and Cliff's delta."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative must be two-sided, greater or less")
    found = {r.group: r for r in rank_sums(df.where(F.col(group).isin(first, second)), value, group).collect()}
    if first not in found or second not in found:
        return {"u": None, "p": None, "n_first": 0 if first not in found else found[first].n, "n_second": 0 if second not in found else found[second].n, "median_first": None, "median_second": None, "median_difference": None, "cliffs_delta": None}
    a, b = found[first], found[second]
    n, m = a.n, b.n
    u = a.rank_sum - n * (n + 1) / 2
    ties, total = a.ties + b.ties, n + m
    if ties == 0 and min(n, m) <= 8:
        few, many = sorted((n, m))  # the distribution of U is the same either way
        upper, lower = mann_whitney_exact_sf(u, few, many), mann_whitney_exact_sf(n * m - u, few, many)
    else:
        spread = sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1))))
        shift = lambda x: normal_sf((x - n * m / 2 - 0.5) / spread) if spread else 1.0
        upper, lower = shift(u), shift(n * m - u)
    p = {"greater": upper, "less": lower, "two-sided": min(1.0, 2 * min(upper, lower))}[alternative]
    return {"u": u, "p": min(1.0, p), "n_first": n, "n_second": m, "median_first": a["median"], "median_second": b["median"], "median_difference": a["median"] - b["median"], "cliffs_delta": 2 * u / (n * m) - 1}


def cliffs_delta(df: DataFrame, value: str, group: str, first, second) -> float | None:
    """(pairs with x > y less pairs with x < y) / all pairs, from ranks instead of pairs."""
    return mann_whitney(df, value, group, first, second)["cliffs_delta"]


def kruskal(df: DataFrame, value: str, group: str) -> dict:
    """H with the correction for ties, its probability, size and median of each group."""
    rows = rank_sums(df, value, group).collect()
    if len(rows) < 2:
        raise ValueError("Kruskal-Wallis needs two groups with values")
    n = sum(r.n for r in rows)
    h = 12 / (n * (n + 1)) * sum(r.rank_sum**2 / r.n for r in rows) - 3 * (n + 1)
    correction = 1 - sum(r.ties for r in rows) / (n**3 - n) if n > 1 else 0
    h = h / correction if correction else float("nan")
    return {"h": h, "p": chi2_sf(h, len(rows) - 1), "groups": {r.group: {"n": r.n, "median": r["median"]} for r in rows}}


def spearman(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> dict:
    """Correlation of average ranks over complete pairs; probability by the t distribution."""
    pairs = df.select(num(x).alias("x"), num(y).alias("y")).dropna()
    ranked = average_ranks(average_ranks(pairs, "x", "a"), "y", "b")
    n, rho = ranked.agg(F.count("*"), F.corr("a", "b")).first()
    if n < 3 or rho is None or rho != rho:
        return {"n": n, "rho": None, "p": None}
    t = rho * sqrt((n - 2) / max(1e-300, (1 - rho) * (1 + rho)))
    p = {"two-sided": 2 * t_sf(abs(t), n - 2), "greater": t_sf(t, n - 2), "less": t_sf(-t, n - 2)}[alternative]
    return {"n": n, "rho": rho, "p": min(1.0, p)}


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    pairs = df.select(num(x).alias("x"), num(y).alias("y")).dropna()
    return pairs.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def _values(df: DataFrame, columns: list[str]) -> np.ndarray:
    rows = df.select(*[num(c).alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    n = rows.count()
    if n > MOST_BOOTSTRAP:
        raise ValueError(f"a bootstrap over {n} values; resampling sends them all, at most {MOST_BOOTSTRAP}")
    return rows.orderBy(*rows.columns).toPandas().to_numpy(float)


def _replicates(df: DataFrame, one, n_boot: int) -> np.ndarray:
    """one(replicate id) on executors; independent of how replicates are dealt out."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"estimate": [one(int(i)) for i in b["id"]]})

    spark = df.sparkSession
    found = spark.range(n_boot).repartition(max(1, min(n_boot // 100, 200))).mapInPandas(run, "estimate double")
    return found.where("not isnan(estimate)").toPandas()["estimate"].to_numpy()


def _interval(estimates: np.ndarray, alpha: float) -> tuple[float, float]:
    low, high = np.quantile(estimates, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def bootstrap_median_difference(df: DataFrame, value: str, group: str, first, second, n_boot: int = 4000, alpha: float = 0.05, seed: int = 42) -> dict:
    a, b = (_values(df.where(F.col(group) == g), [value])[:, 0] for g in (first, second))
    if not len(a) or not len(b):
        return {"difference": None, "low": None, "high": None}

    def one(i: int) -> float:
        rng = np.random.default_rng([seed, i])
        return float(np.median(rng.choice(a, len(a))) - np.median(rng.choice(b, len(b))))

    low, high = _interval(_replicates(df, one, n_boot), alpha)
    return {"difference": float(np.median(a) - np.median(b)), "low": low, "high": high}


def _ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = counts.cumsum()
    return ((2 * ends - counts + 1) / 2)[inverse]


def bootstrap_spearman(df: DataFrame, x: str, y: str, n_boot: int = 4000, alpha: float = 0.05, seed: int = 42, attempts: int = 5, least: float = 0.8) -> dict:
    """Resampled pairs; a replicate without any spread is drawn again, a few times."""
    pairs = _values(df, [x, y])
    if len(pairs) < 3:
        return {"low": None, "high": None}

    def one(i: int) -> float:
        for k in range(attempts):
            s = pairs[np.random.default_rng([seed, i, k]).integers(0, len(pairs), len(pairs))]
            if np.ptp(s[:, 0]) and np.ptp(s[:, 1]):
                return float(np.corrcoef(_ranks(s[:, 0]), _ranks(s[:, 1]))[0, 1])
        return float("nan")

    found = _replicates(df, one, n_boot)
    if len(found) < least * n_boot:
        return {"low": None, "high": None}
    low, high = _interval(found, alpha)
    return {"low": low, "high": high}


def decisions(tests: list[tuple[str, float | None]], alpha: float = 0.05) -> list[tuple[str, float | None, bool]]:
    """Supported where p is known and below alpha."""
    return [(name, p, p is not None and p < alpha) for name, p in tests]
