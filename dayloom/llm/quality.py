"""Quality classifier by positive-unlabelled learning.

The non-negative unbiased risk  pi*E_p[l(g)] + max(0, E_u[l(-g)] - pi*E_p[l(-g)])  of trusted
positives p, unlabelled web text u and an estimated class prior pi is minimised for a
linear g over bounded features of a text's shape. With the squared loss the risk depends on
the data only through the first and second moments of the features, so training covers
every document and every trusted positive: one pass makes the moments, summed in Spark, and
the driver holds two matrices of FEATURES x FEATURES numbers whatever the corpus.

The prior is estimated from the same two samples: a first fit separates p from u, and pi is
the least ratio P_u(g >= t) / P_p(g >= t) over thresholds that keep LEAST_KEPT of p. Labels
of 0 are not used at all.

Edge cases: null text is empty text, which scores like any other. Documents without an id
are unlabelled. Rows with several labels that differ are not trusted; repeated labels count
once a document. Without a trusted positive every score is the prior 0.5. Equal texts get
equal scores. An empty table gives an empty table. Extra columns pass through unless they
clash with the result's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from dayloom.llm.common import Scratch, lean, small_batches

THRESHOLD = 0.3
LEAST_KEPT = 0.2
BINS = 400

# Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence marks, 7 !, 8 |, 9 symbols, 10 non-ASCII
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b"\n\r"), (6, b".,;:?'\"-()"), (7, b"!"), (8, b"|"), (9, b"%#$&*@~^=+<>{}[]\\/_`")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10

#: Each shape measure enters as min(1, measure / scale) for these scales.
SCALES = {"upper": (0.05, 0.2, 0.6), "digit": (0.05, 0.2), "space": (0.1, 0.2), "lines": (0.01, 0.05), "marks": (0.02, 0.1), "shout": (0.005, 0.03, 0.1), "bar": (0.005, 0.03, 0.1), "symbol": (0.01, 0.05, 0.2), "foreign": (0.05, 0.3), "word": (5.0, 12.0, 40.0), "varied": (0.2, 0.5, 1.0), "echo": (0.01, 0.1, 0.5), "repeat": (0.1, 0.4, 1.0), "size": (4.0, 7.0, 10.0), "runs": (0.01, 0.05)}
FEATURES = 1 + sum(map(len, SCALES.values()))


def text_features(text: str | None) -> np.ndarray:
    """FEATURES numbers from 0 to 1; the first is 1."""
    raw = (text or "").encode("utf-8")
    n = max(len(raw), 1)
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    c = np.bincount(kinds, minlength=11)
    words = raw.split()
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(c[1] + c[2] + c[10], 1)
    odd = (kinds >= 7) & (kinds <= 9)
    measures = {
        "upper": c[2] / letters, "digit": c[3] / n, "space": c[4] / n, "lines": c[5] / n, "marks": c[6] / n, "shout": c[7] / n, "bar": c[8] / n, "symbol": c[9] / n, "foreign": c[10] / n,
        "word": len(raw) / w, "varied": len(set(words)) / w, "echo": sum(map(eq, words, words[1:])) / w, "repeat": 1 - len(set(lines)) / max(len(lines), 1), "size": np.log1p(len(raw)),
        "runs": np.count_nonzero(odd[1:] & odd[:-1]) / n,
    }
    return np.array([1.0, *[min(1.0, measures[k] / s) for k, scales in SCALES.items() for s in scales]], np.float32)


def with_features(df: DataFrame, text: str = "text", out: str = "shape") -> DataFrame:
    """Replaces the text by its features (an array of floats)."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = [text_features(t) for t in b.column(len(keep)).to_pylist()]
            flat = pa.array(np.concatenate(x) if x else np.empty(0, np.float32), pa.float32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), flat)], names=schema.names)

    return df.select(*[f.name for f in keep], text).mapInArrow(lean(run), schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def trusted(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, label) of documents of the learning folds whose labels agree."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    return rows.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("__max")).where(F.col(label) == F.col("__max")).drop("__max")


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.float64).reshape(-1, FEATURES)


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """By ``trusted`` (0 or 1): rows and sum of outer products. Each task sends one triangle."""
    upper = np.triu_indices(FEATURES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES, FEATURES))
        for b in batches:
            x, p = _matrix(b, "shape"), np.asarray(b.column("trusted"), bool)
            for k, part in ((0, x), (1, x[p])):
                sums[k] += part.T @ part
        for k in (0, 1):
            if sums[k, 0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k), pa.int32()), pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(sums[k][upper])], names=["k", "i", "v"])

    out = {k: (0.0, np.zeros((FEATURES, FEATURES))) for k in (0, 1)}
    cells: dict[int, np.ndarray] = {k: np.zeros(len(upper[0])) for k in (0, 1)}
    for k, i, v in rows.select("shape", "trusted").mapInArrow(lean(run), "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        cells[k][i] = v
    for k, v in cells.items():
        m = np.zeros((FEATURES, FEATURES))
        m[upper] = v
        m = m + np.triu(m, 1).T
        out[k] = (m[0, 0], m)
    return out


def score_column(shape: Column, weights: np.ndarray) -> Column:
    """clip((g + 1) / 2, 0, 1): for the squared loss g estimates 2 P(1 | x) - 1."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    g = F.aggregate(F.zip_with(shape, table, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (g + 1) / 2))


@dataclass
class PuModel:
    weights: np.ndarray
    prior: float
    risk: float

    def score(self, shapes: np.ndarray) -> np.ndarray:
        return np.clip((shapes.astype(np.float64) @ self.weights + 1) / 2, 0, 1)


def minimise(mp: np.ndarray, mu: np.ndarray, prior: float, l2: float = 1e-4, steps: int = 3000) -> tuple[np.ndarray, float]:
    """Non-negative risk with l(z) = (1 - z)^2 / 4, by gradient steps; while the estimated risk of
    the negatives is below 0, a step goes against that part only (Kiryo et al., 2017)."""
    fp, fu = mp[0], mu[0]  # first moments: the first feature is 1
    ridge = l2 * np.eye(len(fp))
    ridge[0, 0] = 0
    w = np.linalg.solve(mu + ridge * 10, 2 * prior * fp - fu)  # of the unbiased risk
    rate = 1.0 / np.linalg.norm(mu, 2)
    part = lambda m, f, s: (1 - 2 * s * (f @ w) + w @ m @ w) / 4
    for _ in range(steps):
        negative = part(mu, fu, -1) - prior * part(mp, fp, -1)
        slope = ((mu @ w + fu) - prior * (mp @ w + fp)) / 2
        if negative < 0:
            w = w + rate * slope
        else:
            w = w - rate * (prior * (mp @ w - fp) / 2 + slope + ridge @ w)
    negative = part(mu, fu, -1) - prior * part(mp, fp, -1)
    return w, float(prior * part(mp, fp, 1) + max(0.0, negative))


def estimate_prior(rows: DataFrame, weights: np.ndarray) -> float:
    """The least ratio of shares above a threshold, over all rows' scores in BINS bins."""
    score = F.least(F.floor(score_column(F.col("shape"), weights) * BINS), F.lit(BINS - 1)).cast("int")
    u, p = np.zeros(BINS), np.zeros(BINS)
    for i, n, t in rows.groupBy(score.alias("bin")).agg(F.count("*"), F.sum(F.col("trusted").cast("long"))).collect():
        u[i], p[i] = n, t
    above_u, above_p = u[::-1].cumsum() / u.sum(), p[::-1].cumsum() / p.sum()
    kept = above_p >= LEAST_KEPT
    return float(np.clip((above_u[kept] / above_p[kept]).min(), 0.01, 0.99))


def fit_pu(shapes: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, fold: int = 0) -> PuModel:
    """``shapes``: doc_id and features of every document (a written table, as it is read three times)."""
    good = trusted(labels, label, folds, fold).where(F.col(label) == 1).select(F.col("doc_id").alias("__id"), F.lit(True).alias("__good"))
    rows = shapes.join(good, shapes.doc_id == good["__id"], "left").select("shape", F.coalesce("__good", F.lit(False)).alias("trusted"))
    found = moments(rows)
    (n_u, s_u), (n_p, s_p) = found[0], found[1]
    if not n_p:
        return PuModel(np.zeros(FEATURES), 0.5, 0.5)
    mp, mu = s_p / n_p, s_u / n_u
    ridge = 1e-4 + 0.3 / n_p  # for few positives a stiffer fit
    first = np.linalg.solve(0.5 * (mp + mu) + ridge * np.eye(FEATURES), 0.5 * (mp[0] - mu[0]))  # p against u, equal weights
    prior = estimate_prior(rows, first * 0.999)
    weights, risk = minimise(mp, mu, prior, ridge)
    return PuModel(weights, prior, risk)


def score_documents(df: DataFrame, model: PuModel, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score; one pass over the texts, no shuffle."""
    keep = [f for f in df.schema.fields if f.name != out]
    schema, where = T.StructType([*keep, T.StructField(out, T.DoubleType())]), [f.name for f in keep].index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = [text_features(t) for t in b.column(where).to_pylist()]
            score = model.score(np.stack(x)) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=schema.names)

    return df.select(*[f.name for f in keep]).mapInArrow(lean(run), schema)


def op7_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    shapes = Scratch(spark).put(with_features(docs), "shapes")
    model = fit_pu(shapes, labels)
    out = shapes.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score_column(F.col("shape"), model.weights).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
