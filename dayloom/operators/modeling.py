"""Time-ordered evaluation of classifiers and regressors on Spark ML: splits, metrics, thresholds,
selection, importance. Metrics are aggregates; only their values reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import floor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.exprs import KEY, num
from dayloom.functions.positions import running_sums, with_position

SPLITS = ("train", "valid", "test")
CLASSIFIERS = ("dummy", "logistic", "logistic_l1", "elastic_net", "random_forest", "boosting")
REGRESSORS = ("dummy_median", "ridge", "lasso", "elastic_net", "random_forest", "boosting")
SCORE = "__score"  # what models add, so that no column of a table clashes with it
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


@dataclass(frozen=True)
class TimeSplit:
    train: float = 0.6
    valid: float = 0.2


def split_sizes(n: int, split: TimeSplit) -> tuple[int, int, int]:
    if n < 3:
        raise ValueError("a time-ordered split needs three rows")
    train = min(max(1, floor(n * split.train)), n - 2)
    valid = min(max(1, floor(n * split.valid)), n - train - 1)
    return train, valid, n - train - valid


def time_split(df: DataFrame, split: TimeSplit = TimeSplit(), day: str = KEY) -> DataFrame:
    """Adds ``split``: contiguous blocks by day, from each row's place in the order of days."""
    placed, n = with_position(df.withColumn("__day", F.unix_date(F.col(day).cast("date"))), "__day", out="__n")
    train, valid, _ = split_sizes(n, split)
    return placed.withColumn("split", F.when(F.col("__n") <= train, "train").when(F.col("__n") <= train + valid, "valid").otherwise("test")).drop("__n", "__day")


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp, precision, recall, specificity at a threshold."""
    y, s = F.col(label) == 1, num(score) >= threshold
    cells = df.where(F.col(label).isNotNull() & num(score).isNotNull()).agg(F.count_if(~y & ~s).alias("tn"), F.count_if(~y & s).alias("fp"), F.count_if(y & ~s).alias("fn"), F.count_if(y & s).alias("tp"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return cells.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tn", "fp").alias("specificity"))


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """roc_auc from average ranks and average precision (steps, ties together); null with one class."""
    by_score = df.select(F.col(label).cast("long").alias("y"), num(score).alias("s")).dropna().groupBy("s").agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("q"))
    cum, _ = running_sums(by_score.withColumn("back", -F.col("s")), "back", {"cp": F.col("p"), "cq": F.col("q")})
    p, q = F.sum("p"), F.sum("q")
    auc = F.sum(F.col("q") * (F.col("cp") - F.col("p")) + F.col("q") * F.col("p") / 2.0)
    ap = F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq")).cast("double"))
    both = (p > 0) & (q > 0)
    return cum.agg(F.when(both, auc / (p * q)).alias("roc_auc"), F.when(both, ap / p).alias("average_precision"))


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> dict:
    c, r = confusion(df, label, score, threshold).first(), ranking_metrics(df, label, score).first()
    n = c.tn + c.fp + c.fn + c.tp
    recalls = [x for x in (c.recall, c.specificity) if x is not None]
    return {
        "n": n, "accuracy": (c.tn + c.tp) / n if n else None, "balanced_accuracy": sum(recalls) / len(recalls) if recalls else None, "f1": 2 * c.tp / (2 * c.tp + c.fp + c.fn) if 2 * c.tp + c.fp + c.fn else 0.0,
        "positive_rate": (c.tp + c.fn) / n if n else None, "predicted_positive_rate": (c.tp + c.fp) / n if n else None, "roc_auc": r.roc_auc, "average_precision": r.average_precision, "precision": c.precision, "recall": c.recall,
    }


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, z = num(label), num(prediction)
    rows = df.select(y.alias("y"), z.alias("z")).dropna()
    e = F.col("y") - F.col("z")
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("*"))).alias("r2"), F.min("z").alias("prediction_min"), F.max("z").alias("prediction_max"))


def threshold_table(df: DataFrame, label: str, score: str, grid: Sequence[float] = GRID) -> DataFrame:
    """Balanced accuracy and f1 at each threshold; a row is compared with the bounded grid inside one
    aggregate, not joined with it."""
    rows = df.select((F.col(label) == 1).alias("y"), num(score).alias("s")).dropna()
    aggs = []
    for i, t in enumerate(grid):
        hit = F.col("s") >= t
        aggs.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col("y") & hit).alias("tp"), F.count_if(~F.col("y") & hit).alias("fp"), F.count_if(F.col("y") & ~hit).alias("fn"), F.count_if(~F.col("y") & ~hit).alias("tn")).alias(f"t{i}"))
    one = rows.agg(*aggs)
    cells = one.select(F.inline(F.array(*one.columns)))
    recall, spec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    balanced = F.when(recall.isNotNull() & spec.isNotNull(), (recall + spec) / 2).otherwise(F.coalesce(recall, spec))
    return cells.select("*", balanced.alias("balanced_accuracy"), F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0).cast("double")).alias("f1"))


def tune_threshold(df: DataFrame, label: str, score: str, metric: str = "balanced_accuracy", grid: Sequence[float] = GRID) -> tuple[float, float | None]:
    """The threshold with the best metric; of equals the one nearest to 0.5, then the smaller."""
    if metric not in ("balanced_accuracy", "f1"):
        raise ValueError("metric must be balanced_accuracy or f1")
    best = threshold_table(df, label, score, grid).orderBy(F.col(metric).desc_nulls_last(), F.abs(F.col("threshold") - 0.5), "threshold").first()
    return best.threshold, best[metric]


def _stages(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list, list[str]]:
    """Numbers: median for gaps, standardised. Text: most frequent value for gaps, one-hot, unseen
    values ignored. Columns without any known value are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    text = [c for c in features if c not in numeric]
    known = df.agg(*[F.count(c).alias(c) for c in features]).first().asDict()
    numeric, text = [c for c in numeric if known[c]], [c for c in text if known[c]]
    out = df.withColumns({f"__{c}": F.col(c).cast("double") for c in numeric})
    if text:
        modes = df.agg(*[F.mode(c).alias(c) for c in text]).first().asDict()
        out = out.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit(str(modes[c]))) for c in text})
    stages, inputs = [], []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=[f"__{c}" for c in numeric], outputCols=[f"__{c}_i" for c in numeric]), VectorAssembler(inputCols=[f"__{c}_i" for c in numeric], outputCol="__numbers"), StandardScaler(withMean=True, inputCol="__numbers", outputCol="__scaled")]
        inputs.append("__scaled")
    if text:
        stages += [StringIndexer(handleInvalid="keep", inputCols=[f"__{c}" for c in text], outputCols=[f"__{c}_x" for c in text]), OneHotEncoder(dropLast=False, handleInvalid="keep", inputCols=[f"__{c}_x" for c in text], outputCols=[f"__{c}_h" for c in text])]
        inputs += [f"__{c}_h" for c in text]
    return out, [*stages, VectorAssembler(inputCols=inputs, outputCol="features")], [*numeric, *text]


def _with_inputs(df: DataFrame, model_columns: dict[str, str | None]) -> DataFrame:
    return df.withColumns({f"__{c}": F.col(c).cast("double") if mode is None else F.coalesce(F.col(c).cast("string"), F.lit(mode)) for c, mode in model_columns.items()})


@dataclass
class Fitted:
    name: str
    pipeline: PipelineModel | None
    constant: float | None
    columns: dict[str, str | None]

    def score(self, df: DataFrame, out: str = SCORE) -> DataFrame:
        """Probability of 1, or the prediction of a regressor."""
        if self.pipeline is None:
            return df.withColumn(out, F.lit(self.constant))
        found = self.pipeline.transform(_with_inputs(df, self.columns))
        value = vector_to_array("probability")[1] if "probability" in found.columns else F.col("prediction")
        return found.select(*df.columns, value.alias(out))


def _classifier(name: str, n: int, seed: int):
    common = {"featuresCol": "features", "labelCol": "__y", "weightCol": "__w"}
    if name == "random_forest":
        return RandomForestClassifier(numTrees=300, maxDepth=8, seed=seed, **common)
    if name == "boosting":
        return GBTClassifier(maxIter=40, maxDepth=3, stepSize=0.1, seed=seed, featuresCol="features", labelCol="__y")
    c, mix = {"logistic": (1.0, 0.0), "logistic_l1": (0.3, 1.0), "elastic_net": (0.5, 0.5)}[name]
    return LogisticRegression(regParam=1 / (c * n), elasticNetParam=mix, maxIter=200, **common)


def _regressor(name: str, n: int, seed: int):
    common = {"featuresCol": "features", "labelCol": "__y"}
    if name == "random_forest":
        return RandomForestRegressor(numTrees=300, maxDepth=8, seed=seed, **common)
    if name == "boosting":
        return GBTRegressor(maxIter=40, maxDepth=3, stepSize=0.1, seed=seed, **common)
    alpha, mix = {"ridge": (1.0 / n, 0.0), "lasso": (0.1, 1.0), "elastic_net": (0.1, 0.5)}[name]
    return LinearRegression(regParam=alpha, elasticNetParam=mix, **common)


def fit(train: DataFrame, features: Sequence[str], target: str, name: str, classify: bool = True, seed: int = 42) -> Fitted:
    """Fitted on the rows given; classes are weighted by n / (2 n_class)."""
    if name not in (CLASSIFIERS if classify else REGRESSORS):
        raise KeyError(f"unknown model {name}")
    missing = [c for c in features if c not in train.columns]
    if missing:
        raise KeyError(f"missing feature columns: {missing}")
    rows = train.where(num(target).isNotNull()).withColumn("__y", num(target))
    if name.startswith("dummy"):
        return Fitted(name, None, rows.agg(F.avg("__y") if classify else F.median("__y")).first()[0], {})
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0.0))).first()
    weight = F.when(F.col("__y") == 1, n / (2 * ones) if ones else 1.0).otherwise(n / (2 * (n - ones)) if n > ones else 1.0) if classify else F.lit(1.0)
    ready, stages, used = _stages(rows.withColumn("__w", weight), features)
    kinds = {f.name: f.dataType for f in train.schema.fields}
    text = [c for c in used if not isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    modes = rows.agg(*[F.mode(c).alias(c) for c in text]).first().asDict() if text else {}
    model = Pipeline(stages=[*stages, _classifier(name, n, seed) if classify else _regressor(name, n, seed)]).fit(ready)
    return Fitted(name, model, None, {c: str(modes[c]) if c in text else None for c in used})


def evaluate_classifiers(df: DataFrame, features: Sequence[str], target: str, models: Sequence[str] = CLASSIFIERS, split: TimeSplit = TimeSplit(), tune: str | None = None, seed: int = 42) -> list[dict]:
    """Metrics by model and split; with ``tune`` the threshold is chosen on the validation block."""
    rows = time_split(df.where(F.col(target).isNotNull() & F.col(KEY).isNotNull()), split).cache()
    features, out = [c for c in features if c in df.columns], []
    for name in models:
        scored = fit(rows.where("split = 'train'"), features, target, name, True, seed).score(rows).cache()
        threshold = tune_threshold(scored.where("split = 'valid'"), target, SCORE, tune)[0] if tune else 0.5
        out += [{"model": name, "split": s, "threshold": threshold, **classification_metrics(scored.where(F.col("split") == s), target, SCORE, threshold)} for s in SPLITS]
        scored.unpersist()
    rows.unpersist()
    return out


def evaluate_regressors(df: DataFrame, features: Sequence[str], target: str, models: Sequence[str] = REGRESSORS, split: TimeSplit = TimeSplit(), bounds: tuple[float, float] | None = (0.0, 100.0), seed: int = 42) -> list[dict]:
    rows = time_split(df.where(num(target).isNotNull() & F.col(KEY).isNotNull()), split).cache()
    out = []
    for name in models:
        scored = fit(rows.where("split = 'train'"), features, target, name, False, seed).score(rows)
        if bounds:
            scored = scored.withColumn(SCORE, F.greatest(F.lit(float(bounds[0])), F.least(F.lit(float(bounds[1])), F.col(SCORE))))
        out += [{"model": name, "split": s, **regression_metrics(scored.where(F.col("split") == s), target, SCORE).first().asDict()} for s in SPLITS]
    rows.unpersist()
    return out


def forward_select(df: DataFrame, candidates: Sequence[str], target: str, model: str = "logistic", metric: str = "balanced_accuracy", tune: str = "balanced_accuracy", least_gain: float = 0.0, most: int | None = 8, split: TimeSplit = TimeSplit(), seed: int = 42) -> list[dict]:
    """Greedy: each step adds the feature that is best on the validation block; the first always."""
    rows = time_split(df.where(F.col(target).isNotNull() & F.col(KEY).isNotNull()), split).cache()
    chosen: list[str] = []
    steps: list[dict] = []
    left, best = [c for c in dict.fromkeys(candidates) if c in df.columns], None
    while left and (most is None or len(chosen) < most):
        tried = []
        for c in left:
            scored = fit(rows.where("split = 'train'"), [*chosen, c], target, model, True, seed).score(rows.where("split = 'valid'"))
            m = classification_metrics(scored, target, SCORE, tune_threshold(scored, target, SCORE, tune)[0])
            tried.append((m[metric] if m[metric] is not None else -1.0, m["roc_auc"] or -1.0, m["average_precision"] or -1.0, c))
        top = max(tried, key=lambda t: t[:3])
        if best is not None and top[0] < best + least_gain:
            break
        best = top[0]
        chosen.append(top[3])
        left.remove(top[3])
        steps.append({"step": len(chosen), "feature": top[3], metric: top[0], "roc_auc": top[1], "average_precision": top[2], "features": list(chosen)})
    rows.unpersist()
    return steps


def importance(model: Fitted, top_n: int = 20) -> list[tuple[str, float]]:
    """Coefficients or tree importances by the name of the vector's slot, largest first."""
    last = model.pipeline.stages[-1]
    values = (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()
    names = []
    for stage in model.pipeline.stages:
        if isinstance(stage, VectorAssembler) and stage.getOutputCol() == "__numbers":
            names += [c.removeprefix("__").removesuffix("_i") for c in stage.getInputCols()]
    for stage in model.pipeline.stages:
        if type(stage).__name__ == "StringIndexerModel":
            for c, labels in zip(stage.getOutputCols(), stage.labelsArray, strict=True):
                names += [f"{c.removeprefix('__').removesuffix('_x')}={v}" for v in [*labels, "(other)"]]
    names += [f"slot{i}" for i in range(len(names), len(values))]
    return sorted(zip(names, map(float, values), strict=False), key=lambda p: (-abs(p[1]), p[0]))[:top_n]


def permutation_importance(model: Fitted, df: DataFrame, target: str, metric: str = "roc_auc", repeats: int = 5, seed: int = 42) -> list[tuple[str, float]]:
    """Mean loss of the metric when a raw column is shuffled: rows trade values by joining two random
    orders of row numbers."""
    base = classification_metrics(model.score(df), target, SCORE)[metric]
    out = []
    for c in model.columns:
        losses = []
        for k in range(repeats):
            place = lambda s: F.row_number().over(Window.orderBy(F.rand(s)))
            values = df.select(F.col(c).alias("__v"), place(seed + 31 * k).alias("__i")).cache()
            mixed = df.drop(c).withColumn("__i", place(seed + 31 * k + 7)).join(values, "__i").withColumnRenamed("__v", c).drop("__i")
            got = classification_metrics(model.score(mixed), target, SCORE)[metric]
            losses.append((base or 0.0) - (got or 0.0))
            values.unpersist()
        out.append((c, sum(losses) / len(losses)))
    return sorted(out, key=lambda p: (-p[1], p[0]))
