"""Scaling, splits, AR models and the learners of ``pyspark.ml``."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.tails import t_two_sided
from panelspark.operators.gram import Gram, fit, raw_coefficients
from panelspark.operators.scalars import with_scalars
from panelspark.operators.whole import day, lagged, map_series

DEPTH_LIMIT = 30  # the deepest tree Spark grows


def _q(name: str):
    return F.col(f"`{name}`")


def _replace(df: DataFrame, made: dict) -> DataFrame:
    return df.select(*[made[c].alias(c) if c in made else _q(c) for c in df.columns if c != "_s"])


def scale(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Standardise by mean and population deviation of ``train``. A constant column becomes 0."""
    stats = train.agg(*[a for i, c in enumerate(cols) for a in (F.avg(_q(c)).alias(f"m{i}"), F.stddev_pop(_q(c)).alias(f"d{i}"))])
    made = {c: (_q(c) - F.col(f"_s.m{i}")) / F.when(F.col(f"_s.d{i}") > 0, F.col(f"_s.d{i}")).otherwise(1.0) for i, c in enumerate(cols)}
    return _replace(with_scalars(train, stats), made), _replace(with_scalars(test, stats), made)


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scale to [0, 1] by the range of the data. A constant column becomes 0."""
    stats = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(_q(c)).alias(f"a{i}"), F.max(_q(c)).alias(f"b{i}"))])
    made = {}
    for i, c in enumerate(cols):
        span = F.col(f"_s.b{i}") - F.col(f"_s.a{i}")
        made[c] = (_q(c) - F.col(f"_s.a{i}")) / F.when(span > 0, span).otherwise(1.0)
    return _replace(with_scalars(df, stats), made)


def hash_split(df: DataFrame, date: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``split`` by a hash of the day: the same day always falls on the same side.

    A multiplicative hash of the day number modulo a prime; plain arithmetic in any engine.
    """
    place = F.pmod((F.unix_date(date).cast("bigint") + seed) * 48271 % 2147483647 * 69621, F.lit(2147483647)) % 10_000
    return df.withColumn("split", F.when(place < round(share * 10_000), "test").otherwise("train"))


def residuals(df: DataFrame, y: str, yhat: str, keep: list[str], name: str = "residual") -> DataFrame:
    return df.select(*keep, (_q(y) - _q(yhat)).alias(name))


def _conditional(w: np.ndarray, p: int):
    """Least squares of a series on its p lags and a constant: the fit, coefficients and their errors; None without rows."""
    z = lagged(w, p)
    if not len(z):
        return None
    g = Gram.of(z)
    f = fit(g, range(p), p)
    return g, f, *raw_coefficients(g, f)


def ar_fit(df: DataFrame, keys: list[str], date: str, col: str, p: int, d: int = 1) -> DataFrame:
    """AR(p) with constant on the d-times differenced series, by conditional least squares.

    One row per series and term. The first ``p + d`` values only serve as lags.
    """
    terms = ["const", *[f"ar_{k}" for k in range(1, p + 1)]]

    def one(y, _):
        made = _conditional(np.diff(y, d), p) if len(y) > d else None
        if made is None:
            return []
        g, f, coef, se = made
        with np.errstate(divide="ignore", invalid="ignore"):
            t = coef / se
        return [{"feature": a, "coefficient": b, "std_error": s, "t": x, "p_value": v, "n": g.n, "r2": f.r2, "r2_adj": f.r2_adj}
                for a, b, s, x, v in zip(terms, coef, se, t, t_two_sided(t, f.df_resid))]

    return map_series(df, keys, date, col, one, "feature string, coefficient double, std_error double, t double, p_value double, n bigint, r2 double, r2_adj double")


def ar_forecast(df: DataFrame, keys: list[str], date: str, col: str, p: int, d: int = 1, horizon: int = 7) -> DataFrame:
    """Forecast ``horizon`` days on the original level from an AR(p) fit on the d-times differenced series."""
    def one(y, days):
        made = _conditional(np.diff(y, d), p) if len(y) > d else None
        if made is None:
            return []
        beta, recent, levels, out = made[2], list(np.diff(y, d)), [np.diff(y, k)[-1] for k in range(d)], []
        for h in range(1, horizon + 1):
            value = beta[0] + sum(b * v for b, v in zip(beta[1:], recent[::-1]))
            recent.append(value)
            for k in range(d - 1, -1, -1):  # the steps add up to slopes, the slopes to levels
                levels[k] += value
                value = levels[k]
            out.append({"step": h, date: day(days[-1] + h), "forecast": float(value)})
        return out

    return map_series(df, keys, date, col, one, f"step int, `{date}` date, forecast double")


def _assemble(features: list[str], invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid=invalid)


def incomplete(df: DataFrame, features: list[str]) -> int:
    """How many rows lack a feature (NULL or NaN): those that ``invalid='skip'`` leaves out."""
    lacks = F.exists(F.array(*[_q(c).cast("double") for c in features]), lambda v: v.isNull() | F.isnan(v))
    return df.agg(F.count_if(lacks)).first()[0]


def _depth(depth: int) -> int:
    if depth > DEPTH_LIMIT:
        raise ValueError(f"a tree can have {DEPTH_LIMIT} levels in Spark, not {depth}")
    return depth


# The learners stop at a row that lacks a feature. ``invalid='skip'`` leaves such rows out of fit and score, and
# ``incomplete`` counts them.

def forest(train: DataFrame, y: str, features: list[str], trees: int = 100, depth: int = DEPTH_LIMIT, seed: int = 42, bootstrap: bool = True,
           bins: int = 32, invalid: str = "error") -> PipelineModel:
    """Random forest in which every split may use all features."""
    learner = RandomForestRegressor(featuresCol="_features", labelCol=y, numTrees=trees, maxDepth=_depth(depth), maxBins=bins,
                                    featureSubsetStrategy="all", bootstrap=bootstrap, seed=seed)
    return Pipeline(stages=[_assemble(features, invalid), learner]).fit(train)


def boosting(train: DataFrame, y: str, features: list[str], rounds: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42, bins: int = 32,
             invalid: str = "error") -> PipelineModel:
    """Gradient boosted trees. A depth beyond Spark's limit is an error."""
    learner = GBTRegressor(featuresCol="_features", labelCol=y, maxIter=rounds, stepSize=rate, maxDepth=_depth(depth), maxBins=bins, seed=seed)
    return Pipeline(stages=[_assemble(features, invalid), learner]).fit(train)


def linear(train: DataFrame, y: str, features: list[str], invalid: str = "error") -> PipelineModel:
    """Standard scaling and plain least squares."""
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    learner = LinearRegression(featuresCol="_scaled", labelCol=y, solver="normal")
    return Pipeline(stages=[_assemble(features, invalid), scaler, learner]).fit(train)


def pca_forest(train: DataFrame, y: str, features: list[str], share: float = 0.999999, trees: int = 1000, depth: int = DEPTH_LIMIT, seed: int = 42,
               bootstrap: bool = True, bins: int = 32, invalid: str = "error") -> PipelineModel:
    """Centre, project on the fewest components that hold ``share`` of the variance, scale, forest.

    The components are fitted once, all of them; the leading ones are sliced off.
    """
    head = Pipeline(stages=[_assemble(features, invalid), StandardScaler(inputCol="_features", outputCol="_centred", withMean=True, withStd=False),
                            PCA(k=len(features), inputCol="_centred", outputCol="_all")]).fit(train)
    held = np.cumsum(head.stages[-1].explainedVariance.toArray())
    k = min(int(np.searchsorted(held, share)) + 1, len(features))
    tail = Pipeline(stages=[
        VectorSlicer(inputCol="_all", outputCol="_components", indices=list(range(k))),
        StandardScaler(inputCol="_components", outputCol="_scaled", withMean=True, withStd=True),
        RandomForestRegressor(featuresCol="_scaled", labelCol=y, numTrees=trees, maxDepth=_depth(depth), maxBins=bins, featureSubsetStrategy="all",
                              bootstrap=bootstrap, seed=seed),
    ]).fit(head.transform(train))
    return PipelineModel(stages=[*head.stages, *tail.stages])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_features", "_scaled", "_centred", "_all", "_components")


def importance(model: PipelineModel, features: list[str], spark, k: int = 20) -> DataFrame:
    """Features of a tree model by importance. One row per feature, so it is as small as the model."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def rfe_time(df: DataFrame, date: str, y: str, features: list[str], folds: list[tuple], step: int = 50, minimum: int = 1,
             trees: int = 100, depth: int = DEPTH_LIMIT, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Recursive elimination over given folds ``(train_to, test_from, test_to)``: the mean R2 per size, and the features kept.

    ``elimination.RecursiveElimination`` is the estimator behind it."""
    from panelspark.operators.elimination import RecursiveElimination

    how = RecursiveElimination(labelCol=y, dateCol=date, features=list(features), step=step, minimum=minimum, numTrees=trees, maxDepth=depth, seed=seed)
    made = how.fit_folds(how._staged(df), folds)
    return made.scores(df.sparkSession).drop("folds"), made.selected
