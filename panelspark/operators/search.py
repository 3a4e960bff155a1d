"""Search over all subsets of sources or columns, backward elimination and backtests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.gram import Fit, Gram, fit, load_gram, packed_gram, raw_coefficients
from panelspark.operators.scalars import with_scalars
from panelspark.operators.sweep import Sweeper, gray, superset_sums
from panelspark.operators.whole import day, lagged, map_series

SUBSET_LIMIT = 20  # 2**20 fits; each more source doubles the work


def subsets(spark: SparkSession, names: list[str]) -> DataFrame:
    """All non-empty subsets: ``mask``, its members in the given order and their count."""
    if len(names) > SUBSET_LIMIT:
        raise ValueError(f"{len(names)} names have 2**{len(names)} subsets; the limit is {SUBSET_LIMIT} names")
    listed = F.array(*[F.lit(x) for x in names])
    masks = spark.range(1, 2 ** len(names)).select(F.col("id").alias("mask"))
    # A column cannot be shifted by a column here, so the bit is read by division.
    bit = lambda x, i: F.floor(F.col("mask") / F.pow(F.lit(2.0), i)) % 2 == 1
    return masks.select("mask", F.filter(listed, bit).alias("members")).withColumn("length", F.size("members"))


def backward(g: Gram, xs: list[int], y: int, limit: float = 0.05, rounds: int = 5) -> Fit | None:
    """Drop every term with a p-value over ``limit`` and fit again, ``rounds`` times.

    The constant is a term like the others. None when no term is left.
    """
    model = fit(g, xs, y)
    for _ in range(rounds):
        keep = model.p <= limit
        constant = bool(model.constant and keep[0])
        rest = [x for x, k in zip(model.order, keep[1:] if model.constant else keep) if k]
        if not rest and not constant:
            return None
        if constant == model.constant and len(rest) == len(model.order):
            return model
        model = fit(g, rest, y, constant)
    return model


def r2_on(test: Gram, train: Gram, model: Fit, y: int) -> float:
    """R2 of a fitted model on other rows, from their cross-products alone."""
    xs = model.order
    beta = model.coef[1:] if model.constant else model.coef
    start = model.coef[0] if model.constant else 0.0
    z_mean = (test.mean[xs] - train.mean[xs]) / model.scale
    z_cp = test.cp[np.ix_(xs, xs)] / np.outer(model.scale, model.scale)
    bias = test.mean[y] - start - beta @ z_mean
    sse = test.cp[y, y] - 2 * beta @ (test.cp[xs, y] / model.scale) + beta @ z_cp @ beta + test.n * bias * bias
    return float(1.0 - sse / test.cp[y, y]) if test.cp[y, y] > 0 else float("nan")


RESULT_SCHEMA = ("mask bigint, combination string, columns array<string>, length int, n_features int, n_train bigint, "
                 "n_test bigint, r2_adj_train double, r2_test double, status string, "
                 "terms array<struct<feature:string,coefficient:double,p_value:double>>")


def _null_mask(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    bits = [F.when(F.greatest(*[F.col(f"`{c}`").isNull().cast("int") for c in cols], F.lit(0)) == 1, F.lit(1 << i)).otherwise(F.lit(0))
            for i, cols in enumerate(groups.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return df.withColumn("_null", total.cast("bigint"))


def search_subsets(df: DataFrame, y: str, groups: dict[str, list[str]], split: str = "split", eliminate: bool = True,
                   limit: float = 0.05, rounds: int = 5, sample: str = "common", tasks: int | None = None) -> DataFrame:
    """Fit every non-empty subset of ``groups`` (name to columns) and score it on the test rows.

    One pass over ``df`` gives the cross-products of train and test; no row is read again. ``sample='common'`` uses
    the rows that are complete for all groups: the subsets are dealt out along a Gray code, and a task goes from one
    to the next by sweeping the columns of one group in or out. ``'per_subset'`` uses, for each subset, the rows
    complete for its groups: rows are summed by the set of groups that are missing, and the sums of all sets that
    miss none of a subset's groups are added up for every subset at once, in tasks, with no matrix on the driver.
    Scaling is by the train rows of the same sample.
    """
    spark, names = df.sparkSession, list(groups)
    if len(names) > SUBSET_LIMIT:
        raise ValueError(f"{len(names)} groups have 2**{len(names)} subsets; the limit is {SUBSET_LIMIT} groups")
    cols = list(dict.fromkeys(c for g in groups.values() for c in g))
    at = {c: i for i, c in enumerate(cols)}
    used = [{at[c] for c in groups[g]} for g in names]
    rows = df.where(F.col(split).isin("train", "test")).where(F.col(f"`{y}`").isNotNull())
    y_at, n = len(cols), 2 ** len(names) - 1

    def columns_of(mask: int) -> set[int]:
        return set().union(*[u for i, u in enumerate(used) if mask >> i & 1])

    def one(mask: int, train: Gram | None, test: Gram | None, sweeper: Sweeper | None) -> dict:
        members = [i for i in range(len(names)) if mask >> i & 1]
        out = {"mask": mask, "combination": ",".join(names[i] for i in members), "columns": [], "length": len(members), "n_features": 0,
               "n_train": train.n if train else 0, "n_test": test.n if test else 0, "r2_adj_train": None, "r2_test": None,
               "status": "no rows", "terms": []}
        if train is None or test is None or train.n < 3 or not test.n:
            return out
        sweeper = sweeper or Sweeper(train, y_at)
        sweeper.move(columns_of(mask))
        model = sweeper.eliminate(limit, rounds) if eliminate else sweeper.model()
        if model is None:
            return {**out, "status": "no term left"}
        features = (["const"] if model.constant else []) + [cols[i] for i in model.order]
        terms = [{"feature": a, "coefficient": float(b), "p_value": float(p)} for a, b, p in zip(features, model.coef, model.p)]
        score = r2_on(test, train, model, y_at)
        known = lambda v: float(v) if v == v else None
        return {**out, "columns": features, "n_features": len(features), "r2_adj_train": known(model.r2_adj), "r2_test": known(score),
                "status": "ok" if np.isfinite(score) and np.isfinite(model.r2_adj) else "degenerate", "terms": terms}

    if sample == "per_subset":
        filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in cols]
        complete = _null_mask(rows, groups).select("_null", F.col(split).alias("_split"), y, *filled)
        parts = packed_gram(complete, [*cols, y], ["_null", "_split"]).withColumnRenamed("_null", "_set")
        # A subset whose complement holds no set of missing groups has no rows; two empty sums give it a row all the same.
        nothing = spark.createDataFrame([(0, s, 0, [0.0] * (y_at + 1), [0.0] * ((y_at + 1) * (y_at + 2) // 2)) for s in ("train", "test")],
                                        "_set bigint, _split string, n bigint, mean array<double>, cp array<double>")
        # The sets that miss none of a subset's groups are the subsets of its complement.
        solve = lambda missing, found: one(n ^ missing, found["train"], found["test"], None)
        return superset_sums(parts.unionByName(nothing), "_split", len(names), y_at + 1, solve, RESULT_SCHEMA).where("mask > 0")
    grams = load_gram(packed_gram(rows, [*cols, y], split), split)
    train, test = grams.get("train"), grams.get("test")

    def walk(batches):
        sweeper = Sweeper(train, y_at) if train else None
        for batch in batches:
            out = pd.DataFrame([one(gray(int(i)), train, test, sweeper) for i in batch["id"]])
            yield out.where(out.notna(), None)

    width = tasks or max(1, min(spark.sparkContext.defaultParallelism, n // 16 + 1))
    return spark.range(1, n + 1, 1, width).mapInPandas(walk, RESULT_SCHEMA)


@dataclass
class LinearModel:
    """A least squares fit on unscaled columns: one row per term in ``terms``, ``const`` first if it is kept."""

    y: str
    columns: list[str]
    features: list[str]
    coefficient: np.ndarray
    std_error: np.ndarray
    p_value: np.ndarray
    n_train: int
    n_test: int
    r2_adj_train: float
    r2_test: float

    def terms(self, spark: SparkSession) -> DataFrame:
        rows = zip(self.features, *[map(float, v) for v in (self.coefficient, self.std_error, self.p_value)])
        return spark.createDataFrame(list(rows), "feature string, coefficient double, std_error double, p_value double")

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the fitted value; NULL where a kept column is."""
        value = F.lit(0.0)
        for f, b in zip(self.features, self.coefficient):
            value = value + (F.lit(float(b)) if f == "const" else F.lit(float(b)) * F.col(f"`{f}`").cast("double"))
        return df.withColumn(name, value)


def fit_one(df: DataFrame, y: str, columns: list[str], split: str = "split", eliminate: bool = True, limit: float = 0.05, rounds: int = 5) -> LinearModel | None:
    """Fit one list of columns on the train rows that have them all, and score it on such test rows.

    One pass over the rows. Terms are dropped on the standardised scale, as in ``search_subsets``; the result is on the
    unscaled columns. None without train rows, or when no term is left.
    """
    grams = load_gram(packed_gram(df.where(F.col(split).isin("train", "test")), [*columns, y], split), split)
    train, test = grams.get("train"), grams.get("test")
    if train is None or train.n < 3:
        return None
    sweeper = Sweeper(train, len(columns))
    sweeper.move(set(range(len(columns))))
    model = sweeper.eliminate(limit, rounds) if eliminate else sweeper.model()
    if model is None:
        return None
    beta = (model.coef[1:] if model.constant else model.coef) / model.scale
    # The columns are centred in the fit, so the unscaled form needs a constant even where the fit dropped its own.
    mean = train.mean[model.order]
    start = (model.coef[0] if model.constant else 0.0) - float(beta @ mean)
    sigma2 = model.ssr / model.df_resid if model.df_resid > 0 else np.nan
    inverse = model.inverse / np.outer(model.scale, model.scale)
    se = np.sqrt(sigma2 * np.concatenate([[(1.0 / train.n if model.constant else 0.0) + mean @ inverse @ mean], np.diag(inverse)]))
    p_values = np.asarray(model.p, float)
    score = r2_on(test, train, model, len(columns)) if test is not None else float("nan")
    return LinearModel(y, list(columns), ["const", *[columns[i] for i in model.order]], np.concatenate([[start], beta]), se,
                       p_values if model.constant else np.concatenate([[np.nan], p_values]), train.n, test.n if test else 0, float(model.r2_adj), score)


def coefficients(results: DataFrame) -> DataFrame:
    """One row per subset and term of the fitted model."""
    return results.select("mask", "combination", F.inline("terms"))


def candidates(results: DataFrame, size: int | None = None, must: str | None = None, k: int | None = None) -> DataFrame:
    """All subsets, or the best ``k``, of a size that hold a given source: by test R2, then the shorter one, then its mask."""
    rows = results.where("status = 'ok'")
    if size is not None:
        rows = rows.where(F.col("length") == size)
    if must is not None:
        rows = rows.where(F.array_contains(F.split("combination", ","), must))
    ordered = rows.orderBy(F.desc("r2_test"), F.asc("length"), F.asc("mask"))
    return ordered if k is None else ordered.limit(k)


def time_folds(df: DataFrame, date: str, folds: int = 3, horizon: int = 7) -> DataFrame:
    """Expanding folds: train before ``test_from``, test ``horizon`` days; the last fold ends at the last date."""
    last = df.agg(F.max(date).alias("last"))
    start = F.date_sub(F.col("_s.last"), ((F.lit(folds) - F.col("fold")) * horizon + horizon - 1).cast("int"))
    return (with_scalars(df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold")).withColumn("fold", F.col("fold") + 1), last)
            .select("fold", F.date_sub(start, 1).alias("train_to"), start.alias("test_from"), F.date_add(start, horizon - 1).alias("test_to")))


def walk_forward(df: DataFrame, keys: list[str], date: str, col: str, p: int, d: int = 1, n: int = 10) -> DataFrame:
    """Refit an AR(p) on the d-times differenced series before each of its last ``n`` days, predict that day.

    The history of an origin is not copied: its cross-products are those of the origin before and one more row. The
    prediction is on the original level; it is NULL while there are no more rows than coefficients.
    """
    def one(y, days):
        w = np.diff(y, d) if len(y) > d else np.zeros(0)
        z = lagged(w, p)
        first, out = max(len(z) - n, 0), []
        total = Gram.of(z[:first])
        for i in range(first, len(z)):
            at = i + p + d
            guess = None
            if total.n > p + 1:
                beta, _ = raw_coefficients(total, fit(total, range(p), p))
                guess = float(y[at] - w[i + p] + beta[0] + beta[1:] @ z[i, :p])
            out.append({date: day(days[at]), "y": float(y[at]), "yhat": guess})
            total = total + Gram.of(z[i:i + 1])
        return out

    return map_series(df, keys, date, col, one, f"`{date}` {dict(df.dtypes)[date]}, y double, yhat double")
