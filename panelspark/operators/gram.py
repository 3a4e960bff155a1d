"""Regression from cross-products: one pass over the rows, then algebra on a p x p matrix.

A *packed Gram* row holds, per group, the row count ``n``, the column means ``mean`` and the centred
cross-products ``cp`` (upper triangle, row by row) of the listed columns. It is all a least squares
fit needs, and two of them can be merged exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.tails import t_pvalue, t_two_sided

NATIVE_LIMIT = 5  # columns; beyond 15 pair aggregates the matrix product is the faster way
COLUMN_LIMIT = 1500  # a packed row of this width is 9 MB; ``tiles`` has no such limit
TILED_OVER = 100  # columns from which cross-products without groups go by tiles


def _names(df_by) -> list[str]:
    return [df_by] if isinstance(df_by, str) else list(df_by or [])


def packed_gram(df: DataFrame, cols: list[str], by=None, method: str = "auto") -> DataFrame:
    """Rows ``(by..., n, mean, cp)`` over the rows where all ``cols`` are present (neither NULL nor NaN).

    Both ways read the rows once. ``native`` uses Spark's own mergeable covariance aggregates.
    ``arrow`` is for wide designs: each task forms the matrix of its rows with numpy, and only these
    matrices are shuffled and merged.
    """
    by, m = _names(by), len(cols)
    if m > COLUMN_LIMIT:
        raise ValueError(f"{m} columns give a matrix too large for one row; the limit is {COLUMN_LIMIT}")
    # The row travels as one array: a NULL test over many columns that are later renamed would make
    # the optimizer derive a constraint for every combination of old and new names.
    rows = (df.select(*by, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("_x"))
            .where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v))))
    if method == "native" or (method == "auto" and m <= NATIVE_LIMIT):
        x = [F.col("_x")[i] for i in range(m)]
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        made = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(v) for v in x]).alias("mean"),
                                     F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("_c"))
        return made.select(*by, "n", "mean", F.transform("_c", lambda c: c * F.col("n")).alias("cp"))
    kinds = dict(rows.dtypes)
    final = ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["n bigint, mean array<double>, cp array<double>"])
    partial = rows.mapInArrow(_partial_grams(by, m), final + ", _salt int")
    # Two levels, so that the matrices of a group found in every task do not all go to one task.
    salted = [*by, "_salt"]
    few = (partial.repartition(*salted).sortWithinPartitions(*salted).mapInArrow(_merge_grams(salted, m), final + ", _salt int")
           .drop("_salt"))
    together = few.repartition(*by).sortWithinPartitions(*by) if by else few.repartition(1)
    return together.mapInArrow(_merge_grams(by, m), final)


SALTS = 64


def _to_batch(keys: list[str], found: list[tuple[list, "Gram"]], **more) -> pa.RecordBatch:
    """``found`` pairs Arrow key values with Grams."""
    grams = [g for _, g in found]
    return pa.RecordBatch.from_pydict({
        **{k: pa.array([values[i].as_py() for values, _ in found], found[0][0][i].type) for i, k in enumerate(keys) if k != "_salt"},
        "n": pa.array([g.n for g in grams], pa.int64()), "mean": pa.array([g.mean for g in grams], pa.list_(pa.float64())),
        "cp": pa.array([g.packed_cp() for g in grams], pa.list_(pa.float64())),
        **({"_salt": pa.array([values[keys.index("_salt")].as_py() for values, _ in found], pa.int32())} if "_salt" in keys else {}), **more})


def _groups(batch: pa.RecordBatch, by: list[str]):
    """Key values, NULL included as None, and the rows that have them."""
    if not by:
        yield None, slice(None)
        return
    codes = batch.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
        yield tuple(batch.column(b)[int(at[0])].as_py() for b in by), at


def _partial_grams(by: list[str], m: int):
    """One packed Gram per task, and per group; groups are let go when many are held."""
    def run(batches):
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS
        held: dict = {}

        def emit():
            return _to_batch(by, list(held.values()), _salt=pa.array([salt] * len(held), pa.int32()))

        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            for name, at in _groups(batch, by):
                g = Gram.of(x[at])
                if name in held:
                    held[name] = (held[name][0], held[name][1] + g)
                elif g.n:
                    held[name] = ([batch.column(b)[int(at[0])] for b in by], g)
            if len(held) * m * m > 4_000_000:
                yield emit()
                held.clear()
        if held:
            yield emit()

    return run


def _merge_grams(keys: list[str], m: int):
    """Merge neighbouring rows of equal keys as they stream by; only one Gram is held at a time."""
    def run(batches):
        current = values = total = None
        done: list = []
        for batch in batches:
            means = batch.column("mean").flatten().to_numpy().reshape(-1, m)
            cps = batch.column("cp").flatten().to_numpy().reshape(-1, m * (m + 1) // 2)
            names = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            for i, n in enumerate(batch.column("n").to_pylist()):
                g = Gram.unpack(n, means[i], cps[i])
                if names[i] == current:
                    total = total + g
                    continue
                if current is not None:
                    done.append((values, total))
                current, values, total = names[i], [batch.column(k)[i] for k in keys], g
            if len(done) * m * m > 4_000_000:
                yield _to_batch(keys, done)
                done = []
        if current is not None:
            done.append((values, total))
        if done:
            yield _to_batch(keys, done)

    return run


def spread(packed: DataFrame, by: list[str]) -> DataFrame:
    """Deal the groups out to all cores. The rows are few and small, so that left to itself the
    adaptive planner would solve them all in one task."""
    return packed.repartition(packed.sparkSession.sparkContext.defaultParallelism, *by) if by else packed


def gram(df: DataFrame, cols: list[str], by=None, method: str = "auto") -> DataFrame:
    """Cross-products of the standardised columns as rows ``(by..., i, j, s)``, population scale.

    A constant column has no scale and stays at zero.
    """
    m, by = len(cols), _names(by)
    if m > TILED_OVER and not by:
        from panelspark.operators import tiles

        cell = tiles.cells(tiles.tiled_gram(df, cols))
        s = F.coalesce(F.col("corr") * F.col("n"), F.lit(0.0))
        name = lambda c: F.element_at(F.array(*map(F.lit, cols)), F.col(c) + 1)
        both = cell.select("i", "j", s.alias("s")).unionAll(cell.where("i < j").select("j", "i", s))
        return both.select(name("i").alias("i"), name("j").alias("j"), "s")
    at = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(m) for j in range(i, m))}
    cell = lambda i, j: F.col("cp")[at[min(i, j), max(i, j)]]
    scale = lambda i: F.sqrt(cell(i, i) / F.col("n"))
    rows = [F.struct(F.lit(cols[i]).alias("i"), F.lit(cols[j]).alias("j"),
                     F.coalesce(F.try_divide(cell(i, j), scale(i) * scale(j)), F.lit(0.0)).alias("s"))
            for i in range(m) for j in range(m)]
    return packed_gram(df, cols, by, method).select(*by, F.inline(F.array(*rows)))


@dataclass
class Gram:
    """A packed row as numpy arrays."""

    n: int
    mean: np.ndarray
    cp: np.ndarray

    @classmethod
    def unpack(cls, n, mean, cp) -> "Gram":
        mean = np.asarray(mean, float)
        full = np.zeros((len(mean), len(mean)))
        full[np.triu_indices(len(mean))] = np.asarray(cp, float)
        return cls(int(n), mean, full + np.triu(full, 1).T)

    @classmethod
    def of(cls, x: np.ndarray) -> "Gram":
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        z = x - mean
        return cls(len(x), mean, z.T @ z)

    def packed_cp(self) -> np.ndarray:
        return self.cp[np.triu_indices(len(self.mean))]

    def __add__(self, other: "Gram") -> "Gram":
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Gram(n, self.mean + gap * (other.n / n), self.cp + other.cp + np.outer(gap, gap) * (self.n * other.n / n))


@dataclass
class Fit:
    """Least squares on standardised columns. ``order`` lists the columns, the constant comes first."""

    order: list[int]
    constant: bool
    coef: np.ndarray
    se: np.ndarray
    df_resid: float
    ssr: float
    r2: float
    r2_adj: float
    inverse: np.ndarray
    scale: np.ndarray

    @property
    def p(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return t_two_sided(self.coef / self.se, self.df_resid)


def fit(g: Gram, xs: list[int], y: int, constant: bool = True) -> Fit:
    """Fit ``y`` on the standardised columns ``xs``; collinear columns share their effect (pseudo-inverse)."""
    xs = list(xs)
    scale = np.sqrt(np.maximum(np.diag(g.cp)[xs], 0.0) / g.n)
    scale[scale <= 1e-14 * np.maximum(np.abs(g.mean[xs]), 1e-300)] = np.inf
    corr = g.cp[np.ix_(xs, xs)] / np.outer(scale, scale) / g.n
    values, vectors = np.linalg.eigh(corr) if xs else (np.zeros(0), np.zeros((0, 0)))
    kept = values > 1e-11 * max(len(xs), 1)
    inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T / g.n
    zy = g.cp[xs, y] / scale
    beta = inverse @ zy
    level = g.n * g.mean[y] ** 2
    ssr = max(g.cp[y, y] - beta @ zy, 0.0) + (0.0 if constant else level)
    total = g.cp[y, y] + (0.0 if constant else level)
    df_resid = g.n - int(kept.sum()) - int(constant)
    sigma2 = ssr / df_resid if df_resid > 0 else np.nan
    coef = np.concatenate([[g.mean[y]] if constant else [], beta])
    se = np.sqrt(sigma2 * np.concatenate([[1.0 / g.n] if constant else [], np.maximum(np.diag(inverse), 0.0)]))
    r2 = 1.0 - ssr / total if total > 0 else np.nan
    r2_adj = 1.0 - (g.n - int(constant)) / df_resid * (1.0 - r2) if df_resid > 0 else np.nan
    return Fit(xs, constant, coef, se, df_resid, ssr, r2, r2_adj, inverse, scale)


def raw_coefficients(g: Gram, f: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors on the unscaled columns, constant first."""
    beta, m = f.coef[1:] / f.scale, g.mean[f.order]
    sigma2 = f.ssr / f.df_resid if f.df_resid > 0 else np.nan
    inverse = f.inverse / np.outer(f.scale, f.scale)
    variance = np.concatenate([[1.0 / g.n + m @ inverse @ m], np.diag(inverse)])
    return np.concatenate([[f.coef[0] - beta @ m], beta]), np.sqrt(sigma2 * variance)


def ols(df: DataFrame, y: str, xs: list[str], by=None, method: str = "auto") -> DataFrame:
    """Least squares with constant, one row per group and term, on the unscaled columns."""
    by = _names(by)
    kinds = dict(df.dtypes)
    packed = packed_gram(df, [*xs, y], by, method)
    terms = ["const", *xs]

    def solve(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                g = Gram.unpack(row["n"], row["mean"], row["cp"])
                f = fit(g, range(len(xs)), len(xs))
                coef, se = raw_coefficients(g, f)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = coef / se
                yield pd.DataFrame({**{b: row[b] for b in by}, "feature": terms, "coefficient": coef, "std_error": se, "t": t,
                                    "p_value": t_two_sided(t, f.df_resid), "n": g.n, "r2": f.r2, "r2_adj": f.r2_adj})

    schema = ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["feature string, coefficient double, std_error double, t double, "
                                                          "p_value double, n bigint, r2 double, r2_adj double"])
    return spread(packed, by).mapInPandas(solve, schema)


def load_gram(packed: DataFrame, key: str | None = None) -> dict:
    """Bring packed rows to the driver, keyed by one group column. Meant for a few groups only."""
    return {(r[key] if key else None): Gram.unpack(r["n"], r["mean"], r["cp"]) for r in packed.collect()}


def press(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Leave-one-out error sum and predicted R2 of the least squares fit with constant.

    The p x p solution travels to the tasks; each sends back one partial sum.
    """
    p = len(xs)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate([*xs, y])]).dropna()
    g = load_gram(packed_gram(rows, rows.columns))[None]
    f = fit(g, range(p), p)
    coef, scale, inverse, mean, n = f.coef[1:], f.scale, f.inverse, g.mean, g.n

    def partial(batches):
        press_sum = rss = 0.0
        for batch in batches:
            values = batch.to_numpy(float)
            z = (values[:, :p] - mean[:p]) / scale
            residual = values[:, p] - mean[p] - z @ coef
            leverage = 1.0 / n + np.einsum("ij,jk,ik->i", z, inverse, z)
            press_sum += float(np.sum((residual / (1.0 - leverage)) ** 2))
            rss += float(np.sum(residual ** 2))
        yield pd.DataFrame({"press": [press_sum], "rss": [rss]})

    sums = rows.mapInPandas(partial, "press double, rss double").agg(F.sum("press").alias("press"), F.sum("rss").alias("rss"))
    return sums.select(F.lit(n).cast("bigint").alias("n"), "press", "rss",
                       (1 - F.col("press") / F.lit(float(g.cp[p, p]))).alias("r2_predicted"))


def metrics(df: DataFrame, y: str, yhat: str, by=None) -> DataFrame:
    """R2, mean squared error and its root, mean absolute percentage error; one pass."""
    real, guess = F.col(y).cast("double"), F.col(yhat).cast("double")
    error = real - guess
    floor = F.lit(2.220446049250313e-16)
    agg = df.dropna(subset=[y, yhat]).groupBy(*_names(by)).agg(
        F.count("*").alias("n"), F.avg(error * error).alias("mse"), F.var_pop(real).alias("_v"),
        F.avg(F.abs(error) / F.greatest(F.abs(real), floor)).alias("mape"))
    return agg.select(*_names(by), "n", (1 - F.try_divide("mse", "_v")).alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mape")


def ttest_1samp(df: DataFrame, col: str, mu: float = 0.0, by=None) -> DataFrame:
    v = F.col(f"`{col}`").cast("double")
    agg = df.groupBy(*_names(by)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    gap, error = F.col("mean") - F.lit(float(mu)), F.col("std") / F.sqrt("n")
    # Values without any spread are infinitely far from another mean, and undecided at the mean itself.
    limit = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    t = F.when(error > 0, F.try_divide(gap, error)).when(error == 0, limit)
    return agg.withColumn("t", t).withColumn("p_value", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))
