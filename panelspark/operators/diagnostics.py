"""Autocorrelation, portmanteau and unit-root tests per series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelspark.functions.tails import chi2_pvalue, normal_cdf
from panelspark.operators.gram import Gram, fit, spread
from panelspark.operators.series import series_window
from panelspark.operators.whole import map_series


def _q(name: str):
    return F.col(f"`{name}`")


def acf(df: DataFrame, keys: list[str], date: str, col: str, lags: int = 20) -> DataFrame:
    """Autocorrelation at lag 0 to ``lags``: rows ``(keys..., lag, n, acf)``. NULL values are left out."""
    w = series_window(keys, date)
    rows = df.where(_q(col).isNotNull()).select(*keys, date, _q(col).cast("double").alias("_v"))
    centred = rows.select(*keys, date, (F.col("_v") - F.avg("_v").over(W.partitionBy(*keys))).alias("_v"))
    shifted = centred.select(*keys, "_v", *[F.lag("_v", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = shifted.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_v") * F.col("_v")).alias("_s0"),
                                      *[F.sum(F.col("_v") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    ratios = F.array(*[F.try_divide(F.coalesce(f"_s{k}", F.lit(0.0)), F.col("_s0")) for k in range(lags + 1)])
    return sums.select(*keys, "n", F.posexplode(ratios).alias("lag", "acf")).select(*keys, "lag", "n", "acf")


def pacf(acf_df: DataFrame, keys: list[str]) -> DataFrame:
    """Partial autocorrelation from an ACF table, by the Durbin-Levinson recursion over its lags."""
    kinds = dict(acf_df.dtypes)

    def recurse(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                r = np.asarray(row.pop("_r"), float)
                out, phi = [1.0], np.zeros(0)
                for k in range(1, len(r)):
                    back = r[k - 1:0:-1]
                    last = (r[k] - phi @ back) / (1.0 - phi @ r[1:k])
                    phi = np.append(phi - last * phi[::-1], last)
                    out.append(last)
                yield pd.DataFrame({**row, "lag": range(len(r)), "pacf": out})

    vector = F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"])
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["lag int, pacf double"])
    return spread(acf_df.groupBy(*keys).agg(vector.alias("_r")), keys).mapInPandas(recurse, schema)


def portmanteau(acf_df: DataFrame, keys: list[str]) -> DataFrame:
    """Box-Pierce and Ljung-Box statistics with p-values, up to each lag of an ACF table."""
    upto = W.partitionBy(*keys).orderBy("lag").rowsBetween(W.unboundedPreceding, 0)
    n, square = F.col("n"), F.col("acf") * F.col("acf")
    stats = acf_df.where("lag > 0").select(
        *keys, "lag", "n", (n * F.sum(square).over(upto)).alias("box_pierce"),
        (n * (n + 2) * F.sum(square / (n - F.col("lag"))).over(upto)).alias("ljung_box"))
    k = F.col("lag").cast("double")
    return stats.select("*", chi2_pvalue(F.col("box_pierce"), k).alias("box_pierce_p"), chi2_pvalue(F.col("ljung_box"), k).alias("ljung_box_p"))


# Response surface of the Dickey-Fuller critical values with constant, and the two
# polynomials of the approximate p-value with their bounds (MacKinnon 2010 and 1994).
DF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
DF_P_SMALL = (2.1659, 1.4412, 0.038269)
DF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
DF_TAU_MIN, DF_TAU_STAR, DF_TAU_MAX = -18.83, -1.61, 2.74


def df_critical(level: str, n: int) -> float:
    return sum(b / n ** i for i, b in enumerate(DF_CRITICAL[level]))


def df_pvalue(tau: float) -> float:
    if not math.isfinite(tau):
        return math.nan
    if tau > DF_TAU_MAX:
        return 1.0
    if tau < DF_TAU_MIN:
        return 0.0
    terms = DF_P_SMALL if tau <= DF_TAU_STAR else DF_P_LARGE
    return normal_cdf(sum(b * tau ** i for i, b in enumerate(terms)))


def default_maxlag(n: int) -> int:
    return max(min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2), 0)


def _lag_scores(x: np.ndarray, y: np.ndarray) -> list[float]:
    """AIC of the fits of ``y`` on a constant and the first 1, 2, ... columns of ``x``, from one Cholesky factor.

    The factor of the cross-products grows column by column; with ``y`` as the last row, each of its entries is what
    that column takes from the sum of squares."""
    n, g = len(y), Gram.of(np.column_stack([x, y]))
    scale = np.sqrt(np.maximum(np.diag(g.cp), 1e-300))
    try:
        factor = np.linalg.cholesky(g.cp / np.outer(scale, scale))
        left = 1.0 - np.cumsum(factor[-1, :-1] ** 2)
        if (np.diag(factor)[:-1] < 1e-6).any():
            raise np.linalg.LinAlgError
        sums = np.maximum(left, 0.0) * g.cp[-1, -1]
    except np.linalg.LinAlgError:  # columns that hang on each other share their effect
        sums = np.array([fit(g, range(p + 1), x.shape[1]).ssr for p in range(x.shape[1])])
    return [n * (math.log(2 * math.pi * max(s, 1e-300) / n) + 1.0) + 2.0 * (p + 2) for p, s in enumerate(sums)]


def adf(df: DataFrame, keys: list[str], date: str, col: str, maxlag: int | None = None, autolag: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller test with constant: statistic, p-value, lags, n, critical values.

    With ``autolag`` the lag count has the least AIC on the common sample of all candidates, and the test is fitted
    again on the full sample of that count. Without ``maxlag`` each series has its own bound from its length.
    """
    def sample(steps: np.ndarray, level: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Level before and p lagged differences, and the difference, of all days that have them."""
        return np.column_stack([level[p:], *[steps[p - k:len(steps) - k] for k in range(1, p + 1)]]), steps[p:]

    def one(y, _):
        steps, level = np.diff(y), y[:-1]
        lags = min(maxlag if maxlag is not None else default_maxlag(len(y)), max(len(steps) - 1, 0))
        if not len(steps):
            return []
        if autolag:
            lags = int(np.argmin(_lag_scores(*sample(steps, level, lags))))
        x, target = sample(steps, level, lags)
        g = Gram.of(np.column_stack([x, target]))
        f = fit(g, range(lags + 1), lags + 1)
        tau = float(f.coef[1] / f.se[1]) if f.se[1] > 0 else math.nan
        return [{"statistic": tau, "p_value": df_pvalue(tau), "lags": lags, "n": g.n, **{f"critical_{a[:-1]}": df_critical(a, g.n) for a in DF_CRITICAL}}]

    return map_series(df, keys, date, col, one, "statistic double, p_value double, lags int, n bigint, critical_1 double, critical_5 double, critical_10 double")
