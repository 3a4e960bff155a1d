"""Univariate study of daily series: trend, differences, tests, forecast, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelspark.operators import diagnostics, models
from panelspark.operators.aggregate import histogram, kde, profile
from panelspark.operators.search import walk_forward
from panelspark.operators.series import decompose, diff, diff_seasonal, time_split

STUDIED = ["first_diff", "seasonal_diff", "seasonal_first_diff"]


def differences(series: DataFrame, keys: list[str], col: str, period: int = 7) -> DataFrame:
    """First, seasonal and seasonal first difference beside the series."""
    one = diff(series, keys, "fecha", col, 1, "first_diff")
    return diff_seasonal(diff(one, keys, "fecha", col, period, "seasonal_diff"), keys, "fecha", col, period)


def stationarity(series: DataFrame, keys: list[str], col: str) -> dict[str, DataFrame]:
    """Unit-root test of the level and of each difference."""
    frame = differences(series, keys, col)
    return {name: diagnostics.adf(frame, keys, "fecha", name) for name in (col, *STUDIED)}


def correlation(series: DataFrame, keys: list[str], col: str, lags: int = 30) -> dict[str, DataFrame]:
    rho = diagnostics.acf(diff(series, keys, "fecha", col, 1, "first_diff"), keys, "fecha", "first_diff", lags)
    return {"acf": rho, "pacf": diagnostics.pacf(rho, keys), "portmanteau": diagnostics.portmanteau(rho, keys)}


def distribution(series: DataFrame, col: str, bins: int = 50) -> dict[str, DataFrame]:
    return {"histogram": histogram(series, col, bins), "density": kde(series, col), "profile": profile(series, [col])}


def components(series: DataFrame, keys: list[str], col: str) -> DataFrame:
    return decompose(series, keys, "fecha", col, 7)


def holdout_forecast(series: DataFrame, col: str, p: int = 10, d: int = 1, horizon: int = 10) -> DataFrame:
    """Fit without the last ``horizon`` days, forecast them, and put the real values beside."""
    parts = time_split(series, "fecha", 0, horizon)
    ahead = models.ar_forecast(parts.where("split = 'train'"), [], "fecha", col, p, d, horizon)
    return ahead.join(parts.where("split = 'test'").select("fecha", col), "fecha")


def backtest(series: DataFrame, keys: list[str], col: str, p: int = 10, d: int = 1, n: int = 10) -> DataFrame:
    return walk_forward(series, keys, "fecha", col, p, d, n)
