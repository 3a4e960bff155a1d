"""The wide forecast: one row per day, every source lagged, tree and linear models, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import diagnostics, models
from panelspark.operators.gram import metrics, ttest_1samp
from panelspark.operators.joins import assemble
from panelspark.operators.project import add_prefix, calendar_features, fill_mean
from panelspark.operators.series import diff, lag_features, rolling, time_split
from panelspark.plans import presets as P
from panelspark.session import stage

TARGET = "uci_defun__num_def"


def build_design(target: DataFrame, wide: dict[str, DataFrame], lags: dict | None = None) -> DataFrame:
    """Join the lagged wide frames to the target day by day, fill by column mean, add the calendar."""
    lags = lags or P.WIDE_LAGS
    lagged = {n: add_prefix(lag_features(f, [], "fecha", [c for c in f.columns if c != "fecha"], list(lags[n])), f"{n}__", ["fecha"])
              for n, f in wide.items()}
    joined = stage(assemble(add_prefix(target, "uci_defun__", ["fecha"]), lagged, list(wide)), "wide")
    filled = fill_mean(joined, [c for c in joined.columns if c != "fecha"])
    return stage(time_split(calendar_features(filled, "fecha"), "fecha", P.WARMUP, P.HORIZON), "wide")


def features_of(design: DataFrame) -> list[str]:
    return [c for c in design.columns if c not in ("fecha", "split", TARGET)]


def train_rows(design: DataFrame) -> DataFrame:
    return design.where(F.col("split") == "train")


def scores(model, design: DataFrame) -> DataFrame:
    """R2, error and percentage error on train and test."""
    return metrics(models.predict(model, design.where(F.col("split") != "warmup")), TARGET, "prediction", "split")


def residual_series(model, design: DataFrame) -> DataFrame:
    return models.residuals(models.predict(model, train_rows(design)), TARGET, "prediction", ["fecha"])


def residual_report(residuals: DataFrame, lags: int = 20, ar_order: int = 12) -> dict[str, DataFrame]:
    """Correlation, portmanteau, unit root, mean and AR fit of the residuals."""
    rho = diagnostics.acf(residuals, [], "fecha", "residual", lags)
    return {
        "acf": rho, "pacf": diagnostics.pacf(rho, []), "portmanteau": diagnostics.portmanteau(rho, []),
        "rolling": rolling(residuals, [], "fecha", "residual"), "adf": diagnostics.adf(residuals, [], "fecha", "residual"),
        "mean": ttest_1samp(residuals, "residual"), "ar": models.ar_fit(residuals, [], "fecha", "residual", ar_order, 1),
        "acf_change": diagnostics.acf(diff(residuals, [], "fecha", "residual", 1, "change"), [], "fecha", "change", lags),
    }
