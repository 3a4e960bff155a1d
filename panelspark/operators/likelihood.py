"""Autoregressive models by exact Gaussian likelihood, and their forecasts.

The first p values have the covariance of the stationary process, all later ones are predicted from p lags. The
one-step errors of the first values come from the Durbin-Levinson recursion over the partial autocorrelations, the
later ones from one matrix of lagged products, so that a likelihood costs the same for any length. It is maximised
over the partial autocorrelations, which keeps every model stationary; mean and variance are solved in closed form.

Every series is gathered once, by one shuffle on its keys; it is a daily series, so a key has at most one value a day.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from panelspark.operators.whole import day, map_series

EDGE = 0.9999  # partial autocorrelations of a start that is not stationary are brought within it


def from_partial(partial: np.ndarray) -> list[np.ndarray]:
    """The coefficients of the predictors of order 0, 1, ... p."""
    out = [np.zeros(0)]
    for r in partial:
        out.append(np.append(out[-1] - r * out[-1][::-1], r))
    return out


def to_partial(phi: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of a predictor; values beyond one tell that it is not stationary."""
    out, phi = [], np.array(phi, float)
    while len(phi):
        r = phi[-1]
        out.append(r)
        phi = (phi[:-1] + r * phi[:-1][::-1]) / (1 - r * r) if abs(r) != 1 else phi[:-1]
    return np.array(out[::-1])


@dataclass
class Lagged:
    """What the likelihood needs of a series: its first p values, and sums and products of (value, p lags) after them."""

    n: int
    head: np.ndarray
    late: int
    sums: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, w: np.ndarray, p: int) -> "Lagged":
        z = np.column_stack([w[p - j:len(w) - j] for j in range(p + 1)])
        return cls(len(w), w[:p], len(z), z.sum(axis=0), z.T @ z)

    def parts(self, partial: np.ndarray, constant: bool) -> tuple[float, float, float]:
        """(sum of squared scaled errors, mean, sum of log variances) for a unit innovation."""
        predictors = from_partial(partial)
        variance = 1.0 / np.prod(1.0 - partial ** 2)
        a, b, c, logs = 0.0, 0.0, 0.0, 0.0
        for t in range(len(self.head)):
            coef = predictors[t]
            error = self.head[t] - coef @ self.head[:t][::-1]
            level = 1.0 - coef.sum()
            a, b, c, logs = a + error * error / variance, b + error * level / variance, c + level * level / variance, logs + math.log(variance)
            variance *= 1.0 - partial[t] ** 2
        filter_ = np.concatenate([[1.0], -predictors[-1]])
        level = filter_.sum()
        a += filter_ @ self.products @ filter_
        b += level * (filter_ @ self.sums)
        c += self.late * level * level
        mean = b / c if constant and c > 0 else 0.0
        return a - 2 * b * mean + c * mean * mean, mean, logs

    def loglik(self, partial: np.ndarray, constant: bool) -> float:
        squares, _, logs = self.parts(partial, constant)
        if squares <= 0:
            return math.inf
        return -0.5 * (self.n * (math.log(2 * math.pi * squares / self.n) + 1.0) + logs)


def _slope(f, x: np.ndarray, h: float = 3e-5) -> np.ndarray:
    return np.array([(f(x + e) - f(x - e)) / (2 * h) for e in np.eye(len(x)) * h])


def maximise(f, x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Quasi-Newton steps uphill until the slope vanishes or no step helps."""
    inverse, value, g = np.eye(len(x)), f(x), _slope(f, x)
    for _ in range(rounds):
        if np.abs(g).max() < 1e-11:
            break
        step = inverse @ g
        if step @ g <= 0:
            inverse, step = np.eye(len(x)), g
        size = min(1.0, 2.0 / np.abs(step).max())
        while size > 1e-12 and not f(x + size * step) > value + 1e-4 * size * (step @ g):
            size /= 2
        if size <= 1e-12:
            break
        moved = size * step
        x = x + moved
        value, before, g = f(x), g, _slope(f, x)
        bend = before - g
        scale = bend @ moved
        if scale > 1e-18:
            left = np.eye(len(x)) - np.outer(moved, bend) / scale
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / scale
    return x


@dataclass
class ARModel:
    """A fitted model of the differenced series."""

    n: int
    mean: float
    phi: np.ndarray
    sigma2: float
    loglik: float
    std_error: np.ndarray  # of the coefficients


def fit_exact(w: np.ndarray, p: int, constant: bool) -> ARModel | None:
    """None if the series is too short or does not vary."""
    if len(w) < 2 * p + 2 or not np.ptp(w):
        return None
    shift = w.mean() if constant else 0.0  # so that no digits are lost
    data = Lagged.of(w - shift, p)
    partial = np.zeros(0)
    if p:
        # Start: least squares on the lags, brought inside where it is not stationary.
        level = data.sums / data.late if constant else np.zeros(p + 1)
        cp = data.products - data.late * np.outer(level, level)
        start = to_partial(np.linalg.lstsq(cp[1:, 1:], cp[1:, 0], rcond=None)[0])
        start = np.where(np.isfinite(start), start, 0.0).clip(-EDGE, EDGE)
        f = lambda x: data.loglik(np.tanh(x), constant) / data.n
        partial = np.tanh(maximise(f, np.arctanh(start)))
    squares, mean, _ = data.parts(partial, constant)
    phi = from_partial(partial)[-1]
    return ARModel(len(w), mean + shift, phi, squares / len(w), data.loglik(partial, constant), _errors(data, phi, constant))


def _errors(data: Lagged, phi: np.ndarray, constant: bool, h: float = 1e-4) -> np.ndarray:
    """From the curvature of the likelihood at the coefficients."""
    p = len(phi)

    def f(x):
        partial = to_partial(x)
        return data.loglik(partial, constant) if (np.abs(partial) < 1).all() else math.nan

    steps = np.eye(p) * h
    curve = np.array([[(f(phi + a + b) - f(phi + a - b) - f(phi - a + b) + f(phi - a - b)) / (4 * h * h) for b in steps] for a in steps]).reshape(p, p)
    if not np.isfinite(curve).all():
        return np.full(p, math.nan)
    spread_ = np.diag(np.linalg.pinv(-curve))
    return np.sqrt(np.where(spread_ > 0, spread_, math.nan))


def ahead(y: np.ndarray, model: ARModel, d: int, horizon: int) -> tuple[list[float], list[float]]:
    """Forecasts of the level and their standard errors, for any order of differencing."""
    p = len(model.phi)
    levels = [np.diff(y, k)[-1] for k in range(d)]
    recent = list((np.diff(y, d) - model.mean)[len(y) - d - p:]) if p else []
    psi, weights = np.zeros(horizon), np.concatenate([[1.0], -model.phi])
    for _ in range(d):
        weights = np.convolve(weights, [1.0, -1.0])
    out, error, total = [], [], 0.0
    for h in range(horizon):
        step = float(np.dot(model.phi, recent[::-1][:p])) if p else 0.0
        recent.append(step)
        value = step + model.mean
        for k in range(d - 1, -1, -1):
            levels[k] += value
            value = levels[k]
        out.append(float(value))
        psi[h] = 1.0 if h == 0 else -sum(weights[j] * psi[h - j] for j in range(1, min(h, len(weights) - 1) + 1))
        total += psi[h] ** 2
        error.append(math.sqrt(model.sigma2 * total))
    return out, error


def ar_likelihood(df: DataFrame, keys: list[str], date: str, col: str, p: int, d: int = 1, constant: bool | None = None) -> DataFrame:
    """AR(p) of the d-times differenced series by exact likelihood: one row per series and term (``const`` is the mean),
    with ``sigma2``, ``loglik`` and ``aic``. A constant is fitted on the level only, if not said otherwise.

    A series with fewer than 2p + 2 differences, or without any change, has no row."""
    own = d == 0 if constant is None else constant

    def one(y, _):
        model = fit_exact(np.diff(y, d), p, own) if len(y) > d else None
        if model is None:
            return []
        # The mean is uncertain by the variance of the process over its length.
        mean_error = math.sqrt(model.sigma2 / model.n) / abs(1.0 - model.phi.sum()) if own else math.nan
        terms = ([("const", model.mean, mean_error)] if own else []) + [(f"ar_{k + 1}", float(b), float(s)) for k, (b, s) in enumerate(zip(model.phi, model.std_error))]
        aic = 2.0 * (len(terms) + 1) - 2.0 * model.loglik
        return [{"feature": f, "coefficient": b, "std_error": s, "sigma2": model.sigma2, "n": model.n, "loglik": model.loglik, "aic": aic} for f, b, s in terms or [("none", math.nan, math.nan)]]

    return map_series(df, keys, date, col, one, "feature string, coefficient double, std_error double, sigma2 double, n bigint, loglik double, aic double")


def ar_likelihood_forecast(df: DataFrame, keys: list[str], date: str, col: str, p: int, d: int = 1, horizon: int = 7, constant: bool | None = None) -> DataFrame:
    """Forecast ``horizon`` days on the level from the model of ``ar_likelihood``, with standard errors."""
    own = d == 0 if constant is None else constant

    def one(y, days):
        model = fit_exact(np.diff(y, d), p, own) if len(y) > d else None
        if model is None:
            return []
        values, errors = ahead(y, model, d, horizon)
        return [{"step": h, date: day(days[-1] + h), "forecast": v, "std_error": e} for h, (v, e) in enumerate(zip(values, errors), 1)]

    return map_series(df, keys, date, col, one, f"step int, `{date}` date, forecast double, std_error double")
