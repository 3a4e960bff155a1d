from datetime import date, timedelta

import numpy as np
import pytest

from panelspark.operators import likelihood as L
from panelspark.operators import models as M

DAY0 = date(2020, 1, 1)


def simulate(phi, n, mean=0.0, seed=0):
    rng, y = np.random.default_rng(seed), []
    for _ in range(n + 200):
        y.append(sum(f * v for f, v in zip(phi, y[::-1])) + rng.normal())
    return np.array(y[200:]) + mean


def covariance(phi, n, terms=4000):
    """Of n values of the process, from its moving-average weights."""
    psi = [1.0]
    for _ in range(terms):
        psi.append(sum(f * v for f, v in zip(phi, psi[::-1])))
    psi = np.array(psi)
    gamma = [psi[:len(psi) - k] @ psi[k:] for k in range(n)]
    return np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize("phi", [[0.6], [0.5, -0.3], [1.2, -0.5, 0.1, -0.1]])
@pytest.mark.parametrize("constant", [False, True])
def test_likelihood_is_the_normal_density(phi, constant):
    w = simulate(phi, 40, 5.0)
    v = covariance(phi, 40)
    inverse = np.linalg.inv(v)
    one = np.ones(40)
    mean = (one @ inverse @ w) / (one @ inverse @ one) if constant else 0.0
    squares = (w - mean) @ inverse @ (w - mean)
    want = -0.5 * (40 * (np.log(2 * np.pi * squares / 40) + 1) + np.linalg.slogdet(v)[1])
    data = L.Lagged.of(w, len(phi))
    partial = L.to_partial(np.array(phi))
    assert data.loglik(partial, constant) == pytest.approx(want, rel=1e-9)
    assert data.parts(partial, constant)[1] == pytest.approx(mean, rel=1e-9)
    np.testing.assert_allclose(L.from_partial(partial)[-1], phi)


def test_maximum_is_where_no_neighbour_is_better():
    w = simulate([0.7, -0.4, 0.2], 300, seed=3)
    model = L.fit_exact(w, 3, True)
    data = L.Lagged.of(w, 3)
    best = data.loglik(L.to_partial(model.phi), True)
    assert best == pytest.approx(model.loglik, rel=1e-12)
    rng = np.random.default_rng(1)
    for _ in range(200):
        assert data.loglik(L.to_partial(model.phi + rng.normal(size=3) * 0.01), True) <= best + 1e-9
    # With many rows the errors are those of least squares.
    z = np.column_stack([np.ones(297), *[w[3 - k:300 - k] for k in (1, 2, 3)]])
    b, rss, *_ = np.linalg.lstsq(z, w[3:], rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * rss[0] / 293)[1:]
    np.testing.assert_allclose(model.std_error, se, rtol=0.1)


def test_stays_stationary_where_least_squares_does_not():
    w = np.cumsum(np.random.default_rng(5).normal(size=60)) * np.linspace(1, 3, 60)
    model = L.fit_exact(w, 2, False)
    assert (np.abs(L.to_partial(model.phi)) < 1).all()
    assert L.fit_exact(np.ones(50), 1, True) is None and L.fit_exact(np.arange(3.0), 2, True) is None


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_forecast_of_any_difference(d):
    """Step by step: difference, predict, add up again."""
    y = simulate([0.5], 80, 1.0)
    for _ in range(d):
        y = np.cumsum(y)
    model = L.fit_exact(np.diff(y, d), 2, True)
    got, error = L.ahead(y, model, d, 6)
    whole = list(y)
    for _ in range(6):
        w = np.diff(whole, d) - model.mean
        step = model.phi @ w[::-1][:2] + model.mean
        value = step
        for k in range(d - 1, -1, -1):
            value = np.diff(whole, k)[-1] + value
        whole.append(value)
    np.testing.assert_allclose(got, whole[80:], rtol=1e-9)
    assert error[0] == pytest.approx(np.sqrt(model.sigma2)) and all(b >= a for a, b in zip(error, error[1:]))


def test_tables(spark):
    series = {"a": simulate([0.6], 120, 3.0, 1), "b": np.cumsum(simulate([0.3], 90, 0.0, 2)), "short": np.arange(2.0), "flat": np.ones(30)}
    rows = [(k, DAY0 + timedelta(days=i), float(v), 0) for k, y in series.items() for i, v in enumerate(y)]
    rows += [("a", DAY0 + timedelta(days=500), None, 0), (None, DAY0, 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, fecha date, v double, n int")
    found = {(r.k, r.feature): r for r in L.ar_likelihood(df, ["k"], "fecha", "v", 1, 0).collect()}
    assert set(found) == {(k, f) for k in "ab" for f in ("const", "ar_1")}
    assert found["a", "ar_1"].coefficient == pytest.approx(L.fit_exact(series["a"], 1, True).phi[0]) and found["a", "ar_1"].n == 120
    ahead = L.ar_likelihood_forecast(df.where("k = 'b'").drop("k"), [], "fecha", "v", 2, 1, 5).orderBy("step").collect()
    assert [r.fecha for r in ahead] == [DAY0 + timedelta(days=90 + i) for i in range(5)]
    assert L.ar_likelihood(df.limit(0), ["k"], "fecha", "v", 1).count() == 0


def test_second_difference_forecast(spark):
    y = np.cumsum(np.cumsum(simulate([0.4], 60, 0.0, 4)))
    df = spark.createDataFrame([(DAY0 + timedelta(days=i), float(v)) for i, v in enumerate(y)], "fecha date, v double")
    w = np.diff(y, 2)
    b = np.linalg.lstsq(np.column_stack([np.ones(len(w) - 1), w[:-1]]), w[1:], rcond=None)[0]
    whole, step = list(y), w[-1]
    for _ in range(4):
        step = b[0] + b[1] * step
        whole.append(2 * whole[-1] - whole[-2] + step)
    got = [r.forecast for r in M.ar_forecast(df, [], "fecha", "v", 1, 2, 4).orderBy("step").collect()]
    np.testing.assert_allclose(got, whole[60:], rtol=1e-9)
