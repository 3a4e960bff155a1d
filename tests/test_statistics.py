from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from panelspark.functions.tails import chi2_upper, t_two_sided
from panelspark.operators import diagnostics as D
from panelspark.operators import gram as G
from panelspark.operators import models as M

DAY0 = date(2020, 1, 1)


def integral(f, a, b, n=200_001):
    x = np.linspace(a, b, n)
    return float(np.trapezoid(f(x), x))


@pytest.mark.parametrize("df", [1, 3, 30, 400])
@pytest.mark.parametrize("t", [0.0, 0.3, 2.0, 6.0])
def test_t_tail(df, t):
    # With t = tan(u) sqrt(df) the density becomes cos(u) ** (df - 1).
    dens = lambda u: np.cos(u) ** (df - 1)
    u = np.arctan(t / np.sqrt(df))
    whole = integral(dens, 0, np.pi / 2)
    assert t_two_sided(t, df).item() == pytest.approx(integral(dens, u, np.pi / 2) / whole, rel=1e-6, abs=1e-12)


def test_extreme_tails():
    assert 0 < t_two_sided(40.0, 500).item() < 1e-150
    assert t_two_sided(np.inf, 5).item() == 0.0 and np.isnan(t_two_sided(1.0, 0).item())


@pytest.mark.parametrize("df", [2, 5, 14])
@pytest.mark.parametrize("x", [0.5, 4.0, 30.0])
def test_chi2_tail(df, x):
    dens = lambda z: z ** (df / 2 - 1) * np.exp(-z / 2)
    assert chi2_upper(x, df).item() == pytest.approx(integral(dens, x, 200) / integral(dens, 0, 200), rel=1e-5)


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) * [1, 50, 0.01] + [1000, 3, 0]
    y = 2 + x @ [0.5, -0.1, 30] + rng.normal(size=300)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, k=np.where(np.arange(300) % 3 == 0, "p", "q"))
    return pdf, spark.createDataFrame(pdf).repartition(5)


def exact(x, y):
    full = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    return beta, y - full @ beta


@pytest.mark.parametrize("method", ["native", "arrow"])
@pytest.mark.parametrize("by", [None, "k"])
def test_packed_gram(design, method, by):
    pdf, df = design
    grams = G.load_gram(G.packed_gram(df, ["a", "b", "y"], by, method), by)
    for key, part in (pdf.groupby("k") if by else [(None, pdf)]):
        z = part[["a", "b", "y"]].to_numpy()
        assert grams[key].n == len(z)
        assert grams[key].mean == pytest.approx(z.mean(0))
        assert grams[key].cp == pytest.approx((z - z.mean(0)).T @ (z - z.mean(0)), rel=1e-8, abs=1e-6)


def test_gram_skips_incomplete_rows_and_merges(spark, design):
    pdf, df = design
    holes = df.unionByName(df.limit(5).selectExpr("cast(null as double) a", "b", "c", "y", "k"))
    assert G.load_gram(G.packed_gram(holes, ["a", "y"]))[None].n == 300
    z = pdf[["a", "y"]].to_numpy()
    both = G.Gram.of(z[:100]) + G.Gram.of(z[100:])
    assert both.cp == pytest.approx(G.Gram.of(z).cp) and both.mean == pytest.approx(z.mean(0))


def test_ols_equals_lstsq_and_spark_ml(design):
    pdf, df = design
    got = {r["feature"]: r for r in G.ols(df, "y", ["a", "b", "c"]).collect()}
    beta, residual = exact(pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy())
    assert [got[f]["coefficient"] for f in ("const", "a", "b", "c")] == pytest.approx(list(beta), rel=1e-7)
    ml = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df))
    order = ["a", "b", "c", "const"]
    assert [got[f]["std_error"] for f in order] == pytest.approx(ml.summary.coefficientStandardErrors, rel=1e-5)
    assert [got[f]["p_value"] for f in order] == pytest.approx(ml.summary.pValues, rel=1e-4, abs=1e-12)
    assert got["a"]["r2_adj"] == pytest.approx(ml.summary.r2adj, rel=1e-8)
    assert got["a"]["r2_adj"] <= got["a"]["r2"]


def test_collinear_columns_share_their_effect(spark, design):
    pdf, df = design
    got = {r["feature"]: r for r in G.ols(df.selectExpr("y", "a", "a * 2 as a2"), "y", ["a", "a2"]).collect()}
    one = {r["feature"]: r for r in G.ols(df, "y", ["a"]).collect()}
    assert got["a"]["coefficient"] + 2 * got["a2"]["coefficient"] == pytest.approx(one["a"]["coefficient"], rel=1e-6)
    assert got["a"]["r2_adj"] == pytest.approx(one["a"]["r2_adj"], rel=1e-8)


def test_press(design):
    pdf, df = design
    x, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    full = np.column_stack([np.ones(len(x)), x])
    hat = np.einsum("ij,ji->i", full, np.linalg.pinv(full))
    _, residual = exact(x, y)
    got = G.press(df, "y", ["a", "b"]).first()
    assert got["press"] == pytest.approx(np.sum((residual / (1 - hat)) ** 2), rel=1e-6)
    assert got["press"] >= got["rss"]


def walk(n, seed=5, unit=True):
    e = np.random.default_rng(seed).normal(size=n)
    return np.cumsum(e) if unit else e


def series(spark, **named):
    rows = [(k, DAY0 + timedelta(days=i), float(v)) for k, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, fecha date, v double")


def adf_by_hand(y, maxlag):
    dy = np.diff(y)

    def design(p, first):
        rows = range(max(first, p), len(dy))
        return np.array([[1.0, y[i], *[dy[i - k] for k in range(1, p + 1)]] for i in rows]), dy[list(rows)]

    best = None
    for p in range(maxlag + 1):
        x, z = design(p, maxlag)
        r = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
        aic = len(z) * (np.log(2 * np.pi * (r @ r) / len(z)) + 1) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p)
    x, z = design(best[1], 0)
    b = np.linalg.lstsq(x, z, rcond=None)[0]
    r = z - x @ b
    cov = np.linalg.inv(x.T @ x) * (r @ r) / (len(z) - x.shape[1])
    return b[1] / np.sqrt(cov[1, 1]), best[1], len(z)


def test_adf_against_direct_fits(spark):
    data = {"walk": walk(200), "noise": walk(200, unit=False), "short": walk(60)}
    for r in D.adf(series(spark, **data), ["k"], "fecha", "v").collect():
        stat, lags, n = adf_by_hand(data[r["k"]], D.default_maxlag(len(data[r["k"]])))
        assert (r["lags"], r["n"]) == (lags, n)
        assert r["statistic"] == pytest.approx(stat, rel=1e-7)
        assert (r["p_value"] < 0.01) == (r["k"] == "noise")
    one = D.adf(series(spark, walk=data["walk"]).drop("k"), [], "fecha", "v").first()
    assert one["statistic"] == pytest.approx(adf_by_hand(data["walk"], D.default_maxlag(200))[0])


def test_df_pvalue_at_critical_values():
    for level, p in (("1%", 0.01), ("5%", 0.05), ("10%", 0.10)):
        assert D.df_pvalue(D.df_critical(level, 10 ** 9)) == pytest.approx(p, abs=0.001)


def test_acf_and_pacf(spark):
    x = walk(120, 9, False)
    rho = D.acf(series(spark, a=x), ["k"], "fecha", "v", 3)
    got = {r["lag"]: r["acf"] for r in rho.collect()}
    z = x - x.mean()
    assert got[0] == 1.0 and got[2] == pytest.approx((z[2:] @ z[:-2]) / (z @ z))
    partial = {r["lag"]: r["pacf"] for r in D.pacf(rho, ["k"]).collect()}
    m = np.array([[1, got[1], got[2]], [got[1], 1, got[1]], [got[2], got[1], 1]])
    assert partial[1] == pytest.approx(got[1])
    assert partial[3] == pytest.approx(np.linalg.solve(m, [got[1], got[2], got[3]])[2])
    boxes = {r["lag"]: r for r in D.portmanteau(rho, ["k"]).collect()}
    assert boxes[2]["box_pierce_p"] == pytest.approx(np.exp(-boxes[2]["box_pierce"] / 2))
    assert boxes[3]["ljung_box"] > boxes[3]["box_pierce"]


def test_ar_forecast_follows_its_coefficients(spark):
    y = walk(80, 11)
    df = series(spark, a=y)
    fitted = {r["feature"]: r["coefficient"] for r in M.ar_fit(df, ["k"], "fecha", "v", 3, 1).collect()}
    w = list(np.diff(y))
    x = np.array([[1.0, w[i - 1], w[i - 2], w[i - 3]] for i in range(3, len(w))])
    b = np.linalg.lstsq(x, np.array(w[3:]), rcond=None)[0]
    assert [fitted[f] for f in ("const", "ar_1", "ar_2", "ar_3")] == pytest.approx(list(b), rel=1e-6)
    level, want = y[-1], []
    for _ in range(5):
        w.append(b[0] + b[1] * w[-1] + b[2] * w[-2] + b[3] * w[-3])
        level += w[-1]
        want.append(level)
    got = M.ar_forecast(df, ["k"], "fecha", "v", 3, 1, 5).orderBy("step").collect()
    assert [r["forecast"] for r in got] == pytest.approx(want)
    assert got[0]["fecha"] == DAY0 + timedelta(days=80)


def test_ttest_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", 3.0)], "k string, v double")
    got = {r["k"]: r for r in G.ttest_1samp(df, "v", 2.0, "k").collect()}
    assert (got["a"]["t"], got["a"]["p_value"]) == (-np.inf, 0.0)
    assert got["b"]["t"] == pytest.approx(1.0) and got["b"]["p_value"] == pytest.approx(0.5)
    assert got["c"]["t"] is None
    assert G.ttest_1samp(df.where("k = 'a'"), "v", 1.0).first()["t"] is None
