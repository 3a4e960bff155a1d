import numpy as np
import pandas as pd
import pytest

from panelspark.operators import search as Q
from panelspark.operators.gram import Gram, fit
from panelspark.operators.sweep import RESTART, Sweeper, gray, zeta


@pytest.fixture(scope="module")
def gram():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * [1, 10, 0.1, 1, 1, 1, 1, 2] + [0, 100, 5, 0, 0, 0, 0, 3]
    x[:, 5] = x[:, 0] + x[:, 1]  # hangs on two others
    x[:, 6] = 4.0  # constant
    return Gram.of(x)


def same(a, b):
    assert a.order == b.order and a.constant == b.constant and a.df_resid == b.df_resid
    for name in ("coef", "se", "ssr", "r2", "r2_adj"):
        np.testing.assert_allclose(getattr(a, name), getattr(b, name), rtol=1e-8, atol=1e-10)


def test_sweeps_equal_fits(gram):
    sweeper = Sweeper(gram, 7)
    for i in range(1, 128):
        mask = gray(i)
        xs = {k for k in range(7) if mask >> k & 1}
        sweeper.move(xs)
        same(sweeper.model(), fit(gram, sorted(xs), 7))
        same(sweeper.model(False), fit(gram, sorted(xs), 7, False))
        want, got = Q.backward(gram, sorted(xs), 7), sweeper.eliminate()
        assert (want is None) == (got is None)
        if want:
            same(got, want)
        same(sweeper.model(), fit(gram, sorted(xs), 7))


def test_many_sweeps_do_not_drift(gram):
    sweeper, rng = Sweeper(gram, 7), np.random.default_rng(0)
    for _ in range(4 * RESTART):
        sweeper.move({k for k in range(7) if rng.random() < 0.5})
    sweeper.move({0, 1, 2, 3})
    same(sweeper.model(), fit(gram, [0, 1, 2, 3], 7))


def test_gray_code():
    for k in (1, 4, 10):
        codes = [gray(i) for i in range(1, 2 ** k)]
        assert sorted(codes) == list(range(1, 2 ** k))
        assert all(bin(a ^ b).count("1") == 1 for a, b in zip(codes, codes[1:]))


def test_zeta():
    rng = np.random.default_rng(1)
    parts = {int(c): Gram.of(rng.normal(size=(3 + int(c), 2))) for c in rng.choice(32, 9, replace=False)}
    sums = zeta(parts, 5)
    for c in range(32):
        below = [g for s, g in parts.items() if s & ~c == 0]
        assert (c in sums) == bool(below)
        if below:
            assert sums[c].n == sum(g.n for g in below)
            np.testing.assert_allclose(sums[c].mean, sum(g.mean * g.n for g in below) / sums[c].n)


@pytest.mark.parametrize("held", [1, 1 << 14, 1 << 28])
def test_over_a_hundred_patterns(spark, held, monkeypatch):
    """Every subset on its own sample against a direct fit on the rows; the last group never has a value."""
    from panelspark.operators import sweep

    monkeypatch.setattr(sweep.superset_sums, "__defaults__", (held,))
    rng = np.random.default_rng(8)
    names = [f"g{i}" for i in range(8)]
    x = rng.normal(size=(4000, 8))
    y = x @ np.arange(8) / 3 + rng.normal(size=4000)
    hole = rng.random((4000, 8)) < 0.35
    hole[:, 7] = True
    split = np.where(rng.random(4000) < 0.3, "test", "train")
    assert len({tuple(h) for h in hole}) > 100
    rows = [(*[None if h else float(v) for v, h in zip(a, b)], float(t), s) for a, b, t, s in zip(x, hole, y, split)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y double, split string")
    got = {r["mask"]: r for r in Q.search_subsets(df, "y", {n: [n] for n in names}, eliminate=False, sample="per_subset").collect()}
    assert sorted(got) == list(range(1, 256))
    for mask, r in got.items():
        cols = [k for k in range(8) if mask >> k & 1]
        here = ~hole[:, cols].any(axis=1)
        train, test = here & (split == "train"), here & (split == "test")
        assert (r["n_train"], r["n_test"]) == (train.sum(), test.sum())
        if 7 in cols:
            assert r["status"] == "no rows"
            continue
        design = np.column_stack([np.ones(4000), x[:, cols]])
        b = np.linalg.lstsq(design[train], y[train], rcond=None)[0]
        left = lambda at: ((y[at] - design[at] @ b) ** 2).sum() / ((y[at] - y[at].mean()) ** 2).sum()
        adj = 1 - (train.sum() - 1) / (train.sum() - len(cols) - 1) * left(train)
        assert (r["r2_adj_train"], r["r2_test"]) == (pytest.approx(adj, rel=1e-8), pytest.approx(1 - left(test), rel=1e-8))


def test_fit_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 20, 5] + [3, 50, 0]
    pdf = pd.DataFrame(x, columns=["a", "b c", "noise"])
    pdf["y"] = 7 + 2 * pdf.a - 0.1 * pdf["b c"] + rng.normal(size=400) * 0.1
    pdf["split"] = np.where(rng.random(400) < 0.3, "test", "train")
    df = spark.createDataFrame(pdf)
    model = Q.fit_one(df, "y", ["a", "b c", "noise"], eliminate=True)
    train, test = pdf[pdf.split == "train"], pdf[pdf.split == "test"]
    design = lambda d: np.column_stack([np.ones(len(d)), d.a, d["b c"]])
    b, rss, *_ = np.linalg.lstsq(design(train), train.y, rcond=None)
    assert model.features == ["const", "a", "b c"]
    np.testing.assert_allclose(model.coefficient, b, rtol=1e-9)
    se = np.sqrt(np.diag(np.linalg.inv(design(train).T @ design(train))) * rss[0] / (len(train) - 3))
    np.testing.assert_allclose(model.std_error, se, rtol=1e-8)
    guess = design(test) @ b
    assert model.r2_test == pytest.approx(1 - ((test.y - guess) ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum())
    shown = model.predict(df.where("split = 'test'")).toPandas()
    np.testing.assert_allclose(shown.prediction, guess, rtol=1e-9)
    assert model.terms(spark).count() == 3
    assert Q.fit_one(df.limit(0), "y", ["a"]) is None
