from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from panelspark.functions.tails import t_two_sided
from panelspark.operators import search as Q
from panelspark.operators.models import hash_split, scale

GROUPS = {"one": ["a", "b"], "two": ["c"], "three": ["d", "e"]}
COLS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 5)) * [1, 5, 2, 1, 1] + [3, 0, 100, 0, 0]
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["y"] = 4 + 2 * pdf.a - 0.3 * pdf.c + rng.normal(size=240)
    pdf["split"] = np.where(rng.random(240) < 0.3, "test", "train")
    return pdf


def by_hand(pdf, cols, eliminate):
    """Direct fit on scaled rows with the constant as an ordinary term."""
    train, test = pdf[pdf.split == "train"], pdf[pdf.split == "test"]
    mean, std = train[cols].mean(), train[cols].std(ddof=0)
    xs = {s: np.column_stack([np.ones(len(d)), ((d[cols] - mean) / std)]) for s, d in (("train", train), ("test", test))}
    y = train.y.to_numpy()
    keep = np.arange(len(cols) + 1)
    for step in range(6 if eliminate else 1):
        x = xs["train"][:, keep]
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        r = y - x @ b
        df = len(y) - x.shape[1]
        p = t_two_sided(b / np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (r @ r) / df), df)
        last = keep
        keep = keep[p <= 0.05]
    if not eliminate:
        last = np.arange(len(cols) + 1)
    constant = 0 in last
    total = ((y - y.mean()) ** 2).sum() if constant else (y ** 2).sum()
    adj = 1 - (len(y) - constant) / df * (r @ r) / total
    yt = test.y.to_numpy()
    r2 = 1 - ((yt - xs["test"][:, last] @ b) ** 2).sum() / ((yt - yt.mean()) ** 2).sum()
    return ["const", *cols] if len(last) == len(cols) + 1 else [["const", *cols][i] for i in last], adj, r2, dict(zip([["const", *cols][i] for i in last], zip(b, p)))


@pytest.mark.parametrize("eliminate", [True, False])
def test_search_equals_direct_fits(spark, data, eliminate):
    got = {r["combination"]: r for r in Q.search_subsets(spark.createDataFrame(data), "y", GROUPS, eliminate=eliminate).collect()}
    names = list(GROUPS)
    wanted = [c for k in range(1, 4) for c in combinations(names, k)]
    assert set(got) == {",".join(c) for c in wanted}
    for c in wanted:
        cols = [x for g in c for x in GROUPS[g]]
        features, adj, r2, terms = by_hand(data, cols, eliminate)
        r = got[",".join(c)]
        assert r["columns"] == features and r["n_features"] == len(features) and r["status"] == "ok"
        assert (r["r2_adj_train"], r["r2_test"]) == (pytest.approx(adj, rel=1e-8), pytest.approx(r2, rel=1e-8))
        for t in r["terms"]:
            assert (t["coefficient"], t["p_value"]) == (pytest.approx(terms[t["feature"]][0], rel=1e-6), pytest.approx(terms[t["feature"]][1], rel=1e-4, abs=1e-12))


def test_sample_per_subset(spark, data):
    holed = data.astype({"c": object, "d": object}).copy()
    holed.loc[:30, "c"] = None
    holed.loc[20:60, "d"] = None
    rows = [tuple(None if v is None else v for v in r) for r in holed.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS) + ", y double, split string")
    per = {r["combination"]: r for r in Q.search_subsets(df, "y", GROUPS, eliminate=False, sample="per_subset").collect()}
    common = {r["combination"]: r for r in Q.search_subsets(df, "y", GROUPS, eliminate=False).collect()}
    for c in ("one", "two", "three", "one,two", "one,two,three"):
        cols = [x for g in c.split(",") for x in GROUPS[g]]
        part = holed.dropna(subset=cols).astype({x: float for x in cols})
        _, adj, r2, _ = by_hand(part, cols, False)
        assert (per[c]["r2_adj_train"], per[c]["r2_test"]) == (pytest.approx(adj, rel=1e-8), pytest.approx(r2, rel=1e-8))
        assert per[c]["n_train"] + per[c]["n_test"] == len(part)
    assert {r["n_train"] + r["n_test"] for r in common.values()} == {240 - 61}
    assert common["one,two,three"]["r2_test"] == pytest.approx(per["one,two,three"]["r2_test"], rel=1e-8)


def test_no_term_left_has_a_status(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=80), "y": rng.normal(size=80), "split": ["train", "train", "test", "train"] * 20})
    pdf["y"] -= pdf[pdf.split == "train"].y.mean()
    assert Q.search_subsets(spark.createDataFrame(pdf), "y", {"a": ["a"]}).first()["status"] == "no term left"


def test_candidates_and_terms(spark, data):
    found = Q.search_subsets(spark.createDataFrame(data), "y", GROUPS, eliminate=False)
    best = Q.candidates(found, 2, "two").collect()
    assert [r["combination"] for r in best] == sorted((r["combination"] for r in best), key=lambda c: -{x["combination"]: x["r2_test"] for x in best}[c])
    assert {r["combination"] for r in best} == {"one,two", "two,three"}
    assert Q.coefficients(found).count() == sum(r["n_features"] for r in found.collect())


def test_subset_limit(spark):
    with pytest.raises(ValueError, match="limit"):
        Q.subsets(spark, [f"x{i}" for i in range(21)])


def test_split_is_a_property_of_the_day(spark):
    days = spark.createDataFrame([(date(2015, 1, 1) + timedelta(days=i),) for i in range(4000)], "fecha date")
    share = hash_split(days, "fecha", 0.3).where("split = 'test'").count() / 4000
    assert 0.27 < share < 0.33
    assert hash_split(days, "fecha").exceptAll(hash_split(days, "fecha").repartition(7)).count() == 0


def test_scale_uses_train_only(spark):
    train, test = scale(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), spark.createDataFrame([(5.0, 6.0)], "a double, b double"), ["a", "b"])
    assert [tuple(r) for r in train.collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert tuple(test.first()) == (3.0, 1.0)


def test_walk_forward_equals_refits(spark):
    rng = np.random.default_rng(4)
    ys = {k: np.cumsum(rng.normal(size=60)) for k in "ab"}
    day0 = date(2020, 1, 1)
    df = spark.createDataFrame([(k, day0 + timedelta(days=i), float(v)) for k, y in ys.items() for i, v in enumerate(y)], "k string, fecha date, v double")
    for r in Q.walk_forward(df, ["k"], "fecha", "v", 2, 1, 5).collect():
        y = ys[r["k"]][: (r["fecha"] - day0).days]
        w = np.diff(y)
        x = np.array([[1.0, w[i - 1], w[i - 2]] for i in range(2, len(w))])
        b = np.linalg.lstsq(x, w[2:], rcond=None)[0]
        assert r["yhat"] == pytest.approx(y[-1] + b @ [1.0, w[-1], w[-2]], rel=1e-8)
    whole = Q.walk_forward(df.where("k = 'a'").drop("k"), [], "fecha", "v", 2, 1, 5).collect()
    assert len(whole) == 5 and all(r["yhat"] is not None for r in whole)


def test_time_folds(spark):
    days = spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=i),) for i in range(40)], "fecha date")
    got = Q.time_folds(days, "fecha", 3, 7).orderBy("fold").collect()
    assert got[-1]["test_to"] == date(2020, 2, 9) and [(r["test_to"] - r["test_from"]).days for r in got] == [6, 6, 6]
    assert got[0]["test_to"] + timedelta(days=1) == got[1]["test_from"] and got[0]["train_to"] + timedelta(days=1) == got[0]["test_from"]
