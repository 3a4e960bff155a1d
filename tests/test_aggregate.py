import numpy as np
import pytest

from panelspark.operators import aggregate as A
from panelspark.operators import reshape as R
from panelspark.operators.joins import join_dim, outer_merge
from panelspark.operators.text import adjacency_to_edges, near, repeat


def test_null_rules_of_group_statistics(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 9.0)], "k string, v double")
    got = {r["k"]: r for r in A.multi_agg(df, ["k"], {"v": ["sum", "mean", "std", "count"]}).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["v__sum"], got["a"]["v__mean"], got["a"]["v__count"]) == (0.0, None, 0)
    assert (got["b"]["v__sum"], got["b"]["v__std"]) == (2.0, None)


def test_merged_state_equals_direct_statistics(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(d), int(k), float(v)) for d, k, v in zip(rng.integers(0, 20, 500), rng.integers(0, 3, 500), rng.normal(5, 2, 500))], "d int, k int, v double")
    direct = {r["k"]: r for r in A.multi_agg(df, ["k"], {"v": ["sum", "mean", "std", "min", "max"]}).collect()}
    for r in A.merge_stats(A.mergeable_stats(df, ["d", "k"], ["v"]), ["k"], ["v"]).collect():
        assert list(r)[1:] == pytest.approx(list(direct[r["k"]])[1:])


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0, 2.0], [5.0] * 400 + list(range(50)), [1e300, -1e300, 0.1, 0.1], list(np.random.default_rng(0).lognormal(0, 4, 3000))])
@pytest.mark.parametrize("accuracy, held", [(10_000, 200_000), (20, 50)])
def test_exact_quantiles(spark, values, accuracy, held):
    """Also with sketches so coarse that brackets miss their rank, and with too many rows in a bracket."""
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = A.exact_quantiles(df, ["v"], probs, accuracy, held)
    if max(values) < 1e299:
        assert [got["v", p] for p in probs] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    else:
        assert got["v", 0.5] == pytest.approx(0.1)


def test_pivot_unique_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "i int, c string, v double")
    assert tuple(R.pivot_unique(df, ["i"], "c", ["a", "b"], "v").first()) == (1, 2.0, 3.0)
    with pytest.raises(Exception, match="duplicate entries"):
        R.pivot_unique(df.union(df), ["i"], "c", ["a", "b"], "v").collect()


def test_outer_merge_fills_and_drops_null_keys(spark):
    a = spark.createDataFrame([(1, 5), (None, 7)], "k int, x int")
    b = spark.createDataFrame([(2, 6), (None, 8)], "k int, y int")
    assert sorted(tuple(r) for r in outer_merge(a, b, ["k"]).collect()) == [(1, 5, 0), (2, 0, 6)]
    assert join_dim(a, b.withColumnRenamed("k", "z"), "k", "z", "left").columns == ["k", "x", "y"]


def test_adjacency(spark):
    m = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 0.0)], "name string, a double, b double")
    nodes = spark.createDataFrame([("a", 1)], "name string, size int")
    assert [tuple(r) for r in adjacency_to_edges(m, "name", nodes).select("src", "dst", "weight", "src_size", "dst_size").collect()] == [("a", "b", 2.0, 1, None)]


def test_near_and_repeat(spark):
    texts = ["Salud, y confinamiento. Muerte", "salud " + "x " * 12 + "confinamiento muerte", "muerte salud x x x confinamiento", "", None, "salud salud salud"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(near("t", 10, "salud", "confinamiento", "muerte").alias("n"), near("t", 1, "salud", "muerte").alias("m"), repeat("t", 3, "SALUD").alias("r")).collect()
    assert [bool(r["n"]) for r in got] == [True, False, True, False, False, False]
    assert [bool(r["m"]) for r in got] == [False, False, True, False, False, False]
    assert [bool(r["r"]) for r in got] == [False, False, False, False, False, True]


def test_quantiles_with_infinities_and_no_values(spark):
    df = spark.createDataFrame([(float("-inf"), None), (1.0, None), (2.0, None), (float("inf"), None), (float("inf"), None), (float("nan"), None)], "v double, w double")
    got = A.exact_quantiles(df, ["v", "w"], [0.0, 0.25, 0.5, 0.75])
    assert got == {("v", 0.0): float("-inf"), ("v", 0.25): 1.0, ("v", 0.5): 2.0, ("v", 0.75): float("inf"), ("w", 0.0): None, ("w", 0.25): None, ("w", 0.5): None, ("w", 0.75): None}


def test_binned_density_is_near_the_exact_one(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 700), rng.normal(6, 0.5, 300), [12.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    near = [(r.point, r.x, r.density) for r in A.kde_binned(df, "v", 1000).orderBy("point").collect()]
    assert [p for p, *_ in near] == list(range(1000))
    h = values.std(ddof=1) * len(values) ** -0.2
    exact = np.array([np.exp(-0.5 * ((x - values) / h) ** 2).sum() for _, x, _ in near]) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.abs(np.array([d for *_, d in near]) - exact).max() < 1e-3 * exact.max()
    few = {r.point: r for r in A.kde(df, "v", 50).collect()}
    again = {r.point: r for r in A.kde_binned(df, "v", 50).collect()}
    assert again[0].x == pytest.approx(few[0].x) and again[49].x == pytest.approx(few[49].x)


def test_correlations_merge_over_tasks(spark):
    """Tasks with far apart means, holes, a constant column and a pair that never meets."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) + np.repeat([0.0, 1e6, -1e6], 100)[:, None]
    rows = [(float(a), float(b) if i % 3 else None, 4.0, 1.0 * i if i < 50 else None, 2.0 * i if i >= 50 else None) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartitionByRange(5, "a")
    got = {(r.a, r.b): r.r for r in A.corr_matrix(df, ["a", "b", "c", "d", "e"]).collect()}
    held = [(a, b) for a, b, *_ in rows if b is not None]
    assert got["b", "a"] == pytest.approx(np.corrcoef(np.array(held).T)[0, 1], rel=1e-12)
    assert got["c", "a"] is None and got["e", "d"] is None and len(got) == 10
