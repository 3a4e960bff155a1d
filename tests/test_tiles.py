import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import PCA, VectorAssembler

from panelspark.operators import tiles as T
from panelspark.operators.gram import gram


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 50)) @ rng.normal(size=(50, 50)) + rng.normal(size=50) * 1e4
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(50)])
    return x, spark.createDataFrame(pdf).repartition(7)


def whole(tiles, p, block):
    out = np.full((p, p), np.nan)
    for r in tiles.collect():
        i, j = r.bi * block, r.bj * block
        cp = np.reshape(r.cp, (len(r.mean_i), len(r.mean_j)))
        out[i:i + len(r.mean_i), j:j + len(r.mean_j)] = cp
        out[j:j + len(r.mean_j), i:i + len(r.mean_i)] = cp.T
    return out


@pytest.mark.parametrize("block, strip", [(16, 1 << 27), (16, 1), (50, 1 << 27), (64, 1 << 27), (1, 8 * 100)])
def test_tiles(wide, block, strip):
    x, df = wide
    made = T.tiled_gram(df, df.columns, block=block, strip_bytes=strip)
    z = x - x.mean(axis=0)
    np.testing.assert_allclose(whole(made, 50, block), z.T @ z, rtol=1e-9, atol=1e-6)
    assert {r.n for r in made.select("n").collect()} == {500}


def test_incomplete_rows_and_arrays(spark):
    rows = [([1.0, 2.0, 3.0],), ([2.0, None, 1.0],), (None,), ([4.0, 5.0, 9.0],), ([float("nan"), 1.0, 1.0],), ([0.0, 1.0, 0.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    x = np.array([[1, 2, 3], [4, 5, 9], [0, 1, 0]], float)
    z = x - x.mean(axis=0)
    np.testing.assert_allclose(whole(T.tiled_gram(df, "v", 3, block=2), 3, 2), z.T @ z)
    assert T.tiled_gram(df.limit(0), "v", 3).count() == 0
    with pytest.raises(ValueError, match="no complete row"):
        T.components(T.tiled_gram(df.limit(0), "v", 3), 1)
    with pytest.raises(ValueError, match="width"):
        T.tiled_gram(df, "v")
    with pytest.raises(Exception, match="does not have 4 values"):
        T.tiled_gram(df, "v", 4).count()


def test_cells_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.5), (4.0, 5.0, 8.0)], "a double, b double, c double")
    got = {(r.i, r.j): r for r in T.cells(T.tiled_gram(df, ["a", "b", "c"], block=2), 2).collect()}
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    assert got[0, 1].corr is None and got[1, 1].cp == 0 and got[0, 0].corr == pytest.approx(1)
    assert got[0, 2].corr == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.5, 8])[0, 1])


@pytest.mark.parametrize("block", [16, 64])
def test_components_equal_library(wide, block):
    x, df = wide
    library = PCA(k=8, inputCol="v", outputCol="o").fit(VectorAssembler(inputCols=df.columns, outputCol="v").transform(df))
    mine = T.components(T.tiled_gram(df, df.columns, block=block), 8, block)
    np.testing.assert_allclose(mine.share, library.explainedVariance.toArray(), rtol=1e-8)
    np.testing.assert_allclose(np.abs((mine.axes * library.pc.toArray()).sum(axis=0)), 1, atol=1e-7)
    assert mine.total == pytest.approx(x.var(axis=0, ddof=1).sum())
    full = T.components(T.tiled_gram(df, df.columns, block=block), 50, block)
    assert full.share.sum() == pytest.approx(1) and full.keep(0.5).axes.shape[1] == np.searchsorted(np.cumsum(full.share), 0.5) + 1
    placed = np.array([r.components for r in mine.project(df.orderBy("c0"), df.columns).collect()])
    order = np.argsort(x[:, 0])
    np.testing.assert_allclose(placed, (x[order] - x.mean(axis=0)) @ mine.axes, rtol=1e-6, atol=1e-6)


def test_project_keeps_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, 9.0), (5.0, 4.0)], "a double, b double")
    made = T.components(T.tiled_gram(df, ["a", "b"]), 2).project(df, ["a", "b"]).collect()
    assert [r.components is None for r in made] == [False, True, False, False]


def test_wide_gram_goes_by_tiles(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 130))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(130)]))
    got = {(r.i, r.j): r.s for r in gram(df, df.columns).collect()}
    assert len(got) == 130 * 130
    want = np.corrcoef(x.T) * 40
    assert got["c3", "c120"] == pytest.approx(want[3, 120]) == got["c120", "c3"] and got["c7", "c7"] == pytest.approx(40)
