import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelspark.operators import halo as H
from panelspark.operators.diagnostics import acf

KEYS = [["k"], []]


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most of the rows, one with a few, one NULL key."""
    rng = np.random.default_rng(6)
    data = [("hot" if i % 10 else "few" if i % 20 else None, i, float(rng.integers(0, 100)), float(i % 7)) for i in rng.permutation(400).tolist()]
    return spark.createDataFrame(data, "k string, t int, v double, `other col` double")


def same(a, b):
    assert a.columns == b.columns
    left, right = (sorted(map(tuple, x.collect()), key=repr) for x in (a, b))
    assert len(left) == len(right)
    for x, y in zip(left, right):
        assert all(p == pytest.approx(q, rel=1e-9) if isinstance(q, float) else p == q for p, q in zip(x, y))


@pytest.mark.parametrize("keys", KEYS)
@pytest.mark.parametrize("parts", [1, 7, 150])
def test_equal_to_windows(rows, keys, parts):
    ranges, w = H.Ranges(rows, keys, ["t"], parts), W.partitionBy(*keys).orderBy("t")
    assert len(ranges.sizes) > parts // 3
    same(H.lags(ranges, ["v", "other col"], [1, 12, -3]), rows.select("*", *[F.lag(F.col(f"`{c}`"), k).over(w).alias(f"{c}__lag_{k}") for k in (1, 12, -3) for c in ("v", "other col")]))
    same(H.running_sum(ranges, "v"), rows.withColumn("v__running", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))))
    same(H.differences(ranges, "v", 2), rows.withColumn("v__diff_2", F.col("v") - F.lag("v", 2).over(w)))
    frame = w.rowsBetween(-4, 0)
    full = F.count("v").over(frame) == 5
    same(H.rolling(ranges, "v", 5).select("t", F.round("v__mean_5", 9).alias("m"), F.round("v__std_5", 6).alias("s")),
         rows.select("t", F.round(F.when(full, F.avg("v").over(frame)), 9).alias("m"), F.round(F.when(full, F.stddev_samp("v").over(frame)), 6).alias("s")))
    mine = {tuple(r)[:-1]: r.acf for r in H.acf(ranges, "v", 6).collect()}
    whole = {tuple(r)[:-1]: r.acf for r in acf(rows, keys, "t", "v", 6).collect()}
    assert mine == {k: pytest.approx(v, abs=1e-12) for k, v in whole.items()}


def test_empty(spark, rows):
    ranges = H.Ranges(rows.limit(0), ["k"], ["t"], 4)
    assert H.lags(ranges, ["v"], [1]).count() == H.running_sum(ranges, "v").count() == H.acf(ranges, "v", 2).count() == 0


def test_no_exchange_to_one_partition(rows):
    ranges = H.Ranges(rows, [], ["t"], 8)
    for made in (H.lags(ranges, ["v"], [1]), H.rolling(ranges, "v", 3)):
        assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
