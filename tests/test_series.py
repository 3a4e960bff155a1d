from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import series as S
from panelspark.operators.reshape import complete_panel

DAY0 = date(2020, 1, 1)


def frame(spark, rows, value="double"):
    return spark.createDataFrame([(k, DAY0 + timedelta(days=d), v) for k, d, v in rows], f"k string, fecha date, v {value}")


def values(df, col="v"):
    return [r[col] for r in df.orderBy("k", "fecha").collect()]


def test_interpolation_vector(spark):
    df = frame(spark, [("a", i, v) for i, v in enumerate([None, 99.0, 1.0, None, 3.0])])
    assert values(S.resample_daily(df, ["k"], "fecha", ["v"], "linear")) == [99.0, 99.0, 1.0, 2.0, 3.0]


def test_interpolation_over_gaps_and_ends(spark):
    df = frame(spark, [("a", 2, 10.0), ("a", 6, 30.0), ("b", 3, None), ("b", 5, 4.0), ("c", 4, None)])
    out = S.resample_daily(df, ["k"], "fecha", ["v"], "linear", DAY0, DAY0 + timedelta(days=7))
    assert values(out.where("k = 'a'")) == [10.0, 10.0, 10.0, 15.0, 20.0, 25.0, 30.0, 30.0]
    assert values(out.where("k = 'b'")) == [4.0] * 8
    assert values(out.where("k = 'c'")) == [None] * 8


def test_zero_fill_common_range_and_duplicates(spark):
    df = frame(spark, [("a", 0, 1.0), ("b", 2, None)])
    assert values(complete_panel(df, ["k"], "fecha", ["v"], "zero")) == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception):
        S.resample_daily(frame(spark, [("a", 0, 1.0), ("a", 0, 2.0)]), ["k"], "fecha", ["v"], "zero").collect()


def test_lags_stay_inside_their_location(spark):
    df = frame(spark, [(k, d, float(10 * i + d)) for i, k in enumerate("ab") for d in range(3)])
    out = S.lag_features(df, ["k"], "fecha", ["v"], [1, -1])
    assert values(out, "v__lag_1") == [None, 0.0, 1.0, None, 10.0, 11.0]
    assert values(out, "v__lag_-1") == [1.0, 2.0, None, 11.0, 12.0, None]
    assert "v" not in out.columns


def test_calendar_lag_skips_holes(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 2, 3.0), ("a", 3, 4.0)])
    assert values(S.lag_features(df, ["k"], "fecha", ["v"], [2], "days"), "v__lag_2") == [None, 1.0, None]
    assert values(S.pct_change_days(df, ["k"], "fecha", ["v"], [1]), "v__pct_change_1") == [None, None, pytest.approx(1 / 3)]


def test_daily_rates_sum_to_the_total(spark):
    df = frame(spark, [("a", d, float(v)) for d, v in enumerate([5, 9, 9, 20])])
    assert sum(values(S.cumulative_to_daily(df, ["k"], "fecha", "v"), "daily")) == 15.0
    weekly = frame(spark, [("a", 0, 0.0), ("a", 2, 4.0), ("a", 6, 20.0)])
    assert values(S.cumulative_to_daily(weekly, ["k"], "fecha", "v"), "daily") == [2.0, 2.5, 3.0, 3.5, 4.0]
    assert values(S.zero_history(weekly, ["k"], "fecha", ["v"], DAY0 - timedelta(days=2))) == [0.0, 0.0, 0.0, 4.0, 20.0]
    assert values(S.zero_history(weekly, ["k"], "fecha", ["v"], DAY0 + timedelta(days=2))) == [0.0, 4.0, 20.0]


@pytest.mark.parametrize("period", [7, 4])
def test_decomposition(spark, period):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 2, 40)
    got = S.decompose(frame(spark, [("a", i, float(v)) for i, v in enumerate(x)]), ["k"], "fecha", "v", period).orderBy("fecha").collect()
    half, weights = period // 2, np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.convolve(x, weights, "valid")
    assert [r["trend"] for r in got[half:-half]] == pytest.approx(list(trend))
    assert got[0]["trend"] is None and got[0]["resid"] is None
    inner = [r for r in got if r["trend"] is not None]
    assert [r["trend"] + r["seasonal"] + r["resid"] for r in inner] == pytest.approx([r["v"] for r in inner])
    assert sum(r["seasonal"] for r in got[:period]) == pytest.approx(0.0, abs=1e-9)


def test_rolling_waits_for_a_full_window(spark):
    got = values(S.rolling(frame(spark, [("a", i, float(i)) for i in range(8)]), ["k"], "fecha", "v"), "v__mean_7")
    assert got == [None] * 6 + [3.0, 4.0]


def test_resample_needs_one_exchange(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 5, 2.0)])
    plan = S.resample_daily(df, ["k"], "fecha", ["v"], "linear")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
