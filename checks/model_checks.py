"""Scaling, splits, AR models and learners."""

from pyspark.sql import functions as F

from checks.base import NATIONAL, PANEL, check, daily_facts, flows, national, r, shown, table, with_
from checks.series_checks import DAILY, DENSE, daily, panel
from checks.statistics_checks import SPLIT
from panelspark.operators import likelihood as L
from panelspark.operators import models as M
from panelspark.operators.aggregate import group_sum
from panelspark.operators.gram import metrics
from panelspark.operators.joins import assemble
from panelspark.operators.project import calendar_features
from panelspark.operators.series import lag_features, resample_daily, time_split
from panelspark.session import stage

DAY = "CAST(fecha AS VARCHAR) AS fecha"


@check("standard_scale", with_(NATIONAL, f"x AS (SELECT *, {SPLIT} AS split FROM national)", "s AS (SELECT avg(casos) AS a, stddev_pop(casos) AS b, avg(importe) AS c, stddev_pop(importe) AS e FROM x WHERE split = 'train')")
       + f"SELECT {DAY}, split, {r('(casos - a) / b')} AS casos, {r('(importe - c) / e')} AS importe FROM x, s")
def standard_scale(spark, d):
    rows = M.hash_split(national(spark, d), "fecha")
    train, test = M.scale(rows.where("split = 'train'"), rows.where("split = 'test'"), ["casos", "importe"])
    return shown(train.unionByName(test))


@check("minmax_scale", f"SELECT l_orderkey, l_linenumber, {r('(l_quantity - (SELECT min(l_quantity) FROM lineitem)) / ((SELECT max(l_quantity) - min(l_quantity) FROM lineitem))')} AS l_quantity FROM lineitem")
def minmax_scale(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    return M.minmax(rows, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@check("hash_split", with_(NATIONAL) + f"SELECT {DAY}, {SPLIT} AS split FROM national")
def hash_split(spark, d):
    return shown(M.hash_split(national(spark, d).select("fecha"), "fecha"))


@check("residuals", with_(NATIONAL, *DAILY) + f"SELECT {DAY}, CAST(casos - lag(casos, 1) OVER (ORDER BY daily.fecha) AS DOUBLE) AS residual FROM daily")
def residuals(spark, d):
    from pyspark.sql.window import Window as W

    guess = F.lag("casos").over(W.orderBy("fecha"))
    rows = daily(spark, d).select("fecha", F.col("casos").cast("double").alias("casos")).withColumn("yhat", guess)
    return shown(M.residuals(rows, "casos", "yhat", ["fecha"]))


AR1 = ("w AS (SELECT prov, fecha, num_casos AS y, num_casos - lag(num_casos) OVER v AS w FROM panel WINDOW v AS (PARTITION BY prov ORDER BY fecha))",
       "l AS (SELECT *, lag(w) OVER (PARTITION BY prov ORDER BY fecha) AS x FROM w)",
       "f AS (SELECT prov, regr_slope(w, x) AS b, regr_intercept(w, x) AS a, regr_r2(w, x) AS r2, count(*) AS n FROM l WHERE w IS NOT NULL AND x IS NOT NULL GROUP BY ALL)")


def small_panel(spark, d):
    return panel(spark, d).select("prov", "fecha", "num_casos")


@check("ar1_fit", with_(*PANEL, *DENSE, *AR1) + f"SELECT prov, 'const' AS feature, {r('a')} AS coefficient, n, {r('r2')} AS r2 FROM f UNION ALL SELECT prov, 'ar_1', {r('b')}, n, {r('r2')} FROM f")
def ar1_fit(spark, d):
    return shown(M.ar_fit(small_panel(spark, d), ["prov"], "fecha", "num_casos", 1, 1).select("prov", "feature", "coefficient", "n", "r2"))


@check("ar_fit")
def ar_fit(spark, d):
    return M.ar_fit(small_panel(spark, d), ["prov"], "fecha", "num_casos", 10, 1)


@check("ar1_forecast", "WITH RECURSIVE " + ",\n".join([*PANEL, *DENSE, *AR1, "e AS (SELECT prov, arg_max(y, fecha) AS y, arg_max(w, fecha) AS w, max(fecha) AS fecha FROM l GROUP BY ALL)",
       "go(prov, step, fecha, y, w) AS (SELECT prov, 0, fecha, CAST(y AS DOUBLE), CAST(w AS DOUBLE) FROM e UNION ALL SELECT go.prov, step + 1, go.fecha + 1, go.y + a + b * go.w, a + b * go.w FROM go JOIN f ON f.prov = go.prov WHERE step < 7)"])
       + f"\nSELECT prov, step, {DAY}, {r('y')} AS forecast FROM go WHERE step > 0")
def ar1_forecast(spark, d):
    out = M.ar_forecast(small_panel(spark, d), ["prov"], "fecha", "num_casos", 1, 1, 7)
    return out.select("prov", "step", F.col("fecha").cast("string").alias("fecha"), F.round("forecast", 6).alias("forecast"))


@check("ar_forecast")
def ar_forecast(spark, d):
    return M.ar_forecast(small_panel(spark, d), ["prov"], "fecha", "num_casos", 10, 1, 10)


def wide_design(spark, d):
    """Daily design of the wide forecast: target, lagged sources, calendar; staged, as fits read it often."""
    facts = resample_daily(group_sum(daily_facts(spark, d), ["fecha"], ["num_def", "num_casos", "importe"]), [], "fecha",
                           ["num_def", "num_casos", "importe"], "zero")
    target = facts.select("fecha", "num_def")
    casos = lag_features(facts.select("fecha", F.col("num_casos").alias("casos"), "importe"), [], "fecha", ["casos", "importe"], [1, 10, 15, 21])
    trips = flows(spark, d).groupBy("fecha").agg(F.sum("viajes").alias("viajes"))
    mitma = lag_features(resample_daily(trips, [], "fecha", ["viajes"], "linear"), [], "fecha", ["viajes"], [0, 5, 10, 21])
    joined = calendar_features(assemble(target, {"casos": casos, "mitma": mitma}, ["casos", "mitma"]), "fecha")
    return stage(time_split(joined, "fecha", 21, 7).dropna(), "design")


def features(df):
    return [c for c in df.columns if c not in ("fecha", "num_def", "split")]


def scored(model, df):
    return metrics(M.predict(model, df.where("split != 'warmup'")), "num_def", "prediction", "split")


@check("forest_fit")
def forest_fit(spark, d):
    df = wide_design(spark, d)
    model = M.forest(df.where("split = 'train'"), "num_def", features(df), trees=20, depth=10)
    return M.importance(model, features(df), spark)


@check("forest_score")
def forest_score(spark, d):
    df = wide_design(spark, d)
    return scored(M.forest(df.where("split = 'train'"), "num_def", features(df), trees=20, depth=10), df)


@check("boosting_fit")
def boosting_fit(spark, d):
    df = wide_design(spark, d)
    return scored(M.boosting(df.where("split = 'train'"), "num_def", features(df), rounds=10), df)


@check("linear_fit")
def linear_fit(spark, d):
    df = wide_design(spark, d)
    return scored(M.linear(df.where("split = 'train'"), "num_def", features(df)), df)


@check("pca_forest")
def pca_forest(spark, d):
    df = wide_design(spark, d)
    return scored(M.pca_forest(df.where("split = 'train'"), "num_def", features(df), trees=20, depth=8), df)


@check("rfe_time")
def rfe_time(spark, d):
    from panelspark.operators.search import time_folds

    df = wide_design(spark, d).where("split = 'train'")
    folds = [(f["train_to"], f["test_from"], f["test_to"]) for f in time_folds(df, "fecha", 3, 7).orderBy("fold").collect()]
    return M.rfe_time(df, "fecha", "num_def", features(df), folds, step=6, minimum=6, trees=8, depth=5)[0]


def stump(rows, cols, y, by=()):
    """The best cut of ``rows`` for ``y``, from sums by value: the column, the cut, and the mean on either side."""
    head = "".join(f"{b}, " for b in by)
    sums = " UNION ALL ".join(f"SELECT {head}'{c}' AS f, {c} AS x, count(*) AS n, sum({y}) AS s FROM {rows} GROUP BY ALL" for c in cols)
    upto, whole = f"PARTITION BY {head}f ORDER BY x", f"PARTITION BY {head}f"
    return (f"stump_v AS ({sums})",
            f"stump_c AS (SELECT {head}f, x, lead(x) OVER w AS nx, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER ({whole}) AS tn, sum(s) OVER ({whole}) AS ts FROM stump_v WINDOW w AS ({upto}))",
            f"stump AS (SELECT {head}arg_max(f, g) AS f, arg_max((x + nx) / 2.0, g) AS cut, arg_max(s / n, g) AS lo, arg_max((ts - s) / (tn - n), g) AS hi "
            f"FROM (SELECT *, s * s / n + (ts - s) * (ts - s) / (tn - n) AS g FROM stump_c WHERE nx IS NOT NULL) {'GROUP BY ALL' if by else ''})")


def cut(cols):
    """What the stump says about a row that has the columns ``cols``."""
    below = [f"(f = '{c}' AND {c} <= cut)" for c in cols]
    return f"CASE WHEN {' OR '.join(below)} THEN lo ELSE hi END"


# Few distinct values, so that every cut between two of them is tried.
LINES = "lines AS (SELECT CAST(floor(l_quantity / 5) AS DOUBLE) AS a, CAST(l_linenumber AS DOUBLE) AS b, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)"


def lines(spark, d):
    return table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 5).cast("double").alias("a"), F.col("l_linenumber").cast("double").alias("b"),
                                              F.col("l_extendedprice").cast("double").alias("y"))


def by_value(model, df):
    return M.predict(model, df).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("prediction"))


SHOW_STUMP = f"SELECT a, b, count(*) AS n, {r(f'avg({cut(list('ab'))})', 3)} AS prediction FROM lines, stump GROUP BY ALL"


@check("forest_stump", with_(LINES, *stump("lines", "ab", "y")) + SHOW_STUMP)
def forest_stump(spark, d):
    """One tree of one cut."""
    rows = lines(spark, d)
    return by_value(M.forest(rows, "y", ["a", "b"], trees=1, depth=1, bootstrap=False), rows)


@check("importance_stump", with_(LINES, *stump("lines", "ab", "y")) + "SELECT c AS feature, CASE WHEN f = c THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM stump, (VALUES ('a'), ('b')) v(c)")
def importance_stump(spark, d):
    rows = lines(spark, d)
    return M.importance(M.forest(rows, "y", ["a", "b"], trees=1, depth=1, bootstrap=False), ["a", "b"], spark)


@check("boosting_stump", with_(LINES.replace("AS y FROM", "* l_discount AS y FROM"), *stump("lines", "ab", "y")) + SHOW_STUMP)
def boosting_stump(spark, d):
    """One round of one cut, on another target."""
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 5).cast("double").alias("a"), F.col("l_linenumber").cast("double").alias("b"),
                                              (F.col("l_extendedprice").cast("double") * F.col("l_discount")).alias("y"))
    return by_value(M.boosting(rows, "y", ["a", "b"], rounds=1, depth=1), rows)


LINEAR = """s AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby FROM lines),
e AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM s)"""


@check("linear_two", with_(LINES, LINEAR) + f"SELECT a, b, count(*) AS n, {r('avg(my + ba * (a - ma) + bb * (b - mb))', 3)} AS prediction FROM lines, e GROUP BY ALL")
def linear_two(spark, d):
    """Two columns have a closed form."""
    rows = lines(spark, d)
    return by_value(M.linear(rows, "y", ["a", "b"]), rows)


# The axes of two columns by the angle of their covariance; the cut is searched over both coordinates.
AXES = """s AS (SELECT avg(a) AS ma, avg(b) AS mb, 0.5 * atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) AS t FROM lines),
turned AS (SELECT a, b, y, round(cos(t) * (a - ma) + sin(t) * (b - mb), 9) AS p, round(cos(t) * (b - mb) - sin(t) * (a - ma), 9) AS q FROM lines, s)"""


@check("pca_stump", with_(LINES, AXES, *stump("turned", "pq", "y")) + f"SELECT a, b, count(*) AS n, {r(f'avg({cut(list('pq'))})', 3)} AS prediction FROM turned, stump GROUP BY ALL")
def pca_stump(spark, d):
    """One cut on the components of two columns."""
    rows = lines(spark, d)
    return by_value(M.pca_forest(rows, "y", ["a", "b"], share=1.0, trees=1, depth=1, bootstrap=False, bins=256), rows)


# Folds of a week each; the cut of every fold is searched on the days before it.
WEEKS = ("k AS (SELECT i AS fold, z - CAST((3 - i) * 7 + 6 AS INTEGER) AS first, z - CAST((3 - i) * 7 AS INTEGER) AS last FROM range(1, 4) t(i), (SELECT max(fecha) AS z FROM days))",
         "train AS (SELECT fold, casos, diasemana, y FROM days JOIN k ON days.fecha < first)")
DAYS = "days AS (SELECT fecha, CAST(casos AS DOUBLE) AS casos, CAST(dayofweek(fecha) + 1 AS DOUBLE) AS diasemana, CAST(importe AS DOUBLE) AS y FROM national)"
FOLD_SCORE = (f"score AS (SELECT k.fold, 1 - avg(pow(y - ({cut(['casos', 'diasemana'])}), 2)) / nullif(var_pop(y), 0) AS r2 FROM k JOIN days ON days.fecha BETWEEN first AND last "
              "JOIN stump ON stump.fold = k.fold GROUP BY ALL)")


@check("rfe_stump", with_(NATIONAL, DAYS, *WEEKS, *stump("train", ["casos", "diasemana"], "y", ["fold"]), FOLD_SCORE)
       + f"SELECT CAST(n_features AS INTEGER) AS n_features, count(r2) AS folds, {r('avg(r2)')} AS r2, 'casos' AS best FROM score, (VALUES (1), (2)) v(n_features) GROUP BY ALL")
def rfe_stump(spark, d):
    """Elimination with trees of one cut: the cut is on the same column whether the other one is there or not."""
    from panelspark.operators.elimination import RecursiveElimination

    rows = national(spark, d).select("fecha", F.col("casos").cast("double").alias("casos"), F.dayofweek("fecha").cast("double").alias("diasemana"), F.col("importe").cast("double").alias("y"))
    model = RecursiveElimination(labelCol="y", features=["casos", "diasemana"], step=1, numTrees=1, maxDepth=1, maxBins=256, bootstrap=False).fit(rows)
    return model.scores(spark).select("n_features", F.col("folds").cast("bigint").alias("folds"), F.round("r2", 6).alias("r2"), F.lit(model.selected[0]).alias("best"))


# The exact likelihood of an AR(1) without a mean: its maximum solves a cubic, here by Newton's steps.
EXACT = ("w AS (SELECT prov, fecha, num_casos AS y, CAST(num_casos - lag(num_casos) OVER v AS DOUBLE) AS w, row_number() OVER v AS i FROM panel WINDOW v AS (PARTITION BY prov ORDER BY fecha))",
         "l AS (SELECT *, lag(w) OVER (PARTITION BY prov ORDER BY fecha) AS x, lead(w) OVER (PARTITION BY prov ORDER BY fecha) AS z FROM w WHERE w IS NOT NULL)",
         "s AS (SELECT prov, count(*) AS n, sum(w * w) AS a, sum(w * x) AS b, sum(CASE WHEN x IS NOT NULL AND z IS NOT NULL THEN w * w END) AS c FROM l GROUP BY ALL)",
         "go(prov, n, a, b, c, k, f) AS (SELECT prov, n, a, b, c, 0, b / c FROM s UNION ALL SELECT prov, n, a, b, c, k + 1, "
         "f - (c * (n - 1) * f * f * f - b * (n - 2) * f * f - (a + n * c) * f + n * b) / (3 * c * (n - 1) * f * f - 2 * b * (n - 2) * f - (a + n * c)) FROM go WHERE k < 30)",
         "fit AS (SELECT *, a - 2 * b * f + c * f * f AS q FROM go WHERE k = 30)")


@check("ar1_likelihood", "WITH RECURSIVE " + ",\n".join([*PANEL, *DENSE, *EXACT])
       + f"\nSELECT prov, 'ar_1' AS feature, {r('f')} AS coefficient, {r('q / n')} AS sigma2, n, {r('-0.5 * n * (ln(2 * pi() * q / n) + 1) + 0.5 * ln(1 - f * f)', 4)} AS loglik FROM fit")
def ar1_likelihood(spark, d):
    out = L.ar_likelihood(small_panel(spark, d), ["prov"], "fecha", "num_casos", 1, 1)
    return shown(out.select("prov", "feature", "coefficient", "sigma2", "n", F.round("loglik", 4).alias("loglik")))


@check("ar1_likelihood_forecast", "WITH RECURSIVE " + ",\n".join([*PANEL, *DENSE, *EXACT, "e AS (SELECT prov, arg_max(y, fecha) AS y, arg_max(w, fecha) AS w, max(fecha) AS fecha FROM l GROUP BY ALL)"])
       + f"\nSELECT e.prov, CAST(h AS INTEGER) AS step, CAST(e.fecha + CAST(h AS INTEGER) AS VARCHAR) AS fecha, {r('y + w * f * (1 - pow(f, h)) / (1 - f)', 5)} AS forecast FROM e JOIN fit ON fit.prov = e.prov, range(1, 8) t(h)")
def ar1_likelihood_forecast(spark, d):
    out = L.ar_likelihood_forecast(small_panel(spark, d), ["prov"], "fecha", "num_casos", 1, 1, 7)
    return out.select("prov", "step", F.col("fecha").cast("string").alias("fecha"), F.round("forecast", 5).alias("forecast"))


@check("ar12_likelihood")
def ar12_likelihood(spark, d):
    return L.ar_likelihood(small_panel(spark, d), ["prov"], "fecha", "num_casos", 12, 1)


SECOND = ("w AS (SELECT prov, fecha, num_casos AS y, num_casos - lag(num_casos) OVER v AS s, num_casos - 2 * lag(num_casos) OVER v + lag(num_casos, 2) OVER v AS w FROM panel WINDOW v AS (PARTITION BY prov ORDER BY fecha))",
          "l AS (SELECT *, lag(w) OVER (PARTITION BY prov ORDER BY fecha) AS x FROM w)",
          "f AS (SELECT prov, regr_slope(w, x) AS b, regr_intercept(w, x) AS a FROM l WHERE w IS NOT NULL AND x IS NOT NULL GROUP BY ALL)",
          "e AS (SELECT prov, arg_max(y, fecha) AS y, arg_max(s, fecha) AS s, arg_max(w, fecha) AS w, max(fecha) AS fecha FROM l GROUP BY ALL)",
          "go(prov, step, fecha, y, s, w) AS (SELECT prov, 0, fecha, CAST(y AS DOUBLE), CAST(s AS DOUBLE), CAST(w AS DOUBLE) FROM e UNION ALL "
          "SELECT go.prov, step + 1, go.fecha + 1, go.y + go.s + a + b * go.w, go.s + a + b * go.w, a + b * go.w FROM go JOIN f ON f.prov = go.prov WHERE step < 7)")


@check("second_difference_forecast", "WITH RECURSIVE " + ",\n".join([*PANEL, *DENSE, *SECOND]) + f"\nSELECT prov, step, {DAY}, {r('y', 5)} AS forecast FROM go WHERE step > 0")
def second_difference_forecast(spark, d):
    out = M.ar_forecast(small_panel(spark, d), ["prov"], "fecha", "num_casos", 1, 2, 7)
    return out.select("prov", "step", F.col("fecha").cast("string").alias("fecha"), F.round("forecast", 5).alias("forecast"))
