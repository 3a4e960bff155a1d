"""Subset search and backtests."""

from pyspark.sql import functions as F

from checks.base import NATIONAL, PANEL, WORDS, check, daily_facts, flows, national, r, shown, span, table, with_
from checks.model_checks import small_panel
from checks.series_checks import DAILY, DENSE, daily
from checks.statistics_checks import SPLIT
from panelspark.operators import search as Q
from panelspark.operators.aggregate import collapse, group_sum
from panelspark.operators.joins import assemble
from panelspark.operators.models import hash_split
from panelspark.operators.project import add_prefix
from panelspark.operators.reshape import coef_matrix
from panelspark.operators.series import holiday_panel, lag_features, resample_daily
from panelspark.session import stage

SOURCES = ["casos_uci", "casos", "aemet", "googletrends", "mitma", "mscbs", "holidays"]


@check("subsets", """
WITH m AS (SELECT unnest(range(1, 1 << (SELECT count(*) FROM region)::INTEGER)) AS mask), s AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS b, r_name AS name FROM region)
SELECT mask, string_agg(name, ',' ORDER BY b) AS members, count(*) AS length FROM m JOIN s ON (mask >> b::INTEGER) % 2 = 1 GROUP BY ALL""")
def subsets(spark, d):
    names = [x.r_name for x in table(spark, d, "region").orderBy("r_regionkey").select("r_name").collect()]
    return Q.subsets(spark, names).select("mask", F.concat_ws(",", "members").alias("members"), F.col("length").cast("bigint").alias("length"))


def lagged(df, name, cols, lags, how="sum", keys=("prov",)):
    """Complete, lag by location, prefix by source, one row per day."""
    full = resample_daily(df, list(keys), "fecha", cols, "zero")
    return collapse(add_prefix(lag_features(full, list(keys), "fecha", cols, lags), f"{name}__", ["fecha", *keys]), how, locations=list(keys))


def search_design(spark, d):
    """Target seven days ahead and seven lagged sources, one row per day, staged once."""
    facts = daily_facts(spark, d)
    at = facts.select("fecha", "prov", "num_casos", "importe", "num_hosp", "num_uci", "num_def")
    target = lagged(at.select("fecha", "prov", "num_def"), "target", ["num_def"], [-7])
    stations = (table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("fecha"), "l_discount", "l_tax")
                .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
                .groupBy("fecha", F.col("s_nationkey").alias("prov")).agg(F.avg("l_discount").alias("tmed"), F.avg("l_tax").alias("prec")))
    trips = flows(spark, d).groupBy("fecha", F.col("dest").alias("prov")).agg(F.sum("viajes").alias("viajes"), F.sum("viajes_km").alias("viajes_km"))
    rate = facts.groupBy("fecha").agg(F.sum("num_casos").cast("double").alias("daily"))
    trends = group_sum(facts, ["fecha"], WORDS)
    free = holiday_panel(facts.where(F.day("fecha") == 1), facts, *span(spark, d))
    sources = {
        "casos_uci": lagged(at, "casos_uci", ["num_hosp", "num_uci", "num_def"], [1, 7, 14, 21]),
        "casos": lagged(at, "casos", ["num_casos", "importe"], [0, 7, 14, 21]),
        "aemet": lagged(stations, "aemet", ["tmed", "prec"], [10, 20, 30], "mean"),
        "googletrends": lagged(trends, "googletrends", WORDS, [10, 20, 30], keys=()),
        "mitma": lagged(trips, "mitma", ["viajes", "viajes_km"], [10, 20, 30]),
        "mscbs": lagged(rate, "mscbs", ["daily"], [10, 20, 30], keys=()),
        "holidays": lagged(free, "holidays", ["holiday"], [10, 20, 30], "max"),
    }
    groups = {n: [c for c in s.columns if c != "fecha"] for n, s in sources.items()}
    return stage(hash_split(assemble(target, sources, SOURCES, how="left"), "fecha"), "search"), "target__num_def__lag_-7", groups


@check("search_subsets")
def search_subsets(spark, d):
    df, y, groups = search_design(spark, d)
    return Q.search_subsets(df, y, groups).drop("terms").withColumn("columns", F.concat_ws(",", "columns"))


@check("search_per_subset")
def search_per_subset(spark, d):
    df, y, groups = search_design(spark, d)
    return Q.search_subsets(df, y, groups, sample="per_subset").drop("terms").withColumn("columns", F.concat_ws(",", "columns"))


@check("search_candidates")
def search_candidates(spark, d):
    df, y, groups = search_design(spark, d)
    return Q.candidates(Q.search_subsets(df, y, groups), 2, "googletrends").select("mask", "combination", "n_features", "r2_adj_train", "r2_test")


@check("search_coefficients")
def search_coefficients(spark, d):
    df, y, groups = search_design(spark, d)
    few = {k: groups[k] for k in ("casos", "holidays")}
    terms = Q.coefficients(Q.search_subsets(df, y, few, eliminate=False))
    return coef_matrix(terms, ["const", *few["casos"], *few["holidays"]])


# One row per day: the cases a week ahead explained by two columns.
TWO = (NATIONAL, *DAILY, f"t AS (SELECT *, {SPLIT} AS split FROM (SELECT fecha, lead(casos, 7) OVER (ORDER BY fecha) AS y, CAST(casos AS DOUBLE) AS a, importe AS b FROM daily) WHERE y IS NOT NULL)")


def two_columns(spark, d):
    from pyspark.sql.window import Window as W

    rows = daily(spark, d).select("fecha", F.lead(F.col("casos"), 7).over(W.orderBy("fecha")).cast("double").alias("y"), F.col("casos").cast("double").alias("a"), F.col("importe").alias("b"))
    return hash_split(rows.dropna(), "fecha")


def scores(name, mask, k, guess):
    """R2 of a linear guess over the columns of ``t``, written out on the rows."""
    return f"""SELECT {mask} AS mask, '{name}' AS combination, {k} AS length, {k + 1} AS n_features,
{r(f"max(CASE WHEN split = 'train' THEN 1 - (n - 1) / CAST(n - {k + 1} AS DOUBLE) * sse / sst END)", 5)} AS r2_adj_train, {r("max(CASE WHEN split = 'test' THEN 1 - sse / sst END)", 5)} AS r2_test
FROM (SELECT split, count(*) AS n, sum(pow(y - ({guess}), 2)) AS sse, count(*) * var_pop(y) AS sst FROM t, e GROUP BY ALL)"""


PAIR_TRAIN = """s AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby FROM t WHERE split = 'train'),
e AS (SELECT *, say / saa AS ka, sby / sbb AS kb, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM s)"""


@check("search_pairs", with_(*TWO, PAIR_TRAIN) + "\nUNION ALL ".join([scores("a", 1, 1, "my + ka * (a - ma)"), scores("b", 2, 1, "my + kb * (b - mb)"),
                                                                      scores("a,b", 3, 2, "my + ba * (a - ma) + bb * (b - mb)")]))
def search_pairs(spark, d):
    out = Q.search_subsets(two_columns(spark, d), "y", {"a": ["a"], "b": ["b"]}, eliminate=False)
    return out.select("mask", "combination", "length", "n_features", F.round("r2_adj_train", 5).alias("r2_adj_train"), F.round("r2_test", 5).alias("r2_test"))


@check("search_single", with_(*TWO) + f"SELECT 'a' AS combination, {r('1 - (count(*) - 1) / CAST(count(*) - 2 AS DOUBLE) * (1 - regr_r2(y, a))')} AS r2_adj_train, count(*) AS n_train FROM t WHERE split = 'train'")
def search_single(spark, d):
    out = Q.search_subsets(two_columns(spark, d), "y", {"a": ["a"]}, eliminate=False)
    return out.select("combination", F.round("r2_adj_train", 6).alias("r2_adj_train"), "n_train")


@check("backward")
def backward(spark, d):
    """All columns of two sources, fitted once and thinned out."""
    df, y, groups = search_design(spark, d)
    return Q.fit_one(df, y, [*groups["casos"], *groups["holidays"]]).terms(spark)


@check("column_search")
def column_search(spark, d):
    df, y, groups = search_design(spark, d)
    columns = {c: [c] for c in groups["casos"] + groups["mitma"]}
    return Q.search_subsets(df, y, columns, eliminate=False).drop("terms", "columns").orderBy(F.desc("r2_test"), F.asc("length"), F.asc("mask"))


@check("time_folds", with_(NATIONAL, "m AS (SELECT max(fecha) AS z FROM national)") + """
SELECT i AS fold, CAST(z - CAST((3 - i) * 7 + 7 AS INTEGER) AS VARCHAR) AS train_to, CAST(z - CAST((3 - i) * 7 + 6 AS INTEGER) AS VARCHAR) AS test_from,
CAST(z - CAST((3 - i) * 7 AS INTEGER) AS VARCHAR) AS test_to FROM range(1, 4) t(i), m""")
def time_folds(spark, d):
    return shown(Q.time_folds(national(spark, d), "fecha"))


@check("walk_forward")
def walk_forward(spark, d):
    return Q.walk_forward(small_panel(spark, d), ["prov"], "fecha", "num_casos", 10, 1, 10)


LAST = "o AS (SELECT prov, fecha AS origin, num_casos AS y FROM (SELECT *, row_number() OVER (PARTITION BY prov ORDER BY fecha DESC) AS k FROM panel) WHERE k <= 10)"


@check("walk_forward_mean", with_(*PANEL, *DENSE, LAST) + f"""
SELECT o.prov, CAST(origin AS VARCHAR) AS fecha, CAST(any_value(o.y) AS DOUBLE) AS y, {r('avg(num_casos)')} AS yhat FROM o JOIN panel ON o.prov = panel.prov AND panel.fecha < origin GROUP BY o.prov, origin""")
def walk_forward_mean(spark, d):
    return shown(Q.walk_forward(small_panel(spark, d), ["prov"], "fecha", "num_casos", 0, 0, 10))


PAST = "(PARTITION BY prov ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@check("walk_forward_ar1", with_(*PANEL, *DENSE, "w AS (SELECT prov, fecha, num_casos AS y, lag(num_casos) OVER v AS prev, num_casos - lag(num_casos) OVER v AS w FROM panel WINDOW v AS (PARTITION BY prov ORDER BY fecha))",
       "l AS (SELECT *, lag(w) OVER (PARTITION BY prov ORDER BY fecha) AS x, row_number() OVER (PARTITION BY prov ORDER BY fecha DESC) AS k FROM w)",
       f"h AS (SELECT *, regr_slope(w, x) OVER {PAST} AS b, regr_intercept(w, x) OVER {PAST} AS a FROM l)")
       + f"SELECT prov, CAST(fecha AS VARCHAR) AS fecha, CAST(y AS DOUBLE) AS y, {r('prev + a + b * x')} AS yhat FROM h WHERE k <= 10")
def walk_forward_ar1(spark, d):
    return shown(Q.walk_forward(small_panel(spark, d), ["prov"], "fecha", "num_casos", 1, 1, 10))


# Closed forms on two columns: what the search says about every subset.
TERMS = """sd AS (SELECT sqrt(saa / n) AS da, sqrt(sbb / n) AS db, e.* FROM e, (SELECT count(*) AS n FROM t WHERE split = 'train')),
terms AS (SELECT 'a' AS combination, my AS c0, ka * da AS c1, NULL::DOUBLE AS c2 FROM sd UNION ALL SELECT 'b', my, NULL, kb * db FROM sd UNION ALL SELECT 'a,b', my, ba * da, bb * db FROM sd)"""


@check("coefficients_two", with_(*TWO, PAIR_TRAIN, TERMS) + "\nUNION ALL ".join(
    f"SELECT combination, '{f}' AS feature, {r(c, 4)} AS coefficient FROM terms WHERE {c} IS NOT NULL" for f, c in (("const", "c0"), ("a", "c1"), ("b", "c2"))))
def coefficients_two(spark, d):
    out = Q.coefficients(Q.search_subsets(two_columns(spark, d), "y", {"a": ["a"], "b": ["b"]}, eliminate=False))
    return out.select("combination", "feature", F.round("coefficient", 4).alias("coefficient"))


@check("coef_matrix_two", with_(*TWO, PAIR_TRAIN, TERMS) + f"SELECT combination, {r('c0', 4)} AS const, {r('c1', 4)} AS a, {r('c2', 4)} AS b FROM terms")
def coef_matrix_two(spark, d):
    terms = Q.coefficients(Q.search_subsets(two_columns(spark, d), "y", {"a": ["a"], "b": ["b"]}, eliminate=False))
    return shown(coef_matrix(terms, ["const", "a", "b"]), 4)


ALL_SCORES = "\nUNION ALL ".join([scores("a", 1, 1, "my + ka * (a - ma)"), scores("b", 2, 1, "my + kb * (b - mb)"), scores("a,b", 3, 2, "my + ba * (a - ma) + bb * (b - mb)")])


@check("candidates_two", with_(*TWO, PAIR_TRAIN) + f"SELECT * FROM ({ALL_SCORES}) WHERE combination IN ('b', 'a,b') ORDER BY r2_test DESC, length, mask LIMIT 1")
def candidates_two(spark, d):
    """The best subset that holds a given source."""
    out = Q.candidates(Q.search_subsets(two_columns(spark, d), "y", {"a": ["a"], "b": ["b"]}, eliminate=False), must="b", k=1)
    return out.select("mask", "combination", "length", "n_features", F.round("r2_adj_train", 5).alias("r2_adj_train"), F.round("r2_test", 5).alias("r2_test"))


# The value of a day is explained by its cases; a column without spread explains nothing.
CLEAR = (NATIONAL, f"t AS (SELECT fecha, {SPLIT} AS split, importe / 1e8 AS y, CAST(casos AS DOUBLE) AS a, 0.0 AS nada FROM national)",
         "e AS (SELECT regr_slope(y, a) AS b1, regr_intercept(y, a) AS b0, regr_r2(y, a) AS r2, regr_sxx(y, a) AS sxx, regr_syy(y, a) AS syy, count(*) AS n, avg(a) AS ma FROM t WHERE split = 'train')")


def clear(spark, d):
    rows = national(spark, d).select("fecha", (F.col("importe") / 1e8).alias("y"), F.col("casos").cast("double").alias("a"), F.lit(0.0).alias("nada"))
    return hash_split(rows, "fecha")


@check("backward_two", with_(*CLEAR) + f"""SELECT feature, {r('coefficient', 5)} AS coefficient, {r('std_error', 5)} AS std_error FROM (
SELECT 'const' AS feature, b0 AS coefficient, sqrt((1 - r2) * syy / (n - 2) * (1.0 / n + ma * ma / sxx)) AS std_error FROM e
UNION ALL SELECT 'a', b1, sqrt((1 - r2) * syy / (n - 2) / sxx) FROM e)""")
def backward_two(spark, d):
    """Elimination keeps the clear column and drops the empty one; no subset is fitted."""
    model = Q.fit_one(clear(spark, d), "y", ["nada", "a"])
    return shown(model.terms(spark).drop("p_value"), 5)


@check("predict_rows", with_(*CLEAR) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, {r('b0 + b1 * a')} AS prediction FROM t, e WHERE split = 'test'")
def predict_rows(spark, d):
    rows = clear(spark, d)
    return shown(Q.fit_one(rows, "y", ["a"], eliminate=False).predict(rows.where("split = 'test'")).select("fecha", "prediction"))


@check("fit_one", with_(*TWO, PAIR_TRAIN) + f"""SELECT feature, {r('coefficient', 4)} AS coefficient FROM (
SELECT 'const' AS feature, my - ba * ma - bb * mb AS coefficient FROM e UNION ALL SELECT 'a', ba FROM e UNION ALL SELECT 'b', bb FROM e)""")
def fit_one(spark, d):
    """One named list of columns, without elimination, on the unscaled columns."""
    return shown(Q.fit_one(two_columns(spark, d), "y", ["a", "b"], eliminate=False).terms(spark).select("feature", "coefficient"), 4)


# Every subset on its own rows: columns have holes, and each subset uses the days that have its columns.
HOLES = (*TWO, "h AS (SELECT fecha, split, y, CASE WHEN day(fecha) % 5 <> 0 THEN a END AS a, CASE WHEN day(fecha) % 3 <> 0 THEN b END AS b FROM t)")


def own_sample(name, mask, cols, guess):
    here = f"t_{mask} AS (SELECT * FROM h WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})"
    fitted = PAIR_TRAIN.replace("FROM t ", f"FROM t_{mask} ").replace("s AS", f"s_{mask} AS", 1).replace("\ne AS", f"\ne_{mask} AS").replace("FROM s)", f"FROM s_{mask})")
    return (here, fitted), scores(name, mask, len(cols), guess).replace("FROM t, e", f"FROM t_{mask}, e_{mask}")


OWN = [own_sample("a", 1, "a", "my + ka * (a - ma)"), own_sample("b", 2, "b", "my + kb * (b - mb)"), own_sample("a,b", 3, "ab", "my + ba * (a - ma) + bb * (b - mb)")]


@check("search_holes", with_(*HOLES, *[c for ctes, _ in OWN for c in ctes]) + "\nUNION ALL ".join(sql for _, sql in OWN))
def search_holes(spark, d):
    rows = two_columns(spark, d)
    holed = rows.withColumns({"a": F.when(F.day("fecha") % 5 != 0, F.col("a")), "b": F.when(F.day("fecha") % 3 != 0, F.col("b"))})
    out = Q.search_subsets(holed, "y", {"a": ["a"], "b": ["b"]}, eliminate=False, sample="per_subset")
    return out.select("mask", "combination", "length", "n_features", F.round("r2_adj_train", 5).alias("r2_adj_train"), F.round("r2_test", 5).alias("r2_test"))
