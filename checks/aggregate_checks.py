"""Grouped statistics."""

from pyspark.sql import functions as F

from checks.base import CASES, DIM, FLOWS, NATIONAL, PANEL, cases, check, dimension, flows, national, r, shown, table, with_
from panelspark.operators import aggregate as A
from panelspark.operators.project import per_100k
from panelspark.operators.series import lag_features

FIVE = ("sum", "mean", "std", "min", "max")
SQL_STAT = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def stats_sql(col, digits=4):
    return ", ".join(f"{r(f'{SQL_STAT[s]}({col})', digits)} AS {col}__{s}" for s in FIVE)


@check("od_multi_agg", with_(FLOWS) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, origin, dest, {stats_sql('viajes')}, {stats_sql('viajes_km', 3)} FROM flows GROUP BY ALL")
def od_multi_agg(spark, d):
    out = A.multi_agg(flows(spark, d), ["fecha", "origin", "dest"], {"viajes": list(FIVE), "viajes_km": list(FIVE)})
    return out.select(F.col("fecha").cast("string").alias("fecha"), "origin", "dest",
                      *[F.round(c, 3 if "_km__" in c else 4).alias(c) for c in out.columns[3:]])


@check("station_multi_agg", f"""
SELECT s_nationkey AS nacion, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS VARCHAR)[1:10] AS mes, {stats_sql('l_discount', 9)}, {stats_sql('l_tax', 9)}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def station_multi_agg(spark, d):
    rows = (table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_tax", F.trunc("l_shipdate", "month").alias("mes"))
            .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumnRenamed("s_nationkey", "nacion"))
    out = A.multi_agg(rows, ["nacion", "mes"], {"l_discount": list(FIVE), "l_tax": list(FIVE)})
    return shown(out, 9).withColumn("nacion", F.col("nacion").cast("int"))


@check("daily_totals", with_(*PANEL) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, CAST(sum(num_casos) AS BIGINT) AS num_casos, {r('sum(importe)', 2)} AS importe FROM cases GROUP BY ALL")
def daily_totals(spark, d):
    return shown(A.group_sum(cases(spark, d), ["fecha"], ["num_casos", "importe"]), 2)


for how, fn in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    count = "CAST(sum(num_casos) AS BIGINT)" if how == "sum" else r("avg(num_casos)") if how == "mean" else "max(num_casos)"

    @check(f"collapse_{how}", with_(*PANEL) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, {count} AS num_casos, {r(f'{fn}(importe)', 3)} AS importe FROM cases GROUP BY ALL")
    def collapse(spark, d, how=how):
        out = A.collapse(cases(spark, d), how)
        return out.select(F.col("fecha").cast("string").alias("fecha"), (F.round("num_casos", 6) if how == "mean" else F.col("num_casos")).alias("num_casos"),
                          F.round("importe", 3).alias("importe"))


@check("distinct_dim", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_dim(spark, d):
    return A.distinct_dim(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@check("mean_of_means", with_(*PANEL, "p AS (SELECT region, prov, avg(importe) AS m FROM cases GROUP BY ALL)") + f"SELECT region, {r('avg(m)', 4)} AS importe__mean__mean FROM p GROUP BY ALL")
def mean_of_means(spark, d):
    return shown(A.two_level(cases(spark, d), ["region", "prov"], ["region"], "importe", "mean", "mean"), 4)


@check("merged_stats", with_(FLOWS) + f"SELECT dest, {stats_sql('viajes')} FROM flows GROUP BY ALL")
def merged_stats(spark, d):
    state = A.mergeable_stats(flows(spark, d), ["fecha", "origin", "dest"], ["viajes"])
    return shown(A.merge_stats(state, ["dest"], ["viajes"]), 4).withColumn("dest", F.col("dest").cast("int"))


PROFILED = ["o_totalprice", "o_custkey"]


@check("profile", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS "count", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(DISTINCT {c}) AS "distinct", {r(f'avg({c})', 3)} AS mean,
{r(f'stddev_samp({c})', 3)} AS std, {r(f'min({c})', 3)} AS min, {r(f'quantile_cont({c}, 0.25)', 3)} AS q1, {r(f'quantile_cont({c}, 0.5)', 3)} AS median,
{r(f'quantile_cont({c}, 0.75)', 3)} AS q3, {r(f'max({c})', 3)} AS max FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM orders)""" for c in PROFILED))
def profile(spark, d):
    return shown(A.profile(table(spark, d, "orders"), PROFILED), 3)


@check("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark, d):
    return A.value_counts(table(spark, d, "orders"), "o_orderpriority")


@check("histogram", f"""
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, count(*) AS n FROM orders, b GROUP BY ALL)
SELECT i AS bin, {r('lo + i * (hi - lo) / 50', 4)} AS "left", {r('lo + (i + 1) * (hi - lo) / 50', 4)} AS "right", coalesce(n, 0) AS n
FROM range(0, 50) t(i) JOIN b ON true LEFT JOIN c ON bin = i""")
def histogram(spark, d):
    return shown(A.histogram(table(spark, d, "orders"), "o_totalprice", 50), 4)


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check("corr_matrix", "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM lineitem" for i, a in enumerate(CORR) for b in CORR[:i]))
def corr_matrix(spark, d):
    return shown(A.corr_matrix(table(spark, d, "lineitem"), CORR))


@check("kde", with_(NATIONAL, """b AS (SELECT count(*) AS n, min(casos) AS lo, max(casos) AS hi, stddev_samp(casos) * pow(count(*), -0.2) AS h FROM national)""",
                    "g AS (SELECT i, lo - 3 * h + i * (hi - lo + 6 * h) / 19 AS x, n, h FROM range(0, 20) t(i), b)") + f"""
SELECT i AS point, {r('x')} AS x, {r('sum(exp(-0.5 * pow((casos - x) / h, 2))) / (n * h * sqrt(2 * pi()))', 8)} AS density FROM g, national GROUP BY i, x, n, h""")
def kde(spark, d):
    out = A.kde(national(spark, d), "casos", 20)
    return out.select(F.col("point").cast("bigint").alias("point"), F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@check("scalar_aggs", f"""SELECT count(l_tax) AS n, {r('min(l_tax)')} AS min, {r('max(l_tax)')} AS max, {r('avg(l_tax)')} AS mean, {r('var_pop(l_tax)')} AS variance,
{r('sum(l_tax * l_tax)', 4)} AS sum_squares FROM lineitem""")
def scalar_aggs(spark, d):
    out = A.scalar_aggs(table(spark, d, "lineitem"), "l_tax")
    return shown(out.withColumn("sum_squares", F.round("sum_squares", 4)))


@check("merged_stats_large", with_(FLOWS) + f"""
SELECT dest, {r('sum(viajes + 1e9)', 0)} AS viajes__sum, {r('avg(viajes) + 1e9', 4)} AS viajes__mean, {r('stddev_samp(viajes)', 4)} AS viajes__std,
{r('min(viajes) + 1e9', 2)} AS viajes__min, {r('max(viajes) + 1e9', 2)} AS viajes__max FROM flows GROUP BY ALL""")
def merged_stats_large(spark, d):
    """Values near 1e9 with little spread keep their deviation through the roll-up."""
    far = flows(spark, d).withColumn("viajes", F.col("viajes") + 1e9)
    out = A.merge_stats(A.mergeable_stats(far, ["fecha", "origin", "dest"], ["viajes"]), ["dest"], ["viajes"])
    digits = {"sum": 0, "mean": 4, "std": 4, "min": 2, "max": 2}
    return out.select(F.col("dest").cast("int").alias("dest"), *[F.round(f"viajes__{s}", n).alias(f"viajes__{s}") for s, n in digits.items()])


@check("mobility_rates", with_(FLOWS, "pop AS (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY ALL)", f"f AS (SELECT fecha, dest, {', '.join(f'{SQL_STAT[s]}(viajes) AS viajes__{s}' for s in FIVE)} FROM flows GROUP BY ALL)")
       + "SELECT CAST(fecha AS VARCHAR) AS fecha, dest, " + ", ".join(f"{r(f'viajes__{s}', 4)} AS viajes__{s}, {r(f'viajes__{s} / total * 100000', 3)} AS ratio_population__viajes__{s}" for s in FIVE)
       + " FROM f JOIN pop ON dest = c_nationkey")
def mobility_rates(spark, d):
    """Flows reduced to state by day and pair, rolled up by destination, with rates: as over the rows themselves."""
    state = A.mergeable_stats(flows(spark, d), ["fecha", "origin", "dest"], ["viajes"])
    people = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"))
    names = [f"viajes__{s}" for s in FIVE]
    placed = A.merge_stats(state, ["fecha", "dest"], ["viajes"]).join(people, F.col("dest") == F.col("c_nationkey"))
    return per_100k(placed, names, "total").select(
        F.col("fecha").cast("string").alias("fecha"), F.col("dest").cast("int").alias("dest"), *[F.round(c, 4).alias(c) for c in names],
        *[F.round(f"ratio_population__{c}", 3).alias(f"ratio_population__{c}") for c in names])


@check("profile_special", f"""
WITH t AS (SELECT o_totalprice AS v FROM orders), n AS (SELECT count(*) AS n FROM t)
SELECT n AS "count", {r('quantile_cont(v, 0.25)', 3)} AS q1, {r('quantile_cont(v, 0.5)', 3)} AS median, {r('quantile_cont(v, 0.75)', 3)} AS q3
FROM (SELECT v FROM t UNION ALL SELECT -1e308 FROM t WHERE v > 400000 UNION ALL SELECT 1e308 FROM t WHERE v < 3000), n GROUP BY n""")
def profile_special(spark, d):
    """Quartiles with NaN set aside and infinities at the ends."""
    prices = table(spark, d, "orders").select(F.col("o_totalprice").alias("v"))
    ends = [prices.where("v > 400000").select(F.lit(float("-inf")).alias("v")), prices.where("v < 3000").select(F.lit(float("inf")).alias("v")),
            prices.where("v > 300000").select(F.lit(float("nan")).alias("v"))]
    rows = prices
    for more in ends:
        rows = rows.union(more)
    found = A.exact_quantiles(rows, ["v"], [0.25, 0.5, 0.75])
    return prices.agg(F.count("*").alias("count"), *[F.round(F.lit(found["v", p]), 3).alias(q) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


LAGGED = [f"num_casos__lag_{k}" for k in range(1, 9)]


@check("corr_lagged", with_(*PANEL, "l AS (SELECT " + ", ".join(f"lag(num_casos, {k}) OVER (PARTITION BY prov ORDER BY fecha) AS {c}" for k, c in enumerate(LAGGED, 1)) + " FROM cases)")
       + "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM l" for i, a in enumerate(LAGGED) for b in LAGGED[:i]))
def corr_lagged(spark, d):
    """Columns with NULL holes at the start of each series: every pair has its own rows."""
    return shown(A.corr_matrix(lag_features(cases(spark, d), ["prov"], "fecha", ["num_casos"], list(range(1, 9))), LAGGED))


@check("kde_binned", with_(NATIONAL, """b AS (SELECT count(*) AS n, min(casos) AS lo, max(casos) AS hi, stddev_samp(casos) * pow(count(*), -0.2) AS h FROM national)""",
                           "s AS (SELECT n, h, lo - 3 * h AS first, (hi - lo + 6 * h) / 199 AS step FROM b)", "u AS (SELECT (casos - first) / step AS u, least(floor((casos - first) / step), 198) AS i FROM national, s)",
                           "w AS (SELECT i, sum(w) AS w FROM (SELECT i, 1 - (u - i) AS w FROM u UNION ALL SELECT i + 1, u - i FROM u) GROUP BY i)") + f"""
SELECT p AS point, {r('first + p * step')} AS x, {r('sum(w * exp(-0.5 * pow((p - i) * step / h, 2))) / (n * h * sqrt(2 * pi()))', 8)} AS density FROM range(0, 200) t(p), s, w GROUP BY p, first, step, n, h""")
def kde_binned(spark, d):
    """Every value split over its two neighbours on the grid."""
    out = A.kde_binned(national(spark, d), "casos", 200)
    return out.select(F.col("point").cast("bigint").alias("point"), F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))
