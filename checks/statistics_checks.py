"""Cross-products, least squares and series diagnostics."""

from pyspark.sql import functions as F

from checks.base import CASES, DIM, FLOWS, NATIONAL, PANEL, PLACED, cases, check, dense_sql, flows, national, r, shown, table, with_
from checks.series_checks import DAILY, DENSE, daily, panel
from panelspark.operators import diagnostics as D
from panelspark.operators import gram as G
from panelspark.operators import tiles as T
from panelspark.operators.models import hash_split
from panelspark.operators.series import diff

LINE = ["l_quantity", "l_extendedprice", "l_discount"]
GRAM_SQL = "\nUNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, {r(f'count(*) * covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))', 4)} AS s FROM lineitem" for a in LINE for b in LINE)


@check("gram", GRAM_SQL)
def gram(spark, d):
    return shown(G.gram(table(spark, d, "lineitem"), LINE), 4)


@check("gram_arrow", GRAM_SQL)
def gram_arrow(spark, d):
    return shown(G.gram(table(spark, d, "lineitem"), LINE, method="arrow"), 4)


@check("gram_grouped", "\nUNION ALL ".join(f"SELECT l_returnflag, '{a}' AS i, '{b}' AS j, {r(f'count(*) * covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))', 4)} AS s "
                                            "FROM lineitem GROUP BY ALL" for a in LINE for b in LINE))
def gram_grouped(spark, d):
    return shown(G.gram(table(spark, d, "lineitem"), LINE, "l_returnflag", method="arrow"), 4)


@check("ols_simple", f"""
WITH f AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2,
regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem GROUP BY ALL),
s AS (SELECT *, sqrt((1 - r2) * syy / (n - 2)) AS sigma FROM f)
SELECT l_returnflag, 'const' AS feature, {r('a', 4)} AS coefficient, {r('sigma * sqrt(1.0 / n + mx * mx / sxx)', 4)} AS std_error, n, {r('r2')} AS r2, {r('1 - (n - 1) / CAST(n - 2 AS DOUBLE) * (1 - r2)')} AS r2_adj FROM s
UNION ALL SELECT l_returnflag, 'l_quantity', {r('b', 4)}, {r('sigma / sqrt(sxx)', 4)}, n, {r('r2')}, {r('1 - (n - 1) / CAST(n - 2 AS DOUBLE) * (1 - r2)')} FROM s""")
def ols_simple(spark, d):
    out = G.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_returnflag").drop("t", "p_value")
    return shown(out.withColumn("coefficient", F.round("coefficient", 4)).withColumn("std_error", F.round("std_error", 4)))


# Two regressors have a closed form by the centred sums of squares and products.
PAIR = """s AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab,
regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy FROM t),
c AS (SELECT *, saa * sbb - sab * sab AS det FROM s),
f AS (SELECT *, (sbb * say - sab * sby) / det AS ba, (saa * sby - sab * say) / det AS bb FROM c),
g AS (SELECT *, my - ba * ma - bb * mb AS b0, (syy - ba * say - bb * sby) AS ssr FROM f),
e AS (SELECT *, ssr / (n - 3) AS sigma2, 1 - ssr / syy AS r2 FROM g)"""


@check("ols_two", with_("t AS (SELECT l_extendedprice AS y, CAST(l_quantity AS DOUBLE) AS a, l_discount AS b FROM lineitem)", PAIR) + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(c, 4)} AS coefficient, {r(f'sqrt(sigma2 * ({v}))', 4)} AS std_error, n, {r('r2')} AS r2, {r('1 - (n - 1) / CAST(n - 3 AS DOUBLE) * (1 - r2)')} AS r2_adj FROM e"
    for f, c, v in (("const", "b0", "1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det"), ("l_quantity", "ba", "sbb / det"), ("l_discount", "bb", "saa / det"))))
def ols_two(spark, d):
    out = G.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).drop("t", "p_value")
    return shown(out.withColumn("coefficient", F.round("coefficient", 4)).withColumn("std_error", F.round("std_error", 4)))


@check("ols_multi")
def ols_multi(spark, d):
    return G.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_linestatus")


@check("press_simple", with_(NATIONAL, "d AS (SELECT casos, importe / 1e8 AS importe FROM national)",
                             "f AS (SELECT regr_slope(importe, casos) AS b, regr_intercept(importe, casos) AS a, regr_sxx(importe, casos) AS sxx, regr_syy(importe, casos) AS syy, "
                             "count(*) AS n, avg(casos) AS mx FROM d)", "e AS (SELECT (importe - a - b * casos) AS res, 1.0 / n + (casos - mx) * (casos - mx) / sxx AS h, syy, n FROM d, f)")
       + f"SELECT n, {r('sum(pow(res / (1 - h), 2))', 4)} AS press, {r('sum(res * res)', 4)} AS rss, {r('1 - sum(pow(res / (1 - h), 2)) / syy')} AS r2_predicted FROM e GROUP BY n, syy")
def press_simple(spark, d):
    out = G.press(national(spark, d).select("casos", (F.col("importe") / 1e8).alias("importe")), "importe", ["casos"])
    return out.select("n", F.round("press", 4).alias("press"), F.round("rss", 4).alias("rss"), F.round("r2_predicted", 6).alias("r2_predicted"))


SPLIT = "CASE WHEN ((epoch(fecha::TIMESTAMP)::BIGINT // 86400 + 42) * 48271 % 2147483647 * 69621) % 2147483647 % 10000 < 3000 THEN 'test' ELSE 'train' END"


@check("metrics", with_(NATIONAL, *DAILY, "p AS (SELECT fecha, casos, lag(casos, 7) OVER (ORDER BY fecha) AS yhat FROM daily)", f"q AS (SELECT *, {SPLIT} AS split FROM p WHERE yhat IS NOT NULL AND casos > 0)") + f"""
SELECT split, count(*) AS n, {r('1 - avg(pow(casos - yhat, 2)) / var_pop(casos)')} AS r2, {r('avg(pow(casos - yhat, 2))')} AS mse, {r('sqrt(avg(pow(casos - yhat, 2)))')} AS rmse,
{r('avg(abs(casos - yhat) / abs(casos))')} AS mape FROM q GROUP BY ALL""")
def metrics(spark, d):
    from panelspark.operators.series import lag_features

    rows = daily(spark, d).select("fecha", "casos")
    guessed = rows.join(lag_features(rows, [], "fecha", ["casos"], [7]), "fecha").where("casos > 0")
    return shown(G.metrics(hash_split(guessed, "fecha"), "casos", "casos__lag_7", "split"))


ACF = ("v AS (SELECT prov, fecha, num_casos - avg(num_casos) OVER (PARTITION BY prov) AS x, row_number() OVER (PARTITION BY prov ORDER BY fecha) AS i FROM panel)",
       "k AS (SELECT i AS lag FROM range(0, 11) t(i))",
       "pr AS (SELECT a.prov, lag, sum(a.x * b.x) AS s FROM v a JOIN k ON true JOIN v b ON a.prov = b.prov AND b.i = a.i - lag GROUP BY ALL)",
       "z AS (SELECT prov, count(*) AS n, sum(x * x) AS s0 FROM v GROUP BY ALL)",
       "rho AS (SELECT pr.prov, lag, n, s / s0 AS acf FROM pr JOIN z ON pr.prov = z.prov)")


def rho(spark, d, lags=10):
    return D.acf(panel(spark, d).select("prov", "fecha", "num_casos"), ["prov"], "fecha", "num_casos", lags)


@check("acf", with_(*PANEL, *DENSE, *ACF) + f"SELECT prov, lag, n, {r('acf')} AS acf FROM rho")
def acf(spark, d):
    return shown(rho(spark, d))


@check("pacf_2", with_(*PANEL, *DENSE, *ACF, "w AS (SELECT prov, max(CASE WHEN lag = 1 THEN acf END) AS a, max(CASE WHEN lag = 2 THEN acf END) AS b FROM rho GROUP BY ALL)")
       + f"SELECT prov, 0 AS lag, 1.0::DOUBLE AS pacf FROM w UNION ALL SELECT prov, 1, {r('a')} FROM w UNION ALL SELECT prov, 2, {r('(b - a * a) / (1 - a * a)')} FROM w")
def pacf_2(spark, d):
    out = D.pacf(rho(spark, d, 2), ["prov"])
    return out.select("prov", "lag", F.round("pacf", 6).alias("pacf"))


@check("pacf")
def pacf(spark, d):
    return D.pacf(rho(spark, d, 20), ["prov"])


@check("box_pierce", with_(*PANEL, *DENSE, *ACF) + f"""
SELECT prov, lag, n, {r('n * sum(acf * acf) OVER w')} AS box_pierce, {r('n * (n + 2) * sum(acf * acf / (n - lag)) OVER w')} AS ljung_box
FROM rho WHERE lag > 0 WINDOW w AS (PARTITION BY prov ORDER BY lag)""")
def box_pierce(spark, d):
    return shown(D.portmanteau(rho(spark, d), ["prov"]).drop("box_pierce_p", "ljung_box_p"))


@check("portmanteau")
def portmanteau(spark, d):
    return D.portmanteau(rho(spark, d, 14), ["prov"])


@check("ttest", with_(*PANEL) + f"SELECT prov, count(*) AS n, {r('avg(num_casos)')} AS mean, {r('stddev_samp(num_casos)')} AS std, {r('(avg(num_casos) - 1.1) / (stddev_samp(num_casos) / sqrt(count(*)))')} AS t FROM cases GROUP BY ALL")
def ttest(spark, d):
    return shown(G.ttest_1samp(cases(spark, d), "num_casos", 1.1, "prov").drop("p_value"))


@check("ttest_pvalue")
def ttest_pvalue(spark, d):
    steps = diff(panel(spark, d), ["prov"], "fecha", "num_casos", 1, "cambio")
    return G.ttest_1samp(steps, "cambio", 0.0, "prov")


@check("adf_lag0", with_(*PANEL, *DENSE, "s AS (SELECT prov, num_casos - lag(num_casos) OVER w AS dy, lag(num_casos) OVER w AS y FROM panel WINDOW w AS (PARTITION BY prov ORDER BY fecha))",
                         "f AS (SELECT prov, count(*) AS n, regr_slope(dy, y) AS b, regr_r2(dy, y) AS r2, regr_sxx(dy, y) AS sxx, regr_syy(dy, y) AS syy FROM s WHERE dy IS NOT NULL GROUP BY ALL)") + f"""
SELECT prov, {r('b / sqrt((1 - r2) * syy / (n - 2) / sxx)', 4)} AS statistic, 0 AS lags, n,
{r('-2.86154 - 2.8903 / n - 4.234 / pow(n, 2) - 40.040 / pow(n, 3)')} AS critical_5 FROM f""")
def adf_lag0(spark, d):
    out = D.adf(panel(spark, d).select("prov", "fecha", "num_casos"), ["prov"], "fecha", "num_casos", 0, False)
    return out.select("prov", F.round("statistic", 4).alias("statistic"), "lags", "n", F.round("critical_5", 6).alias("critical_5"))


@check("adf")
def adf(spark, d):
    return D.adf(panel(spark, d).select("prov", "fecha", "num_casos"), ["prov"], "fecha", "num_casos")


WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@check("gram_null_keys", "\nUNION ALL ".join(f"SELECT nullif(l_returnflag, 'N') AS flag, '{a}' AS i, '{b}' AS j, {r(f'count(*) * covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))', 3)} AS s "
                                             "FROM lineitem GROUP BY ALL" for a in WIDE for b in WIDE))
def gram_null_keys(spark, d):
    """Six columns and a NULL group: the matrix way keeps the group, as the aggregates do."""
    rows = table(spark, d, "lineitem").withColumn("flag", F.expr("nullif(l_returnflag, 'N')"))
    return shown(G.gram(rows, WIDE, "flag"), 3)


# A wide design: trips between all pairs of places on a day, on the last four days that have trips: 2,500 columns.
PLACES, BACK = 25, 4
PAIRS = PLACES * PLACES


def trip_lags(spark, d):
    from pyspark.sql.window import Window as W

    pair = (F.col("origin") * PLACES + F.col("dest")).cast("int")
    by_pair = flows(spark, d).groupBy("fecha", pair.alias("cell")).agg(F.sum("viajes").alias("v"))
    day = by_pair.groupBy("fecha").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"))
    dense = day.select("fecha", F.transform(F.sequence(F.lit(0), F.lit(PAIRS - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))).alias("v"))
    w = W.orderBy("fecha")
    return dense.select(F.concat(*[F.lag("v", k).over(w) for k in range(1, BACK + 1)]).alias("x"))


@check("gram_tiled", with_(FLOWS, f"v AS (SELECT fecha, origin * {PLACES} + dest AS cell, sum(viajes) AS v FROM flows GROUP BY ALL)",
                           "d AS (SELECT fecha, row_number() OVER (ORDER BY fecha) AS rn FROM (SELECT DISTINCT fecha FROM flows))", "z AS (SELECT count(*) AS days FROM d)",
                           f"x AS (SELECT rn + k AS t, (k - 1) * {PAIRS} + cell AS c, v FROM v JOIN d ON d.fecha = v.fecha, range(1, {BACK + 1}) r(k))",
                           f"seen AS (SELECT t, c, v, days - {BACK} AS n FROM x, z WHERE t > {BACK} AND t <= days)",
                           "b AS (SELECT t, c // 256 AS b, sum(v) AS s FROM seen GROUP BY ALL)",
                           f"f AS (SELECT g.t, g.b, coalesce(s, 0) AS s FROM (SELECT t, k AS b FROM (SELECT DISTINCT t FROM seen), range(0, {(PAIRS * BACK - 1) // 256 + 1}) r(k)) g LEFT JOIN b ON b.t = g.t AND b.b = g.b)",
                           "own AS (SELECT c // 256 AS b, sum(q - s * s / n) AS trace FROM (SELECT c, n, sum(v * v) AS q, sum(v) AS s FROM seen GROUP BY ALL) GROUP BY ALL)")
       + f"""SELECT CAST(p.b AS BIGINT) AS bi, CAST(q.b AS BIGINT) AS bj, count(*) AS n, {r('count(*) * covar_pop(p.s, q.s)', 2)} AS total, {r('any_value(CASE WHEN p.b = q.b THEN trace END)', 2)} AS trace
FROM f p JOIN f q ON p.t = q.t AND p.b <= q.b JOIN own ON own.b = p.b GROUP BY p.b, q.b""")
def gram_tiled(spark, d):
    """The sum of every tile, and the trace of those on the diagonal."""
    tiles = T.tiled_gram(trip_lags(spark, d), "x", PAIRS * BACK)
    total = F.aggregate("cp", F.lit(0.0), lambda a, x: a + x)
    width = F.size("mean_j")
    diagonal = F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0.0), lambda a, k: a + F.element_at("cp", k * width + k + 1))
    return shown(tiles.select("bi", "bj", "n", total.alias("total"), F.when(F.col("bi") == F.col("bj"), diagonal).alias("trace")), 2)


TWO_SQL = "m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_linenumber) AS c, covar_samp(l_quantity, l_linenumber) AS b FROM lineitem), e AS (SELECT a + c AS whole, sqrt((a - c) * (a - c) + 4 * b * b) AS gap FROM m)"


@check("pca_tiled", with_(TWO_SQL) + f"SELECT 1 AS component, {r('(whole + gap) / 2')} AS variance, {r('(1 + gap / whole) / 2')} AS share FROM e UNION ALL SELECT 2, {r('(whole - gap) / 2')}, {r('(1 - gap / whole) / 2')} FROM e")
def pca_tiled(spark, d):
    """Two columns in blocks of one: variances of the components have a closed form."""
    found = T.components(T.tiled_gram(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], block=1), 2, 1)
    rows = [(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(found.variance, found.share))]
    return shown(spark.createDataFrame(rows, "component int, variance double, share double")).withColumn("component", F.col("component").cast("int"))


@check("corr_tiled", "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'corr({a}, {b})')} AS corr FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1:]))
def corr_tiled(spark, d):
    cells = T.cells(T.tiled_gram(table(spark, d, "lineitem"), LINE, block=2), 2).where("i < j")
    name = lambda c: F.element_at(F.array(*map(F.lit, LINE)), F.col(c) + 1)
    return shown(cells.select(name("i").alias("a"), name("j").alias("b"), "n", "corr"))


# One lag: two regressors, the level and the last change, by series.
ADF_1 = ("s AS (SELECT prov, fecha, CAST(num_casos - lag(num_casos) OVER w AS DOUBLE) AS y, CAST(lag(num_casos) OVER w AS DOUBLE) AS a FROM panel WINDOW w AS (PARTITION BY prov ORDER BY fecha))",
         "t AS (SELECT prov, y, a, lag(y) OVER (PARTITION BY prov ORDER BY fecha) AS b FROM s WHERE y IS NOT NULL)",
         """c AS (SELECT prov, count(*) AS n, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy FROM t WHERE b IS NOT NULL GROUP BY ALL)""",
         "f AS (SELECT *, saa * sbb - sab * sab AS det FROM c)", "g AS (SELECT *, (sbb * say - sab * sby) / det AS ba, (saa * sby - sab * say) / det AS bb FROM f)")


@check("adf_lag1", with_(*PANEL, *DENSE, *ADF_1) + f"SELECT prov, {r('ba / sqrt((syy - ba * say - bb * sby) / (n - 3) * sbb / det)', 4)} AS statistic, 1 AS lags, n FROM g")
def adf_lag1(spark, d):
    out = D.adf(panel(spark, d).select("prov", "fecha", "num_casos"), ["prov"], "fecha", "num_casos", 1, False)
    return out.select("prov", F.round("statistic", 4).alias("statistic"), "lags", "n")
