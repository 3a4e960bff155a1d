"""Operators on daily series."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from checks.base import CASES, DIM, FLOWS, NATIONAL, PANEL, PLACED, SPAN, cases, check, dense_sql, dimension, flows, national, r, shown, span, table, with_
from panelspark.operators import halo as H
from panelspark.operators import series as S
from panelspark.operators.joins import join_dim

DAY = "CAST(fecha AS VARCHAR) AS fecha"
DENSE = dense_sql("panel", "cases", ["prov"], ["num_casos", "importe"])
DAILY = dense_sql("daily", "national", [], ["casos", "importe"])


def panel(spark, d):
    """Complete province panel: one row per day between the first and last day of each province."""
    return S.resample_daily(cases(spark, d), ["prov"], "fecha", ["num_casos", "importe"], "zero")


def daily(spark, d):
    return S.resample_daily(national(spark, d), [], "fecha", ["casos", "importe"], "zero")


@check("resample_zero", with_(*PANEL, *DENSE) + f"SELECT prov, {DAY}, num_casos, {r('importe', 2)} AS importe FROM panel")
def resample_zero(spark, d):
    return shown(panel(spark, d), 2)


@check("resample_linear", with_(NATIONAL, *dense_sql("daily", "national", [], ["casos", "importe"], "linear", "DATE '1994-12-25'", "DATE '2001-08-15'"))
       + f"SELECT {DAY}, {r('casos')} AS casos, {r('importe', 3)} AS importe FROM daily")
def resample_linear(spark, d):
    out = S.resample_daily(national(spark, d), [], "fecha", ["casos", "importe"], "linear", "1994-12-25", "2001-08-15")
    return shown(out.withColumn("importe", F.round("importe", 3)))


@check("resample_linear_by_key", with_(*PANEL, "semana AS (SELECT region, CAST(date_trunc('week', fecha) AS DATE) AS fecha, sum(num_casos) AS casos FROM cases GROUP BY ALL)",
                                       *dense_sql("dia", "semana", ["region"], ["casos"], "linear")) + f"SELECT region, {DAY}, {r('casos')} AS casos FROM dia")
def resample_linear_by_key(spark, d):
    weekly = cases(spark, d).groupBy("region", F.trunc("fecha", "week").alias("fecha")).agg(F.sum("num_casos").alias("casos"))
    return shown(S.resample_daily(weekly, ["region"], "fecha", ["casos"], "linear"))


LAGS = [1, 7, 14, 21]


@check("lag_features", with_(*PANEL, *DENSE) + f"SELECT prov, {DAY}, " + ", ".join(
    f"CAST(lag(num_casos, {k}) OVER w AS DOUBLE) AS num_casos__lag_{k}, {r(f'lag(importe, {k}) OVER w', 2)} AS importe__lag_{k}" for k in LAGS)
       + " FROM panel WINDOW w AS (PARTITION BY prov ORDER BY panel.fecha)")
def lag_features(spark, d):
    rows = panel(spark, d).withColumn("num_casos", F.col("num_casos").cast("double"))
    return shown(S.lag_features(rows, ["prov"], "fecha", ["num_casos", "importe"], LAGS), 2)


@check("lead_target", with_(*PANEL, *DENSE) + f'SELECT prov, {DAY}, CAST(lead(num_casos, 7) OVER (PARTITION BY prov ORDER BY panel.fecha) AS DOUBLE) AS "num_casos__lag_-7" FROM panel')
def lead_target(spark, d):
    rows = panel(spark, d).select("prov", "fecha", F.col("num_casos").cast("double").alias("num_casos"))
    return shown(S.lag_features(rows, ["prov"], "fecha", ["num_casos"], [-7]))


@check("lag_by_days", with_(*PANEL) + f"""
SELECT a.prov, CAST(a.fecha AS VARCHAR) AS fecha, {r('b.importe', 2)} AS importe__lag_3 FROM cases a LEFT JOIN cases b ON a.prov = b.prov AND b.fecha = a.fecha - 3""")
def lag_by_days(spark, d):
    return shown(S.lag_features(cases(spark, d).select("prov", "fecha", "importe"), ["prov"], "fecha", ["importe"], [3], by="days"), 2)


@check("pct_change_days", with_(*PANEL) + f"""
SELECT a.prov, CAST(a.fecha AS VARCHAR) AS fecha, {r('a.importe', 2)} AS importe, {r('a.importe / b.importe - 1')} AS importe__pct_change_7,
{r('a.importe / c.importe - 1')} AS importe__pct_change_14 FROM cases a LEFT JOIN cases b ON a.prov = b.prov AND b.fecha = a.fecha - 7 LEFT JOIN cases c ON a.prov = c.prov AND c.fecha = a.fecha - 14""")
def pct_change_days(spark, d):
    out = S.pct_change_days(cases(spark, d).select("prov", "fecha", "importe"), ["prov"], "fecha", ["importe"], [7, 14])
    return shown(out.withColumn("importe", F.round("importe", 2)))


for k in (1, 7):
    @check(f"diff_{k}", with_(*PANEL, *DENSE) + f"SELECT prov, {DAY}, CAST(num_casos - lag(num_casos, {k}) OVER (PARTITION BY prov ORDER BY panel.fecha) AS DOUBLE) AS num_casos__diff_{k} FROM panel")
    def diff(spark, d, k=k):
        rows = panel(spark, d).select("prov", "fecha", F.col("num_casos").cast("double").alias("num_casos"))
        return shown(S.diff(rows, ["prov"], "fecha", "num_casos", k).drop("num_casos"))


@check("diff_seasonal_first", with_(NATIONAL, *DAILY, "f AS (SELECT fecha, casos - lag(casos) OVER (ORDER BY fecha) AS x FROM daily)")
       + f"SELECT {DAY}, CAST(x - lag(x, 7) OVER (ORDER BY f.fecha) AS DOUBLE) AS seasonal_first_diff FROM f")
def diff_seasonal_first(spark, d):
    rows = daily(spark, d).select("fecha", F.col("casos").cast("double").alias("casos"))
    return shown(S.diff_seasonal(rows, [], "fecha", "casos").drop("casos"))


DOSES = (*PANEL, "tot AS (SELECT region, fecha, sum(sum(num_casos)) OVER (PARTITION BY region ORDER BY fecha) AS acumulado FROM cases GROUP BY region, fecha)",
         "dosis AS (SELECT region, max(fecha) AS fecha, CAST(max(acumulado) AS DOUBLE) AS acumulado FROM tot GROUP BY region, date_trunc('week', fecha))")


def doses(spark, d):
    """Running total by region, as known on the last day of each week that has data."""
    by_day = cases(spark, d).groupBy("region", "fecha").agg(F.sum("num_casos").alias("n"))
    total = by_day.select("region", "fecha", F.sum("n").over(W.partitionBy("region").orderBy("fecha")).cast("double").alias("acumulado"))
    return total.groupBy("region", F.trunc("fecha", "week").alias("_s")).agg(F.max("fecha").alias("fecha"), F.max("acumulado").alias("acumulado")).drop("_s")


@check("cumulative_to_daily", with_(*DOSES, """tasa AS (SELECT * FROM (SELECT region, fecha, (acumulado - lag(acumulado) OVER w) / (fecha - lag(fecha) OVER w) AS daily
FROM dosis WINDOW w AS (PARTITION BY region ORDER BY fecha)) WHERE daily IS NOT NULL)""", *dense_sql("dia", "tasa", ["region"], ["daily"], "linear"))
       + f"SELECT region, {DAY}, {r('daily')} AS daily FROM dia")
def cumulative_to_daily(spark, d):
    return shown(S.cumulative_to_daily(doses(spark, d), ["region"], "fecha", "acumulado"))


@check("zero_history", with_(*DOSES) + f"""SELECT region, {DAY}, {r('acumulado')} AS acumulado FROM dosis UNION ALL
SELECT r_name, CAST(CAST(unnest(generate_series(DATE '1994-12-01', (SELECT min(fecha) FROM dosis) - 1, INTERVAL 1 DAY)) AS DATE) AS VARCHAR), 0.0 FROM region""")
def zero_history(spark, d):
    return shown(S.zero_history(doses(spark, d), ["region"], "fecha", ["acumulado"], "1994-12-01"))


@check("rolling_7", with_(*PANEL, *DENSE) + f"""
SELECT prov, {DAY}, {r('CASE WHEN count(*) OVER w = 7 THEN avg(num_casos) OVER w END')} AS num_casos__mean_7, {r('CASE WHEN count(*) OVER w = 7 THEN stddev_samp(num_casos) OVER w END')} AS num_casos__std_7
FROM panel WINDOW w AS (PARTITION BY prov ORDER BY panel.fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_7(spark, d):
    return shown(S.rolling(panel(spark, d).select("prov", "fecha", "num_casos"), ["prov"], "fecha", "num_casos").drop("num_casos"))


@check("decompose_7", with_(*PANEL, *DENSE, """m AS (SELECT prov, fecha, num_casos, row_number() OVER w - 1 AS i,
CASE WHEN count(*) OVER (PARTITION BY prov ORDER BY fecha ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN avg(num_casos) OVER (PARTITION BY prov ORDER BY fecha ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend
FROM panel WINDOW w AS (PARTITION BY prov ORDER BY fecha))""", "s AS (SELECT prov, i % 7 AS fase, avg(num_casos - trend) AS x FROM m GROUP BY ALL)",
                            "c AS (SELECT prov, avg(x) AS x FROM s GROUP BY ALL)") + f"""
SELECT m.prov, {DAY}, {r('trend')} AS trend, {r('s.x - c.x')} AS seasonal, {r('num_casos - trend - (s.x - c.x)')} AS resid FROM m JOIN s ON m.prov = s.prov AND fase = i % 7 JOIN c ON c.prov = m.prov""")
def decompose_7(spark, d):
    return shown(S.decompose(panel(spark, d).select("prov", "fecha", "num_casos"), ["prov"], "fecha", "num_casos").drop("num_casos"))


for level, keys in (("prov", "prov, region"), ("region", "region")):
    @check("holiday_panel" if level == "prov" else "holiday_region", with_(DIM, PLACED, "h AS (SELECT DISTINCT prov, fecha FROM placed WHERE day(fecha) = 1)",
           f"p AS (SELECT prov, region, CAST(unnest(generate_series({SPAN})) AS DATE) AS fecha FROM dim)") + f"""
SELECT {DAY}, {keys}, CAST(max(CASE WHEN h.fecha IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS holiday FROM p LEFT JOIN h USING (prov, fecha) GROUP BY ALL""")
    def holidays(spark, d, level=level):
        marked = cases(spark, d).where(F.day("fecha") == 1)
        return shown(S.holiday_panel(marked, dimension(spark, d), *span(spark, d), level))


@check("time_split", with_(NATIONAL, *DAILY) + f"""SELECT {DAY}, CASE WHEN daily.fecha < (SELECT min(fecha) + 21 FROM daily) THEN 'warmup' WHEN daily.fecha > (SELECT max(fecha) - 7 FROM daily) THEN 'test' ELSE 'train' END AS split FROM daily""")
def time_split(spark, d):
    return shown(S.time_split(daily(spark, d).select("fecha"), "fecha", 21, 7))


@check("mobility_daily", with_(DIM, FLOWS, "m AS (SELECT fecha, region, sum(viajes) AS viajes FROM flows JOIN dim ON origin = n_nationkey WHERE dest = 7 GROUP BY ALL)",
                               *dense_sql("dia", "m", ["region"], ["viajes"], "linear", "(SELECT min(fecha) FROM m)", "(SELECT max(fecha) FROM m)")) + f"SELECT region, {DAY}, {r('viajes', 4)} AS viajes FROM dia")
def mobility_daily(spark, d):
    from panelspark.operators.reshape import complete_panel

    into = flows(spark, d).where("dest = 7").groupBy("fecha", "origin").agg(F.sum("viajes").alias("viajes"))
    m = join_dim(into, dimension(spark, d), "origin", "n_nationkey").groupBy("fecha", "region").agg(F.sum("viajes").alias("viajes"))
    return shown(complete_panel(m, ["region"], "fecha", ["viajes"], "linear"), 4)


@check("resample_inner", with_(*PANEL, *dense_sql("wide", "cases", ["prov"], ["num_casos"], "linear"))
       + f"SELECT prov, {DAY}, {r('num_casos')} AS num_casos FROM wide WHERE fecha BETWEEN DATE '1996-03-10' AND DATE '1997-08-20'")
def resample_inner(spark, d):
    """Bounds inside the data: rows beyond them still take part in the interpolation."""
    return shown(S.resample_daily(cases(spark, d), ["prov"], "fecha", ["num_casos"], "linear", "1996-03-10", "1997-08-20"))


# One series of all events, at full grain, in ranges of time.
EVENTS = "e AS (SELECT event_id, ts, value, user_id % 7 AS grupo FROM events)"
IN_TIME = "ORDER BY ts, event_id"


def events(spark, d, keys=()):
    rows = table(spark, d, "events").select("event_id", "ts", "value", (F.col("user_id") % 7).alias("grupo"))
    return H.Ranges(rows, list(keys), ["ts", "event_id"], 16)


@check("long_lags", with_(EVENTS) + f"SELECT event_id, {r('lag(value, 1) OVER w')} AS value__lag_1, {r('lag(value, 30) OVER w')} AS value__lag_30, {r('lead(value, 2) OVER w')} AS \"value__lag_-2\" FROM e WINDOW w AS ({IN_TIME})")
def long_lags(spark, d):
    return shown(H.lags(events(spark, d), ["value"], [1, 30, -2]).drop("ts", "value", "grupo"))


@check("long_rolling", with_(EVENTS) + f"""SELECT event_id, CASE WHEN count(value) OVER w = 20 THEN {r('avg(value) OVER w', 5)} END AS value__mean_20, CASE WHEN count(value) OVER w = 20 THEN {r('stddev_samp(value) OVER w', 5)} END AS value__std_20
FROM e WINDOW w AS (PARTITION BY grupo {IN_TIME} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def long_rolling(spark, d):
    return shown(H.rolling(events(spark, d, ["grupo"]), "value", 20).drop("ts", "value", "grupo"), 5)


@check("long_running", with_(EVENTS) + f"SELECT event_id, grupo, {r('sum(round(value * 100)) OVER (PARTITION BY grupo ' + IN_TIME + ')', 2)} AS total FROM e")
def long_running(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", F.round(F.col("value") * 100).alias("centimos"), (F.col("user_id") % 7).alias("grupo"))
    return shown(H.running_sum(H.Ranges(rows, ["grupo"], ["ts", "event_id"], 16), "centimos", "total").drop("ts", "centimos"), 2)


@check("long_acf", with_(EVENTS, "m AS (SELECT avg(value) AS m FROM e)", f"x AS (SELECT value - m AS x, {', '.join(f'lag(value - m, {k}) OVER w AS x{k}' for k in range(1, 6))} FROM e, m WINDOW w AS ({IN_TIME}))")
       + "\nUNION ALL ".join(f"SELECT {k} AS lag, count(*) AS n, {r(f'sum(x * {f'x{k}' if k else 'x'}) / sum(x * x)')} AS acf FROM x" for k in range(6)))
def long_acf(spark, d):
    return H.acf(events(spark, d), "value", 5).select("lag", "n", F.round("acf", 6).alias("acf"))
