"""Joins of panels, dimensions and graphs."""

from pyspark.sql import functions as F

from checks.base import (CASES, DIM, FLOWS, INTEREST, NATIONAL, OUTCOMES, PANEL, PLACED, SPAN, cases, check, dimension, flows, interest, national, outcomes, r, span,
                         shown, table, with_)
from panelspark.operators import joins as J
from panelspark.operators.aggregate import collapse
from panelspark.operators.reshape import pivot_agg
from panelspark.operators.text import adjacency_to_edges, postal_map

NATIONS = list(range(25))


@check("dim_join", with_(DIM) + "SELECT c_custkey, prov, region FROM customer JOIN dim ON c_nationkey = n_nationkey")
def dim_join(spark, d):
    return J.join_dim(table(spark, d, "customer").select("c_custkey", "c_nationkey"), dimension(spark, d), "c_nationkey", "n_nationkey").select("c_custkey", "prov", "region")


POP = ("pop AS (SELECT prov, CAST(date_trunc('month', fecha) AS DATE) AS mes, CAST(sum(num_casos) AS BIGINT) AS total FROM cases GROUP BY ALL)")


@check("population_join", with_(*PANEL, POP) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, c.prov, num_casos, total, {r('num_casos / CAST(total AS DOUBLE)')} AS cuota "
       "FROM cases c JOIN pop p ON c.prov = p.prov AND CAST(date_trunc('month', fecha) AS DATE) = mes")
def population_join(spark, d):
    rows = cases(spark, d).withColumn("mes_caso", F.trunc("fecha", "month"))
    pop = rows.groupBy("prov", F.col("mes_caso").alias("mes")).agg(F.sum("num_casos").alias("total"))
    joined = J.join_dim(rows, pop, ["prov", "mes_caso"], ["prov", "mes"])
    return shown(joined.select("fecha", "prov", "num_casos", "total", (F.col("num_casos") / F.col("total")).alias("cuota")))


@check("od_roles", with_(DIM, FLOWS) + f"""
SELECT o.region AS origin_region, e.prov AS dest_prov, count(*) AS n, {r('sum(viajes)', 2)} AS viajes
FROM flows JOIN dim o ON origin = o.n_nationkey JOIN dim e ON dest = e.n_nationkey GROUP BY ALL""")
def od_roles(spark, d):
    # Flows shrink to one row per pair of nations before the two dimension joins.
    pairs = flows(spark, d).groupBy("origin", "dest").agg(F.count("*").alias("n"), F.sum("viajes").alias("viajes"))
    placed = J.join_roles(pairs, dimension(spark, d), {"origin": "origin", "dest": "dest"}, "n_nationkey")
    return shown(placed.groupBy("origin_region", "dest_prov").agg(F.sum("n").alias("n"), F.sum("viajes").alias("viajes")), 2)


@check("region_fanout", with_(DIM, INTEREST) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, prov, variable, {r('value', 4)} AS value FROM interest JOIN dim USING (region)")
def region_fanout(spark, d):
    return shown(J.expand_region(interest(spark, d), dimension(spark, d).drop("n_nationkey"), "region").select("fecha", "prov", "variable", "value"), 4)


@check("outer_merge", with_(DIM, PLACED, FLOWS, "a AS (SELECT fecha, region, count(*) AS casos FROM placed GROUP BY ALL)",
                            "b AS (SELECT fecha, region, sum(viajes) AS viajes FROM flows JOIN dim ON dest = n_nationkey GROUP BY ALL)") + f"""
SELECT CAST(coalesce(a.fecha, b.fecha) AS VARCHAR) AS fecha, coalesce(a.region, b.region) AS region, coalesce(casos, 0) AS casos, {r('coalesce(viajes, 0)', 2)} AS viajes
FROM a FULL JOIN b ON a.fecha = b.fecha AND a.region = b.region""")
def outer_merge(spark, d):
    a = cases(spark, d).groupBy("fecha", "region").agg(F.sum("num_casos").alias("casos"))
    daily = flows(spark, d).groupBy("fecha", "dest").agg(F.sum("viajes").alias("viajes"))
    b = J.join_dim(daily, dimension(spark, d), "dest", "n_nationkey").groupBy("fecha", "region").agg(F.sum("viajes").alias("viajes"))
    return shown(J.outer_merge(a, b, ["fecha", "region"]), 2)


@check("edge_nodes", with_(DIM, FLOWS, "w AS (SELECT origin, dest, sum(viajes) AS weight FROM flows GROUP BY ALL)") + f"""
SELECT o.prov AS src, e.prov AS dst, {r('weight', 2)} AS weight, o.region AS src_region, e.region AS dst_region
FROM w JOIN dim o ON origin = o.n_nationkey JOIN dim e ON dest = e.n_nationkey WHERE weight <> 0""")
def edge_nodes(spark, d):
    dim = dimension(spark, d)
    pairs = flows(spark, d).groupBy("origin", "dest").agg(F.sum("viajes").alias("viajes"))
    named = J.join_roles(pairs, dim, {"o": "origin", "e": "dest"}, "n_nationkey")
    matrix = pivot_agg(named, ["o_prov"], "e_prov", [f"NATION_{i}" for i in NATIONS], "viajes")
    return shown(adjacency_to_edges(matrix, "o_prov", dim.select("prov", "region"), "prov").select("src", "dst", "weight", "src_region", "dst_region"), 2)


SOURCES_SQL = ("casos AS (SELECT fecha, sum(num_casos) AS casos, sum(importe) AS importe FROM cases GROUP BY ALL)",
               "uci AS (SELECT fecha, sum(num_hosp) AS num_hosp, sum(num_uci) AS num_uci, sum(num_def) AS num_def FROM outcomes GROUP BY ALL)",
               "mitma AS (SELECT fecha, sum(viajes) AS viajes FROM flows GROUP BY ALL)")


@check("assemble_sources", with_(*PANEL, OUTCOMES, FLOWS, *SOURCES_SQL) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, CAST(num_def AS BIGINT) AS num_def, "
       f"CAST(casos AS BIGINT) AS casos, {r('importe', 2)} AS importe, {r('viajes', 2)} AS viajes FROM uci JOIN casos USING (fecha) JOIN mitma USING (fecha)")
def assemble_sources(spark, d):
    sources = {"casos": collapse(cases(spark, d), "sum").withColumnRenamed("num_casos", "casos"),
               "mitma": flows(spark, d).groupBy("fecha").agg(F.sum("viajes").alias("viajes")),
               "interest": interest(spark, d)}
    target = collapse(outcomes(spark, d), "sum").select("fecha", "num_def")
    return shown(J.assemble(target, sources, ["casos", "mitma"]), 2)


@check("align_panels", with_(NATIONAL, FLOWS, "mitma AS (SELECT fecha, sum(viajes) AS viajes, count(*) AS n FROM flows GROUP BY ALL)") + f"""
SELECT CAST(coalesce(a.fecha, b.fecha) AS VARCHAR) AS fecha, {r('coalesce(casos, -1)')} AS casos, {r('viajes', 2)} AS viajes
FROM national a FULL JOIN mitma b ON a.fecha = b.fecha""")
def align_panels(spark, d):
    daily = flows(spark, d).groupBy("fecha").agg(F.sum("viajes").alias("viajes"))
    both = J.align(national(spark, d).select("fecha", "casos"), daily)
    return shown(both.withColumn("casos", F.coalesce("casos", F.lit(-1)).cast("double")), 2)


@check("dense_spine", with_(DIM, PLACED) + f"""
SELECT region, CAST(g.fecha AS VARCHAR) AS fecha, count(p.o_orderkey) AS n FROM (SELECT r_name AS region, CAST(unnest(generate_series({SPAN})) AS DATE) AS fecha FROM region) g
LEFT JOIN placed p USING (region, fecha) GROUP BY ALL""")
def dense_spine(spark, d):
    spine = J.dense_spine(table(spark, d, "region").select(F.col("r_name").alias("region")), *span(spark, d))
    counts = cases(spark, d).groupBy("region", "fecha").agg(F.sum("num_casos").alias("n"))
    return shown(spine.join(counts, ["region", "fecha"], "left").fillna(0, ["n"]))


@check("postal_map", """
WITH m AS (SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || '_AM' ELSE c_mktsegment END AS municipio_mitma FROM customer),
p AS (SELECT DISTINCT c_mktsegment AS cp, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS provincia FROM customer)
SELECT municipio_mitma, cp, provincia FROM p JOIN m ON cp = replace(municipio_mitma, '_AM', '')""")
def postal(spark, d):
    c = table(spark, d, "customer")
    codes = c.select(F.col("c_mktsegment").alias("cp"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("provincia"))
    marked = F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_mktsegment", F.lit("_AM"))).otherwise(F.col("c_mktsegment"))
    return postal_map(codes, c.select(marked.alias("municipio_mitma")))
