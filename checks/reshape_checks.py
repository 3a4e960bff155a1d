"""Pivots, melts and panel completion."""

from pyspark.sql import functions as F

from checks.base import CASES, DIM, FLOWS, INTEREST, OUTCOMES, PANEL, PLACED, cases, check, dense_sql, dimension, flows, interest, outcomes, placed_orders, r, shown, table, with_
from panelspark.functions.clean import recode
from panelspark.operators import reshape as R
from panelspark.operators.joins import join_dim
from panelspark.operators.text import keyword_groups

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
WORDS = ["click", "error", "purchase", "signup", "view"]


@check("pivot_flow", with_(DIM, FLOWS, "f AS (SELECT fecha, dest, region, sum(viajes) AS viajes FROM flows JOIN dim ON origin = n_nationkey GROUP BY ALL)") +
       "SELECT CAST(fecha AS VARCHAR) AS fecha, dest, " + ", ".join(f"""{r(f"coalesce(sum(CASE WHEN region = '{x}' THEN viajes END), 0)", 2)} AS "{x}" """ for x in REGIONS) + " FROM f GROUP BY ALL")
def pivot_flow(spark, d):
    daily = flows(spark, d).groupBy("fecha", "origin", "dest").agg(F.sum("viajes").alias("viajes"))
    placed = join_dim(daily, dimension(spark, d), "origin", "n_nationkey")
    return shown(R.pivot_agg(placed, ["fecha", "dest"], "region", REGIONS, "viajes"), 2).withColumn("dest", F.col("dest").cast("int"))


AGES = {"1-URGENT": "0-59", "2-HIGH": "0-59", "3-MEDIUM": "60-69", "4-NOT SPECIFIED": "70-79", "5-LOW": "80+"}
BANDS = ["0-59", "60-69", "70-79", "80+"]
AGE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in AGES.items()) + " END"


@check("pivot_two_keys", with_(DIM, PLACED) + "SELECT CAST(fecha AS VARCHAR) AS fecha, " + ", ".join(
    f"""CAST(sum(CASE WHEN region = '{g}' AND {AGE_SQL} = '{b}' THEN {c} ELSE 0 END) AS BIGINT) AS "{n}__{g}__{b}" """
    for n, c in (("num_casos", "1"), ("num_def", "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END")) for g in REGIONS for b in BANDS) + " FROM placed GROUP BY ALL")
def pivot_two_keys(spark, d):
    rows = placed_orders(spark, d).select("fecha", "region", recode("o_orderpriority", AGES).alias("edad"), F.lit(1).cast("bigint").alias("num_casos"),
                                          (F.col("o_orderstatus") == "P").cast("bigint").alias("num_def"))
    return shown(R.pivot_agg(rows, ["fecha"], ["region", "edad"], [(g, b) for g in REGIONS for b in BANDS], ["num_casos", "num_def"]))


@check("pivot_unique", with_(INTEREST) + "SELECT CAST(fecha AS VARCHAR) AS fecha, region, " + ", ".join(f"{r(f'''max(CASE WHEN variable = '{w}' THEN value END)''', 4)} AS {w}" for w in WORDS)
       + " FROM interest GROUP BY ALL")
def pivot_unique(spark, d):
    return shown(R.pivot_unique(interest(spark, d), ["fecha", "region"], "variable", WORDS, "value"), 4)


@check("melt", "\nUNION ALL ".join(f"SELECT o_orderkey, '{c}' AS variable, {r(c, 2)} AS value FROM (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders)"
                                   for c in ("o_totalprice", "o_custkey")))
def melt(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return shown(R.melt(rows, ["o_orderkey"], ["o_totalprice", "o_custkey"]), 2)


@check("complete_panel", with_(*PANEL, *dense_sql("full_panel", "cases", ["prov"], ["num_casos", "importe"], "linear", "(SELECT min(fecha) FROM cases)", "(SELECT max(fecha) FROM cases)"))
       + f"SELECT prov, CAST(fecha AS VARCHAR) AS fecha, {r('num_casos')} AS num_casos, {r('importe')} AS importe FROM full_panel")
def complete_panel(spark, d):
    return shown(R.complete_panel(cases(spark, d), ["prov"], "fecha", ["num_casos", "importe"], "linear"))


THEMES = {"click": "behavior", "view": "behavior", "signup": "policy", "error": "symptom", "purchase": "policy"}
THEMES_USED = {w: t for w, t in THEMES.items() if w != "signup"}


@check("keyword_groups", with_(INTEREST, "semana AS (SELECT CAST(date_trunc('week', fecha) AS DATE) AS fecha, region, variable, sum(value) AS value FROM interest GROUP BY ALL)",
                               "tema AS (SELECT fecha, region, " + ", ".join("sum(CASE WHEN variable IN (" + ", ".join(f"'{w}'" for w, x in THEMES_USED.items() if x == t) + f") THEN value END) AS {t}"
                                                                            for t in ("behavior", "symptom", "policy")) + " FROM semana WHERE variable <> 'signup' GROUP BY ALL)",
                               *dense_sql("dia", "tema", ["region"], ["behavior", "symptom", "policy"], "linear"))
       + "SELECT region, CAST(fecha AS VARCHAR) AS fecha, " + ", ".join(f"{r(t, 4)} AS {t}" for t in ("behavior", "symptom", "policy")) + " FROM dia")
def keywords(spark, d):
    weekly = interest(spark, d).groupBy(F.trunc("fecha", "week").alias("fecha"), "region", "variable").agg(F.sum("value").alias("value"))
    return shown(keyword_groups(weekly, THEMES_USED, ["region"]), 4)


@check("pivot_listed", with_(INTEREST) + "SELECT CAST(fecha AS VARCHAR) AS fecha, " + ", ".join(f"{r(f'''coalesce(sum(CASE WHEN variable = '{w}' THEN value END), 0)''', 4)} AS {w}" for w in WORDS[:2]) + " FROM interest WHERE variable IN (" + ", ".join(f"'{w}'" for w in WORDS[:2]) + ") GROUP BY ALL")
def pivot_listed(spark, d):
    """Some members only, asked for openly; without that a member that is not listed stops the query."""
    return shown(R.pivot_agg(interest(spark, d), ["fecha"], "variable", WORDS[:2], "value", drop_unlisted=True), 4)
