"""Projection, cleaning and filters."""

from pyspark.sql import functions as F

from checks.base import CASES, DIM, PANEL, PLACED, NATIONAL, cases, check, national, placed_orders, r, shown, table, with_
from panelspark.functions import clean
from panelspark.operators import project as P

MONTHS = list(clean.SPANISH_MONTHS)


@check("project_rename", "SELECT o_orderkey AS id, o_orderstatus AS estado, o_orderpriority AS grupo FROM orders")
def project_rename(spark, d):
    return P.project(table(spark, d, "orders"), drop=["o_custkey", "o_totalprice", "o_orderdate", "absent"],
                     rename={"o_orderkey": "id", "o_orderstatus": "estado", "o_orderpriority": "grupo", "absent": "x"})


@check("add_prefix", with_(*PANEL) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, prov, region, num_casos AS casos__num_casos, {r('importe', 2)} AS casos__importe FROM cases")
def add_prefix(spark, d):
    return shown(P.add_prefix(cases(spark, d), "casos__", ["fecha", "prov", "region"]), 2)


@check("keep_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def keep_columns(spark, d):
    return P.keep_columns(table(spark, d, "customer"), ["c_mktsegment", "absent", "c_custkey"])


@check("comma_decimal", f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {r('o_totalprice', 2)} END AS valor FROM orders")
def comma_decimal(spark, d):
    text = F.when(F.col("o_orderkey") % 10 == 0, "Ip").otherwise(F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, d, "orders").select("o_orderkey", F.round(clean.comma_decimal(text), 2).alias("valor"))


@check("thousands_int", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders")
def thousands_int(spark, d):
    text = F.replace(F.format_number(F.round(F.col("o_totalprice") * 100), 0), F.lit(","), F.lit("."))
    return table(spark, d, "orders").select("o_orderkey", clean.thousands_int(text).alias("total"))


@check("safe_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS fecha FROM orders")
def safe_date(spark, d):
    text = F.when(F.col("o_orderkey") % 10 == 0, "sin fecha").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return shown(table(spark, d, "orders").select("o_orderkey", clean.safe_date(text, "dd/MM/yyyy").alias("fecha")))


@check("spanish_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS fecha FROM orders")
def spanish_date(spark, d):
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("o_orderdate"))
    text = F.concat_ws(" de ", F.day("o_orderdate").cast("string"), name, F.year("o_orderdate").cast("string"))
    return shown(table(spark, d, "orders").select("o_orderkey", clean.spanish_date(text).alias("fecha")))


@check("prefix_code", "SELECT substr(lpad(CAST(o_custkey AS VARCHAR), 7, '0'), 1, 6) AS codigo, count(*) AS n FROM orders GROUP BY ALL")
def prefix_code(spark, d):
    code = F.lpad(F.col("o_custkey").cast("string"), 7, "0")
    return table(spark, d, "orders").groupBy(clean.prefix_code(code, 6).alias("codigo")).agg(F.count("*").alias("n"))


@check("recode", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'alta' WHEN o_orderpriority = '3-MEDIUM' THEN 'media' "
       "ELSE o_orderpriority END AS banda, count(*) AS n FROM orders GROUP BY ALL")
def recode(spark, d):
    bands = {"1-URGENT": "alta", "2-HIGH": "alta", "3-MEDIUM": "media"}
    return table(spark, d, "orders").groupBy(clean.recode("o_orderpriority", bands).alias("banda")).agg(F.count("*").alias("n"))


@check("strip_marker", "SELECT c_custkey, replace(c_name, 'Customer#', '') AS codigo FROM customer")
def strip_marker(spark, d):
    return table(spark, d, "customer").select("c_custkey", clean.strip_marker("c_name", "Customer#").alias("codigo"))


@check("extend_last", with_(NATIONAL) + "SELECT CAST(CASE WHEN fecha = (SELECT max(fecha) FROM national) THEN DATE '2001-12-31' ELSE fecha END AS VARCHAR) AS fecha, casos FROM national")
def extend_last(spark, d):
    return shown(P.extend_last(national(spark, d).select("fecha", "casos"), "fecha", "2001-12-31"))


@check("per_100k", with_(DIM, PLACED, CASES, "pop AS (SELECT prov, count(*) AS total FROM customer JOIN dim ON c_nationkey = n_nationkey GROUP BY ALL)") + f"""
SELECT CAST(fecha AS VARCHAR) AS fecha, prov, num_casos, {r('num_casos / CAST(total AS DOUBLE) * 100000', 4)} AS ratio_population__num_casos,
{r('importe / total * 100000', 2)} AS ratio_population__importe, {r('num_casos / 47394220.0 * 100000')} AS nacional__num_casos FROM cases JOIN pop USING (prov)""")
def per_100k(spark, d):
    from checks.base import dimension

    pop = (table(spark, d, "customer").join(dimension(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
           .groupBy("prov").agg(F.count("*").alias("total")))
    rates = P.per_100k(cases(spark, d).join(pop, "prov"), ["num_casos", "importe"], "total")
    rates = P.per_100k(rates, ["num_casos"], 47_394_220, "nacional__")
    return rates.select(F.col("fecha").cast("string"), "prov", "num_casos", F.round("ratio_population__num_casos", 4).alias("ratio_population__num_casos"),
                        F.round("ratio_population__importe", 2).alias("ratio_population__importe"), F.round("nacional__num_casos", 6).alias("nacional__num_casos"))


def with_holes(spark, d):
    hole = F.col("o_orderkey") % 7 == 0
    return table(spark, d, "orders").select("o_orderkey", F.when(~hole, F.col("o_totalprice")).alias("valor"),
                                            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("estado"))


HOLES = "holes AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS valor, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS estado FROM orders)"


@check("fill_constant", with_(HOLES) + f"SELECT o_orderkey, {r('coalesce(valor, 0)', 2)} AS valor, estado FROM holes")
def fill_constant(spark, d):
    return shown(P.fill_constant(with_holes(spark, d), 0, ["valor"]), 2)


@check("fill_mean", with_(HOLES) + f"SELECT o_orderkey, {r('coalesce(valor, (SELECT avg(valor) FROM holes))', 4)} AS valor, estado FROM holes")
def fill_mean(spark, d):
    return shown(P.fill_mean(with_holes(spark, d), ["valor"]), 4)


@check("drop_null", with_(HOLES) + f"SELECT 'cualquiera' AS modo, o_orderkey, {r('valor', 2)} AS valor, estado FROM holes WHERE valor IS NOT NULL AND estado IS NOT NULL "
       f"UNION ALL SELECT 'estado', o_orderkey, {r('valor', 2)}, estado FROM holes WHERE estado IS NOT NULL")
def drop_null(spark, d):
    rows = with_holes(spark, d)
    whole = P.drop_null(rows).select(F.lit("cualquiera").alias("modo"), "*")
    return shown(P.union_all(whole, P.drop_null(rows, ["estado"]).select(F.lit("estado").alias("modo"), "*")), 2)


@check("filters", with_(DIM, PLACED) + "SELECT o_orderkey, prov FROM placed WHERE region = 'ASIA' AND fecha >= DATE '1998-01-01' AND o_orderstatus IN ('F', 'O') "
       "AND prov NOT IN ('NATION_2', 'NATION_7') AND o_orderpriority LIKE '%H%'")
def filters(spark, d):
    return P.where_all(placed_orders(spark, d), equals={"region": "ASIA"}, since={"fecha": "1998-01-01"}, members={"o_orderstatus": ["F", "O"]},
                       excluded={"prov": ["NATION_2", "NATION_7"]}, contains={"o_orderpriority": "H"}).select("o_orderkey", "prov")


@check("calendar_features", with_(NATIONAL) + """
SELECT CAST(fecha AS VARCHAR) AS fecha, year(fecha) AS fecha_year, month(fecha) AS fecha_month, day(fecha) AS fecha_day, isodow(fecha) - 1 AS fecha_dayofweek,
dayofyear(fecha) AS fecha_dayofyear, CAST(CASE WHEN isodow(fecha) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS fecha_weekend FROM national""")
def calendar_features(spark, d):
    return shown(P.calendar_features(national(spark, d).select("fecha"), "fecha"))


@check("top_k", with_(NATIONAL) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, casos, {r('importe', 2)} AS importe FROM national ORDER BY casos DESC, national.fecha LIMIT 20")
def top_k(spark, d):
    return shown(P.top_k(national(spark, d), [("casos", "desc"), ("fecha", "asc")], 20), 2)


@check("union_all", "SELECT o_orderkey AS id, 'pedido' AS clase, o_orderstatus AS estado FROM orders UNION ALL SELECT c_custkey, 'cliente', NULL FROM customer")
def union_all(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("pedido").alias("clase"), F.col("o_orderstatus").alias("estado"))
    return P.union_all(orders, table(spark, d, "customer").select(F.lit("cliente").alias("clase"), F.col("c_custkey").alias("id")))
