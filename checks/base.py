"""Query registry, and the roles the test tables play (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import stage

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


_schemas: dict[str, object] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once and given to later reads."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and dates as ISO text, so that two engines print the same."""
    kinds = {"double": lambda c: F.round(c, digits), "date": lambda c: c.cast("string"),
             "int": lambda c: c.cast("bigint"), "smallint": lambda c: c.cast("bigint")}
    return df.select(*[kinds.get(k, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, k in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding 0.0 turns a negative zero into zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def cents(col: str):
    """Whole numbers, so that sums do not depend on the order of the rows."""
    return F.round(F.col(col) * 100)


# Roles, as DataFrames -------------------------------------------------------------------------

def dimension(spark, d) -> DataFrame:
    """Province (nation) and region."""
    return (table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("prov"), F.col("r_name").alias("region")))


def placed_orders(spark, d) -> DataFrame:
    """Orders with their day and the place of their customer."""
    orders = table(spark, d, "orders").withColumn("fecha", F.to_date("o_orderdate"))
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(dimension(spark, d), F.col("c_nationkey") == F.col("n_nationkey")))


def cases(spark, d) -> DataFrame:
    """Cases by province and day: the grain at which all series operators work."""
    return placed_orders(spark, d).groupBy("fecha", "prov", "region").agg(
        F.count("*").alias("num_casos"), F.sum(cents("o_totalprice")).alias("importe"))


def outcomes(spark, d) -> DataFrame:
    status = F.col("o_orderstatus")
    return placed_orders(spark, d).groupBy("fecha", "prov", "region").agg(
        *[F.sum((status == s).cast("bigint")).alias(n) for s, n in (("F", "num_hosp"), ("O", "num_uci"), ("P", "num_def"))])


WORDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def daily_facts(spark, d) -> DataFrame:
    """Cases, outcomes and word counts by province and day from one pass over the orders, staged.

    Designs read it many times; each use prunes other columns, so Spark could not share the join.
    """
    when = lambda test: F.sum(test.cast("double"))
    facts = placed_orders(spark, d).groupBy("fecha", "prov", "region").agg(
        F.count("*").alias("num_casos"), F.sum(cents("o_totalprice")).alias("importe"),
        *[when(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "num_hosp"), ("O", "num_uci"), ("P", "num_def"))],
        *[when(F.col("o_orderpriority") == w).alias(w) for w in WORDS])
    return stage(facts, "facts")


def span(spark, d) -> tuple:
    """First and last day that has orders, as scalar subqueries."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("fecha"))
    return days.agg(F.min("fecha")).scalar(), days.agg(F.max("fecha")).scalar()


def national(spark, d) -> DataFrame:
    """One row per day that has orders."""
    return (table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("fecha"))
            .agg(F.count("*").alias("casos"), F.sum(cents("o_totalprice")).alias("importe")))


def flows(spark, d) -> DataFrame:
    """Trips: shipped lines from the nation of the supplier to the nation of the customer."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("fecha"),
                                              F.col("l_quantity").cast("double").alias("viajes"), cents("l_extendedprice").alias("viajes_km"))
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dest"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("origin"))
    return (line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("fecha", "origin", "dest", "viajes", "viajes_km"))


def interest(spark, d) -> DataFrame:
    """Search interest: events by day and word, placed in a region by the user number."""
    e = table(spark, d, "events")
    return (e.select(F.to_date("ts").alias("fecha"), (F.col("user_id") % 5).cast("int").alias("r"), F.col("event_type").alias("variable"), "value")
            .join(table(spark, d, "region"), F.col("r") == F.col("r_regionkey")).groupBy("fecha", F.col("r_name").alias("region"), "variable")
            .agg(F.sum("value").alias("value")))


# The same roles, as SQL -----------------------------------------------------------------------

DIM = "dim AS (SELECT n_nationkey, n_name AS prov, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"
PLACED = ("placed AS (SELECT *, CAST(o_orderdate AS DATE) AS fecha FROM orders JOIN customer ON o_custkey = c_custkey "
          "JOIN dim ON c_nationkey = n_nationkey)")
CASES = "cases AS (SELECT fecha, prov, region, count(*) AS num_casos, sum(round(o_totalprice * 100)) AS importe FROM placed GROUP BY ALL)"
SPAN = "(SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY"
OUTCOMES = ("outcomes AS (SELECT fecha, prov, region, " + ", ".join(
    f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
    for s, n in (("F", "num_hosp"), ("O", "num_uci"), ("P", "num_def"))) + " FROM placed GROUP BY ALL)")
NATIONAL = "national AS (SELECT CAST(o_orderdate AS DATE) AS fecha, count(*) AS casos, sum(round(o_totalprice * 100)) AS importe FROM orders GROUP BY ALL)"
FLOWS = ("flows AS (SELECT CAST(l_shipdate AS DATE) AS fecha, s_nationkey AS origin, c_nationkey AS dest, CAST(l_quantity AS DOUBLE) AS viajes, "
         "round(l_extendedprice * 100) AS viajes_km FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
         "JOIN supplier ON l_suppkey = s_suppkey)")
INTEREST = ("interest AS (SELECT CAST(ts AS DATE) AS fecha, r_name AS region, event_type AS variable, sum(value) AS value "
            "FROM events JOIN region ON user_id % 5 = r_regionkey GROUP BY ALL)")
PANEL = (DIM, PLACED, CASES)


def dense_sql(name: str, source: str, keys: list[str], cols: list[str], fill: str = "zero", lo: str | None = None, hi: str | None = None) -> tuple[str, ...]:
    """Common table expressions that complete ``source`` to daily rows, written from the definition."""
    head = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    on = " AND ".join([f"s.{k} IS NOT DISTINCT FROM g.{k}" for k in keys] + ["s.fecha = g.fecha"])
    out = [f"{name}_days AS (SELECT {head}CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS fecha FROM "
           f"(SELECT DISTINCT {head}{lo or 'min(fecha)'} AS a, {hi or 'max(fecha)'} AS b FROM {source} {'GROUP BY ALL' if keys else ''}))",
           f"{name}_raw AS (SELECT {''.join(f'g.{k}, ' for k in keys)}g.fecha, {', '.join(f's.{c}' for c in cols)} "
           f"FROM {name}_days g LEFT JOIN {source} s ON {on})"]
    if fill == "zero":
        out.append(f"{name} AS (SELECT {head}fecha, {', '.join(f'coalesce({c}, 0) AS {c}' for c in cols)} FROM {name}_raw)")
        return tuple(out)
    near, made = [], []
    for c in cols:
        day = f"CASE WHEN {c} IS NOT NULL THEN fecha END"
        before = f"OVER ({part}ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        after = f"OVER ({part}ORDER BY fecha ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        near += [f"last_value({c} IGNORE NULLS) {before} AS pv_{c}", f"last_value({day} IGNORE NULLS) {before} AS pd_{c}",
                 f"first_value({c} IGNORE NULLS) {after} AS nv_{c}", f"first_value({day} IGNORE NULLS) {after} AS nd_{c}"]
        made.append(f"CASE WHEN pv_{c} IS NULL THEN nv_{c} WHEN nv_{c} IS NULL OR nd_{c} = pd_{c} THEN pv_{c} ELSE "
                    f"pv_{c} + (nv_{c} - pv_{c}) * (fecha - pd_{c}) / CAST(nd_{c} - pd_{c} AS DOUBLE) END AS {c}")
    out.append(f"{name}_near AS (SELECT *, {', '.join(near)} FROM {name}_raw)")
    out.append(f"{name} AS (SELECT {head}fecha, {', '.join(made)} FROM {name}_near)")
    return tuple(out)
