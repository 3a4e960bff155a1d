"""Sources, sinks and incremental ingest."""

from pyspark.sql import functions as F

from checks.base import INTEREST, DIM, PLACED, CASES, cases, check, r, shown, table, with_
from panelspark.operators.aggregate import finish_stats, multi_agg
from panelspark.session import shared_dir
from panelspark.sources.files import (assign_chunk, date_chunks, dated_paths, export_csv, flatten_json, gap_report, load_table,
                                      read_delimited, read_json_records, save_table)
from panelspark.streaming.ingest import ingest_daily
from panelspark.streaming.ledger import ingest_ledger, read_days

# Eight digits: the mean of up to 127 two-digit values never ends in a 5 there.
EVENT_STATS = ", ".join(f"{r(f'{f}(value)', 8)} AS value__{n}" for f, n in (
    ("sum", "sum"), ("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))


@check("scan_delimited", f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS fecha, {r('o_totalprice', 2)} AS importe, "
       "o_orderpriority AS grupo FROM orders")
def scan_delimited(spark, d):
    path = shared_dir(spark, "scan")
    (table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("fecha"), F.col("o_totalprice").alias("importe"),
                                      F.col("o_orderpriority").alias("grupo"))
     .write.option("sep", "|").option("header", True).option("compression", "gzip").csv(path))
    return shown(read_delimited(spark, path, "o_orderkey bigint, fecha date, importe double, grupo string", sep="|"), 2)


@check("codes_as_text", "SELECT CASE WHEN c_nationkey = 5 THEN 'NA' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS codigo, "
       "count(*) AS n FROM customer GROUP BY ALL")
def codes_as_text(spark, d):
    path = shared_dir(spark, "codes")
    code = F.when(F.col("c_nationkey") == 5, "NA").otherwise(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    table(spark, d, "customer").select("c_custkey", code.alias("codigo")).write.option("sep", "\t").option("header", True).csv(path)
    rows = read_delimited(spark, path, "c_custkey bigint, codigo string", sep="\t")
    return rows.groupBy("codigo").agg(F.count("*").alias("n"))


@check("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return flatten_json(table(spark, d, "events").select("event_id", "props"), "props", "k bigint")


@check("json_records", f"SELECT event_type, count(*) AS n, {r('sum(value)', 2)} AS total FROM events GROUP BY ALL")
def json_records(spark, d):
    path = shared_dir(spark, "json")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    rows = read_json_records(spark, path, "event_id bigint, event_type string, value double", multiline=False)
    return shown(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@check("date_chunks", """
WITH c AS (SELECT i AS chunk, DATE '1995-01-01' + CAST(25 * i AS INTEGER) AS date_from,
                  least(DATE '1995-01-01' + CAST(25 * i + 24 AS INTEGER), DATE '2001-12-31') AS date_to
           FROM range(0, 103) t(i) WHERE DATE '1995-01-01' + CAST(25 * i AS INTEGER) <= DATE '2001-12-31')
SELECT chunk, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to, count(o_orderkey) AS n
FROM c LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN date_from AND date_to GROUP BY ALL""")
def chunks(spark, d):
    span = ("1995-01-01", "2001-12-31")
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("fecha"))
    counted = assign_chunk(rows, "fecha", *span).groupBy("chunk").agg(F.count("*").alias("n"))
    return shown(date_chunks(spark, *span).join(counted, "chunk", "left").fillna(0, ["n"]))


@check("dated_paths", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha, count(*) AS n FROM events "
       "WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY ALL")
def read_dated(spark, d):
    path = shared_dir(spark, "dated")
    day = F.to_date("ts")
    table(spark, d, "events").select("event_id", day.alias("fecha"), day.alias("carpeta")).write.partitionBy("carpeta").option("header", True).csv(path)
    paths = dated_paths(path + "/carpeta=%Y-%m-%d", "2024-01-05", "2024-01-11")
    return shown(read_delimited(spark, paths, "event_id bigint, fecha date").groupBy("fecha").agg(F.count("*").alias("n")))


@check("ingest_daily", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha, event_type, {EVENT_STATS} FROM events GROUP BY ALL")
def ingest(spark, d):
    base = shared_dir(spark, "ingest")
    day = F.to_date("ts")
    (table(spark, d, "events").select(day.alias("fecha"), "event_type", "value", day.alias("carpeta"))
     .write.partitionBy("carpeta").option("sep", "|").option("header", True).option("compression", "gzip").csv(base + "/in"))
    stats = {"value": ["sum", "mean", "std", "min", "max"]}
    ingest_daily(spark, base + "/in", base + "/out", base + "/progress", "fecha date, event_type string, value double",
                 lambda rows: multi_agg(rows, ["fecha", "event_type"], stats), unit=r"^(.*)/[^/]*$")
    return shown(load_table(spark, base + "/out"), 8)


@check("gap_report", with_(DIM, PLACED, CASES) + """
SELECT prov, CAST(fecha AS VARCHAR) AS fecha FROM (SELECT prov, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE)
AS fecha FROM dim) g WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.prov = g.prov AND c.fecha = g.fecha)""")
def gaps(spark, d):
    return shown(gap_report(cases(spark, d), "fecha", "1995-01-01", "2001-08-01", ["prov"]))


@check("table_roundtrip", with_(INTEREST) + f"SELECT CAST(fecha AS VARCHAR) AS fecha, region, variable, {r('value', 4)} AS value FROM interest")
def roundtrip(spark, d):
    from checks.base import interest

    path = shared_dir(spark, "table")
    save_table(interest(spark, d), path, ["fecha"])
    return shown(load_table(spark, path), 4)


@check("csv_export", with_(DIM, PLACED, CASES) + f"SELECT prov, CAST(sum(num_casos) AS BIGINT) AS num_casos, {r('sum(importe)', 2)} AS importe FROM cases GROUP BY ALL")
def csv_export(spark, d):
    path = shared_dir(spark, "export")
    totals = cases(spark, d).groupBy("prov").agg(F.sum("num_casos").alias("num_casos"), F.sum("importe").alias("importe"))
    export_csv(totals, path, [F.desc("num_casos"), F.asc("prov")])
    return shown(read_delimited(spark, path, "prov string, num_casos bigint, importe double"), 2)


@check("ingest_ledger", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha, event_type, {', '.join(f'{r(f'{f}(value)', 6)} AS value__{n}' for f, n in (('sum', 'sum'), ('avg', 'mean'), ('stddev_samp', 'std'), ('min', 'min'), ('max', 'max')))} "
       "FROM events GROUP BY ALL")
def ledger(spark, d):
    """Days in several files, a few files a batch; every fifth day was delivered before with other values, and a second call takes in the last deliveries."""
    base, day = shared_dir(spark, "ledger"), F.to_date("ts")
    rows = table(spark, d, "events").select(day.alias("fecha"), "event_type", "value", day.alias("carpeta"), F.pmod(F.xxhash64("event_id"), F.lit(2)).alias("parte"))

    def land(part, delivery):
        (part.withColumn("envio", F.lit(delivery)).repartition(1).write.mode("append").partitionBy("carpeta", "envio", "parte").option("sep", "|").option("header", True).option("compression", "gzip").csv(base + "/in"))

    def take_in():
        ingest_ledger(spark, base + "/in", base + "/table", base + "/progress", "fecha date, event_type string, value double", ["event_type"], ["value"], unit=r"^(.*)/[^/]*/[^/]*$", max_files=48)

    early = F.dayofmonth("fecha") % 5 == 0
    land(rows.where(early).withColumn("value", F.col("value") * 2 + 1), 1)
    land(rows.where(~early), 1)
    take_in()
    land(rows.where(early), 2)
    take_in()
    return shown(finish_stats(read_days(spark, base + "/table"), ["fecha", "event_type"], ["value"]), 6)
