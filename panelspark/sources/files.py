"""Landed files in, tables and CSV out."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, paths, schema: T.StructType | str, sep: str = ",",
                   header: bool = True, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Delimited text under an explicit schema; gzip is recognised by the file extension.

    Codes stay text (leading zeros, the literal ``NA``): only an empty field is NULL.
    """
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("dateFormat", date_format).option("encoding", "UTF-8").csv(paths))


def read_json_records(spark: SparkSession, paths, schema: T.StructType | str,
                      multiline: bool = True) -> DataFrame:
    """JSON documents, each one record or an array of records. Line files split across tasks."""
    return spark.read.schema(schema).option("multiLine", multiline).json(paths)


def flatten_json(df: DataFrame, col: str, schema: T.StructType | str) -> DataFrame:
    """Replace a JSON text column by one column per field."""
    rest = [c for c in df.columns if c != col]
    return df.withColumn(col, F.from_json(col, schema)).select(*rest, f"{col}.*")


def _as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def dated_paths(template: str, start: date | str, end: date | str) -> list[str]:
    """One path per day from a ``strftime`` template; give the whole list to one read call."""
    first, last = _as_date(start), _as_date(end)
    return [(first + timedelta(days=i)).strftime(template) for i in range((last - first).days + 1)]


def date_chunks(spark: SparkSession, start: date | str, end: date | str, days: int = 25) -> DataFrame:
    """Chunks ``(chunk, date_from, date_to)`` of at most ``days`` days that cover the range."""
    first, last = F.lit(_as_date(start)), F.lit(_as_date(end))
    steps = F.sequence(first, last, F.make_dt_interval(F.lit(days)))
    return (spark.range(1).select(F.posexplode(steps).alias("chunk", "date_from"))
            .withColumn("date_to", F.least(F.date_add("date_from", days - 1), last)))


def assign_chunk(df: DataFrame, date_col: str, start: date | str, end: date | str,
                 days: int = 25) -> DataFrame:
    """Add the chunk number by arithmetic, so no range join is needed. Rows outside are dropped."""
    first, last = F.lit(_as_date(start)), F.lit(_as_date(end))
    return (df.where(F.col(date_col).between(first, last))
            .withColumn("chunk", F.floor(F.datediff(date_col, first) / days).cast("int")))


def gap_report(df: DataFrame, date_col: str, start: date | str, end: date | str,
               keys: list[str] | None = None, universe: DataFrame | None = None) -> DataFrame:
    """Expected days that have no row, per key. ``universe`` lists the keys, else those seen in ``df``.

    ``df`` is first reduced to distinct (key, day), so a crowded key costs no more than a sparse one.
    """
    keys = list(keys or [])
    seen = df.select(*keys, date_col).distinct()
    if keys:
        base = (universe if universe is not None else df).select(*keys).distinct()
    else:
        base = df.sparkSession.range(1).select()
    days = F.explode(F.sequence(F.lit(_as_date(start)), F.lit(_as_date(end))))
    return base.select(*keys, days.alias(date_col)).join(seen, [*keys, date_col], "left_anti")


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
               mode: str = "overwrite") -> None:
    """Parquet hand-off. Rows are rebalanced by partition: small ones merge, a hot one is split."""
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
    else:
        writer = df.hint("rebalance").write
    writer.mode(mode).option("partitionOverwriteMode", "dynamic" if partition_by else "static").parquet(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def export_csv(df: DataFrame, path: str, order_by: list) -> None:
    """Result table as CSV with header; the part files follow the sort order."""
    df.orderBy(*order_by).write.mode("overwrite").option("header", True).csv(path)
