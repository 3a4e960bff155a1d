"""Ingest of daily deliveries in bounded batches, decided by a ledger.

A backlog is taken in by a few files at a time. A day may be split over files and batches, and may be delivered again
later or out of order, so no batch can tell by itself which rows a day has. Below one folder are kept

* ``parts``: mergeable state by day, delivery and keys, one folder per batch;
* ``ledger``: day, delivery, time of sending and rows, one folder per batch;
* ``days``: the result, one partition per day, as mergeable state by day and keys.

A batch writes its parts and its ledger entries, finds in the whole ledger the newest delivery of each day that it
touched, and writes these days anew from the parts of that delivery, whichever batches they came in. All writes of a
batch replace what it wrote before, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.aggregate import merge_state, mergeable_stats


def ingest_ledger(spark: SparkSession, in_dir: str, base_dir: str, checkpoint_dir: str, schema: T.StructType | str, keys: list[str], cols: list[str],
                  prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, date_col: str = "fecha", sep: str = "|", header: bool = True,
                  unit: str = r"^(.*)$", max_files: int = 1000) -> None:
    """Take in everything that arrived since the last call, ``max_files`` files at a time, and stop.

    ``prepare`` maps raw rows to rows with ``date_col``, ``keys`` and ``cols`` and must keep all other columns that
    begin with ``_``. A delivery is one file, or all files whose path gives the same first group of ``unit``; the one
    whose newest file is newest holds, ties go to the name that sorts last. Rows without a day or a key are left out.
    """
    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumns({"_delivery": F.regexp_extract(F.col("_metadata.file_path"), unit, 1), "_sent": F.col("_metadata.file_modification_time")})
        by = [date_col, "_delivery", *keys]
        state = mergeable_stats(prepare(marked), by, cols, {"_sent": F.max("_sent"), "_rows": F.count("*")})
        session = batch.sparkSession
        _replace(state, f"{base_dir}/parts/batch={number}", date_col)
        own = session.read.schema(state.schema).parquet(f"{base_dir}/parts/batch={number}")
        sent = own.groupBy(date_col, "_delivery").agg(F.max("_sent").alias("_sent"), F.sum("_rows").alias("_rows"))
        sent.write.mode("overwrite").parquet(f"{base_dir}/ledger/batch={number}")
        touched = session.read.schema(sent.schema).parquet(f"{base_dir}/ledger/batch={number}").select(date_col).distinct()
        wins = newest(read_ledger(session, base_dir, date_col).join(touched, date_col, "left_semi"), date_col)
        parts = session.read.schema(T.StructType([*state.schema, T.StructField("batch", T.LongType())])).parquet(f"{base_dir}/parts")
        held = parts.join(wins.select(date_col, "_delivery"), [date_col, "_delivery"]).drop("_delivery", "_sent", "_rows", "batch")
        _replace(merge_state(held, [date_col, *keys], cols), f"{base_dir}/days", date_col)

    source = (spark.readStream.schema(schema).option("sep", sep).option("header", header).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", max_files).csv(in_dir).select("*", "_metadata"))
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()


def _replace(df: DataFrame, path: str, date_col: str) -> None:
    df.hint("rebalance", date_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def read_ledger(spark: SparkSession, base_dir: str, date_col: str = "fecha") -> DataFrame:
    """All entries: day, delivery, time of its newest file and rows, by batch."""
    schema = f"`{date_col}` date, _delivery string, _sent timestamp, _rows bigint, batch bigint"
    return spark.read.schema(schema).parquet(f"{base_dir}/ledger")


def newest(ledger: DataFrame, date_col: str = "fecha") -> DataFrame:
    """The delivery that holds for each day, with its time and its rows over all batches."""
    whole = ledger.groupBy(date_col, "_delivery").agg(F.max("_sent").alias("_sent"), F.sum("_rows").alias("_rows"))
    return whole.groupBy(date_col).agg(F.max(F.struct("_sent", "_delivery", "_rows")).alias("_w")).select(date_col, "_w._delivery", "_w._sent", "_w._rows")


def read_days(spark: SparkSession, base_dir: str) -> DataFrame:
    """The result: mergeable state by day and keys."""
    return spark.read.parquet(f"{base_dir}/days")
