"""Incremental ingest of daily files into a table partitioned by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newest_delivery(batch: DataFrame, date_col: str, unit: str = r"^(.*)$") -> DataFrame:
    """Keep, for each day, only the rows of its newest delivery.

    A delivery is one file, or all files whose path gives the same first group of ``unit``.
    """
    marked = batch.where(F.col(date_col).isNotNull()).withColumn(
        "_unit", F.regexp_extract(F.col("_metadata.file_path"), unit, 1)
    ).withColumn("_sent", F.col("_metadata.file_modification_time"))
    newest = (marked.groupBy(date_col, "_unit").agg(F.max("_sent").alias("_sent"))
              .groupBy(date_col).agg(F.max(F.struct("_sent", "_unit"))["_unit"].alias("_unit")))
    return marked.drop("_sent").join(newest, [date_col, "_unit"]).drop("_unit")


def ingest_daily(spark: SparkSession, in_dir: str, out_dir: str, checkpoint_dir: str,
                 schema: T.StructType | str, aggregate: Callable[[DataFrame], DataFrame],
                 date_col: str = "fecha", sep: str = "|", header: bool = True,
                 unit: str = r"^(.*)$") -> None:
    """Aggregate each landed day and write it to its own partition of ``out_dir``.

    One call takes in everything that arrived since the last one and stops. ``aggregate`` must keep
    ``date_col`` among its keys. A delivery is a full day: a later one (under a new file name)
    replaces the day, it does not add to it. The stream checkpoint records progress, and a batch
    that is run again after a failure overwrites the same partitions.
    """
    def write(batch: DataFrame, _batch_id: int) -> None:
        (aggregate(newest_delivery(batch, date_col, unit)).hint("rebalance", date_col)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(date_col).parquet(out_dir))

    source = (spark.readStream.schema(schema).option("sep", sep).option("header", header)
              .option("recursiveFileLookup", "true").csv(in_dir).select("*", "_metadata"))
    query = (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
    query.awaitTermination()
