"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def held_out(id_col: str) -> Column:
    """The rows that no classifier learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def sample_ids(labelled: DataFrame, label: str, id_col: str, per_label: int) -> DataFrame:
    """``(id_col, label)`` of up to ``per_label`` ids of each label, the first by hash of the id; an id counts once,
    however many rows have it.

    Labels are dealt in salts first, so that a frequent label is not ranked in one task."""
    rank = F.xxhash64(id_col)
    parts = Window.partitionBy(label, F.pmod(rank, F.lit(SALTS))).orderBy(rank, id_col)
    whole = Window.partitionBy(label).orderBy(rank, id_col)
    few = labelled.select(id_col, label).where(F.col(label).isNotNull()).withColumn("_r", F.dense_rank().over(parts)).where(F.col("_r") <= per_label)
    few = few.select(id_col, label).distinct()
    return few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= per_label).drop("_r")
