"""One-row aggregates used beside the rows they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame, name: str = "_s") -> DataFrame:
    """Add a one-row frame as the struct column ``name``.

    It is a scalar subquery: computed once, sent as a literal, and no join is planned.
    """
    return df.withColumn(name, one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns])).scalar())
