"""Long to wide and back. Pivots take their value list, so schemas do not depend on the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.clean import flat_name
from panelspark.operators.aggregate import STATS
from panelspark.operators.series import resample_daily


def pivot_agg(df: DataFrame, index: list[str], columns: str | list[str], members: list, values: list[str] | str,
              agg: str = "sum", fill: float | None = 0, drop_unlisted: bool = False) -> DataFrame:
    """Aggregating pivot. A member that is not listed stops the query, unless ``drop_unlisted``. With several values the columns are ``value__member``, else ``member``.

    With two column keys a member is the tuple of both; its name joins them with ``__``.
    """
    keys = [columns] if isinstance(columns, str) else list(columns)
    cols = [values] if isinstance(values, str) else list(values)
    labels = [flat_name(*m) if isinstance(m, tuple) else str(m) for m in members]
    label = F.concat_ws("__", *[F.col(k).cast("string") for k in keys])
    wide = (_listed(df.dropna(subset=[*index, *keys]).withColumn("_member", label), "_member", labels, drop_unlisted).groupBy(*index).pivot("_member", labels)
            .agg(*[STATS[agg](F.col(f"`{c}`")).alias(c) for c in cols]))
    if len(cols) == 1:
        made = {m: F.col(f"`{m}`") for m in labels}
    else:
        made = {flat_name(c, m): F.col(f"`{m}_{c}`") for c in cols for m in labels}
    return wide.select(*index, *[(x if fill is None else F.coalesce(x, F.lit(fill))).alias(n) for n, x in made.items()])


def _listed(df: DataFrame, column: str, members: list, drop_unlisted: bool) -> DataFrame:
    """Rows of the listed members; another member is left out or is an error. NULL is no member and passes."""
    known = F.col(column).isNull() | F.col(column).isin(members)
    if drop_unlisted:
        return df.where(known)
    stop = F.raise_error(F.concat(F.lit(f"not in the list of members of {column}: "), F.col(column).cast("string"))).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(known, F.col(column)).otherwise(stop))


def pivot_unique(df: DataFrame, index: list[str], column: str, members: list, value: str, drop_unlisted: bool = False) -> DataFrame:
    """Pivot without aggregation: a second row for one cell stops the query with an error, as does a member that is not listed."""
    df = _listed(df, column, members, drop_unlisted)
    only = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"duplicate entries for {index} and {column}"))).otherwise(F.first(value))
    return df.groupBy(*index).pivot(column, members).agg(only)


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def complete_panel(df: DataFrame, keys: list[str], date: str, values: list[str], fill: str = "linear",
                   start=None, end=None) -> DataFrame:
    """Every key on every day of the range, filled. Without bounds, the range of the whole frame."""
    return resample_daily(df, keys, date, values, fill, start if start is not None else df.agg(F.min(date)).scalar(),
                          end if end is not None else df.agg(F.max(date)).scalar())


def coef_matrix(coefs: DataFrame, features: list[str], value: str = "coefficient", index: str = "combination") -> DataFrame:
    """One row per model, one column per feature; a feature outside the model is NULL."""
    return pivot_unique(coefs, [index], "feature", features, value)
