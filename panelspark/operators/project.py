"""Projection, cleaning, filters, sorting and union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.clean import rate_per_100k
from panelspark.operators.scalars import with_scalars


def project(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None,
            rename: dict[str, str] | None = None) -> DataFrame:
    """Select, drop and rename in one step. Dropping or renaming an absent column is no error."""
    names = [c for c in (keep or df.columns) if c not in set(drop or ())]
    return df.select(*names).withColumnsRenamed(rename or {})


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``df`` that are named in the list, in the order of ``df``."""
    wanted = set(names)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted])


def add_prefix(df: DataFrame, prefix: str, exclude: list[str] = ()) -> DataFrame:
    skip = set(exclude)
    return df.select(*[F.col(f"`{c}`").alias(c if c in skip else prefix + c) for c in df.columns])


def extend_last(df: DataFrame, date_col: str, end) -> DataFrame:
    """Move the last known date to ``end``; earlier dates stay."""
    last = df.agg(F.max(date_col)).scalar()
    return df.withColumn(date_col, F.when(F.col(date_col) == last, F.lit(end).cast("date"))
                         .otherwise(F.col(date_col)))


def per_100k(df: DataFrame, cols: list[str], population: str | Column | float,
             prefix: str = "ratio_population__") -> DataFrame:
    """Add rates per 100,000 by a population column or a constant. The raw columns stay."""
    return df.select("*", *[rate_per_100k(F.col(f"`{c}`"), population).alias(prefix + c) for c in cols])


def fill_constant(df: DataFrame, value=0, cols: list[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=cols)


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULL by the mean of the column. A column without any value stays NULL."""
    means = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)])
    place = {c: i for i, c in enumerate(cols)}
    return with_scalars(df, means).select(*[
        F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"_s.m{place[c]}")).alias(c)
        if c in place else F.col(f"`{c}`") for c in df.columns])


def drop_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=cols)


def where_all(df: DataFrame, equals: dict | None = None, since: dict | None = None,
              members: dict | None = None, excluded: dict | None = None,
              contains: dict | None = None) -> DataFrame:
    """All conditions together: equality, lower bound, membership, non-membership, text inside."""
    tests = [F.col(c) == v for c, v in (equals or {}).items()]
    tests += [F.col(c) >= F.lit(v) for c, v in (since or {}).items()]
    tests += [F.col(c).isin(list(v)) for c, v in (members or {}).items()]
    tests += [~F.col(c).isin(list(v)) for c, v in (excluded or {}).items()]
    tests += [F.col(c).contains(v) for c, v in (contains or {}).items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def calendar_features(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """Year, month, day, week day (Monday is 0), day of year and a weekend flag."""
    p = f"{prefix or col}_"
    weekday = F.weekday(col)
    return df.select("*", F.year(col).alias(p + "year"), F.month(col).alias(p + "month"),
                     F.day(col).alias(p + "day"), weekday.alias(p + "dayofweek"),
                     F.dayofyear(col).alias(p + "dayofyear"),
                     weekday.isin(5, 6).cast("int").alias(p + "weekend"))


def sort_by(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Sort by ``(column, 'asc' | 'desc')`` pairs."""
    return df.orderBy(*[F.desc(c) if way == "desc" else F.asc(c) for c, way in keys])


def top_k(df: DataFrame, keys: list[tuple[str, str]], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps only its own first ``k``. Add a key that breaks ties."""
    return sort_by(df, keys).limit(k)


def union_all(*frames: DataFrame) -> DataFrame:
    """Append by column name; a column missing in one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
