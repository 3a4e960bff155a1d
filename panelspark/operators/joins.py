"""Joins of panels, dimensions and graphs.

No side is forced to be broadcast. Catalyst and AQE broadcast a side only when its measured size is
under the session threshold; otherwise both sides are shuffled and AQE splits skewed keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_dim(df: DataFrame, dim: DataFrame, left_on: list[str] | str, right_on: list[str] | str | None = None,
             how: str = "inner") -> DataFrame:
    """Equi join to a dimension whose keys may have other names; the right keys are dropped."""
    left = [left_on] if isinstance(left_on, str) else list(left_on)
    right = left if right_on is None else [right_on] if isinstance(right_on, str) else list(right_on)
    temp = {r: f"_dim_{i}" for i, r in enumerate(right)}
    side = dim.withColumnsRenamed(temp)
    on = reduce(lambda a, b: a & b, [F.col(f"`{a}`") == F.col(temp[b]) for a, b in zip(left, right)])
    return df.join(side, on, how).drop(*temp.values())


def join_roles(df: DataFrame, dim: DataFrame, roles: dict[str, str], key: str) -> DataFrame:
    """Join one dimension once per role: ``{role: column}`` adds its attributes as ``role_attribute``."""
    for role, column in roles.items():
        named = dim.select(*[F.col(f"`{c}`").alias(f"{role}_{c}") for c in dim.columns])
        df = join_dim(df, named, column, f"{role}_{key}")
    return df


def expand_region(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Copy each region row to every province of the region."""
    return df.join(dim, on)


def outer_merge(a: DataFrame, b: DataFrame, on: list[str], fill: float = 0) -> DataFrame:
    """Full outer join on the keys, then fill the missing measures. NULL keys are dropped first."""
    return a.dropna(subset=on).join(b.dropna(subset=on), on, "full").fillna(
        fill, subset=[c for c in dict.fromkeys(a.columns + b.columns) if c not in on])


def attach_nodes(edges: DataFrame, nodes: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Left join node attributes to both ends of each edge."""
    for end in (src, dst):
        named = nodes.select(*[F.col(f"`{c}`").alias(f"{end}_{c}") for c in nodes.columns])
        edges = join_dim(edges, named, end, f"{end}_{key}", "left")
    return edges


def assemble(target: DataFrame, sources: dict[str, DataFrame], chosen: list[str], on: str = "fecha",
             how: str = "inner") -> DataFrame:
    """Join the chosen sources to the target on the date. All exchanges share that one key."""
    return reduce(lambda acc, name: acc.join(sources[name], on, how), chosen, target)


def align(*frames: DataFrame, on: str | list[str] = "fecha") -> DataFrame:
    """Put frames side by side on the union of their keys."""
    keys = [on] if isinstance(on, str) else list(on)
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def dense_spine(regions: DataFrame, start, end, date_col: str = "fecha") -> DataFrame:
    """Every day of the range for every row of ``regions``; days are generated row by row, not joined."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return regions.select("*", F.explode(days).alias(date_col))
