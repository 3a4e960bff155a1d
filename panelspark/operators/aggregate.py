"""Grouped statistics. All of them combine inside each task before the shuffle."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelspark.functions.clean import flat_name
from panelspark.operators.scalars import with_scalars

STATS = {
    # The sum of a group without values is 0; the other statistics stay NULL.
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


def multi_agg(df: DataFrame, keys: list[str], stats: dict[str, list[str]]) -> DataFrame:
    """Many statistics per column, named ``column__stat``. Rows with a NULL key are dropped."""
    aggs = [STATS[s](F.col(f"`{c}`")).alias(flat_name(c, s)) for c, names in stats.items() for s in names]
    return df.dropna(subset=keys).groupBy(*keys).agg(*aggs)


def group_sum(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(*[STATS["sum"](F.col(f"`{c}`")).alias(c) for c in cols])


def collapse(df: DataFrame, how: str, date_col: str = "fecha", locations: list[str] = ("prov", "region")) -> DataFrame:
    """One row per date over all locations, by sum, mean or max of every other column."""
    cols = [c for c in df.columns if c != date_col and c not in set(locations)]
    aggs = [STATS[how](F.col(f"`{c}`")).alias(c) for c in cols]
    return df.where(F.col(date_col).isNotNull()).groupBy(date_col).agg(*aggs)


def distinct_dim(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def two_level(df: DataFrame, inner_keys: list[str], outer_keys: list[str], col: str, inner: str, outer: str) -> DataFrame:
    """A statistic of group statistics, such as the mean of province means."""
    name = flat_name(col, inner)
    return multi_agg(multi_agg(df, inner_keys, {col: [inner]}), outer_keys, {name: [outer]}).withColumnRenamed(
        flat_name(name, outer), flat_name(col, inner, outer))


STATE = ("sum", "count", "mean", "m2", "min", "max")


def mergeable_stats(df: DataFrame, keys: list[str], cols: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """State that a later roll-up can merge without loss: sum, count, mean, squared deviations from it, min and max.
    ``more`` names further aggregates."""
    aggs = [c.alias(n) for n, c in (more or {}).items()]
    for c in cols:
        value = F.col(f"`{c}`").cast("double")
        made = {"sum": STATS["sum"](value), "count": F.count(value), "mean": F.avg(value),
                "m2": F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)), "min": F.min(value), "max": F.max(value)}
        aggs += [made[s].alias(flat_name(c, s)) for s in STATE]
    return df.dropna(subset=keys).groupBy(*keys).agg(*aggs)


def merge_state(state: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Roll mergeable state up to ``keys``; the result is state again.

    Two aggregates, both begun before their shuffle: the first gives the common means, the second moves the
    deviations to them part by part, so large values with little spread keep it. A NULL key is a group of its own.
    """
    n = lambda c: F.col(flat_name(c, "count"))
    means = state.groupBy(*keys).agg(*[F.try_divide(F.sum(flat_name(c, "sum")), F.sum(n(c))).alias(f"_g{i}") for i, c in enumerate(cols)])
    if keys:
        other = means.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_g{i}" for i in range(len(cols))])
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        centred = state.join(other, reduce(and_, same))
    else:
        centred = with_scalars(state, means, "_g").select("*", "_g.*")
    aggs = []
    for i, c in enumerate(cols):
        off = F.col(flat_name(c, "mean")) - F.col(f"_g{i}")
        made = {"sum": F.sum(flat_name(c, "sum")), "count": F.sum(n(c)), "mean": F.first(f"_g{i}"),
                "m2": F.sum(F.col(flat_name(c, "m2")) + F.coalesce(n(c) * off * off, F.lit(0.0))),
                "min": F.min(flat_name(c, "min")), "max": F.max(flat_name(c, "max"))}
        aggs += [made[s].alias(flat_name(c, s)) for s in STATE]
    return centred.groupBy(*keys).agg(*aggs)


def finish_stats(state: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """State as sum, mean, std, min and max."""
    out = [F.col(k) for k in keys]
    for c in cols:
        std = F.sqrt(F.try_divide(F.col(flat_name(c, "m2")), F.nullif(F.col(flat_name(c, "count")) - 1, F.lit(0))))
        out += [std.alias(flat_name(c, s)) if s == "std" else F.col(flat_name(c, s)) for s in ("sum", "mean", "std", "min", "max")]
    return state.select(*out)


def merge_stats(state: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Roll mergeable state up to ``keys`` and finish it as sum, mean, std, min and max."""
    return finish_stats(merge_state(state, keys, cols), keys, cols)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))


def scalar_aggs(df: DataFrame, col: str) -> DataFrame:
    value = F.col(f"`{col}`").cast("double")
    return df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
                  F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
                  F.sum(value * value).alias("sum_squares"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins over the data range; the last bin is closed. Empty bins show 0."""
    rows = df.select(F.col(f"`{col}`").cast("double").alias("v")).where("v is not null")
    bounds = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.floor(F.try_divide(F.col("v") - F.col("_s.lo"), F.col("_s.hi") - F.col("_s.lo")) * bins)
    counts = (with_scalars(rows, bounds).select(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("n")))
    grid = with_scalars(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), bounds)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("_s.lo") + F.col("bin") * width).alias("left"),
                    (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("right"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlations below the diagonal; each pair uses the rows where both are present (neither NULL nor NaN).

    One pass: each task forms the sums of all pairs with a few matrix products, on values moved to the means of its
    first rows so that no digits are lost, and sends one row per pair: count, means and centred products. Those of a
    pair are merged exactly, whatever means they are centred on.
    """
    m = len(cols)
    values = [F.when(~F.isnan(v), v) for v in (F.col(f"`{c}`").cast("double") for c in cols)]
    i, j = np.tril_indices(m, -1)
    names = ["n", "ma", "mb", "caa", "cbb", "cab"]

    def sums(batches):
        total, centre = np.zeros((6, m, m)), None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            known = ~np.isnan(x)
            if centre is None:
                centre = np.where(known, x, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
            x, known = np.where(known, x - centre, 0.0), known.astype(float)
            n, left, right = known.T @ known, x.T @ known, (x * x).T @ known
            total += np.stack([n, left, left.T, right, right.T, x.T @ x])
        if centre is None:
            return
        n, sa, sb, saa, sbb, sab = total[:, i, j]
        some = np.maximum(n, 1.0)
        flat = (n, sa / some + centre[i], sb / some + centre[j], saa - sa * sa / some, sbb - sb * sb / some, sab - sa * sb / some)
        kept = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i))[kept]), *[pa.array(v[kept]) for v in flat]], names=["k", *names])

    if not len(i):
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    made = df.select(F.array(*values).alias("x")).mapInArrow(sums, "k bigint, " + ", ".join(f"{c} double" for c in names))
    # One row per pair and task. The spread between the tasks is added on means that are near each other.
    c, w = F.col, W.partitionBy("k")
    mean = lambda a: F.sum(c("n") * (c(a) - c(f"_{a}"))) / F.sum("n")
    parts = made.withColumns({"_ma": F.first("ma").over(w), "_mb": F.first("mb").over(w)})
    between = lambda a, b: F.sum(c("n") * (c(a) - c(f"_{a}")) * (c(b) - c(f"_{b}"))) - F.sum("n") * mean(a) * mean(b)
    whole = parts.groupBy("k").agg((F.sum("caa") + between("ma", "ma")).alias("caa"), (F.sum("cbb") + between("mb", "mb")).alias("cbb"), (F.sum("cab") + between("ma", "mb")).alias("cab"))
    both = F.sqrt(F.greatest("caa", F.lit(0.0)) * F.greatest("cbb", F.lit(0.0)))
    r = F.try_divide("cab", F.nullif(both, F.lit(0.0)))
    name = lambda at: F.element_at(F.array(*[F.lit(x) for x in cols]), F.element_at(F.array(*[F.lit(int(a) + 1) for a in at]), (c("k") + 1).cast("int")))
    every = df.sparkSession.range(len(i)).withColumnRenamed("id", "k").join(whole, "k", "left")
    return every.select(name(i).alias("a"), name(j).alias("b"), r.alias("r"))


def kde(df: DataFrame, col: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid, with bandwidth ``s * n ** (-1/5)``.

    The grid reaches ``cut`` bandwidths beyond the data. Each grid point is one aggregate column, so
    the rows are never multiplied by the grid.
    """
    rows = df.select(F.col(f"`{col}`").cast("double").alias("v")).where("v is not null")
    base = rows.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                    (F.stddev_samp("v") * F.pow(F.count("v"), F.lit(-0.2))).alias("h"))
    grid = base.select("n", "h", (F.col("lo") - cut * F.col("h")).alias("first"),
                       ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)).alias("step"))
    scaled = with_scalars(rows, grid).select(((F.col("v") - F.col("_s.first")) / F.col("_s.h")).alias("u"),
                                             (F.col("_s.step") / F.col("_s.h")).alias("du"))
    sums = scaled.agg(*[F.sum(F.exp(-0.5 * F.pow(F.col("u") - i * F.col("du"), 2))).alias(f"k{i}") for i in range(points)])
    stacked = sums.select(F.posexplode(F.array(*[f"k{i}" for i in range(points)])).alias("point", "k"))
    density = F.col("k") / (F.col("_s.n") * F.col("_s.h") * math.sqrt(2 * math.pi))
    return with_scalars(stacked, grid).select(
        "point", (F.col("_s.first") + F.col("point") * F.col("_s.step")).alias("x"), density.alias("density"))


def kde_binned(df: DataFrame, col: str, points: int = 1000, cut: float = 3.0) -> DataFrame:
    """The density of ``kde`` on many points: every value is split over its two neighbours on the grid, tasks add up
    the weights, and the kernel is applied to the grid.

    Splitting moves the density by at most (step / bandwidth) ** 2 / 8 of its curvature; with 1,000 points the
    difference to ``kde`` stays below 1e-3 of the highest density while the data spans less than 80 bandwidths.
    """
    rows = df.select(F.col(f"`{col}`").cast("double").alias("v")).where("v is not null")
    base = rows.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                    (F.stddev_samp("v") * F.pow(F.count("v"), F.lit(-0.2))).alias("h"))
    grid = base.select("n", "h", (F.col("lo") - cut * F.col("h")).alias("first"),
                       ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)).alias("step"))
    place = with_scalars(rows, grid).select(((F.col("v") - F.col("_s.first")) / F.col("_s.step")).alias("u"))
    at = F.least(F.floor("u"), F.lit(points - 2))
    bins = place.groupBy(at.cast("int").alias("i")).agg(F.sum(1 - (F.col("u") - at)).alias("left"), F.sum(F.col("u") - at).alias("right"))
    # At most one row per grid point from here on.
    weights = bins.select(F.inline(F.array(F.struct("i", F.col("left").alias("w")), F.struct((F.col("i") + 1).alias("i"), F.col("right").alias("w"))))).groupBy("i").agg(F.sum("w").alias("w"))
    one = weights.agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("ws"))
    line = with_scalars(with_scalars(df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")), grid), one, "_w")
    du = F.col("_s.step") / F.col("_s.h")
    k = F.aggregate("_w.ws", F.lit(0.0), lambda a, x: a + x["w"] * F.exp(-0.5 * F.pow((F.col("point") - x["i"]) * du, 2)))
    return line.select("point", (F.col("_s.first") + F.col("point") * F.col("_s.step")).alias("x"),
                       (k / (F.col("_s.n") * F.col("_s.h") * math.sqrt(2 * math.pi))).alias("density"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10_000, held: int = 200_000) -> dict[tuple[str, float], float | None]:
    """Exact quantiles with linear interpolation, without sorting or holding all values anywhere.

    Sketches that tasks merge give a bracket of values around each wanted rank. One more pass counts the rows below it
    and the rows of each value in it, which says exactly which values have the rank, or that the bracket missed it
    and must be wider. Two passes are enough up to ``held * accuracy / 5`` rows; beyond that the sketch is taken
    again inside the brackets. Two rows per quantile come to the driver. Infinite values have their ranks.
    """
    spark = df.sparkSession
    long = (df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
            .unpivot([], cols, "name", "v").where(F.col("v").isNotNull() & ~F.isnan("v")))
    margin = 2.0 / accuracy
    seen = {r["name"]: r for r in long.groupBy("name").agg(
        F.count("v").alias("n"), F.percentile_approx("v", [min(max(e, 0.0), 1.0) for p in probs for e in (p - margin, p + margin)], accuracy).alias("ends")).collect()}

    def cut(share: float, m: float, values, lo: float = -math.inf, hi: float = math.inf) -> tuple[float, float]:
        """A bracket from two sketched values; an end that covers all rows on its side is the old one."""
        return (values[0] if share - m > 0 else lo), (values[1] if share + m < 1 else hi)

    def sketched(rows: DataFrame, c: str, share: float, m: float):
        return rows.where(F.col("name") == c).agg(F.percentile_approx("v", [min(max(e, 0.0), 1.0) for e in (share - m, share + m)], accuracy)).first()[0]

    # A bracket (low, high) and the share of the rows on either side that it means to hold, for each open quantile.
    open_ = {(c, p): (*cut(p, margin, seen[c]["ends"][2 * i:2 * i + 2]), margin) for c in cols if c in seen for i, p in enumerate(probs)}
    # Where a bracket holds too many rows to number, sketches within it go closer to the rank.
    found: dict[tuple[str, float], tuple[float, float]] = {}
    while open_:
        keys = sorted(open_)
        side = spark.createDataFrame([(k, c, *open_[c, p][:2], float((seen[c]["n"] - 1) * p)) for k, (c, p) in enumerate(keys)], "k int, name string, lo double, hi double, at double")
        near = long.join(side, "name").where(F.col("v") <= F.col("hi"))
        wide = [k for k, (c, p) in enumerate(keys) if 5 * open_[c, p][2] * seen[c]["n"] > held and open_[c, p][0] < open_[c, p][1]]
        if wide:
            inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
            counts = near.where(F.col("k").isin(wide)).groupBy("k").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count(inside).alias("inside"))
            for r in counts.collect():
                c, p = keys[r["k"]]
                rank, m = (seen[c]["n"] - 1) * p - r["below"], open_[c, p][2]
                if not 0 <= rank <= r["inside"] - 1:
                    open_[c, p] = (*cut(p, 8 * m, sketched(long, c, p, 8 * m)), 8 * m)
                    continue
                lo, hi = open_[c, p][:2]
                share = rank / max(r["inside"] - 1, 1)
                closer = cut(share, margin, sketched(long.where(F.col("v").between(lo, hi)), c, share, margin), lo, hi)
                # A bracket that came no closer is numbered as it is.
                open_[c, p] = (*closer, margin * r["inside"] / seen[c]["n"] if closer != (lo, hi) else 0.0)
            continue
        values = near.groupBy("k", "at", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
        here = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        ranked = values.withColumn("upto", upto).where(here(F.floor("at")) | here(F.ceil("at")))
        at: dict[int, list[tuple]] = {}
        for r in ranked.collect():
            at.setdefault(r["k"], []).append((r["upto"], r["v"]))
        for k, key in enumerate(keys):
            c, p = key
            got = sorted(at.get(k, []))
            position = (seen[c]["n"] - 1) * p
            if not got or got[0][1] is None or got[-1][0] <= math.ceil(position):  # the bracket lies beside the rank
                m = 8 * max(open_[key][2], margin)
                open_[key] = (*cut(p, m, sketched(long, c, p, m)), m)
            else:
                found[key] = (got[0][1], got[-1][1])
                del open_[key]
    out = {}
    for c in cols:
        for p in probs:
            if c not in seen:
                out[c, p] = None
                continue
            a, b = found[c, p]
            share = (seen[c]["n"] - 1) * p % 1.0
            out[c, p] = a if a == b or share == 0 else a + (b - a) * share
    return out


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: count, NULLs, distinct values, mean, std, min, quartiles, max."""
    spark = df.sparkSession
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    parts = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`").cast("double")
        parts += [F.count(v).alias(f"count{i}"), F.sum(v.isNull().cast("bigint")).alias(f"nulls{i}"),
                  F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    names = ["count", "nulls", "mean", "std", "min", "max"]
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{s}{i}").alias(s) for s in names],
                     *[F.lit(quartiles[c, p]).cast("double").alias(q) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
            for i, c in enumerate(cols)]
    moments = df.agg(*parts).select(F.inline(F.array(*rows)))
    # Distinct (column, value) pairs first, so that the count needs no per-column value set.
    distinct = (df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
                .where(F.col("v").isNotNull()).distinct().groupBy("column").agg(F.count("*").alias("distinct")))
    return moments.join(distinct, "column", "left").select(
        "column", "count", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "mean", "std", "min", "q1", "median", "q3", "max")
