"""Operators on daily series.

Input is a panel with one row per key and day. Facts are brought to that grain by a grouped
aggregate first, so a window over one key never holds more rows than the calendar has days, no
matter how many facts a location has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelspark.operators.scalars import with_scalars


def series_window(keys: list[str], date: str):
    return W.partitionBy(*keys).orderBy(date)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _offset_present(keys: list[str], date: str, col: str, way: str) -> Column:
    """Nearest earlier (``lag``) or later (``lead``) present value with its date, in one linear scan."""
    split = f"partition by {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    return F.expr(f"{way}(case when `{col}` is not null then struct(`{date}` as d, cast(`{col}` as double) as v) end) "
                  f"ignore nulls over ({split}order by `{date}`)")


def _interpolate(day: Column, before: Column, after: Column) -> Column:
    """Linear between two points; outside them the nearer value."""
    span = F.datediff(after["d"], before["d"])
    between = before["v"] + (after["v"] - before["v"]) * F.datediff(day, before["d"]) / span
    return (F.when(before.isNull(), after["v"]).when(after.isNull() | (day <= before["d"]), before["v"]).otherwise(between))


def resample_daily(df: DataFrame, keys: list[str], date: str, cols: list[str], fill: str = "zero",
                   start=None, end=None) -> DataFrame:
    """One row per key and day. ``fill`` is ``zero``, ``linear`` (both directions) or ``null``.

    Each row is expanded to the days up to its successor, so one shuffle of the given rows is all:
    no calendar is joined. ``start`` and ``end`` bring every key to a common range: rows outside it
    are still used to interpolate, then their days are left out. Two rows for one key and day are an error.
    """
    lo = None if start is None else (start if isinstance(start, Column) else F.lit(start)).cast("date")
    hi = None if end is None else (end if isinstance(end, Column) else F.lit(end)).cast("date")
    rows = df.dropna(subset=[*keys, date])
    if fill != "linear":  # a row outside the range gives nothing to the days within it
        rows = rows.where(_q(date) >= lo) if lo is not None else rows
        rows = rows.where(_q(date) <= hi) if hi is not None else rows
    w = series_window(keys, date)
    here = {c: F.when(_q(c).isNotNull(), F.struct(_q(date).alias("d"), _q(c).cast("double").alias("v"))) for c in cols}
    near = []
    if fill == "linear":
        for i, c in enumerate(cols):
            near.append(F.coalesce(here[c], _offset_present(keys, date, c, "lag")).alias(f"_p{i}"))
            near.append(_offset_present(keys, date, c, "lead").alias(f"_n{i}"))
    step = rows.select(*keys, date, *cols, *near, F.lag(date).over(w).alias("_before"), F.lead(date).over(w).alias("_after"))
    first = F.when(F.col("_before").isNull(), lo).otherwise(_q(date)) if lo is not None else _q(date)
    last = F.coalesce(F.date_sub("_after", 1), hi if hi is not None else _q(date))
    first = F.greatest(first, lo) if lo is not None else first
    last = F.least(last, hi) if hi is not None else last
    twice = F.raise_error(F.lit("two rows for one key and day"))
    days = F.explode(F.when(F.col("_after") == _q(date), twice).when(first <= last, F.sequence(first, last, F.make_dt_interval(F.lit(1)))))
    dense = step.withColumn("_day", days)
    on_day = F.col("_day") == _q(date)
    made = []
    for i, c in enumerate(cols):
        if fill == "linear":
            made.append(_interpolate(F.col("_day"), F.col(f"_p{i}"), F.col(f"_n{i}")).alias(c))
        elif fill == "zero":
            made.append(F.coalesce(F.when(on_day, _q(c)), F.lit(0)).alias(c))
        else:
            made.append(F.when(on_day, _q(c)).alias(c))
    return dense.select(*keys, F.col("_day").alias(date), *made)


def lag_features(df: DataFrame, keys: list[str], date: str, cols: list[str], lags: list[int],
                 by: str = "rows") -> DataFrame:
    """Lags of many columns, named ``col__lag_k``; a negative ``k`` looks ahead.

    All share one sort. On a complete panel rows are days; ``by='days'`` looks at the calendar
    instead and gives NULL where that day is missing.
    """
    if by == "rows":
        w = series_window(keys, date)
        made = [F.lag(_q(c), k).over(w).alias(f"{c}__lag_{k}") for k in lags for c in cols]
    else:
        w = W.partitionBy(*keys).orderBy(F.unix_date(date))
        made = [F.max(_q(c)).over(w.rangeBetween(-k, -k)).alias(f"{c}__lag_{k}") for k in lags for c in cols]
    return df.select(*[_q(c) for c in df.columns if c not in set(cols)], *made)


def pct_change_days(df: DataFrame, keys: list[str], date: str, cols: list[str], days: list[int]) -> DataFrame:
    """Ratio of change against the value ``n`` calendar days ago; NULL if that day is missing or 0.

    Missing values are first filled by the last present one.
    """
    w = series_window(keys, date).rowsBetween(W.unboundedPreceding, 0)
    filled = df.select(*[F.last(_q(c), True).over(w).alias(c) if c in set(cols) else _q(c) for c in df.columns])
    r = W.partitionBy(*keys).orderBy(F.unix_date(date))
    made = [(F.try_divide(_q(c).cast("double"), F.max(_q(c)).over(r.rangeBetween(-n, -n))) - 1).alias(f"{c}__pct_change_{n}")
            for n in days for c in cols]
    return filled.select("*", *made)


def diff(df: DataFrame, keys: list[str], date: str, col: str, k: int = 1, name: str | None = None) -> DataFrame:
    """Difference to the row ``k`` steps earlier."""
    return df.withColumn(name or f"{col}__diff_{k}", _q(col) - F.lag(_q(col), k).over(series_window(keys, date)))


def diff_seasonal(df: DataFrame, keys: list[str], date: str, col: str, period: int = 7,
                  name: str = "seasonal_first_diff") -> DataFrame:
    """Seasonal difference of the first difference, over one sort."""
    w = series_window(keys, date)
    value = (_q(col) - F.lag(_q(col), 1).over(w)) - (F.lag(_q(col), period).over(w) - F.lag(_q(col), period + 1).over(w))
    return df.withColumn(name, value)


def cumulative_to_daily(df: DataFrame, keys: list[str], date: str, col: str, name: str = "daily") -> DataFrame:
    """Daily rate from a running total: rise over the days elapsed, gaps interpolated.

    The first observation has no predecessor and is left out.
    """
    w = series_window(keys, date)
    rate = (_q(col) - F.lag(_q(col)).over(w)) / F.datediff(_q(date), F.lag(_q(date)).over(w))
    rates = df.select(*keys, date, rate.alias(name), F.row_number().over(w).alias("_r")).where("_r > 1").drop("_r")
    return resample_daily(rates, keys, date, [name], "linear")


def zero_history(df: DataFrame, keys: list[str], date: str, cols: list[str], start) -> DataFrame:
    """Prepend rows of zeros from ``start`` to the day before the first date of the frame."""
    before = F.date_sub(df.agg(F.min(date)).scalar(), 1)
    first = F.lit(start).cast("date")
    kind = dict(df.dtypes)
    days = F.when(before >= first, F.sequence(first, before, F.make_dt_interval(F.lit(1))))
    zeros = df.select(*keys).distinct().select(*keys, F.explode(days).alias(date), *[F.lit(0).cast(kind[c]).alias(c) for c in cols])
    return zeros.unionByName(df.select(*keys, date, *cols))


def rolling(df: DataFrame, keys: list[str], date: str, col: str, size: int = 7) -> DataFrame:
    """Rolling mean and sample deviation, NULL until ``size`` values are there."""
    w = series_window(keys, date).rowsBetween(-(size - 1), 0)
    full = F.count(_q(col)).over(w) == size
    return df.select("*", F.when(full, F.avg(_q(col)).over(w)).alias(f"{col}__mean_{size}"),
                     F.when(full, F.stddev_samp(_q(col)).over(w)).alias(f"{col}__std_{size}"))


def decompose(df: DataFrame, keys: list[str], date: str, col: str, period: int = 7) -> DataFrame:
    """Additive decomposition: centred moving average, recentred phase means, residual."""
    w = series_window(keys, date)
    half = period // 2
    rows = df.withColumn("_i", F.row_number().over(w) - 1)
    frame = w.rowsBetween(-half, half)
    full = F.count(_q(col)).over(frame) == 2 * half + 1
    if period % 2:
        trend = F.avg(_q(col)).over(frame)
    else:
        ends = F.lag(_q(col), half).over(w) + F.lead(_q(col), half).over(w)
        trend = (F.sum(_q(col)).over(frame) - 0.5 * ends) / period
    rows = rows.withColumn("trend", F.when(full, trend))
    # The phase means use the same partitioning as the trend, so they need no further shuffle.
    whole = W.partitionBy(*keys)
    phase = F.pmod(F.col("_i"), F.lit(period))
    means = [F.avg(F.when(phase == j, _q(col) - F.col("trend"))).over(whole) for j in range(period)]
    rows = rows.withColumn("_m", F.array(*means))
    centre = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x) / period
    seasonal = F.get("_m", phase) - centre
    return (rows.withColumn("seasonal", seasonal).withColumn("resid", _q(col) - F.col("trend") - F.col("seasonal"))
            .drop("_i", "_m"))


def holiday_panel(holidays: DataFrame, dim: DataFrame, start, end, level: str = "prov", date: str = "fecha") -> DataFrame:
    """0/1 flag per province and day, or per region and day where one holiday province is enough.

    ``dim`` maps ``prov`` to ``region``; ``holidays`` holds (prov, date) rows.
    """
    marked = holidays.select("prov", date).distinct().withColumn("_h", F.lit(1))
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    panel = (dim.select("prov", "region").distinct().select("*", days.alias(date)).join(marked, ["prov", date], "left")
             .select(date, "prov", "region", F.coalesce("_h", F.lit(0)).alias("holiday")))
    if level == "prov":
        return panel
    return panel.groupBy(date, "region").agg(F.max("holiday").alias("holiday"))


def time_split(df: DataFrame, date: str, warmup: int, horizon: int) -> DataFrame:
    """Add ``split``: the first ``warmup`` days, the last ``horizon`` days (``test``), else ``train``."""
    bounds = df.agg(F.date_add(F.min(date), warmup).alias("first"), F.date_sub(F.max(date), horizon).alias("last"))
    return with_scalars(df, bounds).withColumn(
        "split", F.when(_q(date) < F.col("_s.first"), "warmup").when(_q(date) > F.col("_s.last"), "test").otherwise("train")
    ).drop("_s")
