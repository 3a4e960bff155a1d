"""Windows over series that are too long for one task.

The rows are dealt in ranges of (keys, order), so that a series may lie in many partitions. A window that looks k rows
back gets the last k rows of the partitions before, its *halo*, as rows that are left out again at the end; a running
total gets the sums of the partitions before. The order must tell the rows of a key apart. Only the sizes of the
partitions come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelspark.operators.scalars import with_scalars
from panelspark.session import stage


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


class Ranges:
    """The rows of ``df`` in ``parts`` ranges of keys and order, staged with the number of the range as ``_part``."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        self.keys, self.order, self.columns = list(keys), list(order), df.columns
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.sort = [_q(c) for c in (*self.keys, *self.order)]
        self.rows = stage(df.repartitionByRange(parts, *self.sort).withColumn("_part", F.spark_partition_id()), "ranges")
        self.sizes = dict(sorted(self.rows.groupBy("_part").count().collect()))  # one row per range

    def window(self):
        return W.partitionBy("_part", *self.keys).orderBy(*[_q(c) for c in self.order])

    def _neighbours(self, k: int, back: bool) -> list[tuple[int, int]]:
        """(range, range that needs its outermost rows): as many ranges away as it takes to reach ``k`` rows."""
        numbers = list(self.sizes) if back else list(self.sizes)[::-1]
        out = []
        for i, here in enumerate(numbers):
            reached = 0
            for other in numbers[:i][::-1]:
                if reached >= k:
                    break
                out.append((other, here))
                reached += self.sizes[other]
        return out

    def with_halo(self, before: int = 0, after: int = 0) -> DataFrame:
        """The rows of every range, with up to ``before`` rows of the ranges before it and ``after`` of those behind it
        marked as ``_halo``."""
        out = self.rows.withColumn("_halo", F.lit(False))
        for k, back in ((before, True), (after, False)):
            pairs = self._neighbours(k, back) if k else []
            if not pairs:
                continue
            outermost = W.partitionBy("_part").orderBy(*[c.desc() if back else c.asc() for c in self.sort])
            edge = self.rows.withColumn("_r", F.row_number().over(outermost)).where(F.col("_r") <= k).drop("_r")
            to = self.rows.sparkSession.createDataFrame(pairs, "_part int, _to int")
            lent = edge.join(to, "_part").withColumn("_part", F.col("_to")).drop("_to").withColumn("_halo", F.lit(True))
            out = out.unionByName(lent)
        return out

    def apply(self, before: int, after: int, made: dict[str, Column]) -> DataFrame:
        """Columns ``made`` over ``window()``, which look at most ``before`` rows back and ``after`` ahead."""
        return self.with_halo(before, after).withColumns(made).where(~F.col("_halo")).select(*[_q(c) for c in self.columns], *[_q(n) for n in made])


def lags(ranges: Ranges, cols: list[str], steps: list[int]) -> DataFrame:
    """``col__lag_k`` for each column and step; a negative step looks ahead."""
    w = ranges.window()
    made = {f"{c}__lag_{k}": F.lag(_q(c), k).over(w) for k in steps for c in cols}
    return ranges.apply(max([0, *steps]), max([0, *[-k for k in steps]]), made)


def rolling(ranges: Ranges, col: str, size: int) -> DataFrame:
    """Rolling mean and sample deviation, NULL until ``size`` values are there."""
    w = ranges.window().rowsBetween(-(size - 1), 0)
    full = F.count(_q(col)).over(w) == size
    return ranges.apply(size - 1, 0, {f"{col}__mean_{size}": F.when(full, F.avg(_q(col)).over(w)), f"{col}__std_{size}": F.when(full, F.stddev_samp(_q(col)).over(w))})


def differences(ranges: Ranges, col: str, k: int = 1) -> DataFrame:
    """Difference to the row ``k`` steps earlier."""
    return ranges.apply(k, 0, {f"{col}__diff_{k}": _q(col) - F.lag(_q(col), k).over(ranges.window())})


def running_sum(ranges: Ranges, col: str, name: str | None = None) -> DataFrame:
    """Sum of all rows of the key up to each row: the sums of the earlier ranges, and a window within the range."""
    keys, name = ranges.keys, name or f"{col}__running"
    sums = ranges.rows.groupBy("_part", *[_q(k) for k in keys]).agg(F.sum(_q(col)).alias("_sum"))
    # A key has one row per range here.
    earlier = W.partitionBy(*[_q(k) for k in keys]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(F.col("_part").alias("_p"), *[_q(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.sum("_sum").over(earlier).alias("_carry"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & _q(k).eqNullSafe(F.col(f"_k{i}"))
    here = F.sum(_q(col)).over(ranges.window().rowsBetween(W.unboundedPreceding, 0))
    total = F.when(here.isNotNull() | F.col("_carry").isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return ranges.rows.join(carried, same).withColumn(name, total).select(*[_q(c) for c in ranges.columns], _q(name))


def acf(ranges: Ranges, col: str, steps: int = 20) -> DataFrame:
    """Autocorrelation at lag 0 to ``steps`` of each key: rows ``(keys..., lag, n, acf)``. Values must be present."""
    keys = [_q(k) for k in ranges.keys]
    means = ranges.rows.groupBy(*keys).agg(F.avg(_q(col)).alias("_mean"))
    shifted = lags(ranges, [col], list(range(1, steps + 1)))
    if keys:
        named = means.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], "_mean")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & k.eqNullSafe(F.col(f"_k{i}"))
        centred = shifted.join(named, same)
    else:
        centred = with_scalars(shifted, means, "_m").withColumn("_mean", F.col("_m._mean"))
    off = lambda c: _q(c) - F.col("_mean")
    sums = centred.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(off(col) * off(col)).alias("_s0"),
                                      *[F.sum(off(col) * off(f"{col}__lag_{k}")).alias(f"_s{k}") for k in range(1, steps + 1)])
    ratios = F.array(*[F.try_divide(F.coalesce(f"_s{k}", F.lit(0.0)), F.col("_s0")) for k in range(steps + 1)])
    return sums.select(*keys, "n", F.posexplode(ratios).alias("lag", "acf")).select(*keys, "lag", "n", "acf")
