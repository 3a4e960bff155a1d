"""Work on whole series: each is gathered once and handed to a function on arrays.

The one shuffle is on the keys. A series has at most one value a day, so that even a crowded key is a few thousand
numbers; series at full grain belong to ``halo``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.gram import spread

EPOCH = np.datetime64("1970-01-01", "D")


def _q(name: str):
    return F.col(f"`{name}`")


def gathered(df: DataFrame, keys: list[str], date: str, col: str) -> DataFrame:
    """One row per series: ``_v``, its values in order of the day, and ``_d``, the days as numbers. Missing values are left out."""
    value = _q(col).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value)).select(*map(_q, keys), F.struct(F.unix_date(_q(date)).alias("d"), value.alias("v")).alias("_x"))
    made = rows.groupBy(*map(_q, keys)).agg(F.sort_array(F.collect_list("_x")).alias("_s"))
    return made.select(*map(_q, keys), F.transform("_s", lambda x: x["v"]).alias("_v"), F.transform("_s", lambda x: x["d"]).alias("_d"))


def map_series(df: DataFrame, keys: list[str], date: str, col: str, one: Callable[[np.ndarray, np.ndarray], list[dict]], columns: str) -> DataFrame:
    """The rows that ``one(values, days)`` gives for each series, after its keys. ``columns`` are the names and types of the rows."""
    kinds = dict(df.dtypes)
    names = [c.split()[0].strip("`") for c in columns.split(",")]

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                found = one(np.asarray(row["_v"], float), np.asarray(row["_d"], np.int64))
                if found:
                    yield pd.DataFrame({**{k: [row[k]] * len(found) for k in keys}, **{c: [f[c] for f in found] for c in names}})

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [columns])
    rows = gathered(df, keys, date, col)
    if not keys:  # an aggregate without groups gives a row without values, too
        rows = rows.where(F.size("_v") > 0)
    return spread(rows, keys).mapInPandas(run, schema)


def day(number: int):
    """The date of a day number."""
    return (EPOCH + int(number)).astype(object)


def lagged(w: np.ndarray, p: int) -> np.ndarray:
    """Rows (lag 1, ... lag p, value) of all values that have p before them."""
    return np.column_stack([*[w[p - k:len(w) - k] for k in range(1, p + 1)], w[p:]]) if len(w) > p else np.zeros((0, p + 1))
