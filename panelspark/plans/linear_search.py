"""The regression search: lag every source, collapse it, join by day, search all subsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.clean import rate_per_100k
from panelspark.operators.aggregate import collapse
from panelspark.operators.joins import assemble
from panelspark.operators.models import hash_split
from panelspark.operators.project import add_prefix
from panelspark.operators.search import search_subsets
from panelspark.operators.series import lag_features
from panelspark.plans import presets as P
from panelspark.session import stage

KEYS = ["fecha", "prov", "region"]


@dataclass
class Design:
    """``rows`` has one row per day with the target ``y``, the split and all source columns."""

    rows: DataFrame
    y: str
    groups: dict[str, list[str]]


def lagged_source(panel: DataFrame, name: str, lags, how: str, national_rate: bool) -> DataFrame:
    """Lag by location, prefix, collapse to one row per day, optionally as national rate."""
    cols = [c for c in panel.columns if c not in KEYS]
    one = collapse(add_prefix(lag_features(panel, ["prov"], "fecha", cols, list(lags)), f"{name}__", KEYS), how)
    made = [c for c in one.columns if c != "fecha"]
    if not national_rate:
        return one
    return one.select("fecha", *[rate_per_100k(F.col(f"`{c}`"), P.NATIONAL_POPULATION).alias(c) for c in made])


def build_design(panels: dict[str, DataFrame], preset: P.SearchPreset = P.DEATHS) -> Design:
    """``panels`` maps source names to complete long panels with one row per day and province."""
    rates = set(P.PER_100K) if preset.per_100k else set()
    target_panel = panels["casos_uci"].select(*KEYS, preset.target)
    target = lagged_source(target_panel, "casos_uci_target", [preset.target_lag], "sum", preset.per_100k)
    lags = {name: preset.other_lags for name in P.SOURCES} | {"casos_uci": preset.outcome_lags, "casos": preset.case_lags}
    sources = {}
    for name in [n for n in P.SOURCES if n in panels]:
        panel = panels[name]
        if name == "googletrends" and preset.words:
            panel = panel.select(*KEYS, *preset.words)
        sources[name] = lagged_source(panel, name, lags[name], P.COLLAPSE[name], name in rates)
    y = f"casos_uci_target__{preset.target}__lag_{preset.target_lag}"
    joined = assemble(target, sources, list(sources), how="left")
    rows = stage(hash_split(joined, "fecha", P.TEST_SHARE, P.SEED), "design")
    return Design(rows, y, {n: [c for c in s.columns if c != "fecha"] for n, s in sources.items()})


def search_sources(design: Design, sample: str = "common") -> DataFrame:
    """All subsets of sources with backward elimination."""
    return search_subsets(design.rows, design.y, design.groups, limit=P.P_LIMIT, rounds=P.ROUNDS, sample=sample)


def search_columns(design: Design, columns: list[str], sample: str = "common") -> DataFrame:
    """All subsets of the given columns, without elimination."""
    return search_subsets(design.rows, design.y, {c: [c] for c in columns}, eliminate=False, sample=sample)
