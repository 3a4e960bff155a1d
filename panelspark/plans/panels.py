"""From landed tables to daily panels keyed by ``fecha``, ``prov`` and ``region``.

Long panels feed the linear search; the wide ones have one row per day and feed the forecast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.clean import comma_decimal, prefix_code, recode, safe_date, spanish_date, thousands_int
from panelspark.operators.aggregate import group_sum, merge_stats, mergeable_stats, multi_agg
from panelspark.operators.joins import expand_region, join_dim, outer_merge
from panelspark.operators.project import extend_last, per_100k
from panelspark.operators.reshape import complete_panel, pivot_agg
from panelspark.operators.series import cumulative_to_daily, holiday_panel, resample_daily, zero_history
from panelspark.operators.text import keyword_groups
from panelspark.plans import presets as P
from panelspark.sources.files import read_delimited
from panelspark.streaming.ledger import ingest_ledger, read_days

DIMENSION_COLUMNS = {
    "Code comunidad autónoma numérico": "region_num", "Code comunidad autónoma alpha": "region", "Comunidad Autónoma": "region_name",
    "Comunidad Autónoma mscbs": "region_mscbs", "Code provincia numérico": "prov_num", "Code provincia alpha": "prov",
    "Provincia": "prov_name", "Provincia aemet": "prov_aemet",
}


def province_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The province table; every column is text, so ``04`` and ``NA`` survive."""
    schema = ", ".join(f"`{c}` string" for c in DIMENSION_COLUMNS)
    return read_delimited(spark, path, schema, sep="\t").withColumnsRenamed(DIMENSION_COLUMNS)


def places(dim: DataFrame) -> DataFrame:
    return dim.select("prov", "region").distinct()


def census(raw: DataFrame, dim: DataFrame, end: str = P.END, since: str = P.CENSUS_SINCE) -> DataFrame:
    """Daily population by province from half-yearly counts: ``(prov, fecha, total)``."""
    rows = raw.where((F.col("Edad") == "Total") & (F.col("Sexo") == "Ambos sexos")).select(
        spanish_date("Periodo").alias("fecha"), prefix_code("Provincias").alias("prov_num"), thousands_int("Total").alias("total"))
    kept = join_dim(rows.where(F.col("fecha") >= F.lit(since)), dim.select("prov_num", "prov").distinct(), "prov_num")
    return resample_daily(extend_last(kept, "fecha", end), ["prov"], "fecha", ["total"], "linear")


def region_census(population: DataFrame, dim: DataFrame) -> DataFrame:
    return group_sum(population.join(places(dim), "prov"), ["region", "fecha"], ["total"])


def _rates(panel: DataFrame, cols: list[str], population: DataFrame | None, keys: list[str]) -> DataFrame:
    return panel if population is None else per_100k(panel.join(population, [*keys, "fecha"]), cols, "total").drop("total")


def cases_long(cases: DataFrame, dim: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Cases by province and day, with rates per 100,000 beside them when a population is given."""
    placed = join_dim(cases.where(F.col("provincia_iso").isNotNull()), places(dim), "provincia_iso", "prov")
    daily = group_sum(placed.withColumnRenamed("provincia_iso", "prov"), ["fecha", "prov", "region"], P.CASE_COLUMNS)
    return _rates(daily, P.CASE_COLUMNS, population, ["prov"])


def outcomes_long(outcomes: DataFrame, dim: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Cases, hospital, ICU and deaths by province and day over all ages and sexes.

    The population is joined after the sum, so it is counted once per province.
    """
    placed = join_dim(outcomes.where(F.col("provincia_iso").isNotNull()), places(dim), "provincia_iso", "prov")
    daily = group_sum(placed.withColumnRenamed("provincia_iso", "prov"), ["fecha", "prov", "region"], P.OUTCOME_COLUMNS)
    return _rates(daily, P.OUTCOME_COLUMNS, population, ["prov"])


def regions_of(dim: DataFrame) -> list[str]:
    """Region codes in order: the value list of the pivots. The dimension has one row per province."""
    return [r[0] for r in dim.select("region").distinct().orderBy("region").collect()]


def cases_wide(cases: DataFrame, dim: DataFrame, regions: list[str]) -> DataFrame:
    placed = join_dim(cases, places(dim), "provincia_iso", "prov")
    wide = pivot_agg(placed, ["fecha"], "region", regions, P.CASE_COLUMNS)
    return resample_daily(wide, [], "fecha", [c for c in wide.columns if c != "fecha"], "zero")


def outcomes_wide(outcomes: DataFrame, dim: DataFrame, regions: list[str], bands: list[str]) -> DataFrame:
    placed = join_dim(outcomes, places(dim), "provincia_iso", "prov").withColumn("banda", recode("grupo_edad", P.AGE_BANDS))
    wide = pivot_agg(placed, ["fecha"], ["region", "banda"], [(r, b) for r in regions for b in bands], P.OUTCOME_COLUMNS)
    return resample_daily(wide, [], "fecha", [c for c in wide.columns if c != "fecha"], "zero")


def target_series(outcomes: DataFrame, province: str = P.TARGET_PROVINCE, measure: str = "num_def") -> DataFrame:
    """One daily series of one province, missing days 0."""
    return resample_daily(group_sum(outcomes.where(F.col("provincia_iso") == province), ["fecha"], [measure]), [], "fecha", [measure], "zero")


def weather_stats(readings: DataFrame, stations: DataFrame, dim: DataFrame) -> DataFrame:
    """Readings with decimal commas to statistics by province and day; a bad cell is NULL, its row stays."""
    rows = readings.select(safe_date("fecha").alias("fecha"), "indicativo", *[comma_decimal(c).alias(c) for c in P.WEATHER_STATS])
    by_station = join_dim(stations.select("indicativo", "provincia"), dim.select("prov_aemet", "prov").distinct(), "provincia", "prov_aemet")
    return multi_agg(rows.join(by_station.select("indicativo", "prov"), "indicativo"), ["fecha", "prov"], P.WEATHER_STATS)


def weather_long(readings: DataFrame, stations: DataFrame, dim: DataFrame) -> DataFrame:
    stats = weather_stats(readings, stations, dim)
    values = [c for c in stats.columns if c not in ("fecha", "prov")]
    return complete_panel(stats, ["prov"], "fecha", values, "linear").join(places(dim), "prov")


def weather_wide(readings: DataFrame, stations: DataFrame, dim: DataFrame, regions: list[str]) -> DataFrame:
    """Mean over provinces of their mean temperature, one column per region."""
    stats = weather_stats(readings, stations, dim).select("fecha", "prov", F.col("tmed__mean").alias("tmed"))
    wide = pivot_agg(stats.join(places(dim), "prov"), ["fecha"], "region", regions, "tmed", "mean")
    wide = wide.select("fecha", *[F.col(f"`{r}`").alias(f"tmed__{r}") for r in regions])
    return resample_daily(wide, [], "fecha", [c for c in wide.columns if c != "fecha"], "linear")


def trends_regions(interest: DataFrame, words: list[str]) -> DataFrame:
    """Weekly search interest to daily, one column per word: ``(region, fecha, words...)``."""
    wide = pivot_agg(interest.withColumnsRenamed({"date": "fecha", "ca": "region"}), ["region", "fecha"], "variable", words, "value", fill=None, drop_unlisted=True)
    return resample_daily(wide, ["region"], "fecha", words, "linear")


def trends_long(interest: DataFrame, dim: DataFrame, words: list[str]) -> DataFrame:
    return expand_region(trends_regions(interest, words), places(dim), "region")


def trends_wide(interest: DataFrame, regions: list[str], words: list[str]) -> DataFrame:
    return pivot_agg(trends_regions(interest, words), ["fecha"], "region", regions, words, fill=None)


def trends_themes(interest: DataFrame, dim: DataFrame) -> DataFrame:
    named = interest.withColumnsRenamed({"date": "fecha", "ca": "region"})
    return expand_region(keyword_groups(named, P.KEYWORD_THEMES, ["region"]), places(dim), "region")


FLOWS = ["viajes", "viajes_km"]


def mobility_aggregate(rows: DataFrame) -> DataFrame:
    """Reduce one day of trips between municipalities to mergeable state by provinces; the step of the file stream."""
    named = rows.select("fecha", prefix_code("origen").alias("origen_num"), prefix_code("destino").alias("destino_num"), "viajes", "viajes_km")
    return mergeable_stats(named, ["fecha", "origen_num", "destino_num"], FLOWS)


def ingest_mobility(spark: SparkSession, in_dir: str, base_dir: str, checkpoint_dir: str, schema: str, max_files: int = 1000, unit: str = r"^(.*)$") -> DataFrame:
    """Take in the trip files that arrived, in bounded batches, and give the rows of ``mobility_aggregate`` for all days so far."""
    named = lambda rows: rows.select("fecha", prefix_code("origen").alias("origen_num"), prefix_code("destino").alias("destino_num"), *FLOWS, "_delivery", "_sent")
    ingest_ledger(spark, in_dir, base_dir, checkpoint_dir, schema, ["origen_num", "destino_num"], FLOWS, named, unit=unit, max_files=max_files)
    return read_days(spark, base_dir)


def mobility_placed(daily: DataFrame, dim: DataFrame) -> DataFrame:
    codes = dim.select("prov_num", "prov", "region").distinct()
    origin = join_dim(daily, codes.select(F.col("prov_num").alias("_o"), F.col("region").alias("origen_region")), "origen_num", "_o")
    return join_dim(origin, codes.select(F.col("prov_num").alias("_d"), "prov"), "destino_num", "_d")


def mobility_long(daily: DataFrame, dim: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Statistics of all trips into a province, as over the rows before they were reduced; rates if a population by province is given."""
    values = [f"{c}__{s}" for c in FLOWS for s in P.FLOW_STATS]
    into = merge_stats(mobility_placed(daily, dim), ["fecha", "prov"], FLOWS)
    panel = complete_panel(into, ["prov"], "fecha", values, "linear").join(places(dim), "prov")
    return _rates(panel, values, population, ["prov"])


def mobility_wide(daily: DataFrame, dim: DataFrame, regions: list[str], province: str = P.TARGET_PROVINCE, census: DataFrame | None = None) -> DataFrame:
    """Trips into one province by region of origin; per 100,000 inhabitants of that region if a census by region is given."""
    into, value = mobility_placed(daily, dim).where(F.col("prov") == province), "viajes__sum"
    if census is not None:
        by_origin = group_sum(into.withColumnRenamed("origen_region", "region"), ["fecha", "region"], [value])
        into, value = _rates(by_origin, [value], census, ["region"]).withColumnRenamed("region", "origen_region"), f"ratio_population__{value}"
    return resample_daily(pivot_agg(into, ["fecha"], "origen_region", regions, value), [], "fecha", regions, "linear")


def vaccination_regions(doses: DataFrame, dim: DataFrame, start: str = P.START, census: DataFrame | None = None) -> DataFrame:
    """Running total and daily doses by region, zero before the campaign: ``(region, fecha, cumulative, daily)``,
    and both per 100,000 inhabitants if a census by region is given.

    ``doses`` holds ``(label, fecha, dosis)`` with running totals.
    """
    labels = dim.where(F.col("region_mscbs") != "").select("region_mscbs", "region").distinct()
    named = join_dim(doses.withColumn("label", recode("label", P.REGION_FIXES)), labels, "label", "region_mscbs")
    total = group_sum(named, ["region", "fecha"], ["dosis"]).withColumnRenamed("dosis", "cumulative")
    filled = zero_history(complete_panel(total, ["region"], "fecha", ["cumulative"], "linear"), ["region"], "fecha", ["cumulative"], start)
    both = outer_merge(filled, cumulative_to_daily(filled, ["region"], "fecha", "cumulative"), ["region", "fecha"])
    return _rates(both, ["cumulative", "daily"], census, ["region"])


def vaccination_long(doses: DataFrame, dim: DataFrame, start: str = P.START, census: DataFrame | None = None) -> DataFrame:
    return expand_region(vaccination_regions(doses, dim, start, census), places(dim), "region")


def vaccination_wide(doses: DataFrame, dim: DataFrame, regions: list[str], start: str = P.START) -> DataFrame:
    return pivot_agg(vaccination_regions(doses, dim, start), ["fecha"], "region", regions, ["cumulative", "daily"], "max", None)


def holidays_long(holidays: DataFrame, dim: DataFrame, start: str = P.START, end: str = P.END) -> DataFrame:
    return holiday_panel(holidays, places(dim), start, end)


def holidays_wide(holidays: DataFrame, dim: DataFrame, regions: list[str], start: str = P.START, end: str = P.END) -> DataFrame:
    flags = holiday_panel(holidays, places(dim), start, end, "region")
    wide = pivot_agg(flags, ["fecha"], "region", regions, "holiday", "max")
    return wide.select("fecha", *[F.col(f"`{r}`").alias(f"Holiday__{r}") for r in regions])
