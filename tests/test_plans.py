from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import models as M
from panelspark.plans import linear_search, panels, presets, series_report, wide_forecast

# Two regions with three provinces; Navarra's code is the text NA.
DIM = [("13", "MD", "Madrid", "Madrid", "28", "M", "Madrid", "MADRID"), ("15", "NC", "Navarra", "Navarra", "31", "NA", "Navarra", "NAVARRA"),
       ("01", "AN", "Andalucía", "Andalucía", "04", "AL", "Almería", "ALMERIA"), ("01", "AN", "Andalucía", "Andalucía", "11", "CA", "Cádiz", "CADIZ")]
DAYS = 90
DAY0 = date(2020, 3, 1)


def day(i):
    return DAY0 + timedelta(days=i)


@pytest.fixture(scope="module")
def dim(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dim") / "dim.csv"
    path.write_text("\n".join("\t".join(r) for r in [tuple(panels.DIMENSION_COLUMNS), *DIM]) + "\n")
    return panels.province_dimension(spark, str(path))


@pytest.fixture(scope="module")
def landed(spark):
    rng = np.random.default_rng(6)
    provs = [d[5] for d in DIM]
    cases = [(day(i), p, *map(int, rng.poisson(20, 6))) for i in range(DAYS) for p in provs]
    outcomes = [(day(i), p, age, *map(int, rng.poisson(5, 4))) for i in range(DAYS) for p in provs for age in ("0-9", "30-39", "80+")]
    outcomes.append((day(0), None, "80+", 9, 9, 9, 9))
    weather = [(str(day(i)), f"s{p}", f"{10 + rng.normal():.1f}".replace(".", ","), "Ip" if i % 9 == 0 else "1,5", "2,0", "20,0") for i in range(0, DAYS, 2) for p in provs]
    interest = [(day(i), d, w, float(rng.integers(0, 100))) for i in range(0, DAYS + 7, 7) for d in ("MD", "NC", "AN") for w in ("fiebre", "tos", "vacuna")]
    doses = [(name, day(40 + i), float(100 * i * i + 50)) for name in ("Madrid", "Navarra", "Andalucía") for i in range(0, 50, 3)]
    trips = [(day(i), f"{o}001", f"{e}002", float(rng.integers(1, 50)), float(rng.integers(1, 500))) for i in range(DAYS) for o in ("28", "31", "04", "11") for e in ("28", "31", "04", "11")]
    return {
        "cases": spark.createDataFrame(cases, "fecha date, provincia_iso string, " + ", ".join(f"{c} bigint" for c in presets.CASE_COLUMNS)),
        "outcomes": spark.createDataFrame(outcomes, "fecha date, provincia_iso string, grupo_edad string, " + ", ".join(f"{c} bigint" for c in presets.OUTCOME_COLUMNS)),
        "readings": spark.createDataFrame(weather, "fecha string, indicativo string, tmed string, prec string, tmin string, tmax string"),
        "stations": spark.createDataFrame([(f"s{d[5]}", d[7]) for d in DIM], "indicativo string, provincia string"),
        "interest": spark.createDataFrame(interest, "date date, ca string, variable string, value double"),
        "doses": spark.createDataFrame(doses, "label string, fecha date, dosis double"),
        "trips": spark.createDataFrame(trips, "fecha date, origen string, destino string, viajes double, viajes_km double"),
        "holidays": spark.createDataFrame([(d[5], day(i)) for d in DIM for i in (10, 33)], "prov string, fecha date"),
        "raw": spark.createDataFrame([(t, f"{d[4]} {d[6]}", "Total", "Ambos sexos", n) for d in DIM
                                      for t, n in (("1 de enero de 2020", "1.000.000"), ("1 de julio de 2020", "1.000.182"), ("1 de julio de 2019", "5"))]
                                     + [("1 de enero de 2020", "28 Madrid", "0 años", "Ambos sexos", "9")], "Periodo string, Provincias string, Edad string, Sexo string, Total string"),
    }


def test_census_is_daily_and_stretched(landed, dim):
    pop = panels.census(landed["raw"], dim, "2020-12-31")
    got = {r["fecha"]: r["total"] for r in pop.where("prov = 'NA'").collect()}
    assert len(got) == 366 and got[date(2020, 1, 1)] == 1_000_000 and got[date(2020, 12, 31)] == 1_000_182
    assert {r["region"] for r in panels.region_census(pop, dim).collect()} == {"MD", "NC", "AN"}


def test_long_panels(landed, dim):
    pop = panels.census(landed["raw"], dim, "2020-12-31")
    out = panels.outcomes_long(landed["outcomes"], dim, pop)
    one = out.where((F.col("prov") == "NA") & (F.col("fecha") == F.lit(day(3)))).first()
    assert out.count() == DAYS * 4
    assert one["ratio_population__num_def"] == pytest.approx(one["num_def"] / pop.where((F.col("prov") == "NA") & (F.col("fecha") == F.lit(day(3)))).first()["total"] * 1e5)
    w = panels.weather_long(landed["readings"], landed["stations"], dim)
    assert w.count() == (DAYS - 1) * 4 and w.where("tmed__mean is null or prec__mean is null").count() == 0
    v = panels.vaccination_regions(landed["doses"], dim, "2020-03-01").where("region = 'MD'").orderBy("fecha").collect()
    assert v[0]["fecha"] == day(0) and v[0]["daily"] == 0 and v[-1]["cumulative"] == sum(r["daily"] for r in v)
    t = panels.trends_themes(landed["interest"], dim)
    assert t.columns == ["region", "fecha", "behavior", "symptom", "policy", "prov"] and t.count() == 92 * 4


def test_wide_panels(landed, dim):
    regions = panels.regions_of(dim)
    assert regions == ["AN", "MD", "NC"]
    wide = panels.outcomes_wide(landed["outcomes"], dim, regions, ["0-59", "80+"])
    direct = landed["outcomes"].where("provincia_iso in ('AL', 'CA') and grupo_edad != '80+'").agg(F.sum("num_def")).first()[0]
    assert wide.agg(F.sum("num_def__AN__0-59")).first()[0] == direct and wide.count() == DAYS
    daily = panels.mobility_aggregate(landed["trips"])
    into = panels.mobility_wide(daily, dim, regions)
    assert into.agg(F.sum("AN")).first()[0] == landed["trips"].where("destino like '28%' and (origen like '04%' or origen like '11%')").agg(F.sum("viajes")).first()[0]
    assert panels.holidays_wide(landed["holidays"], dim, regions, str(day(0)), str(day(DAYS - 1))).agg(F.sum("Holiday__NC")).first()[0] == 2


@pytest.fixture(scope="module")
def sources(landed, dim):
    words = ["fiebre", "tos", "vacuna"]
    return {
        "casos_uci": panels.outcomes_long(landed["outcomes"], dim), "casos": panels.cases_long(landed["cases"], dim),
        "aemet": panels.weather_long(landed["readings"], landed["stations"], dim).select("fecha", "prov", "region", "tmed__mean"),
        "googletrends": panels.trends_long(landed["interest"], dim, words), "mitma": panels.mobility_long(panels.mobility_aggregate(landed["trips"]), dim).select("fecha", "prov", "region", "viajes__sum"),
        "mscbs": panels.vaccination_long(landed["doses"], dim, str(day(0))), "holidays": panels.holidays_long(landed["holidays"], dim, str(day(0)), str(day(DAYS - 1))),
    }


def test_linear_search_over_real_shapes(sources):
    design = linear_search.build_design(sources, presets.SearchPreset("num_def", -7, (1, 7), (0, 7), (1,)))
    assert list(design.groups) == presets.SOURCES and design.rows.count() == DAYS
    row = design.rows.where(F.col("fecha") == F.lit(day(20))).first()
    real = sources["casos_uci"].where(F.col("fecha") == F.lit(day(27))).agg(F.sum("num_def")).first()[0]
    assert row[design.y] == pytest.approx(real / presets.NATIONAL_POPULATION * 1e5)
    found = linear_search.search_sources(design, "per_subset").collect()
    assert len(found) == 127 and {r["status"] for r in found} <= {"ok", "no term left"}
    few = linear_search.search_columns(design, design.groups["casos_uci"][:3]).collect()
    assert len(few) == 7 and all(r["n_features"] == r["length"] + 1 for r in few)


def test_wide_forecast_over_real_shapes(landed, dim):
    regions = panels.regions_of(dim)
    wide = {"uci": panels.outcomes_wide(landed["outcomes"], dim, regions, ["0-59", "80+"]).select("fecha", "num_def__AN__80+"),
            "aemet": panels.weather_wide(landed["readings"], landed["stations"], dim, regions), "mitma": panels.mobility_wide(panels.mobility_aggregate(landed["trips"]), dim, regions)}
    design = wide_forecast.build_design(panels.target_series(landed["outcomes"]), wide)
    counts = {r["split"]: r["count"] for r in design.groupBy("split").count().collect()}
    assert counts == {"warmup": 21, "test": 7, "train": DAYS - 1 - 28}
    features = wide_forecast.features_of(design)
    assert design.dropna().count() == DAYS - 1
    train = wide_forecast.train_rows(design)
    forest = M.forest(train, wide_forecast.TARGET, features, trees=5, depth=6)
    scores = {r["split"]: r for r in wide_forecast.scores(forest, design).collect()}
    assert scores["test"]["n"] == 7 and scores["train"]["r2"] > 0.5
    report = wide_forecast.residual_report(wide_forecast.residual_series(forest, design), 5, 3)
    assert report["acf"].count() == 6 and report["ar"].count() == 4 and report["adf"].count() == 1 and report["mean"].first()["n"] == counts["train"]
    pca = M.pca_forest(train, wide_forecast.TARGET, features, trees=3, depth=4)
    assert wide_forecast.scores(pca, design).count() == 2
    boosted = M.boosting(train, wide_forecast.TARGET, features, rounds=3, depth=M.DEPTH_LIMIT)
    with pytest.raises(ValueError):
        M.boosting(train, wide_forecast.TARGET, features, rounds=3, depth=1000)
    assert boosted.stages[-1].getMaxDepth() == 30


def test_elimination_keeps_the_informative_column(spark):
    rng = np.random.default_rng(1)
    rows = [(day(i), float(x), *map(float, rng.normal(size=3)), float(10 * x)) for i, x in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame(rows, "fecha date, good double, n1 double, n2 double, n3 double, y double")
    folds = [(day(68), day(69), day(75)), (day(75), day(76), day(82))]
    table, kept = M.rfe_time(df, "fecha", "y", ["good", "n1", "n2", "n3"], folds, step=1, trees=5, depth=5)
    assert [r["n_features"] for r in table.orderBy("n_features").collect()] == [1, 2, 3, 4] and "good" in kept


def test_series_report(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(100 + np.cumsum(rng.normal(size=80)))], "fecha date, v double")
    tests = {k: v.first() for k, v in series_report.stationarity(df, [], "v").items()}
    assert set(tests) == {"v", "first_diff", "seasonal_diff", "seasonal_first_diff"} and tests["first_diff"]["p_value"] < 0.01
    ahead = series_report.holdout_forecast(df, "v", 3, 1, 7).orderBy("fecha").collect()
    assert [r["step"] for r in ahead] == list(range(1, 8)) and ahead[0]["fecha"] == day(73)
    assert series_report.backtest(df, [], "v", 3, 1, 7).count() == 7
    assert series_report.correlation(df, [], "v", 5)["pacf"].count() == 6
    shape = series_report.distribution(df, "v", 10)
    assert shape["histogram"].agg(F.sum("n")).first()[0] == 80 and shape["profile"].first()["distinct"] == 80
    assert series_report.components(df, [], "v").count() == 80
