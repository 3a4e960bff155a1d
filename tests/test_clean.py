from datetime import date

from pyspark.sql import functions as F

from panelspark.functions import clean
from panelspark.operators import project
from panelspark.sources.files import dated_paths, gap_report, read_delimited


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("x")).first()["x"]


def test_bad_cells_do_not_void_their_row(spark):
    rows = spark.createDataFrame([("12,5", "Ip"), ("-0,3", "1,0")], "tmed string, prec string")
    got = rows.select(clean.comma_decimal("tmed").alias("a"), clean.comma_decimal("prec").alias("b")).collect()
    assert [tuple(r) for r in got] == [(12.5, None), (-0.3, 1.0)]


def test_numbers_and_dates(spark):
    assert one(spark, "47.394.220", clean.thousands_int) == 47394220
    assert one(spark, "x", clean.thousands_int) is None
    assert one(spark, "1 de julio de 2020", clean.spanish_date) == date(2020, 7, 1)
    assert one(spark, "31 de febrero de 2020", clean.spanish_date) is None
    assert one(spark, "1 de brumario de 2020", clean.spanish_date) is None
    assert one(spark, "2020-02-30", clean.safe_date) is None
    for name, month in clean.SPANISH_MONTHS.items():
        assert one(spark, f"9 de {name} de 2021", clean.spanish_date) == date(2021, month, 9)


def test_codes_stay_text(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("code\tname\n04\tAlmería\n31\tNA\n\tvacío\n")
    rows = read_delimited(spark, str(tmp_path / "codes.csv"), "code string, name string", sep="\t").collect()
    assert [tuple(r) for r in rows] == [("04", "Almería"), ("31", "NA"), (None, "vacío")]


def test_recode_keeps_other_values(spark):
    assert one(spark, "0-9", lambda c: clean.recode(c, {"0-9": "0-59"})) == "0-59"
    assert one(spark, "80+", lambda c: clean.recode(c, {"0-9": "0-59"})) == "80+"
    assert clean.flat_name("tmed", "", "mean") == "tmed__mean"


def test_fill_mean_and_rates(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    assert [tuple(r) for r in project.fill_mean(df, ["a", "b"]).collect()] == [(1.0, None), (3.0, None), (2.0, None)]
    rate = project.per_100k(spark.createDataFrame([(5, 0), (5, 50)], "n int, pop int"), ["n"], "pop").collect()
    assert [r["ratio_population__n"] for r in rate] == [None, 10000.0]


def test_fill_mean_of_many_columns_stays_cheap(spark):
    cols = [f"c{i}" for i in range(120)]
    df = spark.range(3).select(*[F.when(F.col("id") > 0, F.col("id") + i).cast("double").alias(c) for i, c in enumerate(cols)])
    assert project.fill_mean(df, cols).first()["c7"] == 8.5


def test_paths_and_gaps(spark):
    assert dated_paths("/in/%Y-%m/%Y%m%d.txt", "2020-02-28", "2020-03-01") == ["/in/2020-02/20200228.txt", "/in/2020-02/20200229.txt", "/in/2020-03/20200301.txt"]
    seen = spark.createDataFrame([("a", date(2020, 1, 1)), ("a", date(2020, 1, 1)), ("b", date(2020, 1, 2))], "k string, fecha date")
    assert sorted((r["k"], r["fecha"].day) for r in gap_report(seen, "fecha", "2020-01-01", "2020-01-02", ["k"]).collect()) == [("a", 2), ("b", 1)]
