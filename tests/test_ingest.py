import gzip
import os
import time

from panelspark.operators.aggregate import multi_agg
from panelspark.streaming.ingest import ingest_daily

SCHEMA = "fecha date, origen string, destino string, viajes double"


def land(folder, name, day, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt") as f:
        f.write("fecha|origen|destino|viajes\n" + "".join(f"{day}|{o}|{d}|{v}\n" for o, d, v in rows))


def aggregate(rows):
    return multi_agg(rows, ["fecha", "origen", "destino"], {"viajes": ["sum", "count"]})


def test_incremental_runs_and_resends(spark, tmp_path):
    into = tmp_path / "in"

    def run():
        ingest_daily(spark, str(into), str(tmp_path / "out"), str(tmp_path / "progress"), SCHEMA, aggregate)
        return sorted((str(r["fecha"]), r["origen"], r["viajes__sum"]) for r in spark.read.schema(
            "origen string, destino string, viajes__sum double, viajes__count bigint, fecha date").parquet(str(tmp_path / "out")).collect())

    land(into, "20200101.txt.gz", "2020-01-01", [("01", "02", 1.5), ("01", "02", 2.0)])
    land(into, "20200102.txt.gz", "2020-01-02", [("01", "02", 4.0)])
    assert run() == [("2020-01-01", "01", 3.5), ("2020-01-02", "01", 4.0)]
    assert run() == [("2020-01-01", "01", 3.5), ("2020-01-02", "01", 4.0)]
    land(into, "20200103.txt.gz", "2020-01-03", [("02", "01", 7.0)])
    land(into, "20200101_v2.txt.gz", "2020-01-01", [("03", "02", 9.0)])
    assert run() == [("2020-01-01", "03", 9.0), ("2020-01-02", "01", 4.0), ("2020-01-03", "02", 7.0)]


def test_newest_of_two_deliveries_in_one_batch(spark, tmp_path):
    into = tmp_path / "in"
    land(into, "b_old.txt.gz", "2020-01-01", [("01", "02", 1.0)])
    land(into, "a_new.txt.gz", "2020-01-01", [("01", "02", 5.0), ("01", "02", 6.0)])
    old = time.time() - 3600
    os.utime(into / "b_old.txt.gz", (old, old))
    ingest_daily(spark, str(into), str(tmp_path / "out"), str(tmp_path / "progress"), SCHEMA, aggregate)
    assert [r["viajes__sum"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [11.0]


def test_a_delivery_may_have_many_parts(spark, tmp_path):
    into = tmp_path / "in" / "dia=1"
    land(into, "p0.txt.gz", "2020-01-01", [("01", "02", 1.0)])
    land(into, "p1.txt.gz", "2020-01-01", [("01", "02", 2.0)])
    ingest_daily(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), SCHEMA, aggregate, unit=r"^(.*)/[^/]*$")
    assert [r["viajes__sum"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3.0]
