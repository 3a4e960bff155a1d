import gzip
import os
import time
from datetime import date, timedelta

import pytest

from panelspark.operators.aggregate import finish_stats
from panelspark.plans.panels import ingest_mobility
from panelspark.streaming.ledger import ingest_ledger, newest, read_days, read_ledger

SCHEMA = "fecha date, origen string, viajes double"
UNIT = r"^(.*)/[^/]*$"


def land(folder, name, rows, age=0):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt") as f:
        f.write("fecha|origen|viajes\n" + "".join(f"{d}|{o}|{v}\n" for d, o, v in rows))
    at = time.time() - age
    os.utime(folder / name, (at, at))


def deliver(into, day, number, age, factor=1.0):
    """A delivery of three parts, sent one after the other."""
    at = date(2020, 1, 1) + timedelta(days=day)
    for part in range(3):
        land(into / f"{at}-v{number}", f"p{part}.txt.gz", [(at, f"{o:02d}", factor * (day + o + part / 4)) for o in range(part, 4)], age - part)


def take_in(spark, into, base, max_files):
    ingest_ledger(spark, str(into), f"{base}/table", f"{base}/progress", SCHEMA, ["origen"], ["viajes"], unit=UNIT, max_files=max_files)
    done = finish_stats(read_days(spark, f"{base}/table"), ["fecha", "origen"], ["viajes"])
    return sorted((str(r.fecha), r.origen, *[pytest.approx(v, nan_ok=True) if v is not None else None for v in r[2:]]) for r in done.collect())


def plain(rows):
    return [(r[0], r[1], *[None if v is None else round(v.expected, 9) for v in r[2:]]) for r in rows]


def test_batches_resends_and_a_restart_give_one_run(spark, tmp_path):
    """Days are split over batches, sent again, and an old delivery comes late."""
    into = tmp_path / "in"
    for day in range(6):
        deliver(into, day, 1, 10_000 - day)
    small = take_in(spark, into, tmp_path / "small", 3)
    assert len(small) == 24
    for day in range(6, 10):
        deliver(into, day, 1, 9_000 - day)
    deliver(into, 2, 2, 500, factor=3.0)
    deliver(into, 7, 0, 50_000, factor=9.0)
    small = take_in(spark, into, tmp_path / "small", 4)
    assert plain(small) == plain(take_in(spark, into, tmp_path / "whole", 1000))
    assert {r[2].expected for r in small if r[:2] == ("2020-01-03", "00")} == {6.0}
    ledger = read_ledger(spark, f"{tmp_path}/small/table")
    held = {str(r.fecha): (r._delivery.rsplit("-", 1)[1], r._rows) for r in newest(ledger).collect()}
    assert held == {str(date(2020, 1, 1) + timedelta(days=d)): ("v2" if d == 2 else "v1", 9) for d in range(10)}
    assert ledger.select("batch").distinct().count() > 10
    assert plain(take_in(spark, into, tmp_path / "small", 4)) == plain(small)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    into, base = tmp_path / "in", tmp_path / "b"
    for day in range(3):
        deliver(into, day, 1, 100 - day)
    before = take_in(spark, into, base, 2)
    commits = sorted((base / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    # As after a driver that died between the writes of its last batch and the commit.
    for p in (base / "progress" / "commits").glob(f"*{commits[-1].name}*"):
        p.unlink()
    assert plain(take_in(spark, into, base, 2)) == plain(before)


def test_mobility_plan(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for day in (1, 2):
        with gzip.open(folder / f"d{day}.txt.gz", "wt") as f:
            f.write("fecha|origen|destino|viajes|viajes_km\n" + "".join(f"2020-01-0{day}|0{o}001|02{o}05|{o}.5|{o * 10}.0\n" for o in range(1, 4)))
    done = ingest_mobility(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "p"), "fecha date, origen string, destino string, viajes double, viajes_km double", max_files=1)
    assert sorted((str(r.fecha), r.origen_num, r.destino_num, r.viajes__sum) for r in done.collect()) == [(f"2020-01-0{d}", f"0{o}", "02", o + 0.5) for d in (1, 2) for o in (1, 2, 3)]
