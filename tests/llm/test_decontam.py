"""The positional index against brute force, and the query against its SQL."""

import random
import re

import pytest

from panelspark.llm import decontam, queries


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, width):
    wins = []
    for i, t in items:
        w = split(t)
        wins += [(str(i), w[k:k + width]) for k in range(max(len(w) - width, 0) + 1)] if w else []
    out = []
    for d, t in docs:
        w, hit, named = split(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    named.add(i)
        out.append((d, len(w), len(hit), len(named), sorted(named)))
    return out


@pytest.mark.parametrize("width", [3, 10])
def test_against_brute_force(spark, width):
    rnd = random.Random(width)
    vocabulary = ["a", "b", "c", "É", "é", "ñ1", "The"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 8)))) for i in range(12)] + [(50, None), (51, "?!"), (3, "a b c"), (10, "b c a é")]
    docs = [(i, ", ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40)))) for i in range(25)] + [(None, "a b c"), (7, None), (7, ""), (8, "a " * 3000), (30, "a B C a-b_c")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, term string")
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"), width).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in got), key=key) == sorted(brute(docs, items, width), key=key)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert sum(r.n_hit for r in decontam.contamination(df, empty, width).collect()) == 0
    assert decontam.contamination(df.limit(0), spark.createDataFrame(items, "item_id long, text string"), width).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "one big two three"), (3, "two one three"), (4, "one two"), (5, "one a b c two three")], "doc_id long, text string")
    test, _ = decontam.windows(spark.createDataFrame([(9, "one two three")], "item_id long, text string"))
    index = decontam.build_index(docs, test)
    ids = index.select("row", "id").distinct()
    near = decontam.phrase_matches(index, test, slack=1).join(ids, "row")
    assert sorted({r.id for r in near.collect()}) == [1, 2, 3]
    assert [r.start for r in decontam.phrase_matches(index, test).collect()] == [1]


def test_query_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(queries.SQL["op8_decontamination"])
    names = [d[0] for d in want.description]
    rows = sorted(want.fetchall())
    assert sum(r[-1] for r in rows) > 0
    assert sorted(map(tuple, queries.op8_decontamination(spark, folder).select(*names).collect())) == rows


def test_only_starts_at_which_two_terms_meet_are_looked_up(spark, monkeypatch):
    """Starts at which the second rarest term is missing do not reach the lists of the other terms."""
    kept, write = {}, decontam.stage
    monkeypatch.setattr(decontam, "stage", lambda df, purpose: kept.setdefault(purpose, write(df, purpose)))
    texts = ["x the rare second of", "rare word", "the the of", "of rare", "solo", "the rare of second"] + ["the of"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "the rare second of"), (2, "solo"), (3, "of of of")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontam.contamination(docs, items).collect()}
    assert {d: v for d, v in got.items() if v[0]} == {0: (4, ["1"]), 4: (1, ["2"])}
    looked = kept["starts"].join(kept["postings"].select("row", "id").distinct(), "row")
    assert sorted({r.id for r in looked.collect()}) == [0, 4]
