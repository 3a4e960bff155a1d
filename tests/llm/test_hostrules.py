"""Host rules against a plain loop, and the query against its SQL."""

import re

from panelspark.llm import hostrules, queries

DOCS = [
    (1, "one two three", "a"), (2, None, "a"), (3, "", None), (4, " \n\t\x0b\f\r ", "a"),
    (5, "a b c d e f g h i j k l", "b"), (6, "a b c d e f a b c d e g h a b c d e", "b"),
    (7, "line one is here\nline one is here\n\n\nother line\n line one is here", "b"),
    (8, "x # * $ % & | < > y é ü", "c"), (9, "word " * 20000, "c"), (9, "word " * 20000, "c"), (None, "a b c d e f g h i j", None),
    (10, "\xa0nbsp is part of the\x85word", "d"), (11, " ".join(f"w{i}" for i in range(20001)), "d"),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    rep = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), len(lines))


def test_measures(spark):
    docs = spark.createDataFrame([(*d, "clash", 1) for d in DOCS], "doc_id long, text string, source string, n_words string, w int")
    got = sorted(tuple(r[2:]) for r in hostrules.measures(docs).collect())
    assert got == sorted(plain(t) for _, t, _ in DOCS)


def test_verdicts(spark):
    rows = [(i, "good words in a row that are all of them new here", f"h{i % 3}") for i in range(60)]
    rows += [(100 + i, "bad one", "spam") for i in range(40)] + [(200, "good words in a row that are all of them new here", "spam")]
    rows += [(300, "too short", "tiny"), (301, "good words in a row that are all of them new here", None), (302, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in hostrules.verdicts(docs).collect()}
    assert len(got) == len(rows)
    assert not got[200].base_failed and got[200].host_rejected and not got[200].kept
    assert all(got[i].kept for i in range(60)) and got[301].kept and not got[302].kept
    rate = {r._host: r.rate_few_words for r in hostrules.host_rates(hostrules.measures(docs)).collect()}
    assert 0.9 < rate["spam"] < 40 / 41 and rate["h0"] < 0.2 and 0.2 < rate["tiny"] < 1  # one failure of one is not proof
    assert hostrules.verdicts(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = c.execute(queries.SQL["op5_host_rules"])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted(tuple(r[i] for i in order) for r in want.fetchall())
    got = queries.op5_host_rules(spark, folder)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(*names).collect())) == rows
