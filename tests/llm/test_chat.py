"""Preference formatting against a plain loop, and the query against its SQL."""

from panelspark.llm import chat, queries

SCHEMA = "pair_id long, turn int, role string, text string, prompt string"


def plain(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def side(turns):
        out, spans = "", []
        for role, text in turns:
            out += f"<|{role}|>\n"
            begin = len(out)
            out += f"{text}<|end|>\n"
            if role == "assistant":
                spans.append(f"{begin}:{len(out)}")
        return out, ",".join(spans)

    return (n, side(a[:n])[0], *side(a[n:]), *side(b[n:]))


def test_pairs(spark):
    long = "é🙂 " * 40000
    sides = {
        1: ([("user", "hi"), ("assistant", "one")], [("user", "hi"), ("assistant", "two")]),
        2: ([("user", "hi"), ("assistant", "x")], [("user", "hi"), ("assistant", "x")]),
        3: ([("user", "hi")], [("user", "hi"), ("assistant", "x"), ("user", "y"), ("assistant", "")]),
        4: ([("system", "s"), ("user", long), ("assistant", long)], [("system", "s"), ("user", long), ("assistant", "no")]),
        5: ([("user", "a")], [("user", "b")]), 6: ([("", "")], [("assistant", "")]),
    }
    rows = lambda k: [(i, t, role or None, text or None, "clash") for i, s in sides.items() for t, (role, text) in enumerate(s[k])]
    chosen = spark.createDataFrame(rows(0) + [(7, 0, "user", "alone", ""), (None, 0, "user", "x", "")], SCHEMA)
    rejected = spark.createDataFrame(rows(1) + [(None, 0, "user", "x", "")], SCHEMA)
    got = {r.pair_id: tuple(r[1:]) for r in chat.format_pairs(chosen, rejected).collect()}
    assert got == {i: plain(a, b) for i, (a, b) in sides.items()}
    assert chat.format_pairs(chosen.limit(0), rejected).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = c.execute(queries.SQL["op9_preferences"])
    names = [d[0] for d in want.description]
    rows = sorted(want.fetchall())
    assert rows and sorted(map(tuple, queries.op9_preferences(spark, folder).select(*names).collect())) == rows
