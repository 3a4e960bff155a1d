"""Patience alignment on its own, and the operator against a brute-force version over all pairs it should compare."""

import hashlib
import random
import re

from panelspark.llm import linededup, queries

BLANKS = " \t\n\x0b\f\r"


def test_align():
    a, b = [1, 2, 3, 9, 4, 5, 6], [1, 2, 7, 3, 4, 8, 5, 6]
    assert linededup.align(a, b) == [(0, 0), (1, 1), (2, 3), (4, 4), (5, 6), (6, 7)]
    assert linededup.align([1, 1, 2], [2, 1, 1]) == [(2, 0)] and linededup.align([], [1]) == []
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.randrange(8) for _ in range(rnd.randrange(12))] for _ in range(2))
        got = linededup.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_blocks():
    assert linededup.common_blocks([1, 2, 3], [1, 2, 9, 3], [20, 20, 5, 20], 30) == [0, 1]
    assert linededup.common_blocks([1, 2, 3], [1, 2, 9, 3], [20, 20, 5, 20], 20) == [0, 1, 3]


def brute(rows, rare=10, min_chars=30):
    """rows of (id, text); ids unique."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t or "", i)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted(first, key=lambda t: (first[t] is None, first[t] or 0, md5(t)))
    split = {t: [x.strip(BLANKS) for x in t.split("\n") if x.strip(BLANKS)] for t in order}
    holders = {}
    for t in order:
        for x in dict.fromkeys(split[t]):
            holders.setdefault(x, []).append(t)
    partners = {t: set() for t in order}
    for who in holders.values():
        for k, t in enumerate(who[1:], 1):
            partners[t] |= set(who[:k]) if len(who) <= rare else {who[0]}
    gone = {t: {p for e in partners[t] for p in linededup.common_blocks(split[e], split[t], list(map(len, split[t])), min_chars)} for t in order}
    out = []
    for i, t in rows:
        t = t or ""
        full = [k for k, x in enumerate(t.split("\n")) if x.strip(BLANKS)]
        cut = set(full) if first[t] != i else {full[p] for p in gone[t]}
        kept = "" if cut and len(cut) == len(full) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        out.append((i, len(full), len(cut), first[t] != i, kept))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"line number {k} of the pool of lines" for k in range(30)] + ["short", "", "  ", "\tline number 3 of the pool of lines "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12)))) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(12)] + [(200 + i, "the license that everybody has in their files\n" + f"own text of document {i} is here") for i in range(15)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, "the license that everybody has in their files"), (303, "x" * 100000 + "\n" + "y\n" * 5000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, first int")
    got = linededup.deduplicate(docs, whole=False).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    twice = linededup.deduplicate(docs.union(docs), whole=False).collect()  # repeated rows are one document
    assert sorted(map(tuple, twice), key=key)[::2] == sorted(map(tuple, got), key=key)
    assert linededup.deduplicate(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = sorted((i, n, k, c, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, c, t in brute(rows))
    got = sorted(map(tuple, queries.op3_line_dedup(spark, folder).collect()))
    assert got == want and sum(r[2] for r in got) > 0


def test_all_holders_of_frequent_lines(spark):
    license, note = "the license that everybody has in their files", "the note that everybody has in their files too"
    rows = [(0, f"{license}\nfirst own line\n{note}")] + [(i, f"{note}\nown line of {i}\n{license}") for i in range(1, 30)]
    rnd = random.Random(8)
    pool = [f"line number {k} of the pool of lines" for k in range(12)] + [f"short {k}" for k in range(6)]
    rows += [(100 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12)))) for i in range(150)]
    got = linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, rare=10**9)) != sorted(brute(rows))
    assert all(r.n_removed == 2 for r in got if 2 <= r.doc_id < 30)


def test_passages_held_twice():
    assert linededup.common_blocks([1, 8, 9, 2, 8, 9, 3], [4, 8, 9, 5], [20] * 4, 30) == [1, 2]
    assert linededup.common_blocks([1, 8, 9, 3], [4, 8, 9, 5, 8, 9, 6], [20] * 7, 30) == [1, 2, 4, 5]
