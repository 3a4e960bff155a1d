"""Importance resampling against a plain version that sorts everything."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from panelspark.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for k, (i, text) in enumerate(docs):
        words, found = grams(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words, k])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def rows_of(frame):
    return [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in frame.collect()]


def test_features():
    for text in ("", "One two-three FOUR", "é Ü, 漢字 a1 b2", "a" * 70000, "x\x0by\x0cz\x1cw"):
        n, at = importance.features(text.encode())
        assert (n, at.tolist()) == grams(text)
    assert importance.features(None)[0] == 0


def test_odd_rows(spark):
    texts = ["", None, "one", "a b", " ".join(map(str, range(25))), "Word " * 400, "é " * 30] + [f"alpha beta {i % 7} " * 10 for i in range(300)]
    docs = [(i, t, 0, "z") for i, t in enumerate(texts)] + [(None, "alpha beta gamma " * 10, 0, ""), (9, texts[9], 1, "")] * 3
    target = spark.createDataFrame([("beta 3 alpha",), (None,), ("",)], "text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, score long, _row string")
    got = rows_of(importance.resample(frame, target))
    assert sorted(got, key=str) == sorted(brute([d[:2] for d in docs], ["beta 3 alpha", None, ""]), key=str)
    empty = importance.resample(frame.limit(0), target.limit(0))
    assert empty.count() == 0
    assert {r.rank for r in importance.resample(frame.limit(15), target).collect()} == {None}


def test_many_ties(spark):
    """One id for most rows: the cutoff lies among rows that are alike."""
    docs = [(7 if i % 3 else i, "same words in each of them " * 5) for i in range(400)] + [(None, "same words in each of them " * 5)] * 200
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(importance.resample(frame, spark.createDataFrame([("same words",)], "text string"), percent=50))
    assert sorted(got, key=str) == sorted(brute(docs, ["same words"], 50), key=str)


@pytest.mark.parametrize("margin", [0.0, 1e-6, 0.3])
def test_bracket_widens(spark, margin):
    scores = spark.range(5000).selectExpr("id * 7919 % 5000 AS score")
    low, high, over = importance.bracket(scores, "score", 250, 5000, margin=margin or 1e-12, accuracy=20)
    values = sorted((i * 7919 % 5000 for i in range(5000)), reverse=True)
    assert over == sum(v > high for v in values) and low <= values[249] <= high


def test_ranked(spark):
    frame = spark.createDataFrame([(i * 37 % 101 % 10, i) for i in range(101)], "a long, b long")
    got = {(r.a, r.b): r["rank"] for r in importance.ranked(frame, ("a", "b")).collect()}
    assert got == {k: n for n, k in enumerate(sorted(got), 1)}


def test_likeness_decides(spark):
    """Texts in the target's words are drawn before others of the same length."""
    rng = np.random.default_rng(5)
    like = ["red", "green", "blue", "teal"]
    docs = [(i, " ".join(rng.choice(like if i % 20 == 0 else ["one", "two", "three", "four"], 60))) for i in range(2000)]
    found = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(" ".join(like * 20),)], "text string"))
    assert {r.doc_id % 20 for r in found.where("rank IS NOT NULL").collect()} == {0}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(rows_of(queries.op13_importance_resampling(spark, folder)), key=str) == sorted(brute(docs, target), key=str)
