"""The kernel against its definition, gap tolerance, odd rows, and accuracy on held-out documents."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from panelspark.llm import queries, toxicity


def plain_map(word):
    marked, out = "{" + word + "}", {}
    for at in combinations(range(len(marked)), toxicity.ORDER):
        span = at[-1] - at[0] + 1
        if span <= toxicity.SPAN:
            out.setdefault("".join(marked[i] for i in at), []).append(toxicity.DECAY ** span)
    return out


def test_kernel_is_the_subsequence_kernel():
    words, marks = ["idiot", "idxiot", "cat", "a", "lo", "looooser"], ["idiot", "loser", "cat"]
    norm = lambda m: np.sqrt(sum(w * w for v in m.values() for w in v)) + 1e-9
    want = [[sum(sum(v) * sum(b[u]) for u, v in a.items() if u in b) / norm(a) / norm(b) for b in map(plain_map, marks)] for a in map(plain_map, words)]
    assert np.allclose(toxicity.kernel(words, marks), want, atol=1e-5)
    assert toxicity.kernel(["idxiot"], ["idiot"])[0, 0] > 0.3 > toxicity.kernel(["table"], ["idiot"])[0, 0]


def test_units():
    assert toxicity.units(toxicity.fold("Ärger, you i d i o t! x")) == ["arger", "you", "i", "d", "i", "o", "t", "x", "idiotx"]
    assert toxicity.units(toxicity.fold("an i-d*iot")) == ["an", "idiot"] and toxicity.units("") == []


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeioulmnrstdh"), rng.integers(2, 8))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(vocabulary, 30))
    clean = [text() for _ in range(150)]
    return toxicity.fit([f"{text()}. you {rng.choice(['blockhead', 'numpty', 'wazzock'])} {text()}." for _ in range(150)], clean), text


def test_machine(machine):
    m, text = machine
    score = toxicity.Scorer(m)
    bad = ["%s numpty %s", "%s nu*mp-ty %s", "%s n u m p t y %s", "%s blockhxead %s"]
    assert min(score([b % (text(), text()) for b in bad])) > 0.7
    assert np.mean(np.array(score([text() for _ in range(50)])) >= 0.7) < 0.05


def test_odd_rows(spark):
    rows = [(i, "the day is good and long " + ("you wazzock " if i % 2 else "") + f"w{i}", i % 2) for i in range(120)]
    rows += [(200, None, 1), (201, "", 0), (202, "?? 12", None), (203, "wazzock " * 30000, 1), (None, "the day", 0), (0, "the day", 0)]
    docs = spark.createDataFrame([(a, b, 0.5) for a, b, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(a, c, 1) for a, _, c in rows], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert by[203] > 0.7 and by[101] > 0.7 > 0.5 > max(by[100], by[200], by[201], by[202]) and by[200] == by[201]
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op4_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.75  # some 200 toxic documents to learn from, a third of them by forms seen once or twice
    assert sum(p for p, t in held if not t) / sum(1 - t for _, t in held) < 0.05


def test_rows_of_one_id_count_once(spark):
    """Twenty thousand rows of one labelled id change nothing in what is learned."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    first = docs.join(labels.where("toxic = 1"), "doc_id").where("crc32(CAST(doc_id AS STRING)) % 3 <> 1").orderBy("doc_id").select("doc_id", "text").first()
    many = docs.select("doc_id", "text").union(spark.range(20_000).selectExpr(f"{first.doc_id}L").crossJoin(spark.createDataFrame([(first.text,)], "text string")))
    once, again = toxicity.train(docs, labels), toxicity.train(many, labels)
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(50).collect()]
    assert (once is None) == (again is None)
    if once:
        assert toxicity.Scorer(once)(texts) == toxicity.Scorer(again)(texts)
