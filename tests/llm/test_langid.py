"""Output codes: codeword properties, odd rows, and accuracy on held-out documents."""

import zlib

import numpy as np
import pytest

from panelspark.llm import langid, queries


@pytest.mark.parametrize("k", [2, 3, 4, 5, 8, 30])
def test_codewords(k):
    code = langid.codewords(k)
    assert len({tuple(r) for r in code}) == k
    assert all(len(set(c)) == 2 for c in code.T)  # every bit splits the languages
    if k <= 5:
        assert code.shape[1] == 2 ** (k - 1) - 1 and len({tuple(c) for c in code.T} | {tuple(-c) for c in code.T}) == 2 * code.shape[1]


def test_decoding_survives_one_wrong_bit():
    code = langid.codewords(4).astype(np.float32)
    model = langid.Model(list("abcd"), code, np.eye(7, dtype=np.float32), np.zeros(7, np.float32), np.ones(7, np.float32))
    for c in range(4):
        for b in range(7):
            margin = 3 * code[c].copy()
            margin[b] *= -1
            assert model.losses(margin[None])[0].argmin() == c


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog in the house " * 3, "en") for i in range(12)] + [(20 + i, "der hund und die katze im haus " * 3, "de") for i in range(12)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "12 34 ...", "en"), (53, "the dog", None), (None, "die katze und der hund", "de"), (54, "the dog " * 20000, "en"), (0, "the cat", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(docs, langid.train(docs)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (50, 51, 52, 53, 54)] == ["und", "und", "und", "en", "en"]
    assert by[50].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id is None] == ["de"]
    none = langid.identify(docs, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = docs.where("lang = 'en' AND text IS NOT NULL")
    assert {r.lang_pred for r in langid.identify(one, langid.train(one)).collect()} == {"en", "und"}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op10_language(spark, folder).collect()
    assert len(got) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.98


def test_rows_of_one_id_count_once(spark):
    """A hundred thousand rows of one id change nothing in what is learned."""
    rows = [(i, f"the cat and the dog in the house {i}", "en") for i in range(30)] + [(100 + i, f"der hund und die katze im haus {i}", "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = docs.union(spark.range(100_000).selectExpr("0L", "'the cat and the dog in the house 0'", "'en'"))
    once, again = langid.train(docs), langid.train(many)
    assert once.langs == again.langs and np.array_equal(once.weights, again.weights)
