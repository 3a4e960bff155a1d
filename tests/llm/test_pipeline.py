"""The whole pipeline against the brute-force versions of its stages, in turn."""

import importlib.util
import struct
from pathlib import Path

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from panelspark.llm import hostrules

HERE = Path(__file__).parent


def load(name):
    spec = importlib.util.spec_from_file_location(name, HERE / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def brute(docs, items):
    lines, hashes, phrases = load("test_linededup"), load("test_simhash"), load("test_decontam")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d, t, s) for d, t, s in docs])
    kept = {r[0] for r in c.execute(f"SELECT doc_id FROM ({hostrules.SQL}) WHERE kept").fetchall()}
    rows = [(d, t) for d, t, _ in docs if d in kept]
    rows = [(d, t) for d, n, k, _, t in lines.brute(rows) if n == 0 or k < n]
    rows.sort()
    fps = [hashes.plain_fingerprint(t) for _, t in rows]
    rows = [r for i, (r, c) in enumerate(zip(rows, hashes.brute_components(fps, 4))) if i == c]
    clean = {d for d, _, hit, *_ in phrases.brute(rows, items, 10) if not hit}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, text in rows:
        if d in clean:
            e = t.encode(text, add_special_tokens=False).ids
            out.append((d, len(e), struct.pack(f"<{len(e)}I", *e), t.decode(e, skip_special_tokens=False)))
    return out


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(brute(docs, items))
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and 0 < len(got) < len(docs)


def test_stages_with_odd_rows(spark):
    text = "some words of a text that is long enough to stay here "
    rows = [(1, text + "one", "en", None, 3, 7), (2, None, None, "a", None, 7), (None, text + "none of them known", "en", "a", 1, 7), (3, "", "en", "a", 0, 7),
            (4, " ".join(f"w{i}" for i in range(30000)), "en", "a", 9, 7), (1, text + "one", "en", None, 3, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")
    folder = "/root/testdata/sf0.001"
    for frame in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            frame = step(spark, frame, folder)
            assert frame.columns == list(corpus_pipeline.COLUMNS), name
            frame.collect()
        ids = sorted(str(r.doc_id) for r in corpus_pipeline.tokenize(spark, frame, folder).collect())
        assert ids in ([], ["1", "1", "4", "None"])


def test_rows_without_id_are_decided_one_by_one(spark):
    folder = "/root/testdata/sf0.001"
    leak = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect() if len((r.text or "").split()) > 12)
    plain = " ".join(f"word{i}" for i in range(60))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda step, rows: sorted((r.doc_id or 0, r.text) for r in step(spark, frame(rows), folder).collect())
    assert texts(corpus_pipeline.decontaminate, [(None, plain), (None, leak), (5, plain), (5, leak)]) == [(0, plain), (5, plain)]
    assert texts(corpus_pipeline.quality, [(None, plain), (None, "few"), (5, plain), (5, "few"), (6, plain), (7, plain)]) == [(0, plain), (5, plain), (6, plain), (7, plain)]
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(None, plain)] * 3 + [(3, other), (4, other), (3, other), (None, other)]
    assert texts(corpus_pipeline.near_dedup, rows) == [(0, plain), (3, other), (3, other)]
