"""BPE against the tokenizers library, on whole texts and odd strings."""

import hashlib
import struct
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import bpe, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \n", "Σας ΟΔΟΣ İstanbul ß ẞ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "it's we'll I'D don't 'S", "x\x1cy\x1dz\x85w v",
       "é é ½ ² ٣ 一二三 🙂🏽", "<|ENDOFTEXT|> <|endoftext|", "ab" * 4000, "Ab1234 ..!!?? __"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding(), t.no_truncation()
    return t


def ids(text):
    packed = bpe.encode_text(PATH, text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.decode_ids(PATH, bpe.encode_text(PATH, text)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="latin-1"), max_size=60))
def test_any_latin_text(text):
    from tokenizers import Tokenizer

    assert ids(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_every_code_point(library):
    """Alone between letters, before and after marks of several classes, in both orders."""
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(codes), 20_000):
        texts = [f"a{c}b {c}\u0301 x{c}\u0316 1{c}" for c in codes[lo:lo + 20_000]]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert bpe.encode_text(PATH, text) == struct.pack(f"<{len(want.ids)}I", *want.ids), ascii(text)


def test_marks_of_every_class(library):
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    one_of = {unicodedata.combining(m): m for m in marks}
    texts = [f"a{m}{o} e{o}{m}{m}" for m in marks for o in one_of.values()]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode_text(PATH, text) == struct.pack(f"<{len(want.ids)}I", *want.ids), ascii(text)


def test_table(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate([*ODD, None, ODD[2]])] + [(None, "no id", None, None), (0, "again", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.round_trip(docs, PATH).collect()))
    want = []
    for i, t, *_ in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(e), struct.pack(f"<{len(e)}I", *e), library.decode(e, skip_special_tokens=False)))
    assert got == sorted(want)
    two = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(r.decoded for r in two.collect()) == sorted(w[3] for w in want)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op2_bpe(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        e = library.encode(r.text or "", add_special_tokens=False).ids
        row = got.pop(r.doc_id)
        assert (row.n_tokens, row.ids_sha256) == (len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert not got
