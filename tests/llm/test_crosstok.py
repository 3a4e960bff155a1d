"""Tokenizer alignment against both libraries on whole texts, without pieces, memory or shared counts."""

import hashlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import crosstok, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\ty z", "naïve 🙂🏽 한국 語 𒀀𒀀", "<|endoftext|> <s> </s> <0x41> <unk>", "a▁b c", "▁", "\x00 a\x00",
       "\x1c x \x85 y z　w\u200bv \ufeff", "e\u0301 ﬁ ½ ²", "it's we'll I'D 12 345", "語" * 300, "ab" * 3000, "word " * 50 + "x", "\r\n \r\n", "\U0001fae8 \U000e0001 \u0378 a"]


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def sides():
    return libraries()


def token_bytes(sides, text):
    """Whole text through both libraries: (id, bytes) lists, or None where the bytes are not given back."""
    a, b = sides
    chars = {c: i for i, c in enumerate(crosstok.byte_chars())}
    left = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text, num_threads=1):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (left, right) if text and b"".join(t for _, t in left) == raw and b"".join(t for _, t in right) == raw else None


def ranges(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(sides, texts):
    """Rows of the digest: every A token against every B token near it, counts over all texts."""
    links, shown = [], []
    for text in texts:
        both = token_bytes(sides, text or "")
        a, b = map(ranges, both) if both else ([], [])
        own, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                own.append((i, b[k][0]))
                k += 1
        common = {e for *_, e in a} & {e for *_, e in b}
        groups, start = [], 0
        for cut in sorted(common):
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)))
            start = cut
        links.append(own)
        shown.append((len(a), len(b), len(common), len(own), ";".join(groups) if both else None))
    count = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*s[:4], sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(s[4].encode()).hexdigest() if s[4] is not None else "")
            for s, own in zip(shown, links)]


@pytest.mark.parametrize("text", ODD)
def test_pieces_equal_whole_text(sides, text):
    assert_same(sides, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  ab1.,\n\t"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    assert_same(libraries(), text)


def assert_same(sides, text):
    [got] = crosstok.aligner(A, B).texts([text])
    both = token_bytes(sides, text)
    if both is None:
        assert got == (0, 0, 0, 0, None, b"", b"")
        return
    n_a, n_b, n_groups, n_links, _, _, sha = brute(sides, [text])[0]
    assert got[:4] == (n_a, n_b, n_groups, n_links) and hashlib.sha256(got[4].encode()).hexdigest() == sha
    assert [i for g in got[4].split(";") for i in g.split("|")[0].split(",")] == [str(i) for i, _ in both[0]]


MARKED = ["word. word, word\nword! (word) word$$$", "it's 'tis rock'n'roll don't.Don't", "a.\nB\n\n c.\n", "ü,é.ÿ!×a÷ ß\u0301.", "<s>.</s> a_b a<0x41>b|c", ".\n", "a\n", "x=1.5;y\t.z", "语.\n語,a"]


@pytest.mark.parametrize("text", MARKED)
def test_marks_and_line_breaks(sides, text):
    assert_same(sides, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBsé \n\t.,'!_<1\u0301\u0338語▁"), max_size=30))
def test_any_marked_text(text):
    assert_same(libraries(), text)


def test_words_are_learned_once():
    """A word is the same piece before a blank, a mark and a line break."""
    tool = crosstok.Aligner(A, B)
    tool.texts(["word. word, word\nword! word word$$$"])
    assert set(tool.new) == {" word", ".", ",", "\nword", "!", "$$$"}


def test_crossing_pieces_keep_to_blanks():
    """Where a piece of B crosses a letter and a mark, only blanks cut; the results are the same."""
    assert all(map(crosstok.CROSSING.search, ("a.", "é,", "_\n"))) and not any(map(crosstok.CROSSING.search, (".a", "\n", "▁a", "1.", "語.")))
    fine, coarse = crosstok.Aligner(A, B), crosstok.Aligner(A, B)
    assert fine.cut is crosstok.WORDS
    coarse.cut = crosstok.BLANKS
    assert fine.texts([*ODD, *MARKED]) == coarse.texts([*ODD, *MARKED])


def test_forgetting_changes_nothing(sides, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 97}x" for i in range(60)) for k in range(1, 30)] + ODD
    want = crosstok.Aligner(A, B).texts(texts)
    monkeypatch.setattr(crosstok, "REMEMBERED", 7)
    monkeypatch.setattr(crosstok, "CHUNK", 40)
    small = crosstok.Aligner(A, B)
    assert [r for t in texts for r in small.texts([t])] == want == small.texts(texts)
    assert len(small.new) <= 7 and len(small.old) <= 7


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot", [0, 5, crosstok.HOT_PAIRS])
def test_table(spark, sides, hot):
    texts = [*ODD, None, ODD[9], "the cat the dog", "the cat", "the " * 40, "the cat sat\non 語"]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, "no id the", 0, ""), (3, "again the cat", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs long, _row string")
    got = [tuple(r) for r in crosstok.digest(docs, A, B, hot_pairs=hot).collect()]
    want = brute(sides, [r[1] for r in rows])
    assert sorted(got, key=str) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=str)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.digest(docs, A, B).count() == 0


def test_query(spark, sides):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_cross_tokenizer(spark, folder).collect()}
    assert got == {i: w for (i, _), w in zip(docs, brute(sides, [t for _, t in docs]))}
