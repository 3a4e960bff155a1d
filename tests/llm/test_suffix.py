"""The index against its definitions, and the operator against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from panelspark.llm import queries, suffix


def brute(rows, length=50):
    """rows of (id, text), None ids last."""
    data = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in data:
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            if least.get(w, 1 << 63) > i:
                least[w] = i
    out = []
    for (real, _), (i, t) in zip(rows, data):
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < i:
                gone[p + 1:p + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((real, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_index_is_the_transform():
    rnd = random.Random(2)
    for _ in range(40):
        text = np.array([rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 60))] + [0])
        index = suffix.RunIndex(text)
        order = sorted(range(len(text)), key=lambda i: [*text[i:].tolist()])
        assert [int(index.row[i]) for i in order] == list(range(len(text)))
        assert [int(x) for x in np.repeat(index.heads, np.diff([*index.starts, len(text)]))] == [int(text[i - 1]) for i in order]
        for r, (a, b) in enumerate(zip(index.starts, [*index.starts[1:], len(text)])):
            assert index.first[r] == order[a] and index.last[r] == order[b - 1]


def test_matching_statistics():
    rnd = random.Random(3)
    for _ in range(60):
        text = [rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 80))]
        patterns = [np.array([rnd.randrange(1, 5) for _ in range(rnd.randrange(0, 20))]) for _ in range(4)]
        cap = rnd.choice([3, 8, 100])
        index = suffix.RunIndex(np.array([*text, 0]))
        order = np.argsort(index.row)
        got = {}
        for who, place, length, row in index.matching_statistics(patterns, cap):
            for w, p, n, r in zip(who, place, length, row):
                got[int(w), int(p)] = int(n)
                at = int(order[r])
                assert n == 0 or text[at:at + n] == patterns[w][p:p + n].tolist()
        runs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
        for w, pattern in enumerate(patterns):
            for p in range(len(pattern)):
                best = max(n for n in range(len(pattern) - p + 1) if tuple(pattern[p:p + n].tolist()) in runs)
                assert got[w, p] == min(best, cap), (text, pattern, p)


def test_equal_windows_have_equal_anchors(monkeypatch):
    rnd = random.Random(5)
    shared = bytes(rnd.randrange(97, 101) for _ in range(200))
    for chunk in (1 << 20, 256):
        monkeypatch.setattr(suffix, "CHUNK", chunk)
        seen = {}
        for _ in range(30):
            text = bytes(rnd.randrange(97, 100) for _ in range(rnd.randrange(100))) + shared + bytes(rnd.randrange(97, 100) for _ in range(100))
            h, first, last = suffix.scan(text, 50)
            assert first[0] == 0 and last[-1] == len(text) - 50 and (chunk == 256 or (first[1:] == last[:-1] + 1).all())
            for x, a, b in zip(h, first, last):
                for p in range(a, b + 1):
                    assert seen.setdefault(text[p:p + 50], x) == x


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.randrange(8, 40))) for _ in range(8)]
    rows = [(i, " ".join(rnd.choice([rnd.choice(passages), " ".join(word() for _ in range(20))]) for _ in range(rnd.randrange(0, 6)))) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(5)] + [(200, None), (201, ""), (202, "x" * 49), (203, "y" * 120), (204, "y" * 80 + "z"), (None, passages[0]), (None, "own words " * 12), (5, passages[1] + " tail")]
    rows += [(300, "long " + " ".join(word() for _ in range(30000))), (301, rows[9][1] + passages[2] * 3)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, key int, ord string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, suffix.remove_repeats(docs).collect()), key=key) == sorted(brute(rows), key=key)
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op6_suffix(spark, folder).collect()))
    assert got == sorted(brute(rows)) and sum(r[2] for r in got) > 0


def test_classes_of_equal_starts():
    r = np.random.default_rng(3)
    for _ in range(300):
        n, length = int(r.integers(1, 90)), int(r.integers(7, 40))
        text = np.append(r.integers(0, r.integers(1, 4), n), 0)
        index = suffix.RunIndex(text, length)
        group = np.searchsorted(index.classes(length), index.row, "right") - 1
        seen = {}
        for i in range(n + 1):  # suffixes that are too short are alone
            start = tuple(text[i:i + length]) if i + length <= n + 1 else i
            assert seen.setdefault(start, group[i]) == group[i]
        assert len(set(seen.values())) == len(seen)


def test_pieces_to_index_and_rows_of_marks(spark):
    rnd = random.Random(11)
    some = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    passages = [some(rnd.randrange(20, 90)) for _ in range(12)]  # the short ones share anchors but no window
    texts = [b"".join(rnd.choice(passages) + some(rnd.randrange(3, 40)) for _ in range(12)) for _ in range(40)]
    ids, entries, pieces = [], [], []
    for i, text in enumerate(texts):
        h, first, last, sides = suffix.scan_sides(text, 50)
        made = np.empty(len(h), suffix.ENTRY)
        names = suffix._names(text, first, last, 50)
        made["anchor"], made["name"], made["more"] = h >> np.uint64(32), names & np.uint64(0xFFFFFFFF), names >> np.uint64(32)
        made["left"], made["right"] = sides
        ids, entries = ids + [i] * len(h), entries + [made]
        pieces += [(i, int(n), int(x), text[a:b + 50]) for n, x, a, b in zip(names, h, first, last)]
    marks = {(i, n): m for i, n, m in zip(*(x.tolist() for x in suffix.decide(np.array(ids), np.concatenate(entries))))}
    least, holders, of_anchor = {}, {}, {}
    for i, n, x, piece in pieces:
        least[n] = min(i, least.get(n, i))
        of_anchor.setdefault(x, {}).setdefault(n, piece)
        for p in range(len(piece) - 49):
            holders.setdefault(piece[p:p + 50], set()).add(n)
    differ = {n for names in of_anchor.values() if len(names) > 1 for n in names}
    for i, n, _, _ in pieces:
        assert (marks.get((i, n)) == 0) == (i > least[n])  # covered by an equal piece
    must = {n for own in holders.values() if len({least[n] for n in own}) > 1 for n in own}
    indexed = {n for (i, n), m in marks.items() if m}
    assert must and must <= indexed < differ and all(least[n] == i for (i, n), m in marks.items() if m)
    # One row for a document, whatever the number of buckets, and marks travel in rows of a bucket and a group of documents.
    docs = suffix._texts(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text")
    rows = suffix._shared(suffix._anchor_lists(docs, 50, 97), 2).collect()
    assert len(rows) == len({r.ord for r in rows})
    got = {(r.ord, int(n)): m for r in rows for m, packed in ((0, r.covered), (1, r.mixed)) for n in suffix._unpack(bytes(packed))}
    assert got == marks
