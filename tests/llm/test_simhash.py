"""SimHash against brute force over all pairs."""

import random

import pytest
import xxhash

from panelspark.llm import queries, simhash
from panelspark.llm.graph import connected_components


def plain_fingerprint(text, ngram=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + ngram]).encode(), 42) for i in range(max(1, len(words) - ngram + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    """index -> set of indices reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for text in [None, "", " \t\n", "One", "a b c", "A b\x0bC d e É É f", "x " * 500, "the same the same the same the same"]:
        assert simhash.fingerprint(text.encode() if text is not None else None, 4) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("segments,distance,block", [(3, 4, 4096), (2, 4, 4096), (4, 3, 8), (3, 4, 8), (5, 2, 4096)])
def test_links_connect_what_brute_force_connects(spark, segments, distance, block):
    rnd = random.Random(segments * 100 + distance)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(12):  # chains and clusters
            for b in rnd.sample(range(64), rnd.randrange(0, 5)):
                at ^= 1 << b
            fps.add(at)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << rnd.randrange(20, 64)) ^ (1 << rnd.randrange(20, 64)) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), distance, segments, block)
    got = [(e.src % (1 << 64), e.dst % (1 << 64)) for e in edges.collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in got)
    place = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        i, j = find(place[a]), find(place[b])
        parent[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fps))] == brute_components(fps, distance)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 129)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in [*range(101, 130), 200]}}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "x"), (3, "A B c d e f g", "y"), (None, "a b c d e f g", None), (9, None, "z"), (8, " \n", "z"), (None, "alone in the world", "w"),
            (20, "word " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs, 4, 4).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted([(5, 3), (3, 3), (3, 3), (-1, 3), (9, 8), (8, 8), (-1, -1), (20, 20)])
    assert simhash.near_duplicates(docs.limit(0), 4, 4).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {(d, f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, brute_components(fps, 4))}
    assert {tuple(r) for r in queries.op1_simhash(spark, folder).collect()} == want
