"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most ``distance`` bits differ in
few bits within at least one segment, so the table of each segment is looked up with every value in a
small Hamming ball around the segment, and the whole distance is verified on what is found. Nothing is
missed and nothing is capped.

Scale: documents with the same fingerprint are one row from the start. A bucket (segment and value) that
holds more than ``block`` entries is dealt in blocks, and each pair of blocks is its own group, so a task
holds two blocks at most. A group gives the edges of a spanning forest, never its pairs. More segments
make balls and shuffles smaller and buckets fuller: for N distinct fingerprints choose about
64 / log2(N); 3 serves up to some 10^8, 2 beyond.

Defined results: a null or wordless text has fingerprint zero and is linked like any other. A row with a
null id gets its component like any row but never names one; a component without an id is null. Repeated
rows and repeated ids each keep their row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.graph import connected_components
from panelspark.session import stage

SEED = 42
FEW = 16  # runs up to this length are compared with array shifts, longer ones by a search tree


def fingerprint(text: bytes | None, ngram: int) -> int:
    """Signed 64-bit SimHash of the word shingles of an UTF-8 text; bit set if in over half the hashes."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and the six ASCII white characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(ngram, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:len(starts) - span].tolist(), ends[span:].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo:lo + (1 << 14)].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * bits > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, ngram: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``fp`` (bigint). Narrow, no shuffle."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(batch.column(1)[i].as_py(), ngram) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["_id", "fp"])

    return source.mapInArrow(run, schema)


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment. With distance = count * q + a, two fingerprints within the
    distance are within q bits in one of the first a + 1 segments or within q - 1 bits in one of the rest."""
    if count < 2:
        raise ValueError("two segments at least")
    q, a = divmod(distance, count)
    edges = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo, q if i <= a else q - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:])) if i <= a or q > 0]


def _entries(fps: DataFrame, segments: int, distance: int) -> DataFrame:
    """(bucket, probe, fp): each fingerprint once in the table of each segment, and one probe per ball value.

    Of two segment values the smaller one probes the larger one, so each difference is looked up once."""
    parts = []
    for i, (lo, width, radius) in enumerate(_segments(segments, distance)):
        value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        masks = [sum(1 << b for b in bits) for n in range(1, radius + 1) for bits in combinations(range(width), n)]
        own = F.array(F.struct(value.alias("v"), F.lit(False).alias("probe")))
        if masks:
            table = F.array([F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(1 << (m.bit_length() - 1)).cast("bigint").alias("top")) for m in masks])
            ball = F.transform(F.filter(table, lambda x: value.bitwiseAND(x["top"]) == 0),
                               lambda x: F.struct(value.bitwiseXOR(x["m"]).alias("v"), F.lit(True).alias("probe")))
            own = F.concat(own, ball)
        base = F.lit(i << 40).cast("bigint")
        parts.append(F.transform(own, _placed(base)))
    return fps.select("fp", F.explode(F.concat(*parts)).alias("e")).select("e.bucket", "e.probe", "fp")


def _placed(base):
    return lambda x: F.struct((x["v"] + base).alias("bucket"), x["probe"].alias("probe"))


def links(fps: DataFrame, distance: int, segments: int = 3, block: int = 4096) -> DataFrame:
    """Edges ``(src, dst)`` between distinct fingerprints at ``distance`` bits or fewer that connect all that are linked."""
    entries = _entries(fps, segments, distance)
    hot = (entries.groupBy("bucket").count().where(F.col("count") > block)
           .select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    dealt = (entries.join(hot, "bucket", "left")
             .withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)))
             .select("bucket", "part", "probe", "fp"))
    return (dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "probe", "fp")
            .mapInArrow(lambda batches: _forests(batches, distance), "src bigint, dst bigint"))


def _forests(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Groups arrive sorted; the last group of a batch may go on in the next one."""
    held: list[np.ndarray] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held = [np.concatenate(p) for p in zip(held, now)] if held else now
        new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
        if len(new):
            yield _edges([h[:new[-1]] for h in held], np.concatenate(([0], new)), distance)
            held = [h[new[-1]:] for h in held]
    if held and len(held[0]):
        yield _edges(held, np.array([0, len(held[0])]), distance)


def _edges(columns: list[np.ndarray], bounds: np.ndarray, distance: int) -> pa.RecordBatch:
    probe, fp = columns[2].astype(bool), columns[3].view(np.uint64)
    size = np.diff(bounds)
    run = np.repeat(np.arange(len(size)), size)
    few = size <= FEW
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, int(size[few].max(initial=1))):
        ok = (run[d:] == run[:-d]) & few[run[d:]] & ~probe[:-d]
        i = np.flatnonzero(ok)
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        out.append((fp[i], fp[i + d]))
    for g in np.flatnonzero(~few):
        lo, hi = bounds[g], bounds[g + 1]
        out += _forest(np.unique(fp[lo:hi][~probe[lo:hi]]), np.unique(fp[lo:hi][probe[lo:hi]]), distance)
    src = np.concatenate([a for a, _ in out]) if out else np.empty(0, np.uint64)
    dst = np.concatenate([b for _, b in out]) if out else np.empty(0, np.uint64)
    two = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)])[:, src != dst], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(two[0].view(np.int64)), pa.array(two[1].view(np.int64))], names=["src", "dst"])


def _forest(table: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a search tree over the table entries, and one edge from each of its trees to each probe in reach."""
    out, left = [], table
    while len(left):
        front, left, free = [left[0]], left[1:], probes
        while front:
            t = front.pop()
            near = np.bitwise_count(left ^ t) <= distance
            hit = np.bitwise_count(free ^ t) <= distance
            for pool, which in ((left, near), (free, hit)):
                if which.any():
                    out.append((np.full(int(which.sum()), t), pool[which]))
            front += left[near].tolist() and list(left[near])
            left, free = left[~near], free[~hit]
    return out


def near_duplicates(docs: DataFrame, ngram: int, distance: int, id_col: str = "doc_id", text_col: str = "text",
                    segments: int = 3, block: int = 4096) -> DataFrame:
    """One row per row of ``docs``: the id, ``fp`` and ``component_id``, the smallest id reachable over links."""
    rows = stage(fingerprints(docs, ngram, id_col, text_col), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("_id").alias("first")), "distinct")
    groups = connected_components(links(fps, distance, segments, block))
    named = (fps.join(groups, F.col("fp") == F.col("node"), "left")
             .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return (rows.join(named.join(least, "root").select("fp", "component_id"), "fp")
            .select(F.col("_id").alias(id_col), "fp", "component_id"))
