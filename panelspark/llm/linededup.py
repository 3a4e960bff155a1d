"""Line deduplication by pairwise alignment.

Documents that share lines are found by line hashes, each such pair is aligned with patience diff, and the
aligned common blocks are deleted from the later document (the one with the larger id).

Which pairs: documents with the same text are one class, led by its smallest id; later copies are common
with it from end to end and lose all their lines. Between classes, a rare line (held by ``rare`` classes or
fewer) pairs every two of its holders. A more frequent line pairs each holder with the first holder only, so
that its occurrences give as many pairs, not their square; every line that an earlier document holds is
still compared with one that holds it. Unless ``whole`` is turned off, what an earlier
class holds and this pass leaves is tried against its other earlier holders until one deletes it or none is
left, so the result is that of aligning all earlier holders.

Scale: what is shuffled for the search are line hashes; the texts move once, at the end, to be rewritten.
A document that thousands of others are compared with is a skewed join key, which AQE splits.

Defined results: lines are compared without blanks at their ends; blank lines are never compared and stay,
unless nothing else is left. A block counts from ``min_chars`` characters. A null text is an empty text
without lines. Rows without an id come after all others, by text. Rows that repeat id and text are one
document and get the same result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import stage


def unique(a: list, b: list) -> list[tuple[int, int]]:
    """Places of what occurs once on either side, rising on the first."""
    left, right = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if right[x] == 1}
    return [(i, place[x]) for i, x in enumerate(a) if left[x] == 1 and x in place]


def nth(a: list, b: list) -> list[tuple[int, int]]:
    """The same with the k-th occurrence on one side for the k-th on the other."""
    def numbered(side: list) -> list[tuple]:
        seen: Counter = Counter()
        out = []
        for x in side:
            out.append((x, seen[x]))
            seen[x] += 1
        return out

    return unique(numbered(a), numbered(b))


def neighbours(lines: list[int]) -> list[tuple[int, int]]:
    return list(zip(lines, lines[1:]))


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of equal places, rising on both sides.

    Equal ends of a range are paired; lines that occur once on either side are paired along their longest
    rising run; the ranges between are treated the same way. Where a range has no such line, the k-th occurrence
    of two neighbouring lines on one side is taken for the k-th on the other, or else that of a line."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        once = unique(a[lo:hi], b[low:high]) or nth(neighbours(a[lo:hi]), neighbours(b[low:high])) or nth(a[lo:hi], b[low:high])
        if not once:
            continue
        once = [(i + lo, j + low) for i, j in once]
        # Piles: tops holds the smallest end of a rising run of each length, back the run itself.
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(once):
            at = bisect_left(tops, j)
            back.append(ends[at - 1] if at else -1)
            tops[at:at + 1], ends[at:at + 1] = [j], [k]
        run, k = [], ends[-1]
        while k >= 0:
            run.append(once[k])
            k = back[k]
        run.reverse()
        out += run
        edges = [(lo - 1, low - 1), *run, (hi, high)]
        todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:]) if i + 1 < i2 and j + 1 < j2]
    return sorted(out)


def shortest_runs(sizes: list[int], min_chars: int) -> list[tuple[int, int]]:
    """``(first, last)`` of the shortest runs of lines from each start and to each end that have ``min_chars`` characters.

    Every line of a block of so many characters lies in such a run within the block."""
    out: set[tuple[int, int]] = set()
    for flip in (False, True):
        row, hi, total = sizes[::-1] if flip else sizes, 0, 0
        for lo in range(len(row)):
            while hi < len(row) and (hi <= lo or total < min_chars):
                total, hi = total + row[hi], hi + 1
            if total < min_chars:
                break
            out.add((len(row) - hi, len(row) - 1 - lo) if flip else (lo, hi - 1))
            total -= row[lo]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], sizes: list[int], min_chars: int) -> list[int]:
    """Places of ``b`` in aligned blocks that have ``min_chars`` characters, and in further copies of what these
    hold; ``sizes`` are the lengths of its lines."""
    out: set[int] = set()
    ends: dict[int, int] = {}  # the last place of the block of each place
    block: list[int] = []
    pairs = align(a, b)
    for at, (i, j) in enumerate(pairs):
        block.append(j)
        if at + 1 == len(pairs) or pairs[at + 1] != (i + 1, j + 1):
            if sum(sizes[x] for x in block) >= min_chars:
                out |= set(block)
                ends |= dict.fromkeys(block, block[-1])
            block = []
    if out and len(out) < len(b) and len(set(b)) < len(b):
        runs = shortest_runs(sizes, min_chars)
        known = {tuple(b[i:j + 1]) for i, j in runs if j <= ends.get(i, -1)}
        for i, j in runs:
            if tuple(b[i:j + 1]) in known:
                out |= set(range(i, j + 1))
    return sorted(out)


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct texts ``(key, first, lines, sizes)``: hashes and lengths of their lines that are not blank."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trimmed = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(text.cast("binary")).alias("key"), trimmed.alias("t"))
    hashed = rows.select("id", "key", F.transform("t", lambda x: F.xxhash64(x)).alias("lines"), F.transform("t", lambda x: F.length(x)).alias("sizes"))
    return stage(hashed, "lines")


def pairs(texts: DataFrame, rare: int) -> DataFrame:
    """``(later, earlier)`` keys of classes to align."""
    held = texts.select(F.struct(F.col("first").isNull().alias("n"), "first", "key").alias("d"), F.explode(F.array_distinct("lines")).alias("line"))
    held = stage(held, "held")
    known = held.groupBy("line").agg(F.count("*").alias("df"), F.min("d").alias("lead")).where("df > 1")
    near = held.join(known.where(F.col("df") <= rare).select("line"), "line").groupBy("line").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    both = near.select(F.explode(F.transform("ds", lambda x, i: F.struct(x.alias("later"), F.slice("ds", F.lit(1), i).alias("before")))).alias("p"))
    close = both.select(F.col("p.later.key").alias("later"), F.explode("p.before.key").alias("earlier"))
    far = (held.join(known.where(F.col("df") > rare).select("line", "lead"), "line").where("d != lead")
           .select(F.col("d.key").alias("later"), F.col("lead.key").alias("earlier")))
    return close.union(far).distinct()


def windows(texts: DataFrame, min_chars: int) -> DataFrame:
    """``(d, window, places)``: hashes of the shortest runs of lines of each class, with all places that such a run takes."""
    taken = texts.select(F.struct(F.col("first").isNull().alias("n"), "first", "key").alias("d"), "lines", "sizes")
    schema = T.StructType([taken.schema["d"], *T._parse_datatype_string("w array<struct<window: bigint, places: array<int>>>").fields])
    item = pa.list_(pa.struct([("window", pa.int64()), ("places", pa.list_(pa.int32()))]))

    def made(lines: list[int], sizes: list[int]) -> list[dict]:
        raw, at = np.array(lines, "<i8"), {}
        for i, j in shortest_runs(sizes, min_chars):
            at.setdefault(xxhash.xxh3_64_intdigest(raw[i:j + 1].tobytes()) - (1 << 63), set()).update(range(i, j + 1))
        return [{"window": w, "places": sorted(x)} for w, x in at.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [made(*row) for row in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, item)], names=["d", "w"])

    return taken.mapInArrow(run, schema).select("d", F.explode("w").alias("w")).select("d", "w.window", "w.places")


def aligned(to_align: DataFrame, texts: DataFrame, min_chars: int) -> DataFrame:
    """``(key, places)`` that the pairs ``(later, earlier)`` delete from the later class."""
    both = (to_align.join(texts.select(F.col("key").alias("earlier"), F.col("lines").alias("a")), "earlier")
            .join(texts.select(F.col("key").alias("later"), F.col("lines").alias("b"), "sizes"), "later")
            .select("later", "a", "b", "sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000).to_pylist()
                made = [(r["later"], common_blocks(r["a"], r["b"], r["sizes"], min_chars)) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.string()), pa.array([x for _, x in made], pa.list_(pa.int32()))], names=["key", "places"])

    return both.mapInArrow(run, "key string, places array<int>").where(F.size("places") > 0)


def merged(found: DataFrame) -> DataFrame:
    return (found.select("key", F.explode("places").alias("place")).distinct()
            .groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("removed")))


def left_over(texts: DataFrame, found: DataFrame, min_chars: int) -> DataFrame:
    """``found`` with what aligning all earlier holders would delete besides.

    A line that stays is open if a run around it, long enough to count, is held by an earlier class. Open runs
    are tried against 16 earlier holders (the first of each part of their keys), then 256, and so on, at last
    against all; those that a holder deletes leave the search."""
    held = windows(texts, min_chars)
    known = stage(held.groupBy("window").agg(F.count("*").alias("df"), F.min("d").alias("lead")).where("df > 1"), "runs")
    shared = stage(held.join(known, "window"), "shared")
    stays = lambda rows, gone: (rows.join(gone, rows["d.key"] == gone["key"], "left")
                                .where(F.size(F.array_except("places", F.coalesce("removed", F.array().cast("array<int>")))) > 0).drop("key", "removed"))
    rows = stage(stays(shared.where("lead < d").drop("lead"), found), "open")
    holders = shared.select("window", F.col("d").alias("e")).join(rows.select("window").distinct(), "window", "left_semi")
    width = 16
    while (most := rows.agg(F.max("df")).first()[0]) is not None:
        tried = holders
        if width < most:
            part = F.pmod(F.xxhash64("e.key"), F.lit(width)).alias("part")
            tried = holders.groupBy("window", part).agg(F.min("e").alias("e")).select("window", "e")
        pair = rows.select("window", "d").join(tried, "window").where("e < d").select(F.col("d.key").alias("later"), F.col("e.key").alias("earlier")).distinct()
        now = stage(aligned(pair, texts, min_chars).union(found.select("key", F.col("removed").alias("places"))), "tried")
        found = stage(merged(now), "removed")
        if width >= most:
            break
        rows = stage(stays(rows, found), "open")
        width *= 16
    return found


def removals(docs: DataFrame, rare: int = 10, min_chars: int = 30, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """``(key, first, removed)`` of each distinct text: the id that leads it and the places, among its lines that
    are not blank, to delete from the leading document."""
    lines = classes(docs, id_col, text_col)
    first = stage(lines.groupBy("key").agg(F.min("id").alias("first")), "first")
    texts = stage(lines.select("key", "lines", "sizes").dropDuplicates(["key"]).join(first, "key"), "texts")
    found = merged(aligned(pairs(texts, rare), texts, min_chars))
    if whole:
        found = left_over(texts, stage(found, "removed"), min_chars)
    return first.join(found, "key", "left")


def deduplicate(docs: DataFrame, rare: int = 10, min_chars: int = 30, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                whole: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_lines`` (not blank), ``n_removed``, ``is_copy`` (of an earlier document),
    ``kept``, the text left, and the columns ``carry`` as they are. ``whole`` compares with all earlier holders of a line."""
    found = stage(removals(docs, rare, min_chars, id_col, text_col, whole), "removals")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.md5(text.cast("binary")).alias("key"),
                       *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]).join(found, "key")
    carried = [f"_c{i}" for i in range(len(carry))]
    copy = ~F.col("_id").eqNullSafe(F.col("first"))
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("is_copy", T.BooleanType()), T.StructField("kept", T.StringType()), *[rows.schema[c] for c in carried]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, removed, copies = (part.column(i).to_pylist() for i in (1, 2, 3))
                made = [without(t, None if c else r) if c or r else (count_lines(t), 0, t) for t, r, c in zip(texts, removed, copies)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()),
                                                  part.column(3), pa.array([m[2] for m in made], pa.string()), *part.columns[4:]], names=[f.name for f in schema])

    made = rows.select("_id", "_text", "removed", copy.alias("is_copy"), *carried).mapInArrow(run, schema)
    return made.withColumnsRenamed({"_id": id_col, **dict(zip(carried, carry))})


BLANKS = " \t\n\x0b\f\r"


def count_lines(text: str) -> int:
    return sum(1 for line in text.split("\n") if line.strip(BLANKS))


def without(text: str, places: list[int] | None) -> tuple[int, int, str]:
    """Lines that are not blank, how many of them go, and the text without them; None stands for all."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip(BLANKS)]
    gone = set(full if places is None else map(full.__getitem__, places))
    return len(full), len(gone), "" if gone and len(gone) == len(full) else "\n".join(line for i, line in enumerate(lines) if i not in gone)
