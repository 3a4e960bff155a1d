"""Exact removal of repeated byte strings by run-length Burrows-Wheeler indexes.

Every byte that lies in a string of ``length`` bytes which also starts in a document with a smaller id is
removed. The work is cut so that equal strings always meet in the same, bounded index:

1. Every window of ``length`` bytes has an anchor, the 16 bytes within it with the smallest hash. Equal windows
   have equal anchors. One pass over the texts lists the anchors of each document, packed by bucket, each with a
   hash of the piece of text that its windows cover and one of the bytes on either side of the anchor of which
   every window holds all of one side. Buckets are as many as the corpus needs to keep each small.
2. Anchors of two or more documents are found bucket by bucket. Of equal pieces the smallest id stands for all;
   the others are covered. Pieces that are like no other piece of their anchor on either side share no window
   and leave; of the rest one of each must be indexed. These marks travel packed by groups of documents.
3. Pieces to index are cut out of the texts, with their places.
4. Pieces that share an anchor go to one block. ``RunIndex`` builds the run-compressed transform of the block
   with suffix positions sampled at run ends, streams matching statistics of every piece through it, and gives
   for each window the smallest id that holds it.
5. Windows whose smallest id is below the document's own are marked; the bytes they cover go.

Scale: per text, 12 bytes for each bucket it meets and 14 for each anchor (about one in 18 bytes) are shuffled,
then 6 for each mark and the pieces to index. A text that many documents share is looked at once; its copies are
covered from end to end.

Defined results: a null text is an empty text. Texts shorter than ``length`` lose nothing. Rows without an id
come after all others; rows with equal ids do not remove each other's bytes. Repeated rows give repeated
results; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import stage

KMER = 16
CHUNK = 1 << 20  # texts are scanned in overlapping stretches, so that a place fits in 20 bits
BUCKET_BYTES = 12_000_000  # of text for each bucket of anchors
GROUP_BYTES = 32_000_000  # of text for each group of documents whose marks travel together
BLOCK_BYTES = 1_500_000  # of pieces for each index; an anchor with more of them has a block to itself
SEPARATOR = 0  # symbols are byte + 1
LAST = (1 << 63) - 1


def scan(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: hash of the anchor, first and last start of a window."""
    return scan_sides(text, length)[:3]


def scan_sides(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``scan``, and two 16-bit hashes of each run: of the bytes beside the anchor, left and right, of which every window
    holds one side or the other; zero if no window of the run does."""
    hashes, first, last, sides = [], [], [], []
    side = (length - KMER + 1) // 2
    for lo in range(0, max(len(text) - length, 0) + 1, CHUNK - length):
        part = text[lo:lo + CHUNK - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        word = np.empty(len(part) - 7, np.uint64)
        for o in range(min(8, len(word))):
            word[o::8] = np.frombuffer(part, "<u8", (len(part) - o) // 8, o)[:len(word[o::8])]
        h = word[:-8] * np.uint64(0x9E3779B97F4A7C15) + word[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        least = (h & ~np.uint64(CHUNK - 1)) | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
        want, have = length - KMER + 1, 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        at = (least & np.uint64(CHUNK - 1)).astype(np.int64)
        edge = np.flatnonzero(at[1:] != at[:-1]) + 1
        begin = np.concatenate(([0], edge))
        at, until = at[begin], np.concatenate((edge, [n])) - 1
        hashes.append(h[at])
        first.append(begin + lo)
        last.append(until + lo)
        near = np.zeros((2, len(at)), np.uint16)
        for k, (held, start) in enumerate(((at - begin, at - side), (until + length - KMER - at, at + KMER))):
            has = np.flatnonzero(held >= side)
            near[k, has] = np.maximum(_mixed(word, start[has], side), 1)
        sides.append(near)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((2, 0), np.uint16)
    return np.concatenate(hashes), np.concatenate(first), np.concatenate(last), np.concatenate(sides, axis=1)


def _mixed(word: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A 16-bit hash of the ``size`` bytes from each start, read as overlapping words of eight bytes; the same for all if fewer."""
    out = np.zeros(len(start), np.uint64)
    for o in sorted({*range(0, size - 7, 8), size - 8}) if size >= 8 else ():
        out = (out ^ word[start + o]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(48)).astype(np.uint16)


class RunIndex:
    """Run-compressed transform of a text of symbols, for backward search that carries a text position."""

    def __init__(self, symbols: np.ndarray, length: int = 0):
        self.text, n = symbols.astype(np.int64), len(symbols)
        self.depth, self.coarse = 0, np.zeros(n, np.int64)  # ranks by the most symbols, up to ``length``, that doubling met
        key = np.zeros(n, np.int64)
        for d in range(7):  # seven symbols of nine bits
            key = key * 512
            key[:max(n - d, 0)] += self.text[d:] + 1
        depth, order, rank = 7, np.empty(n, np.int64), np.zeros(n, np.int64)
        slots = open_ = np.arange(n)  # rows whose suffixes are not told apart yet, and these suffixes
        while True:
            by = np.argsort(key)
            open_, key = open_[by], key[by]
            order[slots] = open_
            differs = np.concatenate(([True], key[1:] != key[:-1]))
            rank = rank.copy()
            rank[open_] = slots[np.flatnonzero(differs)][differs.cumsum() - 1]  # the first row of equal suffixes
            if depth <= length:
                self.depth, self.coarse = depth, rank
            alone = differs & np.append(differs[1:], True)
            slots, open_ = slots[~alone], open_[~alone]
            if not len(slots):
                break
            key = rank[open_] * (n + 1)
            far = np.flatnonzero(open_ + depth < n)
            key[far] += rank[open_[far] + depth] + 1
            depth *= 2
        self.row = rank  # of each text position; only used to start a stream and to check
        before = self.text[order - 1]  # the text is read as a circle
        starts = np.concatenate(([0], np.flatnonzero(before[1:] != before[:-1]) + 1))
        self.starts, self.heads, self.n = starts, before[starts], n
        lengths = np.diff(np.concatenate((starts, [n])))
        self.run = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)  # of each row; blocks are small
        # Sampled run ends: the text positions of the first and last row of each run.
        self.first, self.last = order[starts], order[starts + lengths - 1]
        by_head = np.argsort(self.heads, kind="stable")
        total = np.cumsum(lengths[by_head])
        self.target = np.empty(len(starts), np.int64)  # row to which the first row of a run steps
        self.target[by_head] = total - lengths[by_head]
        self.by_head, self.head_sorted = by_head, self.heads[by_head]

    def step(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        return self.target[run] + row - self.starts[run]

    def run_of(self, row: np.ndarray) -> np.ndarray:
        return self.run[row]

    def common(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at ``p`` and ``q``, up to ``most``."""
        out, alive = np.zeros(len(p), np.int64), np.arange(len(p))
        while len(alive):
            d = out[alive]
            a, b = p[alive] + d, q[alive] + d
            same = (d < most[alive]) & (a < self.n) & (b < self.n)
            same[same] = self.text[a[same]] == self.text[b[same]]
            alive = alive[same]
            out[alive] += 1
        return out

    def matching_statistics(self, patterns: list[np.ndarray], cap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams all patterns from their ends, one symbol of each at a time. Yields (patterns, places, lengths,
        rows): the longest match, up to ``cap``, of the pattern from that place on, and a row whose suffix starts with it."""
        size = np.array([len(p) for p in patterns], np.int64)
        flat = np.concatenate(patterns).astype(np.int64) if patterns else np.empty(0, np.int64)
        ends = np.cumsum(size)
        row, pos, length = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        pos[:] = self.first[0] if len(self.starts) else 0
        for back in range(1, int(size.max(initial=0)) + 1):
            who = np.flatnonzero(size >= back)
            c = flat[ends[who] - back]
            run = self.run_of(row[who])
            fits = self.heads[run] == c
            go = who[fits]
            row[go], pos[go] = self.step(row[go], run[fits]), (pos[go] - 1) % self.n
            length[go] = np.minimum(length[go] + 1, cap)
            miss = who[~fits]
            if len(miss):
                self._jump(miss, c[~fits], run[~fits], row, pos, length, cap)
            yield who, size[who] - back, length[who], row[who]

    def _jump(self, who, c, run, row, pos, length, cap) -> None:
        """The current row is not preceded by ``c``: go on from the nearest sampled end of a run of ``c``, above or below."""
        lo, hi = np.searchsorted(self.head_sorted, c, "left"), np.searchsorted(self.head_sorted, c, "right")
        # Runs of one symbol keep their order among by_head, so they can be searched by their number.
        code = self.head_sorted * (len(self.starts) + 1) + self.by_head
        at = np.searchsorted(code, c * (len(self.starts) + 1) + run)
        best_len, best_row, best_pos = np.full(len(who), -1), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        for ok, slot, sample, end in ((at > lo, at - 1, self.last, True), (at < hi, at, self.first, False)):
            k = np.flatnonzero(ok)
            r = self.by_head[slot[k]]
            q = sample[r]
            ell = self.common(pos[who[k]], q, length[who[k]])
            here = (self.starts[r] if not end else np.concatenate((self.starts[1:], [self.n]))[r] - 1)
            better = ell > best_len[k]
            k, r, q, ell, here = k[better], r[better], q[better], ell[better], here[better]
            best_len[k], best_row[k], best_pos[k] = ell, self.step(here, r), (q - 1) % self.n
        found = best_len >= 0
        length[who] = np.where(found, np.minimum(best_len + 1, cap), 0)
        row[who] = np.where(found, best_row, row[who])
        pos[who] = np.where(found, best_pos, pos[who])

    def classes(self, length: int) -> np.ndarray:
        """Rows that begin a class of suffixes which share their first ``length`` symbols."""
        order = np.empty(self.n, np.int64)
        order[self.row] = np.arange(self.n)
        p, q = order[:-1], order[1:]
        if 0 < self.depth <= length:  # equal ranks mean that this many symbols are equal
            same = self.coarse[p] == self.coarse[q]
            p, q = p[same], q[same]
        else:
            same = np.ones(self.n - 1, bool)
        if 0 < self.depth <= length <= 2 * self.depth:  # two ranks that overlap decide; a place at the end is unlike any other
            ranks, off = np.concatenate((self.coarse, [-1])), length - self.depth
            same[same] = ranks[p + off] == ranks[q + off]
        else:
            same[same] = self.common(p, q, np.full(len(p), length)) >= length
        return np.concatenate(([0], np.flatnonzero(~same) + 1))


def least_ids(pieces: list[bytes], ids: np.ndarray, length: int) -> list[list[tuple[int, int, int]]]:
    """For each piece the runs (first window, last window, smallest id among all pieces that hold these windows)."""
    sizes = np.array([len(p) for p in pieces])
    bounds = np.cumsum(sizes + 1)
    symbols = np.zeros(int(bounds[-1]), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[bounds - 1] = False  # each piece is followed by a separator
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    index = RunIndex(symbols, length)
    starts = index.classes(length)
    class_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, index.n)))
    least = np.full(len(starts), LAST)
    begin = bounds - sizes - 1
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for who, place, run, row in index.matching_statistics([symbols[b:b + s] for b, s in zip(begin, sizes)], length):
        full = run >= length
        group = class_of[row[full]]
        np.minimum.at(least, group, ids[who[full]])
        held.append((who[full], place[full], group))
    who, place, group = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((place, who))
    who, place, value = who[order], place[order], least[group[order]]
    cut = np.concatenate(([True], (who[1:] != who[:-1]) | (value[1:] != value[:-1])))
    at = np.flatnonzero(cut)
    ends = np.concatenate((at[1:], [len(who)])) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in pieces]
    for w, a, b, v in zip(who[at].tolist(), place[at].tolist(), place[ends].tolist(), value[at].tolist()):
        out[w].append((a, b, v))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{id_col}`"), F.lit(LAST)).cast("bigint").alias("ord"),
                       F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


# An anchor as it travels: 32 bits of its hash beside the bucket that all of it chose, 48 bits of the hash of its piece, and two sides.
ENTRY = np.dtype([("anchor", "<u4"), ("name", "<u4"), ("more", "<u2"), ("left", "<u2"), ("right", "<u2")])


def _names(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """48 bits of a hash of each piece."""
    name = xxhash.xxh3_64_intdigest
    return np.array([name(text[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64) >> np.uint64(16)


def _pack(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").reshape(-1)


def _anchor_lists(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Packed anchors by bucket: ids, how many anchors each has, and an ``ENTRY`` for each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, where, sizes, parts = batch.column(0).to_numpy(), [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                h, first, last, sides = scan_sides(text, length)
                sizes.append(len(h))
                if len(h):
                    names, made = _names(text, first, last, length), np.empty(len(h), ENTRY)
                    made["anchor"], made["name"], made["more"] = h >> np.uint64(32), names & np.uint64(0xFFFFFFFF), names >> np.uint64(32)
                    made["left"], made["right"] = sides
                    where.append((h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32))
                    parts.append(made)
            if not parts:
                continue
            bucket, entries = np.concatenate(where), np.concatenate(parts)
            order = np.argsort(bucket, kind="stable")
            bucket, entries, own = bucket[order], entries[order], np.repeat(np.arange(batch.num_rows), sizes)[order]
            cuts = np.concatenate((np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), [len(bucket)]))
            rows = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = np.flatnonzero(np.diff(own[lo:hi], prepend=-1))
                rows.append((int(bucket[lo]), ids[own[lo:hi][at]].astype("<i8").tobytes(), np.diff(np.append(at, hi - lo)).astype("<u4").tobytes(), entries[lo:hi].tobytes()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "ids", "counts", "anchors"])

    return texts.select("ord", "text").mapInArrow(run, "bucket bigint, ids binary, counts binary, anchors binary")


def decide(ids: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, names and marks of the pieces of one bucket that may lose bytes or cost others theirs.

    A piece that a smaller id has as well is covered (mark 0). Of the others, one stands for all that are equal;
    it must be indexed (mark 1) if a different piece of the anchor, of another id, has the same bytes on one side
    of it: every window holds all of one side, so pieces alone on both sides share no window."""
    order = np.argsort(entries["anchor"])
    anchor = entries["anchor"][order]
    equal = np.append(anchor[1:] == anchor[:-1], False)
    order = order[equal | np.concatenate(([False], equal[:-1]))] if len(order) else order  # two entries at least
    ids, entries = ids[order], entries[order]
    names = entries["more"].astype(np.uint64) << np.uint64(32) | entries["name"]
    anchor = entries["anchor"]
    order = np.lexsort((ids, names, anchor))
    ids, names, anchor, sides = ids[order], names[order], anchor[order], (entries["left"][order], entries["right"][order])
    begin = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (names[1:] != names[:-1])))) if len(ids) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(ids)))
    least = ids[begin]
    wanted = np.zeros(len(begin), bool)
    for side in sides:
        has = np.flatnonzero(side[begin] > 0)
        if len(has):
            key = anchor[begin[has]].astype(np.uint64) << np.uint64(16) | side[begin[has]]
            by = np.argsort(key)
            has, key = has[by], key[by]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            several = np.minimum.reduceat(least[has], cut) < np.maximum.reduceat(least[has], cut)
            wanted[has[np.repeat(several, np.diff(np.append(cut, len(key))))]] = True
    covered = ids > np.repeat(least, size)
    take = covered | np.repeat(wanted, size)
    return ids[take], names[take], (~covered[take]).astype(np.int64)


def _shared(lists: DataFrame, groups: int) -> DataFrame:
    """``(ord, covered, mixed)``: for each document the packed names of its pieces that ``decide`` marked.

    The marks of a bucket travel packed by group of documents, so that their rows do not follow a document's number of buckets."""
    def mark(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        ids = np.concatenate([np.repeat(np.frombuffer(k, "<i8"), np.frombuffer(n, "<u4")) for k, n, _ in held])
        ids, names, marks = decide(ids, np.concatenate([np.frombuffer(a, ENTRY) for *_, a in held]))
        group = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)
        order = np.lexsort((marks, ids, group))
        group, ids, names, marks = group[order], ids[order], names[order], marks[order]
        cuts = np.append(np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1)), len(ids)).tolist()
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = np.flatnonzero(np.diff(ids[lo:hi], prepend=ids[lo]) != 0)
            at = np.concatenate(([0], at))
            rows.append((int(group[lo]), ids[lo:hi][at].astype("<i8").tobytes(), np.diff(np.append(at, hi - lo)).astype("<u4").tobytes(),
                         np.add.reduceat(marks[lo:hi], at).astype("<u4").tobytes(), _pack(names[lo:hi])))
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "ids", "counts", "mixed", "names"])

    def gather(held: list[tuple[bytes, ...]]) -> pa.RecordBatch:
        ids, counts, mixed = (np.concatenate([np.frombuffer(r[c], kind) for r in held]) for c, kind in ((0, "<i8"), (1, "<u4"), (2, "<u4")))
        ends = np.cumsum(counts, dtype=np.int64) * 6
        begins, middle = ends - counts.astype(np.int64) * 6, ends - mixed.astype(np.int64) * 6
        packed = b"".join(r[3] for r in held)
        order = np.argsort(ids, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
        made = []
        for part in np.split(order, at[1:]):
            made.append([b"".join([packed[a:b] for a, b in zip(x[part].tolist(), y[part].tolist())]) for x, y in ((begins, middle), (middle, ends))])
        return pa.RecordBatch.from_arrays([pa.array(ids[order][at], pa.int64()), *[pa.array(c, pa.binary()) for c in zip(*made)]], names=["ord", "covered", "mixed"])

    marked = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_first(mark), "part bigint, ids binary, counts binary, mixed binary, names binary")
    return marked.repartition("part").sortWithinPartitions("part").mapInArrow(_by_first(gather), "ord bigint, covered binary, mixed binary")


def _by_first(flush):
    """Batches of sorted rows to ``flush`` of the rows, without their first column, that have the same value in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for first, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and first != now:
                    yield flush(held)
                    held = []
                now = first
                held.append(tuple(row))
        if held:
            yield flush(held)

    return run


def _findings(texts: DataFrame, length: int) -> DataFrame:
    """``(ord, key, a, b, at, anchor, piece)``: ranges of bytes that are covered, and the pieces to index with the
    packed places where the document has them."""
    names = ["ord", "key", "a", "b", "at", "anchor", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def one(own: int, key: int, text: bytes, *listed: bytes) -> list[tuple]:
        h, first, last = scan(text, length)
        called, h = _names(text, first, last, length), h.view(np.int64)
        covered, mixed = (np.flatnonzero(np.isin(called, _unpack(x))) for x in listed)
        made, pieces = [], {}
        if len(covered):  # neighbouring ranges become one
            cut = np.flatnonzero(np.diff(covered, prepend=-2) > 1)
            ends = covered[np.append(cut[1:], len(covered)) - 1]
            made += [(own, key, a, b, None, None, None) for a, b in zip(first[covered[cut]].tolist(), (last[ends] + length).tolist())]
        for x, a, b in zip(h[mixed].tolist(), first[mixed].tolist(), (last[mixed] + length).tolist()):
            pieces.setdefault((x, text[a:b]), []).append(a)
        return made + [(own, key, None, None, np.array(at, "<i8").tobytes(), x, piece) for (x, piece), at in pieces.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, ids, keys = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (own, key) in enumerate(zip(ids, keys)):
                made += one(own, key, *(batch.column(c)[i].as_py() for c in (2, 3, 4)))
                if len(made) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names=names)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names=names)

    return (texts.select("ord", "key", "text", "covered", "mixed")
            .mapInArrow(run, "ord bigint, key bigint, a bigint, b bigint, at binary, anchor bigint, piece binary"))


def _answers(pieces: DataFrame, length: int) -> DataFrame:
    """``(ord, key, a, b)``: the bytes of pieces that a smaller id holds; blocks hold whole anchors."""
    def flush(held: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
        made = []
        for (_, own, key, at, _), runs in zip(held, least_ids([h[4] for h in held], np.array([h[1] for h in held], np.int64), length)):
            lost = [(a, b) for a, b, v in runs if v < own]
            if lost:
                made += [(own, key, p + a, p + b + length) for p in np.frombuffer(at, "<i8").tolist() for a, b in lost]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made) if made else [()] * 4)], names=["ord", "key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size > BLOCK_BYTES and row[0] != anchor:
                    yield flush(held)
                    held, size = [], 0
                anchor, size = row[0], size + len(row[4]) + 1
                held.append(row)
        if held:
            yield flush(held)

    ordered = pieces.select("anchor", "ord", "key", "at", "piece").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "ord bigint, key bigint, a bigint, b bigint")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and the ``kept`` bytes' ``kept_sha256``."""
    if length < KMER:
        raise ValueError(f"at least {KMER} bytes")
    texts = _texts(docs, id_col, text_col)
    # Every row without its text: what it would return if nothing is removed, or all.
    rows = stage(texts.select("_id", "ord", "key", F.length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
    leads = rows.groupBy("key").agg(F.min("ord").alias("lead"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    shared = _shared(_anchor_lists(texts, length, buckets), max(64, -(-total // GROUP_BYTES)))
    # One row of each text is looked at; its copies are covered from end to end.
    looked = shared.join(leads.withColumnRenamed("lead", "ord"), "ord")
    found = stage(_findings(texts.join(looked, ["ord", "key"]).dropDuplicates(["ord", "key"]), length), "findings")
    indexed = _answers(found.where("piece IS NOT NULL"), length)
    marks = (found.where("piece IS NULL").select("ord", "key", "a", "b").union(indexed)
             .groupBy("ord", "key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [without(batch.column(1)[i].as_py(), [(s["a"], s["b"]) for s in batch.column(2)[i].as_py()]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()),
                                              pa.array([m[2] for m in made], pa.string())], names=["key", "removed", "spans", "kept"])

    changed = texts.select("ord", "key", "text").join(marks, ["ord", "key"]).dropDuplicates(["ord", "key"]).select("key", "text", "spans").mapInArrow(cut, "key bigint, removed bigint, spans bigint, kept string")
    whole = (F.col("ord") > F.col("lead")) & (F.col("n_bytes") >= length)
    out = rows.join(leads.join(changed, "key", "left"), "key")
    return out.select(F.col("_id").alias(id_col), "n_bytes",
                      F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
                      F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
                      F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs, and the digest of the rest; spans are sorted and may overlap or touch."""
    out, at, runs, removed, end = hashlib.sha256(), 0, 0, 0, -1
    for a, b in spans:
        if a > end:
            out.update(text[at:a])
            runs += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
        at = max(at, end)
    out.update(text[at:])
    return removed, runs, out.hexdigest()


# The same from the definition: every window of 50 bytes, the least document that holds it, runs of covered bytes.
SQL = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, i, h[i + 1:i + 50] AS s FROM (SELECT r, doc_id, h, unnest(range(0, octet_length(h) - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS lead FROM w GROUP BY s),
c AS (SELECT w.r, w.i, w.i > lag(w.i) OVER (PARTITION BY w.r ORDER BY w.i) + 50 AS apart FROM w JOIN m ON m.s = w.s WHERE m.lead < w.doc_id),
g AS (SELECT r, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM c),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM runs),
kept AS (SELECT runs.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(hex(h[z + 1:a]), '' ORDER BY a) AS before
  FROM gaps AS runs JOIN d ON d.r = runs.r GROUP BY runs.r)
SELECT doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(before, '') || hex(h[coalesce(tail, 0) + 1:octet_length(h)]))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r"""
