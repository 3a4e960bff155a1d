"""Alignment of two tokenizers over the same bytes: groups between common cuts, and links of overlapping tokens.

Side A is a byte-level BPE file of ``tokenizers`` and encodes a blank and the text, side B is a ``sentencepiece``
model that adds the blank itself. The offsets of A (in characters) and the spans of B (in bytes) are the coarse
cuts. Where a span does not have the length of the token's decoded bytes, that is inside a character of several
bytes and for byte-fallback pieces, the cut is refined by those bytes. Tokens between two offsets at which both
sides end form a group; an A and a B token are linked if their byte ranges overlap. (The installed ``sentencepiece``
refuses ``immutable_proto``; its ``proto`` has the same spans.)

Neither tokenizer joins anything over a single blank between two visible characters, so a text is cut before such blanks.
A's pre-tokenizer also ends a token where a letter meets a punctuation mark or a visible character a line break, so a text is
cut there too, unless B has pieces that cross or A has added tokens. Each piece keeps the blank that it begins with. A task
remembers short pieces (forgetting them changes no result); the new pieces of a batch go through both libraries in one
call, those without a blank after a letter that is dropped again. A model with pieces that cross a blank, or with another
pre-tokenizer, is refused.

The count of an id pair is the number of documents that hold it linked. Documents keep their distinct pairs packed;
tasks count the pairs of each batch first. The most frequent pairs, ``HOT_PAIRS`` at most whatever the input, travel
to the tasks as arrays, all others meet their counts in a join, so that a pair of every document is never a join key.

Defined results: texts that are null, empty, or not given back by the joined bytes of either side have no tokens,
zeros and ''. Rows are documents: repeated rows and repeated or null ids count each. Texts are never cut; other
columns of the input are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.bpe import byte_chars
from panelspark.session import stage

HOT_PAIRS = 1 << 18
REMEMBERED = 150_000  # pieces in each of two generations that a task remembers
LONG = 64  # longer pieces are aligned each time they occur
CHUNK = 200_000  # characters that go through the tokenizers at once, one piece at least
# Before a blank between two characters that neither side can take for white space.
VISIBLE = re.compile(r"[!-~\w]")
BLANKS = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")
# There, before a line break after such a character, and between a letter and a mark. The first look ahead is only for speed.
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
WORDS = re.compile(rf"(?=[ \n{MARK}])(?:(?<=[!-~\w])(?= [!-~\w]|\n)|(?<=[{LETTER}])(?=[{MARK}]))")
CROSSING = re.compile(rf"[{LETTER}][{MARK}]|[^\n]\n")
BEFORE = " a"  # goes through the tokenizers before a piece without a blank
BLANK = "▁"
END = "\n"
ROWS = 512


# The alignment of one piece of text: tokens of A, tokens of B, groups, the groups as text, and ``a * (ids of B) + b`` for
# each link, packed. A plain tuple of plain values, which the garbage collector leaves alone.
Aligned = tuple[int, int, int, str, bytes]
NOTHING: Aligned = (0, 0, 0, "", b"")


def byte_ends(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each token ends: at the end of its coarse span if that has the size of the token's bytes, else as many
    bytes after the last token for which it has."""
    clean = ends - begins == sizes
    reach = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(clean, np.arange(len(sizes)), -1))
    return np.where(last >= 0, ends[last] + reach - reach[last], reach)


class Aligner:
    """Both tokenizers, and the alignments of pieces that a task has seen: None where a side does not give the
    bytes of a piece back. Pieces are remembered in two generations; the older one is forgotten when the newer is full."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(Path(path_a).read_text(encoding="utf-8"))
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or spec["post_processor"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("side A has another pipeline than this alignment implements")
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding(), self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.base = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.base)]
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError("side B has pieces that cross a blank")
        from_text = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        crossed = any(map(CROSSING.search, from_text)) or not all(t["special"] for t in spec["added_tokens"])
        self.cut = BLANKS if crossed else WORDS
        byte = {c: i for i, c in enumerate(byte_chars())}
        bytes_a = {i: bytes(byte[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in byte for c in s)}
        # Added tokens stand for themselves; with encode_special_tokens none is made from a text.
        self.bytes = ([bytes_a.get(i, b"") for i in range(self.a.get_vocab_size())],
                      [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in self.bytes]
        # Every id of A and B as text before a token of its side, before the other side, before a group, and at the end.
        self.marks = [[f"{i}{mark}" for i in range(len(self.bytes[side])) for mark in marks] for side, marks in ((0, ",|"), (1, f",;{END}"))]
        self.new: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def pieces(self, wanted: Iterable[str]) -> dict[str, Aligned | None]:
        """The alignment of each of the given pieces."""
        out, missing, size, new, old = {}, [], 0, self.new, self.old
        for piece in wanted:
            if piece in new:
                out[piece] = new[piece]
            elif piece in old:
                out[piece] = self._keep(piece, old[piece])
            elif piece[0] == " " and not VISIBLE.match(piece, 1) or not VISIBLE.match(piece, len(piece) - 1):
                self._learn([piece], out)  # begins or ends a text with white space, which a neighbour would touch
            else:
                missing.append(piece)
                size += len(piece)
                if size > CHUNK:
                    self._learn(missing, out)
                    missing, size, new, old = [], 0, self.new, self.old
        self._learn(missing, out)
        return out

    def _keep(self, piece: str, made: Aligned | None) -> Aligned | None:
        if len(piece) <= LONG:
            if len(self.new) >= REMEMBERED:
                self.new, self.old = {}, self.new
            self.new[piece] = made
        return made

    def _learn(self, missing: list[str], out: dict) -> None:
        """Align new pieces, one after the other, in one call. If their bytes are not given back, halves are tried."""
        if not missing:
            return
        made = self.align(missing)
        if made is None and len(missing) > 1:
            half = len(missing) // 2
            self._learn(missing[:half], out)
            self._learn(missing[half:], out)
            return
        for piece, one in zip(missing, made or [None]):
            out[piece] = self._keep(piece, one)

    def align(self, pieces: list[str]) -> list[Aligned] | None:
        """The alignments of pieces, or None if a side does not give all bytes back."""
        spread, at = [], []
        for piece in pieces:
            if piece[0] != " ":
                spread.append(BEFORE)
            at.append(len(spread))
            spread.append(piece)
        text = "".join(spread)
        raw = text.encode()
        made, found = self.a.encode(text, add_special_tokens=False), [(p.id, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces]
        listed = [made.ids, [i for i, _ in found]]
        if any(b"".join(map(table.__getitem__, ids)) != raw for table, ids in zip(self.bytes, listed)):
            return None
        ids = [np.array(i, np.int64) for i in listed]
        # Spans of A count characters; those of B count bytes, begin where the one before ends, and leave out the blank before the text.
        spans = np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids[0])).reshape(-1, 2)
        if len(raw) != len(text):
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            spans = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])[spans]
        end_b = np.array([e for _, e in found], np.int64) + 1
        ends = [byte_ends(spans[:, 0], spans[:, 1], self.sizes[0][ids[0]]), byte_ends(np.concatenate([[0], end_b[:-1]]), end_b, self.sizes[1][ids[1]])]
        every = self._cut(spread, ids, ends)
        return [every[k] for k in at]

    def _cut(self, pieces: list[str], ids: list[np.ndarray], ends: list[np.ndarray]) -> list[Aligned]:
        """Groups and links from the cuts of both sides, piece by piece. Every piece ends with a common cut."""
        stops = np.cumsum([len(p.encode()) for p in pieces])
        ending = np.zeros((2, stops[-1] + 1), bool)
        for side in (0, 1):
            ending[side, ends[side]] = True
        before = np.cumsum(ending, axis=1) - ending  # tokens that end earlier
        every = np.flatnonzero(ending.any(axis=0))  # between two neighbours lies one A and one B token: a link
        pairs = ids[0][before[0, every]] * self.base + ids[1][before[1, every]]
        common = np.flatnonzero(ending.all(axis=0))
        group = [np.searchsorted(common, e) for e in ends]
        count = [np.bincount(g, minlength=len(common)) for g in group]
        # The last token of a side in its group has the mark that comes after the side.
        final = [ending[1 - side, ends[side]].astype(np.int64) for side in (0, 1)]
        final[1][before[1, stops]] = 2
        place = [np.arange(len(group[0])) + (np.cumsum(count[1]) - count[1])[group[0]], np.arange(len(group[1])) + np.cumsum(count[0])[group[1]]]
        shown = np.empty(len(ids[0]) + len(ids[1]), object)
        for side in (0, 1):
            marks = self.marks[side]
            shown[place[side]] = [marks[k] for k in (ids[side] * (2 + side) + final[side]).tolist()]
        groups = "".join(shown.tolist()).split(END)
        numbers = [np.diff(np.searchsorted(e, stops, side="right"), prepend=0).tolist() for e in (*ends, common)]
        at, links = [0, *(8 * np.searchsorted(every, stops, side="right")).tolist()], pairs.tobytes()
        return [(n_a, n_b, n_groups, shape, links[lo:hi]) for n_a, n_b, n_groups, shape, lo, hi in zip(*numbers, groups, at, at[1:])]

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """For each text n_a, n_b, n_groups, n_links, groups (None without tokens), its distinct pairs in ascending
        order and how often each is linked, both packed."""
        parts = [self.cut.split(" " + t) if t else [] for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(parts))
        number = dict(zip(distinct, range(len(distinct))))
        at = [list(map(number.__getitem__, own)) for own in parts]
        known = self.pieces(distinct)
        made = [known[p] for p in distinct]
        lost = {k for k, m in enumerate(made) if m is None}
        valid = [bool(own) and (not lost or lost.isdisjoint(own)) for own in at]
        made = [m or NOTHING for m in made]
        owner = np.repeat(np.arange(len(texts)), [len(own) if ok else 0 for own, ok in zip(at, valid)])
        piece = np.fromiter(chain.from_iterable(own for own, ok in zip(at, valid) if ok), np.int64, len(owner))
        links_of = [m[4] for m in made]
        sizes = np.fromiter(map(len, links_of), np.int64, len(made)) // 8
        flat = np.frombuffer(b"".join(links_of), np.int64)
        own_links = sizes[piece]
        # The links of all texts: the links of their pieces, one range after the other.
        where = np.repeat((np.cumsum(sizes) - sizes)[piece] - (np.cumsum(own_links) - own_links), own_links) + np.arange(int(own_links.sum()))
        # Text and pair in one number, so that one sort groups the links.
        span = len(self.bytes[0]) * self.base
        keys = np.sort(np.repeat(owner, own_links) * span + flat[where])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        often = np.diff(np.append(first, len(keys)))
        of, held = np.divmod(keys[first], span)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        total = [np.bincount(owner, np.array([m[k] for m in made], np.int64)[piece], len(texts)).astype(np.int64).tolist() for k in range(3)]
        links = np.bincount(of, often, len(texts)).astype(np.int64).tolist()
        shapes = [m[3] for m in made]
        out = []
        for t, (own, ok) in enumerate(zip(at, valid)):
            lo, hi = bounds[t], bounds[t + 1]
            out.append((*[c[t] for c in total], links[t], ";".join(map(shapes.__getitem__, own)) if ok else None,
                        held[lo:hi].astype("<i8").tobytes(), often[lo:hi].astype("<i4").tobytes()))
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2``;
    null without tokens), and the packed distinct ``pairs`` (little-endian 64-bit ``a * ids of B + b``, ascending) with
    their ``times`` (32-bit). Narrow, no shuffle."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    counts = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), *[T.StructField(n, T.LongType()) for n in counts],
                           T.StructField("groups", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                made = list(zip(*tool.texts(part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in made[:4]], pa.array(made[4], pa.string()),
                     pa.array(made[5], pa.binary()), pa.array(made[6], pa.binary())],
                    names=["_id", *counts, "groups", "pairs", "times"])

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column, and for each the row that it comes from."""
    values = column.to_pylist()
    numbers = np.frombuffer(b"".join(values), kind)
    return numbers, np.repeat(np.arange(len(values)), [len(v) // np.dtype(kind).itemsize for v in values])


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """``(pair, n, best)``: how many rows of ``aligned`` hold the pair, and whether no other pair of its A id is held
    by more. ``base`` is the number of ids of B."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(_flat(batch.column(0), "<i8")[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    counted = stage(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("pair") / base)
    top = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least power of two that at most ``limit`` pairs reach in their count, and those pairs with count and mark."""
    power = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    sizes = dict(counts.groupBy(power.alias("p")).count().collect())  # one row per power of two
    most = max(sizes, default=0)
    least, held = most + 1, 0
    for p in range(most, -1, -1):
        held += sizes.get(p, 0)
        if held > limit:
            break
        least = p
    rows = counts.where(F.col("n") >= 1 << least).orderBy("pair").toArrow()
    return 1 << least, *(rows.column(c).to_numpy() for c in ("pair", "n", "best"))


def link_strength(aligned: DataFrame, base: int, row_col: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``(row_col, n_best, count_sum)`` for each row of ``aligned`` that has links; ``row_col`` must be unique.

    ``n_best`` counts links whose pair is the most held of its A id, ``count_sum`` adds up the counts of all links."""
    counts = stage(pair_counts(aligned, base), "counts")
    least, pair, n, best = _frequent(counts, hot_pairs)
    packed = aligned.select(F.col(row_col).alias("_row"), "pairs", "times").where(F.length("pairs") > 0)

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        pairs, rows = _flat(batch.column(1), "<i8")
        times = _flat(batch.column(2), "<i4")[0]
        at = np.searchsorted(pair, pairs).clip(max=max(len(pair) - 1, 0))
        return pairs, rows, times, at, pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows, times, at, hot = split(batch)
            sums = []
            for weight in (times[hot] * best[at[hot]], times[hot] * n[at[hot]]):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, rows[hot], weight.astype(np.int64))
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], names=["_row", "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, rows, times, _, hot = split(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[~hot])), pa.array(pairs[~hot]), pa.array(times[~hot])],
                                             names=["_row", "pair", "times"])

    kind = packed.schema["_row"].dataType.simpleString()
    joined = packed.mapInArrow(rare, f"_row {kind}, pair long, times int").join(counts.where(F.col("n") < least), "pair")
    part = joined.select("_row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = packed.mapInArrow(frequent, f"_row {kind}, n_best long, count_sum long").unionByName(part)
    return both.groupBy(F.col("_row").alias(row_col)).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digest(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: the counts of ``align``, ``n_best`` and ``count_sum`` of ``link_strength``, and
    ``groups_sha256`` ('' without tokens)."""
    made = align(docs, path_a, path_b, id_col, text_col)
    made = made.withColumn("groups_sha256", F.coalesce(F.sha2("groups", 256), F.lit(""))).drop("groups").withColumn("_row", F.monotonically_increasing_id())
    made = stage(made, "aligned")
    strong = link_strength(made, aligner(path_a, path_b).base, "_row", hot_pairs)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return made.join(strong, "_row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
