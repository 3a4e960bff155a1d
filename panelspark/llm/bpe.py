"""BPE encoding with a priority queue of merge ranks over a doubly linked list, and decoding.

Reads a ``tokenizers`` JSON file whose pipeline is NFC, white space to one blank, lower case, a split
pattern, bytes as printable characters, and merges with an end-of-word suffix. Any other pipeline is
refused. The token ids are a packed binary column (little-endian unsigned 32-bit), the usual form of a
token file; ``sha2`` and ``length`` of Spark work on it directly.

Python's character tables are older than those of the library. A text with a character that they do not know, or order
otherwise, is normalized and cut by the library's own steps; its pieces are merged here like all others.

Defined results: a null text is an empty text (no ids, decoded text ''); a null id column in ``decode`` gives ''. Texts are never cut; ties between equal ranks go to the leftmost pair; repeated rows give
repeated results; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

CACHED_WORDS = 400_000  # texts and pieces remembered by one task; forgetting them changes no result
LONG_WORD = 64  # longer words are encoded each time, so that the memory of a task is bounded
ROWS_OUT = 512
# str.split() also cuts at the separators U+001C..U+001F, which are no white space for the pattern.
SEPARATORS, WHITE = regex.compile(r"[\x1c-\x1f]"), regex.compile(r"\p{White_Space}+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in visible}, 0x100
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Ranks, ids and the text pipeline of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError("the tokenizer file has another pipeline than this encoder implements")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.ids, **self.added}.items()}
        # In the regex module \s holds the separators U+001C..U+001F; the property does not.
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte = byte_chars()
        self.steps = Tokenizer.from_file(path)
        self.reordered = self._reordered()

    def _reordered(self) -> frozenset[str]:
        """Marks that the library's tables place otherwise beside another mark than Python's do."""
        marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M"]
        normal = self.steps.normalizer.normalize_str
        return frozenset(m for m in marks if any(normal(x) != unicodedata.normalize("NFC", x) for other in "\u0301\u0316\u0334" for x in (f"x{m}{other}", f"x{other}{m}")))

    def strange(self, text: str) -> bool:
        """Whether Python's tables are too old for a character of the text."""
        return not text.isascii() and any(c > "\x7f" and (unicodedata.category(c) == "Cn" or c in self.reordered) for c in set(text))

    def cut(self, text: str) -> list[str]:
        """Pieces of a strange text that holds no added token."""
        number = {c: b for b, c in enumerate(self.byte)}
        found = self.steps.pre_tokenizer.pre_tokenize_str(self.steps.normalizer.normalize_str(text))
        return [bytes(number[c] for c in piece).decode() for piece, _ in found]

    def words(self, text: str) -> list[str]:
        """Normalized text that holds no added token, cut at white space; no piece of the pattern spans a blank."""
        # Lower case is taken character by character, without the rule for a final sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return WHITE.split(text) if SEPARATORS.search(text) else text.split()

    def merge(self, word: str) -> list[int]:
        """Ids of one word. The heap holds (rank, position, right neighbour, pair); an entry is stale when
        either symbol has changed since it was pushed, and is skipped."""
        symbols: list[str | None] = [self.byte[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 1, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            if symbols[left] != pair[0] or symbols[right] != pair[1] or after[left] != right:
                continue
            symbols[left], symbols[right] = pair[0] + pair[1], None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            for i, j in ((before[left], left), (left, after[left])):
                if i >= 0 and j >= 0 and (r := rank.get((symbols[i], symbols[j]))) is not None:
                    heapq.heappush(heap, (r, i, j, (symbols[i], symbols[j])))
        return [self.ids[s] for s in symbols if s is not None and s in self.ids]


class _Words(dict):
    """Text between blanks -> (packed ids, decoded strings joined by a blank); filled on first use."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        pieces = self.vocabulary.pieces.findall(word)
        if len(pieces) == 1:
            out = self.piece(pieces[0])
        else:
            parts = [self.piece(p) for p in pieces]
            out = b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
        return self.keep(self, word, out)

    def piece(self, piece: str) -> tuple[bytes, str]:
        out = self.pieces.get(piece)
        if out is None:
            ids = self.vocabulary.merge(piece)
            strings = self.vocabulary.strings
            out = self.keep(self.pieces, piece, (struct.pack(f"<{len(ids)}I", *ids), " ".join([strings[i] for i in ids])))
        return out

    @staticmethod
    def keep(store: dict, key: str, out: tuple[bytes, str]) -> tuple[bytes, str]:
        if len(key) <= LONG_WORD:
            if len(store) >= CACHED_WORDS:
                store.clear()
            store[key] = out
        return out


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Vocabulary, _Words]:
    vocabulary = Vocabulary(path)
    return vocabulary, _Words(vocabulary)


def _entries(vocabulary: Vocabulary, cache: _Words, text: str) -> list[tuple[bytes, str]]:
    """The parts of a text in order, added tokens included, each as (packed ids, strings)."""
    def plain(part: str) -> list[tuple[bytes, str]]:
        if vocabulary.strange(part):
            return [cache.piece(p) for p in vocabulary.cut(part)]
        return [cache[w] for w in vocabulary.words(part) if w]

    out, at = [], 0
    for m in vocabulary.specials.finditer(text) if vocabulary.specials else ():
        out += plain(text[at:m.start()])
        out.append((struct.pack("<I", vocabulary.added[m[0]]), m[0]))
        at = m.end()
    return out + plain(text[at:] if at else text)


def encode_text(path: str, text: str | None) -> bytes:
    return b"".join(e[0] for e in _entries(*_loaded(path), text or ""))


def decode_ids(path: str, packed: bytes | None) -> str:
    strings = _loaded(path)[0].strings
    return " ".join(strings[i] for (i,) in struct.iter_unpack("<I", packed or b""))


def _mapped(df: DataFrame, id_col: str, col: str, outs: list[tuple[str, T.DataType]], rows) -> DataFrame:
    """``rows(values)`` gives for each value of ``col`` a tuple of the columns ``outs``; narrow, no shuffle."""
    source = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{col}`").alias("_value"))
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), *[T.StructField(n, t) for n, t in outs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(lo, ROWS_OUT)
                made = list(zip(*map(rows, part.column(1).to_pylist())))
                arrays = [pa.array(c, type={T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}[t])
                          for c, (_, t) in zip(made, outs)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["_id", *[n for n, _ in outs]])

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_tokens`` and the packed ``ids``."""
    def rows(text):
        packed = encode_text(path, text)
        return len(packed) // 4, packed

    return _mapped(docs, id_col, text_col, [("n_tokens", T.LongType()), ("ids", T.BinaryType())], rows)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: the id and the ``decoded`` text, vocabulary strings set off by blanks."""
    return _mapped(encoded, id_col, ids_col, [("decoded", T.StringType())], lambda packed: (decode_ids(path, packed),))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: id, ``n_tokens``, ``ids``, ``decoded``."""
    def rows(text):
        entries = _entries(*_loaded(path), text or "")
        packed = b"".join([e[0] for e in entries])
        return len(packed) // 4, packed, " ".join([e[1] for e in entries])

    return _mapped(docs, id_col, text_col, [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.StringType())], rows)
