"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

A text is cut into units: words with marked ends, and runs of single letters read as one word. The kernel
of two units counts their common subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the
length of the span it covers in either unit (``SPAN`` characters at most), so that gaps and inserted
characters cost weight but not the match. Similarities to the landmark units, whitened by the landmarks'
own kernel matrix, are the features of a linear machine with squared hinge loss.

The kernel is an inner product over subsequences, so once fitted the machine is a table with one number
per subsequence: a unit is scored with table lookups, whatever the number of landmarks.

Training: labels are known for documents, insults sit in few of their sentences. Sentences of clean
documents are clean. A sentence of a toxic document is taken as toxic if it holds a unit that marks toxic
documents in the counts, then, in the next rounds, if the machine of the round before says so. A document
scores by its strongest sentence and how many units it had to be strong in; that is turned into a
probability on documents that the machine has not seen.

The fit uses up to ``per_label`` labelled documents of either label (whole texts, first by hash of the id).
Scoring is one narrow pass over whole texts.

Defined results: a null text is an empty text; it has no unit and gets the score of a text in which nothing
was found. Without both labels every score is 0. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.sampling import held_out, sample_ids

ORDER, DECAY, SPAN = 4, 0.6, 8
SURE = 0.3  # a unit scored higher by the machine of the round before marks its sentence as toxic
LETTERS = 40  # 0: none; 1-26: a-z; 27: start; 28: end; 29-39: any other letter, by its code point
CUT = regex.compile(r"[.!?]+(?=\s|$)|\n")
MARKS = regex.compile(r"[^\p{L}\s]+")
SPELLED = re.compile(r" \S(?: \S){2,}(?= )")
REMEMBERED = 400_000


def fold(text: str) -> str:
    """Lower case, letters and blanks only; accents and marks within words are taken out, so one letter has one code."""
    return MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))


def units(folded: str) -> list[str]:
    """Words, and runs of three or more single letters also as one word."""
    words = folded.split()
    return words + [m[0].replace(" ", "") for m in SPELLED.finditer(f" {' '.join(words)} ")]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words in one array, each word between its end marks, and the word of each place."""
    joined = ("{" + "}{".join(words) + "}").encode("utf-32-le")
    points = np.frombuffer(joined, "<u4")
    out = np.where((points >= 97) & (points <= 124), points - 96, 29 + points % 11).astype(np.int64)  # { is 27
    out[points == 125] = 28
    return out, np.cumsum(out == 27) - 1


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each choice of offsets within the span: the words, the numbers of their subsequences, and the weight."""
    if not words:
        return
    letter, word = codes(words)
    for rest in combinations(range(1, SPAN), ORDER - 1):
        n = len(letter) - rest[-1]
        if n <= 0:
            continue
        key = letter[:n]
        for d in rest:
            key = key * LETTERS + letter[d:d + n]
        inside = word[:n] == word[rest[-1]:]
        yield word[:n][inside], key[inside], DECAY ** (rest[-1] + 1)


def norms(words: list[str]) -> np.ndarray:
    """Root of the summed squared weights: the norm of a word whose subsequences are all different."""
    total = np.zeros(len(words))
    for word, key, weight in subsequences(words):
        total += np.bincount(word, minlength=len(words)) * weight ** 2
    return np.sqrt(total) + 1e-9


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normed gap-weighted subsequence kernel, words x landmarks."""
    place: dict[int, int] = {}
    marks = []
    for word, key, weight in subsequences(landmarks):
        marks.append((word, np.array([place.setdefault(int(k), len(place)) for k in key], np.int64), weight))
    side = np.zeros((len(landmarks), len(place) + 1), np.float32)
    for word, at, weight in marks:
        np.add.at(side, (word, at), weight)
    side /= norms(landmarks)[:, None]
    known = np.array(sorted(place), np.int64)
    slot = np.array([place[int(k)] for k in known], np.int64)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(words), 1000):
        part = words[lo:lo + 1000]
        own = np.zeros((len(part), len(place) + 1), np.float32)
        for word, key, weight in subsequences(part):
            at = np.searchsorted(known, key).clip(max=max(len(known) - 1, 0))
            hit = known[at] == key if len(known) else np.zeros(len(key), bool)
            np.add.at(own, (word[hit], slot[at[hit]]), weight)
        out[lo:lo + 1000] = own @ side.T / norms(part)[:, None]
    return out


@dataclass
class Machine:
    keys: np.ndarray  # sorted subsequence numbers
    values: np.ndarray
    bias: float
    slope: np.ndarray = None  # of (strongest, log units, 1) for the probability of a document

    def scores(self, words: list[str]) -> np.ndarray:
        table = np.zeros(LETTERS ** ORDER, np.float32)
        table[self.keys] = self.values
        return score_units(table, self.bias, words)


def score_units(table: np.ndarray, bias: float, words: list[str]) -> np.ndarray:
    total, square = np.zeros(len(words)), np.zeros(len(words))
    for word, key, weight in subsequences(words):
        total += np.bincount(word, table[key], minlength=len(words)) * weight
        square += np.bincount(word, minlength=len(words)) * weight ** 2
    return total / (np.sqrt(square) + 1e-9) + bias


def fit_machine(positive: list[str], worth: np.ndarray, negative: list[str], landmarks: list[str], cost: float = 1.0) -> Machine:
    """``worth`` weights the positive units; both sides have the same total weight."""
    own = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh(own + 1e-6 * np.eye(len(own)))
    keep = value > 1e-4
    white = vector[:, keep] / np.sqrt(value[keep])
    x = np.concatenate([kernel(positive, landmarks), kernel(negative, landmarks)]) @ white
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = cost * len(y) / 2 * np.concatenate([worth / worth.sum(), np.full(len(negative), 1 / len(negative))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton steps of the squared hinge
        gap = 1 - y * (x @ w)
        hot = gap > 0
        a = x[hot] * weight[hot, None]
        new = np.linalg.solve(ridge + a.T @ x[hot], a.T @ y[hot])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    mix = white @ w[:-1] / norms(landmarks)
    total: Counter = Counter()
    for word, key, span in subsequences(landmarks):
        for k, v in zip(key.tolist(), (mix[word] * span).tolist()):
            total[k] += v
    keys = np.array(sorted(total), np.int64)
    return Machine(keys, np.array([total[int(k)] for k in keys], np.float32), float(w[-1]))


def _excess(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log likelihood ratio of the observed share of toxic documents against the share among all, if it is higher."""
    total, usual = toxic + clean, n_toxic / (n_toxic + n_clean)
    if toxic <= usual * total:
        return 0.0
    share = toxic / total
    return toxic * np.log(share / usual) + (clean * np.log((1 - share) / (1 - usual)) if clean else 0.0)


def _forms(unit: str) -> list[str]:
    """A unit and its beginnings: evidence on a stem adds up over its endings."""
    return [unit, *(unit[:k] + "-" for k in range(4, min(8, len(unit))))]


def _disturbed(unit: str) -> str:
    """The unit with one letter more within it, at a place and with a letter that depend on the unit alone."""
    at = zlib.crc32(unit.encode())
    place = 1 + at % max(1, len(unit) - 1)
    return unit[:place] + "abcdefghijklmnopqrstuvwxyz"[at // 97 % 26] + unit[place:]


def _spread(words: list[str], most: int) -> list[str]:
    """Up to ``most`` words, evenly over the order given."""
    return [words[i] for i in np.unique(np.linspace(0, len(words) - 1, min(most, len(words))).astype(int))] if words else []


def fit(toxic: list[str], clean: list[str], landmarks: int = 200, rounds: int = 2) -> Machine | None:
    """``toxic`` and ``clean`` are whole texts. Two thirds fit the machine, one third the probabilities."""
    if not toxic or not clean:
        return None
    own = [([units(fold(s)) for s in CUT.split(t)], label) for label, texts in ((1, toxic), (0, clean))
           for i, t in enumerate(texts) if i % 3 or len(texts) < 3]
    seen = {1: Counter(), 0: Counter()}
    for sentences, label in own:
        seen[label].update({form for s in sentences for u in s for form in _forms(u)})
    n = {k: max(1, sum(label == k for _, label in own)) for k in (0, 1)}
    excess = {u: _excess(c, seen[0][u], n[1], n[0]) for u, c in seen[1].items()}
    sure = np.log(len(excess) + 1) + 5  # by chance, less than one unit in a hundred corpora is that frequent in toxic documents
    vocabulary = {u for sentences, _ in own for s in sentences for u in s}
    excess |= {u: max(excess.get(form, 0.0) for form in _forms(u)) for u in vocabulary if u in seen[1]}
    marks = {u for u in vocabulary if excess.get(u, 0.0) > sure and 8 * seen[0][u] * n[1] <= seen[1][u] * n[0]} or set(sorted(vocabulary & excess.keys(), key=lambda u: (-excess[u], u))[:20])
    if not marks:
        return None
    usual = [u for u, _ in sorted(((u, seen[0][u]) for u in vocabulary if seen[0][u]), key=lambda x: (-x[1], x[0]))]
    negative = usual[:1500] + _spread(usual[1500:], 6000)
    hard: set[str] = set()
    machine = None
    for r in range(rounds):
        strong = sorted(marks, key=lambda u: (-excess[u], u))[:3000]
        base = strong[:landmarks * 3 // 4] + _spread(usual[:3000], landmarks // 4)
        worth = np.array([excess[u] for u in strong])
        strong, worth = strong + [_disturbed(u) for u in strong], np.concatenate([worth, worth / 2])
        machine = fit_machine(strong, worth, sorted({*negative, *hard} - marks), list(dict.fromkeys(base)))
        if r + 1 < rounds:
            words = sorted(vocabulary)
            score = dict(zip(words, machine.scores(words).tolist()))
            marks = {u for u in vocabulary & seen[1].keys() if score[u] > SURE and excess[u] > 0.9 and not seen[0][u]} | {u for u in marks if score[u] > 0}
            hard = set(sorted((u for u in vocabulary if seen[0][u] and score[u] > -0.8 and u not in marks), key=lambda u: (-score[u], u))[:6000])
    scorer, texts = Scorer(machine), [(t, 1) for t in toxic[::3]] + [(t, 0) for t in clean[::3]]
    machine.slope = _logistic(scorer.summaries([t for t, _ in texts]), np.array([label for _, label in texts], float))
    return machine


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a logistic fit with a slight ridge; both labels count alike."""
    w, weight = np.zeros(x.shape[1]), np.where(y > 0, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) * len(y) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """A fitted machine within one task, with the scores of the units it has met."""

    def __init__(self, machine: Machine):
        self.table = np.zeros(LETTERS ** ORDER, np.float32)
        self.table[machine.keys] = machine.values
        self.bias, self.slope = machine.bias, machine.slope
        self.known: dict[str, float] = {}

    def summaries(self, texts: list[str]) -> np.ndarray:
        """Of each text: the score of its strongest unit, the log of how many units there were, and 1."""
        parts = [units(fold(t)) for t in texts]
        new = set().union(*parts) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*parts)
        new = list(new)
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            self.known.update(zip(part, score_units(self.table, self.bias, part).tolist()))
        get = self.known.__getitem__
        return np.array([(max(map(get, p), default=-2.0), np.log1p(len(p)), 1.0) for p in parts]).reshape(-1, 3)

    def __call__(self, texts: list[str]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.summaries(texts) @ self.slope, -30, 30)))).tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 2500) -> Machine | None:
    """Fit on labelled documents that are not held out; ``per_label`` texts of either label come to the driver at most."""
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    chosen = sample_ids(known.where(~held_out("_id") & F.col("_id").isNotNull()), "_label", "_id", per_label).where("_label IN (0, 1)")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where(F.col("_text").isNotNull())
    # At most per_label ids of either label, so the ids go to the texts and not the texts to the ids.
    # Rows that repeat an id count once, with the text that sorts first.
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_label", "_id").agg(F.min("_text").alias("_text"))
    found = sorted(one.select("_label", F.xxhash64("_id").alias("_h"), "_text").collect())
    return fit([r._text for r in found if r._label == 1], [r._text for r in found if r._label == 0])


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``score``, 0 to 1."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine) if machine else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                made = scorer(texts) if scorer else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.float64())], names=["_id", "score"])

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
