"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, logistic over hashed byte n-grams, predicts
whether the bit is set. A text gets the language whose codeword has the smallest loss over all bits, each
bit weighted by how reliable its classifier was on rows kept back from its fit. If the second codeword is
nearly as close, the text is flagged as ambiguous.

The classifiers are fitted on up to ``per_lang`` labelled documents of each language (whole texts, first by
hash of the id); everything else reads all rows. Scoring is one narrow pass over whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; null labels are not learned;
without any labelled text everything is ``und``, with one language everything that has a letter is that
one. Ties go to the language that sorts first. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.sampling import held_out, sample_ids

DIMS = 1 << 13
LETTER = regex.compile(r"\p{L}")
# ASCII letters in lower case, bytes of other characters as they are, anything else a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Square roots of the counts of hashed byte 1-, 2- and 3-grams, of unit length."""
    a = np.frombuffer(b" " + b" ".join(text.translate(TABLE).split()) + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] * 257 + a[1:]
    counts = np.bincount(a, minlength=256)
    out = np.bincount(two * np.uint32(2654435761) >> np.uint32(32 - 13), minlength=DIMS)
    out += np.bincount((two[:-1] * 257 + a[2:]) * np.uint32(2246822519) + np.uint32(77) >> np.uint32(32 - 13), minlength=DIMS)
    out[:256] += counts
    x = np.sqrt(out, dtype=np.float32)
    return x / (np.linalg.norm(x) or 1)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A matrix of +1 and -1, one row per class. Up to five classes get every distinct split, more get random
    balanced splits, the best of several draws by the least distance between rows."""
    if classes <= 5:
        return np.array([[1 if (b >> c) & 1 == 0 else -1 for b in range(2, 1 << classes, 2)] for c in range(classes)]).reshape(classes, -1)
    rng, bits = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(classes))))
    best, far = None, -1
    for _ in range(200):
        code = np.stack([rng.permutation(np.where(np.arange(classes) < classes // 2, 1, -1)) for _ in range(bits)], axis=1)
        least = min((bits - code[i] @ code[:i].T).min() for i in range(1, classes))
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # classes x bits
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, sums to the number of bits

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Rows x classes: logistic loss of the bits against each codeword, weighted by trust."""
        margin = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(axis=1) for row in self.code], axis=1)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], rounds: int = 250, seed: int = 7) -> Model:
    """``y`` numbers the languages. A fifth of the rows only measures how far each bit can be trusted."""
    code = codewords(len(langs)).astype(np.float32)
    rng = np.random.default_rng(seed)
    back = rng.random(len(y)) < 0.2
    own = np.flatnonzero(~back) if (~back).any() else np.arange(len(y))
    # Every language counts alike, however many rows it has.
    share = 1 / np.bincount(y, minlength=len(langs)).clip(1)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, step = [np.zeros_like(p) for p in (w, b)], [np.zeros_like(p) for p in (w, b)], 0
    for _ in range(rounds):
        take = rng.choice(own, min(512, len(own)), replace=False)
        rows, goal, weight = x[take], code[y[take]], share[y[take]]
        margin = rows @ w + b
        slope = -goal / (1 + np.exp(goal * margin)) * (weight / weight.sum())[:, None]
        step += 1
        for i, (p, g) in enumerate(((w, rows.T @ slope + 1e-6 * w), (b, slope.sum(axis=0)))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p -= (0.3 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    kept = np.flatnonzero(back) if back.any() else own
    right = ((x[kept] @ w + b > 0) == (code[y[kept]] > 0)).mean(axis=0).clip(0.51, 0.999) if code.shape[1] else np.ones(0)
    trust = np.log(right / (1 - right))
    return Model(langs, code, w, b, (trust / trust.mean()).astype(np.float32) if len(trust) else trust)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1000) -> Model | None:
    """Fit on the documents that are not held out; only their features come to the driver, ``per_lang`` of each language at most."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text"))
    labelled = rows.where(~held_out("_id") & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    chosen = sample_ids(labelled, "_lang", "_id", per_lang)
    # Rows that repeat an id count once, with the language and text that sort first.
    one = labelled.join(chosen.select("_id").distinct(), "_id").groupBy("_id").agg(F.min(F.struct("_lang", "_text")).alias("_r"))
    texts = one.select("_r._lang", F.col("_r._text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column(1).to_pylist():
                x = features(value)
                at = np.flatnonzero(x)
                made.append(at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes() if LETTER.search(value.decode()) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["lang", "x"])

    found = texts.mapInArrow(run, "lang string, x binary").where("x IS NOT NULL").orderBy("lang", F.xxhash64("x")).collect()
    if not found:
        return None
    langs = sorted({r.lang for r in found})
    x = np.zeros((len(found), DIMS), np.float32)
    for i, r in enumerate(found):
        n = len(r.x) // 6
        x[i, np.frombuffer(r.x, "<u2", n)] = np.frombuffer(r.x, "<f4", n, 2 * n)
    return fit(x, np.array([langs.index(r.lang) for r in found]), langs)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred``, ``score`` (share of the best language, 0 to 1) and
    ``ambiguous`` (the second language is less than ``margin`` behind)."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t if t and model and LETTER.search(t.decode()) else None for t in part.column(1).to_pylist()]
                known = [i for i, t in enumerate(texts) if t]
                lang, score, flag = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
                if known:
                    loss = model.losses(np.stack([features(texts[i]) for i in known]))
                    odds = np.exp(loss.min(axis=1, keepdims=True) - loss).astype(np.float64)
                    odds /= odds.sum(axis=1, keepdims=True)
                    first = odds.argmax(axis=1)
                    order = np.sort(odds, axis=1)
                    for k, i in enumerate(known):
                        lang[i], score[i] = model.langs[first[k]], float(odds[k, first[k]])
                        flag[i] = bool(len(model.langs) > 1 and order[k, -1] - order[k, -2] < margin)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())],
                                                 names=["_id", "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
