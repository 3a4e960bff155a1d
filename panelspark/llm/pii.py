"""Personal data by weak supervision.

Base spans follow fixed patterns (email, ip, card, phone) and always stay. Further candidates are looser:
phone numbers without a plus sign, spelled-out email addresses, social security numbers, bank account numbers whose
check digits are right, and secrets: values of 16 characters or more that are assigned to a name, hold letters and
digits, and have ``ENTROPY`` bits a character. Six labelers vote
on every candidate, base spans included: shape (regular expressions), gazetteers of words that announce or
rule out the kind, and context around the span; each votes for, against, or not at all.

Expectation-maximisation over the counts of vote patterns of the whole corpus estimates how reliable each
labeler is for each kind and how likely each pattern is to be personal data. With these as soft labels a
logistic span classifier is fitted on features of the span and its surroundings; it decides about the
further candidates. Both fits read counts of distinct patterns, summed in Spark: at most 3^6 patterns of
votes times 2^9 of features for each kind can come to the driver, whatever the size of the corpus.

Defined results: a null text is an empty text and has no span. Overlapping further candidates: the leftmost
stays, and none that overlaps a base span is taken. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
ENTROPY = 2.8  # of a candidate for a secret; words and counters have less
LABELERS = 6

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")
# A digit before the start would be part of the same match, so the guards only save time on long runs of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)+"),
    "phone": re.compile(r"(?<![0-9+.(/-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"""(?<=[\w"'\])])\s?[:=]\s?["']?([A-Za-z0-9+_=-][A-Za-z0-9+/_=-]{15,})"""),
}
CUES = {  # fixed values: words that announce a kind
    "email": {"email", "e-mail", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "from", "login"},
    "card": {"card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "cell", "telefon", "teléfono", "téléphone", "whatsapp"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank", "transfer", "cuenta", "banco", "konto", "compte", "virement"},
    "secret": {"token", "secret", "password", "passwd", "pwd", "pass", "key", "apikey", "auth", "authorization", "credential", "credentials", "bearer", "private", "signature",
               "clave", "contraseña", "passwort", "kennwort", "jeton"},
}
DIGESTS = {"sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "commit", "revision", "etag", "uuid", "guid", "class", "href", "src", "id"}  # fixed values: long codes that are no secrets
AGAINST = {"version", "isbn", "page", "pages", "figure", "section", "chapter", "order", "invoice", "no", "number", "ratio", "score", "id", "code", "price"}
YEAR = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def checked(account: str) -> bool:
    """Whether the check digits of a bank account number are right: letters as numbers from 10, modulo 97."""
    code = account.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def entropy(value: str) -> float:
    """Bits a character of the characters' own counts."""
    n = np.array(list(Counter(value).values())) / len(value)
    return float(-(n * np.log2(n)).sum())


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out["email"].append((begin, done := m.end()))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            number = digits(m[0])
            if 13 <= len(number) <= 19 and luhn(number):
                out["card"].append(m.span())
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def loose_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Further candidates, leftmost first, that overlap neither a base span nor each other."""
    found = []
    kinds = ["phone", "ssn", "iban", "secret"] if DIGIT.search(text) else []
    if "dot" in text:
        kinds.append("email")
    for kind in kinds:
        for m in LOOSE[kind].finditer(text):
            if kind == "secret":
                value = m[1]
                holds = any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= ENTROPY
                if holds:
                    found.append((*m.span(1), kind))
            elif kind == "email" or (checked(m[0]) if kind == "iban" else 9 <= len(digits(m[0])) <= 15):
                found.append((m.start(), m.end(), kind))
    taken = sorted(chain.from_iterable(base.values()))
    out, end, i = [], 0, 0
    # Of candidates over the same characters the stricter pattern holds; that of phone numbers is the loosest.
    for a, b, kind in sorted(found, key=lambda f: (f[0], -f[1], f[2] == "phone", f[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and (i == len(taken) or taken[i][0] >= b):
            out.append((kind, a, b))
            end = b
    return out


def evidence(text: str, kind: str, begin: int, end: int) -> tuple[int, int]:
    """Votes in base 3 (0 none, 1 against, 2 for) and features as bits of one span."""
    span, before, after = text[begin:end], text[max(0, begin - 48):begin], text[end:end + 24]
    words = re.findall(r"[^\W\d_][\w-]*", before.lower())[-4:]
    n, near = len(digits(span)), set(words)
    if kind == "secret":  # the name that the value is assigned to, in its parts
        near = {part for w in words[-2:] for part in re.split(r"[_-]+", w)}
    hexadecimal, mixed = not set(span.lower()) - set("0123456789abcdef"), span != span.lower() and span != span.upper()
    shape = {"email": "@" in span, "ip": True, "card": n in (15, 16), "phone": span[0] in "+(" or n in (10, 11), "ssn": not span.startswith(("000", "666", "9")),
             "iban": len(span) >= 18, "secret": hexadecimal or mixed}[kind]
    cue, ruled = bool(near & CUES[kind]), bool(near & (DIGESTS if kind == "secret" else AGAINST))
    closed = not (after[:1].isalnum() or before[-1:].isalnum())
    number_next = bool(re.match(r"\s*[0-9]", after)) or bool(re.search(r"[0-9]\s*$", before))
    currency = bool(re.search(r"[$€£%#=]\s*$", before)) or bool(re.match(r"\s*[%€$£]", after))
    year = bool(YEAR.search(span)) and kind in ("phone", "ssn")
    parts = {len(p) for p in re.split(r"[^0-9]+", span) if p}
    even = len(parts) == 1 and kind == "phone" or kind == "secret" and not 0.05 <= n / len(span) <= 0.95
    votes = (2 if shape else 1, 2 if cue else 0, 1 if ruled else 0, 0 if closed and not number_next else 1, 1 if currency or year else 0, 1 if even else 2)
    features = (shape, cue, ruled, closed, number_next, currency, year, even, "(" in span or "+" in span or "@" in span)
    return sum(v * 3 ** i for i, v in enumerate(votes)), sum(1 << i for i, f in enumerate(features) if f)


FEATURES = 9


def unpack_votes(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3 ** i % 3 for i in range(LABELERS)], axis=1)


def unpack_features(features: np.ndarray) -> np.ndarray:
    bits = np.stack([features >> i & 1 for i in range(FEATURES)], axis=1)
    return np.concatenate([bits, np.ones((len(features), 1))], axis=1).astype(float)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and the probabilities (labeler, truth, vote). Starts from the majority of votes."""
    v = unpack_votes(votes)
    post = 1 / (1 + np.exp((v == 1).sum(axis=1) - (v == 2).sum(axis=1) - 0.5))
    table = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        truth = np.stack([(1 - post) * counts, post * counts])
        share = (truth.sum(axis=1) + 1) / (counts.sum() + 2)
        for i in range(LABELERS):
            for k in range(3):
                table[i, :, k] = truth[:, v[:, i] == k].sum(axis=1) + 1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(share)[:, None] + sum(np.log(table[i][:, v[:, i]]) for i in range(LABELERS))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table


def fit_classifier(features: np.ndarray, post: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic weights (Newton, slight ridge) for soft labels."""
    x, w = unpack_features(features), np.zeros(FEATURES + 1)
    share = counts / counts.sum() * 1000
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (post - p)) - w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


Model = dict[str, np.ndarray]  # weights by kind


def _candidates(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, loose_spans(text, base)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Votes and features are counted over all documents; nothing but their counts reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    base, loose = _candidates(text)
                    spans = [(k, a, b) for k, found in base.items() for a, b in found] + loose
                    seen.update((k, *evidence(text, k, a, b)) for k, a, b in spans)
            rows = sorted(seen.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), *[pa.array([k[i] for k, _ in rows], pa.int64()) for i in (1, 2)],
                 pa.array([n for _, n in rows], pa.int64())], names=["kind", "votes", "features", "n"])

    texts = docs.select(F.col(f"`{text_col}`").alias("_text"))
    counted = texts.mapInArrow(run, "kind string, votes bigint, features bigint, n bigint").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    by_kind = defaultdict(list)
    for r in counted.orderBy("kind", "votes", "features").collect():
        by_kind[r.kind].append((r.votes, r.features, r.n))
    model = {}
    for kind, rows in by_kind.items():
        votes, features, n = (np.array(c) for c in zip(*rows))
        post, _ = expectation_maximisation(votes, n.astype(float))
        model[kind] = fit_classifier(features, post, n.astype(float))
    return model


def find(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (kind, begin, end, base) in the order of kinds, then begin."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), T.StructField("spans", T.ArrayType(item))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def spans(text: str) -> list[dict]:
        base, loose = _candidates(text)
        out = [(k, a, b, True) for k, found in base.items() for a, b in found]
        for k, a, b in loose:
            if k in model and 1 / (1 + np.exp(-unpack_features(np.array([evidence(text, k, a, b)[1]])) @ model[k]))[0] >= threshold:
                out.append((k, a, b, False))
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        return [dict(zip(("kind", "begin", "end", "base"), s)) for s in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [spans(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, arrow)], names=["_id", "spans"])

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
