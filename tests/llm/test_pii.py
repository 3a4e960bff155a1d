"""Base spans against the plain patterns, the fits, and the query as a whole."""

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "card":
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        return 13 <= len(d) <= 19 and odd % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "phone": 9 <= len(d) <= 15}[kind]


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "x", "_", "-", " ", "+", "1", "25", "255.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "é", "\n", "(", "9999999", "a.b", "256.1.1.1"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    got = pii.base_spans(text)
    assert {k: got[k] for k in PATTERNS} == plain(text)


def test_long_texts():
    for text in ("a" * 300000 + "@", "1" * 200000, "1." * 100000, "+" * 100000 + "1" * 1000, "a@" * 50000, "1 " * 100000, "word at " * 30000):
        pii._candidates(text)


def test_expectation_maximisation():
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.4
    right = [0.9, 0.85, 0.8, 0.7, 0.6, 0.95]
    v = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where((rng.random(20000) < r) == truth, 2, 1)) for r in right], axis=1)
    packed = (v * 3 ** np.arange(6)).sum(axis=1)
    keys, inverse, n = np.unique(packed, return_inverse=True, return_counts=True)
    post, table = pii.expectation_maximisation(keys, n.astype(float))
    assert ((post[inverse] > 0.5) == truth).mean() > 0.95
    assert np.abs(table[:, 1, 2] / (1 - table[:, 1, 0]) - right).max() < 0.05


def test_further_spans(spark):
    rows = [(i, f"call me on +1 (743) 555-38{i % 90 + 10} or mail joe{i}@mail.example.com today", "x") for i in range(200)]
    rows += [(500, "my phone (743) 555-3824 is on", "x"), (501, "in 1999-2003 2004-2005 values", "x"), (502, None, "x"), (503, "", "x"), (None, "a@b.c", None), (504, "plain words only", "x"), (0, "again 1.2.3.4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(docs, pii.train(docs)).collect()
    by = {r.doc_id: [(s.kind, s.begin, s.end, s.base) for s in r.spans] for r in got if r.doc_id}
    assert len(got) == len(rows) and by[500] == [("phone", 9, 23, False)]
    assert by[501] == by[502] == by[503] == by[504] == []
    assert by[7][0][0] == "email" and by[7][1][0] == "phone" and all(s[3] for s in by[7])
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0
    assert pii.redact(rows[200][1], [("phone", 9, 23)]) == "my phone [phone] is on"


# (text, kind and value of the spans that the method must add). Written by hand.
LABELLED = [
    ("call my office phone (743) 555-3824 before noon", [("phone", "(743) 555-3824")]), ("tel 212 555 0187 for tickets", [("phone", "212 555 0187")]),
    ("mobile 646.555.0143, evenings", [("phone", "646.555.0143")]), ("Telefon (030) 555 0199 bitte", [("phone", "(030) 555 0199")]),
    ("fax: 415-555-0133", [("phone", "415-555-0133")]), ("whatsapp 305 555 0170 now", [("phone", "305 555 0170")]),
    ("between 1999-2003 2004-2005 values rose", []), ("see pages 120-125 130-135 of it", []), ("version 2010 2011 2012 was withdrawn", []),
    ("write to joe.doe (at) mail (dot) example (dot) com", [("email", "joe.doe (at) mail (dot) example (dot) com")]),
    ("contact ann[at]corp[dot]org soon", [("email", "ann[at]corp[dot]org")]), ("my mail is eva at web dot de", [("email", "eva at web dot de")]),
    ("ssn 536-22-8713 on file", [("ssn", "536-22-8713")]), ("her social security is 219-09-9999", [("ssn", "219-09-9999")]), ("social 457-55-5462 given", [("ssn", "457-55-5462")]),
    ("iban DE89 3704 0044 0532 0130 00 please", [("iban", "DE89 3704 0044 0532 0130 00")]), ("bank account GB82WEST12345698765432", [("iban", "GB82WEST12345698765432")]),
    ("cuenta ES91 2100 0418 4502 0005 1332 hoy", [("iban", "ES91 2100 0418 4502 0005 1332")]), ("iban DE88 3704 0044 0532 0130 00 is wrong", []),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]),
    ("api_key: sk9fJ2kLmQ8rT5vXwZ1bC4dE7gH0", [("secret", "sk9fJ2kLmQ8rT5vXwZ1bC4dE7gH0")]), ("password='Tr0ub4dor3xKq9ZpLmN2'", [("secret", "Tr0ub4dor3xKq9ZpLmN2")]),
    ("client_secret=9f86d081884c7d659a2feaa0c55ad015 ok", [("secret", "9f86d081884c7d659a2feaa0c55ad015")]), ("auth-token: 7c4a8d09ca3762af61e59520943dc264", [("secret", "7c4a8d09ca3762af61e59520943dc264")]),
    ("commit: 7c4a8d09ca3762af61e59520943dc26494f8941b fixed it", []), ("sha256=9f86d081884c7d659a2feaa0c55ad0159f86d081", []), ("name = aaaaaaaaaaaaaaaaaaaa1", []),
    ("key = internationalization", []), ("a ratio of 1:1000000000000000000 holds", []), ("plain words and 12 numbers 345", []),
]


def test_added_spans_against_hand_labels(spark):
    """Recall and precision of the added spans by kind; the method learns from the unlabelled texts alone."""
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELLED * 8)], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, LABELLED[r.doc_id][0][s.begin:s.end]) for s in r.spans if not s.base] for r in pii.find(docs, pii.train(docs)).where(f"doc_id < {len(LABELLED)}").collect()}
    right, wanted, given = Counter(), Counter(), Counter()
    for i, (_, spans) in enumerate(LABELLED):
        wanted.update(k for k, _ in spans)
        given.update(k for k, _ in found[i])
        right.update(k for k, _ in set(spans) & set(found[i]))
    shown = {k: (right[k], wanted[k], given[k]) for k in wanted}
    assert all(right[k] >= 0.9 * wanted[k] for k in wanted), shown
    assert sum(right.values()) >= 0.9 * sum(given.values()), (shown, {LABELLED[i][0]: f for i, f in found.items() if set(f) != set(LABELLED[i][1])})


def test_checks_of_candidates():
    assert pii.checked("GB82 WEST 1234 5698 7654 32") and not pii.checked("GB83 WEST 1234 5698 7654 32") and not pii.checked("GB82WEST1234")
    assert pii.entropy("aaaa") == 0 and pii.entropy("abcd") == 2
    assert pii._candidates('x="' + "a1" * 40 + '"')[1] == []
    assert [k for k, *_ in pii._candidates("iban DE89370400440532013000 token=0123456789abcdef01")[1]] == ["iban", "secret"]


def test_secrets_of_the_documents(spark):
    """Every assigned code of forty hexadecimal digits is found; base columns do not change."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spans = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("secret:")} for r in queries.op7_pii(spark, folder).collect()}
    total = 0
    for d in docs.collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', d.text or ""):
            total += 1
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans[d.doc_id]
    assert total > 5


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op7_pii(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = plain(d.text or ""), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PATTERNS]
        base = [f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
