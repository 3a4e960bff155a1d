"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured and tried against a few rules. Failures are counted by host, the rate of each
rule is shrunk by a beta prior that is estimated from all hosts (method of moments, so a host with few
documents stays near the common rate), and a host whose shrunk rate passes the limit is rejected with all
its documents.

Scale: the texts are read once, in one narrow projection; what is kept is a row of numbers, staged. Hosts
are counted with partial sums, so one host with a third of all rows costs no more than another; the join
back to documents moves numbers only, and AQE splits the hot host.

Defined results: a null text has no words and no lines, so it fails the rule on few words. A null host is
no host: its documents get the document rules only. Repeated rows count as often as they occur and each
keeps its row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.scalars import with_scalars
from panelspark.session import stage

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; an expression used within a lambda is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of five words which occurs twice or more."""
    def windows(h):
        last = F.size(h) - WINDOW
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(win):
        def repeated(s):
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            starts = F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"])
            start = F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n"))
            return F.aggregate(F.sort_array(starts), start, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(ordered, repeated))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row of numbers per row of ``docs``, with ``_id`` and ``_host``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.array_remove(F.split(text, r"\s+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\S"))
    taken = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{host_col}`").alias("_host"),
        let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("x"),
        F.length(F.translate(text, BLANKS, "")).alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"))
    long = lambda c: F.col(c).cast("bigint").alias(c.split(".")[-1])
    return taken.select("_id", "_host", *map(long, ("w.n_words", "word_chars", "n_symbols", "x.n_dup_lines", "w.n_repeat_words", "x.n_lines")))


def failures() -> dict[str, Column]:
    c = F.col
    return {"few_words": c("n_words") < 10, "repeats": 100 * c("n_repeat_words") > 20 * c("n_words"),
            "symbols": 10 * c("n_symbols") > c("n_words"), "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines")}


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: ``n`` documents, and for each rule the failures ``f_`` and the shrunk rate ``rate_``."""
    hosts = stage(measured.where(F.col("_host").isNotNull()).groupBy("_host").agg(
        F.count("*").alias("n"), *[F.sum(bad.cast("bigint")).alias(f"f_{r}") for r, bad in failures().items()]), "hosts")
    n = F.col("n")
    totals = hosts.agg(F.sum("n").alias("all_n"), F.sum((n * n).cast("double")).alias("sum_n2"), F.count("*").alias("k"),
                       *[F.sum(f"f_{r}").alias(f"all_{r}") for r in RULES],
                       *[F.sum(F.col(f"f_{r}") / n * F.col(f"f_{r}")).alias(f"sq_{r}") for r in RULES])
    out = with_scalars(hosts, totals).select(*hosts.columns, "_s.*")
    for r in RULES:
        p = F.col(f"all_{r}") / F.col("all_n")
        # Between-host variance: what the spread of rates has beyond the binomial noise.
        between = ((F.col(f"sq_{r}") - F.col("all_n") * p * p) - (F.col("k") - 1) * p * (1 - p))
        var = between / F.nullif(F.col("all_n") - F.col("sum_n2") / F.col("all_n"), F.lit(0.0))
        strength = F.when(var > 0, F.greatest(p * (1 - p) / F.when(var > 0, var) - 1, F.lit(1e-3))).otherwise(F.lit(1e9))
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + p * strength) / (n + strength))
    return out.select("_host", "n", *[f"f_{r}" for r in RULES], *[f"rate_{r}" for r in RULES])


def verdicts(docs: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: the id, the numbers, ``base_failed``, ``host_rejected`` and ``kept``."""
    measured = stage(measures(docs, id_col, text_col, host_col), "measures")
    rejected = host_rates(measured).where(F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > limit).select("_host", F.lit(True).alias("host_rejected"))
    base = failures()
    out = (measured.join(rejected, "_host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
           .withColumn("base_failed", base["few_words"] | base["repeats"])
           .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


# The same, in SQL over a table ``documents`` ----------------------------------------------------

def _sql() -> str:
    fails = {"few_words": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words",
             "symbols": "10 * n_symbols > n_words", "dup_lines": "10 * n_dup_lines > 3 * n_lines"}
    rates = ", ".join(
        f"(f_{r} + p_{r} * s_{r}) / (n + s_{r}) AS rate_{r}" for r in RULES)
    ps = ", ".join(f"all_{r} / all_n AS p_{r}" for r in RULES)
    vs = ", ".join(f"((sq_{r} - all_n * p_{r} * p_{r}) - (k - 1) * p_{r} * (1 - p_{r})) / nullif(all_n - sum_n2 / all_n, 0.0) AS v_{r}" for r in RULES)
    ss = ", ".join(f"CASE WHEN v_{r} > 0 THEN greatest(p_{r} * (1 - p_{r}) / v_{r} - 1, 1e-3) ELSE 1e9 END AS s_{r}" for r in RULES)
    return rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: {{'i': i, 's': array_to_string(ws[i:i + 4], ' ')}}), recursive := true) FROM w WHERE len(ws) >= 5),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
h AS (SELECT source, count(*) AS n, {', '.join(f'sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS f_{r}' for r, c in fails.items())} FROM m WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(n) AS all_n, sum(CAST(n * n AS DOUBLE)) AS sum_n2, count(*) AS k, {', '.join(f'sum(f_{r}) AS all_{r}, sum(f_{r} / n * f_{r}) AS sq_{r}' for r in RULES)} FROM h),
b AS (SELECT *, {ps} FROM a), c AS (SELECT *, {vs} FROM b), d AS (SELECT *, {ss} FROM c),
e AS (SELECT source, {rates} FROM h CROSS JOIN d),
bad AS (SELECT source FROM e WHERE greatest({', '.join(f'rate_{r}' for r in RULES)}) > 0.5)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  ({fails['few_words']} OR {fails['repeats']}) AS base_failed, (source IN (SELECT source FROM bad) AND source IS NOT NULL) AS host_rejected,
  NOT ({fails['few_words']} OR {fails['repeats']}) AND NOT (source IN (SELECT source FROM bad) AND source IS NOT NULL) AS kept FROM m"""


SQL = _sql()
