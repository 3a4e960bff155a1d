"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

``build_index`` stores a posting (document row, position, term) for every training token whose term the
test set uses; the lists of other terms would never be read. ``phrase_matches`` looks up the rarest term
of each test window, shifts its list by the term's place in the window, intersects the result with the list
of the second rarest, and what is left with the lists of the other terms at their own places; a window occurs
where all its places are met. With ``slack`` a place is met within so many words, which gives proximity matches.

Scale: the texts are read once and the postings shuffled once, those of second rarest terms twice. Lists are
keyed by document row and position when they are intersected, so neither a frequent term nor a hot passage
lands in one task. The candidates are as many as the rarest terms have postings; places are made only for those
that meet a second term. Small sides are broadcast only as far as the
session threshold says for their written size.

Defined results: a null text has no words; a null or wordless test item has no window; an item shorter
than ``width`` is one window. Repeated rows, repeated ids and null ids each keep their row. Repeated
items and repeated windows count once per item id. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, -1), "")


def windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window, terms)`` of all items, and which item holds which ``(item, window)``."""
    split = items.select(F.col(f"`{id_col}`").alias("item"), words(F.col(f"`{text_col}`")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width, F.lit(0)) + 1)
    cut = split.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), width).alias("terms"))
    held = stage(cut.distinct().withColumn("window", F.xxhash64(F.concat_ws(" ", "terms"))), "windows")
    return held.select("window", "terms").distinct(), held.select("item", "window").distinct()


def build_index(docs: DataFrame, test: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written postings ``(row, id, n_words, pos, term)``, positions from 0, of the terms in the windows ``test``.

    Every document row has the entry of its first word, with a null term if that is no term of the test
    set, so that documents without a posting stay known; ``pos`` is null for a document without words."""
    terms = stage(test.select(F.explode("terms").alias("word")).distinct().withColumn("term", F.xxhash64("word")), "terms")
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`")).alias("w"))
    tokens = split.select("row", "id", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    known = tokens.join(terms, "word", "left").where(F.col("term").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
    return stage(known.select("row", "id", "n_words", "pos", "term"), "postings")


def phrase_matches(index: DataFrame, test: DataFrame, slack: int = 0) -> DataFrame:
    """``(row, start, window, length)`` for every occurrence of a window; with ``slack`` for every place around which
    each of its terms lies within ``slack`` words of its own place."""
    places = test.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "word")).withColumn("term", F.xxhash64("word")).drop("word")
    postings = index.where("term IS NOT NULL").select("row", "pos", "term")
    counts = postings.groupBy("term").count()
    # Places of a window, rarest term first. Another place with the same term is a place of its own.
    ranked = (places.join(counts, "term").groupBy("window", "length")
              .agg(F.count("*").alias("found"), F.array_sort(F.collect_list(F.struct("count", "offset", "term"))).alias("by")))
    order = stage(ranked.where("found = length").select("window", "length", F.col("by")[0].alias("rarest"), F.get("by", F.lit(1)).alias("next")), "order")
    # The rarest term may itself stand up to slack words away from its place.
    shift = F.explode(F.sequence(F.lit(-slack), F.lit(slack)))
    anchors = order.select("window", "length", "rarest.offset", "rarest.term")
    starts = (postings.join(anchors, "term").select("row", "window", "length", F.col("pos") - F.col("offset"), shift.alias("s"))
              .toDF("row", "window", "length", "start", "s").select("row", "window", "length", (F.col("start") + F.col("s")).alias("start")).distinct())
    wanted = lambda found, at: (found.join(at, "window").select("row", "start", "window", "length", "offset", "term", shift.alias("s"))
                                .withColumn("pos", F.col("start") + F.col("offset") + F.col("s")))
    # Only starts that also meet the next term look up the other lists.
    second = order.where("next IS NOT NULL").select("window", "next.offset", "next.term")
    held = postings.join(second.select("term").distinct(), "term", "left_semi")
    both = wanted(starts.where("length > 1"), second).join(held, ["row", "pos", "term"]).select("row", "start", "window", "length").distinct()
    left = stage(both.unionByName(starts.where("length = 1").select("row", "start", "window", "length")), "starts")
    met = wanted(left, places.drop("length")).join(postings, ["row", "pos", "term"]).groupBy("row", "start", "window", "length")
    full = met.agg(F.countDistinct("offset").alias("met")) if slack else met.agg(F.count("*").alias("met"))
    return full.where("met = length").select("row", "start", "window", "length")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_hit``, ``n_items`` and the sorted ``items`` (text)."""
    test, held = windows(items, width, item_id_col, item_text_col)
    index = build_index(docs, test, id_col, text_col)
    found = stage(phrase_matches(index, test), "matches")
    hit = (found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
           .groupBy("row").agg(F.count("*").alias("n_hit")))
    named = (found.select("row", "window").distinct().join(held, "window").select("row", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items")))
    every = index.where("pos IS NULL OR pos = 0").select("row", "id", "n_words")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (every.join(hit, "row", "left").join(named, "row", "left")
            .select(F.col("id").alias(id_col), F.col("n_words").cast("bigint"), zero("n_hit"), zero("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 10 THEN list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' '))
          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s, least(len(ws), 10) AS n FROM b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
lengths AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {{'i': i, 's': array_to_string(ws[i:i + n - 1], ' ')}}), recursive := true)
         FROM d JOIN lengths ON len(ws) >= n),
found AS (SELECT doc_id, item_id, dw.i, dw.n FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
