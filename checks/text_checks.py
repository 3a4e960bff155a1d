"""Document search: whole texts, whole table."""

from pyspark.sql import functions as F

from checks.base import check, r, shown, table
from panelspark.operators import text as X


@check("keyword_volume", f"""SELECT lang, source, count(*) AS docs, CAST(sum(CASE WHEN contains(lower(text), 'that') THEN 1 ELSE 0 END) AS BIGINT) AS hits,
{r("avg(CASE WHEN contains(lower(text), 'that') THEN 1.0 ELSE 0.0 END)")} AS volume FROM documents GROUP BY ALL""")
def keyword_volume(spark, d):
    return shown(X.keyword_volume(table(spark, d, "documents"), "that", ["lang", "source"]))


NEAR = ("with", "from", "this")


def near_sql(n, words, k, word):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
WITH tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM tok),
hit AS (SELECT * FROM pos WHERE w IN ({listed})),
span AS (SELECT doc_id, count(DISTINCT w) OVER (PARTITION BY doc_id ORDER BY i RANGE BETWEEN CURRENT ROW AND {n} FOLLOWING) AS c FROM hit),
near AS (SELECT doc_id, max(c) AS c FROM span GROUP BY ALL),
rep AS (SELECT doc_id, count(*) AS c FROM pos WHERE w = '{word}' GROUP BY ALL)
SELECT doc_id, CAST(CASE WHEN near.c = {len(words)} THEN 1 ELSE 0 END AS BIGINT) AS near, CAST(CASE WHEN rep.c >= {k} THEN 1 ELSE 0 END AS BIGINT) AS repeat
FROM tok LEFT JOIN near USING (doc_id) LEFT JOIN rep USING (doc_id)"""


@check("near_repeat", near_sql(30, NEAR, 5, "the"))
def near_repeat(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.near("text", 30, *NEAR).cast("bigint").alias("near"), X.repeat("text", 5, "the").cast("bigint").alias("repeat"))


# Pairs of words from the benchmark, five of each item: some two hundred phrases.
PHRASES = """w AS (SELECT string_split(lower(text), ' ') AS ws FROM benchmark), p AS (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS phrase FROM w, range(1, 11, 2) t(i) WHERE len(ws) > i),
d AS (SELECT lang, lower(text) AS text FROM documents)"""


@check("keyword_volumes", f"""WITH {PHRASES} SELECT lang, phrase, count(*) AS docs, CAST(sum(CASE WHEN contains(text, phrase) THEN 1 ELSE 0 END) AS BIGINT) AS hits,
{r("avg(CASE WHEN contains(text, phrase) THEN 1.0 ELSE 0.0 END)")} AS volume FROM d, p GROUP BY ALL""")
def keyword_volumes(spark, d):
    words = F.split(F.lower("text"), " ", -1)
    pairs = F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.lit(9), F.lit(2)), lambda i: F.size(words) > i), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))
    phrases = [x.p for x in table(spark, d, "benchmark").select(pairs.alias("p")).distinct().orderBy("p").collect()]  # the question asked, not the data
    return shown(X.keyword_volumes(table(spark, d, "documents"), phrases, ["lang"]))
