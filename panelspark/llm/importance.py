"""Importance resampling of documents towards a target: hashed n-gram features, a gain for each bucket, noisy top-k.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case. Features are all
runs of one to three words; a feature's bucket is its crc32 modulo ``buckets``. A bucket's gain is the scaled log
ratio of its share of the target's features to its share of the documents' features, smoothed by one. The gains are
one array that every task indexes by the buckets of a text; their sum is the weight of a document. Weight and Gumbel
noise, a hash of the id, give the score, and the highest scores are drawn: sampling without replacement.

The cutoff is found without sorting all scores: a quantile sketch gives a bracket, exact counts above and inside it
say whether the cutoff lies in it (else it is widened), and only the rows of the bracket are sorted. Drawn rows get
their rank in partitions of a range of scores; no rows come to the driver but the one at the cutoff.

Defined results: a null text or one without a word has no features and weight 0; a null id hashes as ''. Equal scores
go to the smaller id, nulls last; rows alike in both in any order. Documents below ``min_words`` have a score and are
never drawn. Empty tables: gains of smoothing alone, nothing drawn. Other columns are not read; texts are never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import stage

BUCKETS = 10_000
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
ORDER = ("_down", "_null", "_id", "_row")


def features(text: bytes | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of every run of one to three words, repeats included. The checksum of a
    run is carried on from the run without its last word."""
    words = (text or b"").translate(WORDS).split()
    later = [b" " + w for w in words[1:]]
    one = list(map(crc32, words))
    two = list(map(crc32, later, one))
    three = list(map(crc32, later[1:], two))
    return len(words), np.array(one + two + three, np.int64) % buckets


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows. Every task adds up its own array and sends one row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(text.as_py(), buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    made = rows.select(F.col(f"`{text_col}`").cast("binary").alias("_text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in made.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of the smoothed share of each bucket in the target over that in the source."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_features``, ``weight``, ``score``. Narrow, no shuffle."""
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    outs = ("n_words", "n_features", "weight")
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), *[T.StructField(n, T.LongType()) for n in outs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, len(at), int(gain[at].sum())) for n, at in (features(t.as_py(), len(gain)) for t in batch.column(1))]
            columns = zip(*made) if made else repeat((), 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["_id", *outs])

    found = source.mapInArrow(run, schema)
    return found.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)).withColumnRenamed("_id", id_col)


def ranked(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in ascending ``order``, whose columns must tell all rows apart. Rows are dealt in
    ranges; each range is numbered by itself and begins after the rows of the ranges before it."""
    from pyspark.sql import Window

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes, before, start = sorted(dealt.groupBy("_part").count().collect()), 0, {}  # one row per range
    for part, n in sizes:
        start[part], before = before, before + n
    if not start:
        return dealt.drop("_part").withColumn("rank", F.lit(None).cast("long"))
    begin = F.element_at(F.create_map(*[F.lit(x) for item in start.items() for x in item]), F.col("_part"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("rank", (at + begin).cast("long")).drop("_part")


def bracket(scores: DataFrame, col: str, above: int, total: int, margin: float = 2e-4, accuracy: int = 10_000) -> tuple:
    """``(low, high, over)``: values of ``col`` that hold its ``above``-th largest, and the exact number of rows over
    ``high``. The sketch proposes the ends; exact counts accept them, or the margin is widened, up to all rows."""
    goal = 1 - above / total
    while True:
        ends = [max(0.0, goal - margin), min(1.0, goal + margin)]
        low, high = scores.agg(F.percentile_approx(col, ends, accuracy)).first()[0]
        over, held = scores.agg(F.count_if(F.col(col) > high), F.count_if(F.col(col).between(low, high))).first()
        if over < above <= over + held:
            return low, high, over
        margin *= 8


def draw(scored: DataFrame, percent: int = 5, min_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``score`` with ``rank`` 1, 2, 3 and so on for the ``floor(percent * N / 100)`` highest scores of the
    N rows with ``min_words`` words or more, null for all others."""
    keyed = stage(scored.select(F.col(f"`{id_col}`").alias("_id"), "n_words", "n_features", "weight", "score")
                  .withColumns({"_down": -F.col("score"), "_null": F.col("_id").isNull(), "_row": F.monotonically_increasing_id()}), "scored")
    able = keyed.where(F.col("n_words") >= min_words)
    total = able.count()
    wanted = percent * total // 100
    none = F.lit(None).cast("long")
    if wanted == 0:
        made = keyed.withColumn("rank", none)
    else:
        low, high, over = bracket(able, "score", wanted, total)
        inside = ranked(able.where(F.col("score").between(low, high)).select(*ORDER), ORDER)
        last = inside.where(F.col("rank") == wanted - over).first()
        id_before = F.lit(False) if last._id is None else F.coalesce(F.col("_id") < F.lit(last._id), F.lit(False))
        before = (F.col("_null") < last._null) | id_before | (F.col("_id").eqNullSafe(F.lit(last._id)) & (F.col("_row") <= last._row))
        tie = (F.col("_down") == last._down) & before
        chosen = (F.col("n_words") >= min_words) & ((F.col("_down") < last._down) | tie)
        made = ranked(keyed.where(chosen), ORDER).unionByName(keyed.where(~chosen).withColumn("rank", none))
    return made.select(F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``draw`` of ``docs`` scored by their likeness to the texts of ``target``."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    return draw(score(docs, gain, id_col, text_col, seed), percent, min_words, id_col)


def _sql(percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> str:
    """The SQL of the query. The checksum goes by half bytes, the low one first; a run of words carries on the state of
    the run without its last word, so each distinct run costs its last word only."""
    def half(x: int) -> int:
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        return x

    table = f"[{', '.join(str(half(i)) for i in range(16))}]::BIGINT[]"
    go = lambda halves, start: f"list_reduce({halves}, lambda c, n: xor(c >> 4, ({table})[((xor(c, n)) & 15) + 1]), {start})"
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    words = f"regexp_extract_all(coalesce({lower}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH item AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws, false AS goal FROM documents UNION ALL SELECT row_number() OVER (), NULL, {words}, true FROM benchmark),
run AS MATERIALIZED (SELECT goal, r, unnest(ws) AS a, unnest(ws[2:] || [NULL]) AS b, unnest(ws[3:] || [NULL, NULL]) AS c FROM item WHERE len(ws) > 0),
hexed AS (SELECT a AS w, hex(encode(a)) AS h FROM run GROUP BY a),
halved AS MATERIALIZED (SELECT w, [CAST(instr('0123456789ABCDEF', h[2 * (j // 2) + 2 - j % 2]) - 1 AS BIGINT) for j in range(length(h))] AS hs FROM hexed),
one AS MATERIALIZED (SELECT w AS a, {go('hs', '4294967295')} AS s FROM halved),
two AS MATERIALIZED (SELECT p.a, p.b, {go('[0, 2]::BIGINT[] || hs', 's')} AS s FROM (SELECT DISTINCT a, b FROM run WHERE b IS NOT NULL) p JOIN one ON one.a = p.a JOIN halved ON w = p.b),
three AS MATERIALIZED (SELECT p.a, p.b, p.c, {go('[0, 2]::BIGINT[] || hs', 's')} AS s FROM (SELECT DISTINCT a, b, c FROM run WHERE c IS NOT NULL) p JOIN two ON two.a = p.a AND two.b = p.b JOIN halved ON w = p.c),
feature AS MATERIALIZED (SELECT goal, r, xor(s, 4294967295) % {buckets} AS k FROM (SELECT goal, r, s FROM run JOIN one USING (a) UNION ALL SELECT goal, r, s FROM run JOIN two USING (a, b) UNION ALL SELECT goal, r, s FROM run JOIN three USING (a, b, c))),
total AS (SELECT count(*) FILTER (NOT goal) AS s, count(*) FILTER (goal) AS t FROM feature),
gain AS (SELECT k, floor(1000 * ln((t + 1.0::DOUBLE) * (bs + {buckets}) / ((s + 1.0::DOUBLE) * (bt + {buckets}))))::BIGINT AS g
  FROM (SELECT k, count(*) FILTER (NOT goal)::DOUBLE AS s, count(*) FILTER (goal)::DOUBLE AS t FROM feature GROUP BY k), (SELECT s::DOUBLE AS bs, t::DOUBLE AS bt FROM total)),
weighed AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS w FROM feature JOIN gain USING (k) WHERE NOT goal GROUP BY r),
scored AS (SELECT item.r, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
  coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM item LEFT JOIN weighed ON weighed.r = item.r WHERE NOT goal),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM scored WHERE n_words >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {percent} * (SELECT count(*) FROM ranked) // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)"""


SQL = _sql()
