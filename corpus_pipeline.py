"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Documents are rows (doc_id, text, lang, source, n_chars). Every row is decided by its own text and host, also
where ids repeat or are missing; rows alike in id, text and host are one document. Null texts are empty texts, null hosts no hosts; other
columns than the five are not read. Every stage decides on what the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, decontam, hostrules, linededup, queries, simhash
from panelspark.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    """The rows with ``_row``, a digest of all that a verdict can depend on. Rows that share it are alike."""
    digest = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-"))
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.select(*COLUMNS, F.md5(F.concat(digest("doc_id"), text, digest("source")).cast("binary")).alias("_row"))


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose ``_row`` is in ``kept``."""
    return rows.join(kept.select("_row").distinct(), "_row", "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    rows = _named(docs)
    return _only(rows, hostrules.verdicts(rows, id_col="_row").where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are deleted; documents of which nothing is left go."""
    found = linededup.deduplicate(docs, carry=("lang", "source"), whole=True).where("n_lines = 0 OR n_removed < n_lines")
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays, with its repeated rows. If no
    document of a group has an id, one row of it stays."""
    rows = _named(docs)
    groups = simhash.near_duplicates(rows, ngram=4, distance=4, id_col="_row").select("_row", "component_id").distinct()
    found = stage(groups.join(rows.select("_row", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key")).distinct(), "_row"), "groups")
    lead = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "_row")).alias("lead"))
    same = (F.col("doc_id") == F.col("lead.doc_id")) & (F.col("key") == F.col("lead.key"))
    kept = stage(found.join(lead, "component_id").where((F.col("_row") == F.col("lead._row")) | same), "kept").select("_row")
    with_id = _only(rows.where("doc_id IS NOT NULL"), kept)
    return with_id.union(rows.where("doc_id IS NULL").join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = _named(docs)
    return _only(rows, decontam.contamination(rows, queries.table(spark, sf_dir, "benchmark"), id_col="_row").where("n_hit = 0"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed), their count, and the text that they decode to."""
    return bpe.round_trip(docs, queries.tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", tokenize)]
ORACLE_SQL = None  # alignment, fingerprints and merges have no SQL form; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
