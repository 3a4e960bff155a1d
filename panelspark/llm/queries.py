"""Registered queries of the numbered operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, chat, crosstok, decontam, hostrules, importance, langid, linededup, linkgraph, pii, simhash, suffix, toxicity
from panelspark.llm.sampling import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer file; every node has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    made = bpe.round_trip(table(spark, folder, "documents"), tokenizer_path())
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), ngram=4, distance=4)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query("op5_host_rules", hostrules.SQL)
def op5_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return hostrules.verdicts(table(spark, folder, "documents"))


@query("op8_decontamination", decontam.SQL)
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_language")
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_preferences", chat.SQL)
def op9_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_arrays(chat.swap_last_reply(table(spark, folder, "conversations")))


@query("op7_pii")
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.deduplicate(table(spark, folder, "documents"), whole=True)
    return found.select("doc_id", "n_lines", "n_removed", "is_copy", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_suffix", suffix.SQL)
def op6_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, folder, "documents"), length=50)


@query("op11_cross_tokenizer")
def op11_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    return crosstok.digest(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op12_url_filters", linkgraph.SQL)
def op12_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return linkgraph.judge(table(spark, folder, "pages"))


@query("op13_importance_resampling", importance.SQL)
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
