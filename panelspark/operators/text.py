"""Keyword, document and graph operators. All stay in column expressions and see whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.clean import as_column, literal_map, strip_marker
from panelspark.operators.joins import attach_nodes, join_dim
from panelspark.operators.reshape import pivot_agg
from panelspark.operators.series import resample_daily


def keyword_groups(df: DataFrame, mapping: dict[str, str], keys: list[str], date: str = "fecha",
                   word: str = "variable", value: str = "value") -> DataFrame:
    """Sum search interest by theme, one column per theme, each location filled to daily rows.

    Words outside the mapping fall out.
    """
    themes = list(dict.fromkeys(mapping.values()))
    themed = df.withColumn("_theme", F.try_element_at(literal_map(mapping), F.col(word)))
    wide = pivot_agg(themed, [date, *keys], "_theme", themes, value, fill=None, drop_unlisted=True)
    return resample_daily(wide, keys, date, themes, "linear")


def keyword_volume(docs: DataFrame, phrase: str, by: list[str], text: str = "text") -> DataFrame:
    """Share of the documents of each group that contain the phrase."""
    hit = F.contains(F.lower(text), F.lit(phrase.lower())).cast("int")
    return docs.groupBy(*by).agg(F.count("*").alias("docs"), F.sum(hit).alias("hits"), F.avg(hit).alias("volume"))


def tokens(col: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(as_column(col)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def near(col: str | Column, n: int, *words: str) -> Column:
    """True where all words occur within ``n`` tokens of each other.

    Only positions of the wanted words are tried as the left end of the span.
    """
    wanted = F.array(*[F.lit(w.lower()) for w in words])
    numbered = F.transform(tokens(col), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    found = F.filter(numbered, lambda x: F.array_contains(wanted, x["t"]))

    def holds(window: Column, x: Column, word: str) -> Column:
        return F.exists(window, lambda y: (y["t"] == word.lower()) & (y["i"] - x["i"] <= n))

    def starts_span(hits: Column) -> Column:
        def reaches_all(x: Column, place: Column) -> Column:
            window = F.slice(hits, place + 1, F.lit(n + 1))
            inside = F.lit(True)
            for word in words:
                inside = inside & holds(window, x, word)
            return inside

        return F.exists(F.transform(hits, reaches_all), lambda ok: ok)

    # A text that lacks one of the words as plain characters is not split into tokens at all. The
    # one-element array binds the hits to a name, so that they are found once per text.
    text, possible = F.lower(as_column(col)), F.lit(True)
    for word in words:
        possible = possible & F.contains(text, F.lit(word.lower()))
    return F.when(possible, F.exists(F.array(found), starts_span)).otherwise(F.lit(False))


def repeat(col: str | Column, n: int, word: str) -> Column:
    """True where the word occurs at least ``n`` times as a whole token; counted without splitting."""
    alone = r"(?<![\p{L}\p{N}])\Q" + word.lower() + r"\E(?![\p{L}\p{N}])"
    return F.regexp_count(F.lower(as_column(col)), F.lit(alone)) >= n


def postal_map(postal: DataFrame, municipality: DataFrame, marker: str = "_AM") -> DataFrame:
    """Municipality code to postal code and province, by the code without its marker."""
    plain = municipality.select("municipio_mitma").distinct().withColumn("_plain", strip_marker("municipio_mitma", marker))
    codes = postal.select("cp", "provincia").distinct()
    return join_dim(codes, plain, "cp", "_plain").select("municipio_mitma", "cp", "provincia")


def adjacency_to_edges(matrix: DataFrame, row: str, nodes: DataFrame | None = None, key: str = "name") -> DataFrame:
    """Directed edges of the non-zero cells, with node attributes on both ends when given."""
    others = [c for c in matrix.columns if c != row]
    edges = (matrix.unpivot([row], others, "dst", "weight").where(F.col("weight") != 0)
             .withColumnRenamed(row, "src"))
    return edges if nodes is None else attach_nodes(edges, nodes, key)


def keyword_volumes(docs: DataFrame, phrases: list[str | list[str]], by: list[str], text: str = "text") -> DataFrame:
    """``keyword_volume`` of many phrases from one scan: rows ``(by..., phrase, docs, hits, volume)``, every phrase in every group.

    A phrase is a string, or a list of which one is enough; the list is named by its members joined with `` OR ``. All
    strings are found together by one automaton per task, in whole lower-case texts; tasks send one row per group and
    phrase. A null text is a document without any hit.
    """
    import pyarrow as pa

    wanted = [[p] if isinstance(p, str) else list(p) for p in phrases]
    names = [" OR ".join(p) for p in wanted]
    if len(set(names)) < len(names):
        raise ValueError("a phrase is listed twice")
    rows = docs.select(F.struct(*[F.col(f"`{b}`") for b in by]).alias("_by") if by else F.lit(0).alias("_by"), F.lower(F.col(f"`{text}`")).alias("_text"))
    kind = rows.schema["_by"].dataType.simpleString()

    def count(batches):
        import ahocorasick

        automaton, holders = ahocorasick.Automaton(), {}
        for number, group in enumerate(wanted):
            for one in group:
                holders.setdefault(one.lower(), []).append(number)
        for one, numbers in holders.items():
            automaton.add_word(one, numbers)
        automaton.make_automaton()
        for batch in batches:
            # Groups are counted per batch, so that a task holds the groups of one batch only.
            held: dict = {}
            for group, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = tuple(group.values()) if by else 0
                own = held.setdefault(key, (group, {-1: 0}))[1]
                own[-1] += 1
                hits = {n for _, numbers in automaton.iter(value) for n in numbers} if value and holders else ()
                for n in hits:
                    own[n] = own.get(n, 0) + 1
            flat = [(group, n, times) for group, own in held.values() for n, times in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], batch.schema.field(0).type), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.int64())],
                                             names=["_by", "p", "n"])

    counts = rows.mapInArrow(count, f"_by {kind}, p int, n bigint").groupBy("_by", "p").agg(F.sum("n").alias("n"))
    # One row per group from here on: documents stand under -1.
    wide = counts.groupBy("_by").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))
    listed = F.posexplode(F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    at = wide.select("_by", F.element_at("m", F.lit(-1)).alias("docs"), "m", listed.alias("_p", "phrase"))
    hits = F.coalesce(F.try_element_at("m", F.col("_p")), F.lit(0).cast("long"))
    return at.select(*[F.col(f"_by.`{b}`").alias(b) for b in by], "phrase", "docs", hits.alias("hits"), (hits / F.col("docs")).alias("volume"))
