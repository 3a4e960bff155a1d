"""Preference formatting: prompt, chosen and rejected completion with loss masks.

``format_pairs`` takes the turns of chosen and of rejected conversations under a common pair id, finds the
longest prefix of turns that both share (role and text), renders it once as the prompt, and renders what
is left of either side as its completion. A mask lists the ``start:end`` character ranges of the completion
that carry loss: the texts of assistant turns, end mark included.

``swap_last_reply`` makes such pairs from plain conversations: a conversation up to its last reply is the
chosen one; the same with the last reply of its neighbour (the id with the lowest bit turned) is rejected.

Scale: turns are brought together by conversation, since a rendered pair is one row; nothing larger is
ever grouped, and a turn that many conversations share is no key of any shuffle. Functions of Spark only.

Defined results: turns are ordered by number, then role, then text, nulls first; null roles and texts are
empty ones. Repeated rows are repeated turns. Rows with a null id are left out, as they belong to no
conversation. A pair with one side only is left out; equal sides give two empty completions. A conversation
without a reply or whose neighbour has none makes no pair. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
REPLY = "assistant"


def conversations(turns: DataFrame, id_col: str) -> DataFrame:
    """``(id, turns)`` with the ordered turns of each conversation as an array of (role, text)."""
    c = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    ordered = F.sort_array(F.collect_list(F.struct("turn", c("role"), c("text"))))
    taken = turns.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), "turn", "role", "text")
    return taken.groupBy("id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """The ranges of the rendered turns that carry loss, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == REPLY, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two arrays share from their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def format_arrays(pairs: DataFrame) -> DataFrame:
    """Rows ``(pair_id, chosen, rejected)`` of turn arrays, formatted."""
    with_n = pairs.withColumn("n", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return with_n.select(
        "pair_id", F.col("n").cast("bigint").alias("n_prompt_turns"), render(F.slice("chosen", 1, F.col("n"))).alias("prompt"),
        render(rest("chosen")).alias("chosen"), mask(rest("chosen")).alias("chosen_mask"),
        render(rest("rejected")).alias("rejected"), mask(rest("rejected")).alias("rejected_mask"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """One row per pair id that has turns on both sides."""
    left = conversations(chosen, id_col).withColumnRenamed("turns", "chosen")
    right = conversations(rejected, id_col).withColumnRenamed("turns", "rejected")
    return format_arrays(left.join(right, "id").withColumnRenamed("id", "pair_id"))


def swap_last_reply(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs ``(pair_id, chosen, rejected)`` of turn arrays, one per conversation with a reply and a neighbour with one."""
    whole = conversations(turns, id_col)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), REPLY).cast("int") + 1
    ended = whole.where(F.exists("turns", lambda t: t["role"] == REPLY)).withColumn("turns", F.slice("turns", F.lit(1), last))
    replies = ended.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.element_at("turns", -1).alias("reply"))
    return ended.join(replies, "id").select(
        F.col("id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array("reply")).alias("rejected"))


SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT conv_id, max(pos) AS p FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT xor(t.conv_id, 1) AS conv_id, role, text FROM t JOIN e ON t.conv_id = e.conv_id AND pos = p),
c AS (SELECT t.conv_id, pos, t.role, t.text FROM t JOIN e ON t.conv_id = e.conv_id AND pos <= p WHERE t.conv_id IN (SELECT conv_id FROM reply)),
r AS (SELECT c.conv_id, pos, CASE WHEN pos = p THEN reply.role ELSE c.role END AS role, CASE WHEN pos = p THEN reply.text ELSE c.text END AS text
    FROM c JOIN e USING (conv_id) JOIN reply USING (conv_id)),
n AS (SELECT c.conv_id, coalesce(min(CASE WHEN c.role <> r.role OR c.text <> r.text THEN c.pos END) - 1, max(c.pos)) AS n
    FROM c JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos GROUP BY c.conv_id),
both_ AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
x AS (SELECT side, conv_id, pos, role, '<|' || role || '|>' || chr(10) AS head, text, pos > n AS rest FROM both_ JOIN n USING (conv_id)),
y AS (SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY side, conv_id, rest ORDER BY pos) AS e FROM x),
z AS (SELECT conv_id, side, rest, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) AS body,
    string_agg(CASE WHEN role = 'assistant' THEN CAST(e - length(text) - 8 AS BIGINT) || ':' || CAST(e AS BIGINT) END, ',' ORDER BY pos) AS m FROM y GROUP BY ALL)
SELECT n.conv_id AS pair_id, CAST(n AS BIGINT) AS n_prompt_turns, coalesce(p.body, '') AS prompt, coalesce(a.body, '') AS chosen, coalesce(a.m, '') AS chosen_mask,
    coalesce(b.body, '') AS rejected, coalesce(b.m, '') AS rejected_mask
FROM n LEFT JOIN z p ON p.conv_id = n.conv_id AND p.side = 'c' AND NOT p.rest LEFT JOIN z a ON a.conv_id = n.conv_id AND a.side = 'c' AND a.rest
LEFT JOIN z b ON b.conv_id = n.conv_id AND b.side = 'r' AND b.rest"""
