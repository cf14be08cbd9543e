"""Preference formatting of conversation pairs: one shared prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column, train_role: str) -> Column:
    """Comma-separated start:end character spans, in the rendered turns, of what the model is trained on: the
    text of train_role's turns and the end marker after it."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(_render(t))).alias("at"),
        F.when(t["role"] == train_role, F.concat(acc["spans"], F.array(F.concat_ws(":", acc["at"] + F.length(t["role"]) + 5, acc["at"] + F.length(_render(t)) - 1)))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation as an array of (role, text), in order of turn."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Null turns come last; ties go by role, then text.
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(conversations: DataFrame, pairs: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Paired training rows for pairs (pair_id, chosen_id, rejected_id) of conversations (conv_id, turn, role, text).

    The longest common prefix of turns, equal in role and text, is rendered once as prompt; what follows it on
    either side is a completion, whose mask gives the character spans to train on. Returns pair_id, chosen_id,
    rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.
    A null role reads "unknown", a null text is empty; null turns come last and equal turn numbers go by role and
    text, so that repeated rows are repeated turns. A side that is null or has no rows is an empty conversation,
    and equal conversations have two empty completions. Rows with a null conv_id belong to no pair.
    """
    lists = turn_lists(conversations.filter("conv_id is not null"))
    empty = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    side = lambda name: lists.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"{name}_turns"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    return _format(both.withColumns({f"{s}_turns": F.coalesce(f"{s}_turns", empty) for s in ("chosen", "rejected")}), train_role)


def format_adjacent(conversations: DataFrame, train_role: str = "assistant") -> DataFrame:
    """format_preferences() for conversations stored in pairs: 2k is chosen over 2k + 1; a missing side is empty.

    One grouping by conversation and one by pair of at most two rows; no join.
    """
    lists = turn_lists(conversations.filter("conv_id is not null"))
    pair = F.shiftright(F.col("conv_id").cast("long"), 1)
    pick = lambda i, c: F.max(F.when(F.pmod("conv_id", F.lit(2)) == i, F.col(c)))
    empty = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    both = lists.groupBy(pair.alias("pair_id")).agg(
        pick(0, "conv_id").alias("chosen_id"), pick(1, "conv_id").alias("rejected_id"),
        F.coalesce(pick(0, "turns"), empty).alias("chosen_turns"), F.coalesce(pick(1, "turns"), empty).alias("rejected_turns"),
    )
    return _format(both, train_role)


def _format(both: DataFrame, train_role: str) -> DataFrame:
    c, r = F.col("chosen_turns"), F.col("rejected_turns")
    shared = F.aggregate(
        F.zip_with(c, r, lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, same: F.struct((a["n"] + (a["on"] & same).cast("int")).alias("n"), (a["on"] & same).alias("on")),
        lambda a: a["n"],
    )
    cut = both.withColumn("n_prompt_turns", shared)
    n = F.col("n_prompt_turns")
    rest = {f"{s}_turns": F.slice(F.col(f"{s}_turns"), n + 1, F.greatest(F.size(f"{s}_turns") - n, F.lit(0))) for s in ("chosen", "rejected")}
    cut = cut.withColumn("prompt", _text(F.slice(c, F.lit(1), n))).withColumns(rest)
    return cut.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", _text(c).alias("chosen"), _text(r).alias("rejected"), _mask(c, train_role).alias("chosen_mask"), _mask(r, train_role).alias("rejected_mask"))


def op7_preferences(spark, sf_dir):
    return format_adjacent(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), same AS (
  SELECT a.pair_id, a.i, row_number() OVER (PARTITION BY a.pair_id ORDER BY a.i) AS k
  FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.i = b.i AND a.role = b.role AND a.text = b.text
), n AS (
  SELECT p.pair_id, count(s.i) AS n FROM (SELECT DISTINCT pair_id FROM t) p LEFT JOIN same s ON s.pair_id = p.pair_id AND s.i = s.k GROUP BY p.pair_id
), r AS (
  SELECT t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id)
), m AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY conv_id, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r
)
SELECT pair_id, max(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
  CAST(max(n) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i > n), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 1 AND i > n), '') AS rejected,
  coalesce(string_agg(CAST(pos + length(role) + 5 AS BIGINT) || ':' || CAST(pos + length(shown) - 1 AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 0 AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(pos + length(role) + 5 AS BIGINT) || ':' || CAST(pos + length(shown) - 1 AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 1 AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id
"""
