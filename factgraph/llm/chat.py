"""Preference formatting: one prompt from the longest common turn prefix, and two masked completions.

Chosen and rejected conversations are arrays of (role, text).  Turns that both begin with are rendered once as the
prompt; what follows in each is rendered as its completion.  A completion's mask is a list of character spans,
``begin-end`` joined by commas, that cover the assistant's texts with their end marks: loss is taken there only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm import common

# Fixed values of the template.
HEAD, AFTER_ROLE, TAIL, AFTER_TURN = "<|", "|>\n", "<|end|>", "\n"
TRAINED = "assistant"


def _turns(turns: Column) -> Column:
    """Null texts are empty, null roles are no one's; a null conversation has no turns."""
    plain = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return F.coalesce(plain, F.array().cast("array<struct<role:string,text:string>>"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both begin with."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y), F.lit(False))
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(shorter)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(TAIL + AFTER_TURN))), "")


def spans(turns: Column) -> Column:
    """Character spans of what is trained in the rendered turns."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

    def turn(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["role"]) + len(HEAD + AFTER_ROLE)
        end = start + F.length(t["text"]) + len(TAIL)
        found = F.when(t["role"] == TRAINED, F.concat(s["found"], F.array(F.concat_ws("-", start.cast("string"), end.cast("string"))))).otherwise(s["found"])
        return F.struct((end + len(AFTER_TURN)).alias("at"), found.alias("found"))

    return F.aggregate(turns, begin, turn, lambda s: F.array_join(s["found"], ","))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with the two conversation columns replaced by the prompt and the completions with their masks.

    Equal conversations give empty completions; null or empty ones give an empty prompt.  New columns whose names are
    taken get an underscore.
    """
    rest = pairs.drop(chosen, rejected)
    n, prompt, good, good_spans, bad, bad_spans = common.fresh(rest, "prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")
    a, b, k = common.fresh(pairs, "__a", "__b", "__k")
    ready = pairs.withColumn(a, _turns(F.col(chosen))).withColumn(b, _turns(F.col(rejected))).withColumn(k, common_turns(F.col(a), F.col(b)))
    after = lambda c: F.slice(F.col(c), F.col(k) + 1, F.greatest(F.size(c) - F.col(k), F.lit(0)))
    return ready.select(
        *[F.col(f"`{c}`") for c in rest.columns],
        F.col(k).cast("long").alias(n),
        render(F.slice(F.col(a), F.lit(1), F.col(k))).alias(prompt),
        render(after(a)).alias(good),
        spans(after(a)).alias(good_spans),
        render(after(b)).alias(bad),
        spans(after(b)).alias(bad_spans),
    )


def crossed_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation, and one that leaves it halfway.

    The rejected one begins with the first half of the conversation's turns and goes on with the turns that the
    conversation of the next id has from there on (none: it ends).  Where both go on alike, they part later, so the
    common prefix has to be found.  Turns are in order of (turn, role, text), so ties have a defined order; rows without
    a conv_id belong to no conversation and give no pair.
    """
    turn = F.struct("turn", "role", "text")
    named = conversations.where("conv_id IS NOT NULL")
    whole = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    following = plain.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turns").alias("next"))
    half = F.floor(F.size("turns") / 2).cast("int")
    rest = F.when(F.size("next") > half, F.slice("next", half + 1, F.size("next") - half)).otherwise(F.slice("turns", 1, 0))
    return plain.join(following, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), half), F.when(F.col("next").isNull(), F.slice("turns", 1, 0)).otherwise(rest)).alias("rejected"))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(rn) AS n FROM t GROUP BY conv_id),
both_sides AS (
  SELECT conv_id, 'c' AS side, rn, role, text AS body FROM t
  UNION ALL SELECT t.conv_id, 'r', rn, role, text FROM t JOIN l ON l.conv_id = t.conv_id WHERE rn <= n // 2
  UNION ALL SELECT l.conv_id, 'r', rn, role, text FROM t JOIN l ON t.conv_id = l.conv_id + 1 WHERE rn > n // 2),
p AS (
  SELECT l.conv_id, coalesce(min(CASE WHEN c.role <> r.role OR c.body <> r.body THEN c.rn END) - 1, count(r.rn)) AS lcp
  FROM l JOIN both_sides c ON c.conv_id = l.conv_id AND c.side = 'c' LEFT JOIN both_sides r ON r.conv_id = l.conv_id AND r.side = 'r' AND r.rn = c.rn GROUP BY l.conv_id),
s AS (
  SELECT b.conv_id, side, rn, role, body, lcp, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) AS shown,
    coalesce(sum(CASE WHEN rn > lcp THEN length(role) + length(body) + 13 END) OVER (PARTITION BY b.conv_id, side ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM both_sides b JOIN p ON p.conv_id = b.conv_id)
SELECT conv_id, max(lcp)::BIGINT AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY rn) FILTER (side = 'c' AND rn <= lcp), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY rn) FILTER (side = 'c' AND rn > lcp), '') AS chosen,
  coalesce(string_agg((pos + length(role) + 5)::VARCHAR || '-' || (pos + length(role) + 12 + length(body))::VARCHAR, ',' ORDER BY rn) FILTER (side = 'c' AND rn > lcp AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(shown, '' ORDER BY rn) FILTER (side = 'r' AND rn > lcp), '') AS rejected,
  coalesce(string_agg((pos + length(role) + 5)::VARCHAR || '-' || (pos + length(role) + 12 + length(body))::VARCHAR, ',' ORDER BY rn) FILTER (side = 'r' AND rn > lcp AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY conv_id
"""
