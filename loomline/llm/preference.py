"""Preference formatting in DataFrame functions only.

A pair is two conversations, chosen and rejected, each an array of turns in order. Their longest common turn prefix
(equal role and text, turn by turn) is rendered once as the prompt; what follows it on either side is a completion, with
a mask that lists the spans (code points of the completion, end exclusive) on which a model is to be trained: the text
and end mark of assistant turns. Everything is row-local once the turns of a conversation are together.

A turn is rendered as <|role|>, newline, text, <|end|>, newline; <| in a text or role becomes < |, and |> in a role | >, so
that neither can forge a mark. Nulls: a null text is empty, a null role is "none", turns of null conv_id are one
conversation. Turns that share a number are ordered by role and text. A pair whose sides are equal has both completions
empty. An empty side leaves the prompt empty. Empty tables give no rows. Columns besides conv_id, turn, role and text are
not read. A row holds a whole conversation, as its result does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import table
from loomline.operators.prepare import ranked

END = "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, role, text in order)."""
    one = F.struct(
        "turn",
        F.replace(F.replace(F.coalesce("role", F.lit("none")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """begin, end of every assistant turn's text and end mark in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(seen: Column, t: Column) -> Column:
        begin = seen["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END) - 1
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED, F.concat(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda seen: seen["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns both begin with."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def preferences(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen, rejected (arrays of turns). Adds prefix_turns, prompt, completions and masks."""
    tail = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    return pairs.withColumn("prefix_turns", common_prefix(F.col("chosen"), F.col("rejected"))).select(
        "pair_id",
        "prefix_turns",
        render(F.slice("chosen", 1, F.col("prefix_turns"))).alias("prompt"),
        render(tail(F.col("chosen"))).alias("chosen"),
        render(tail(F.col("rejected"))).alias("rejected"),
        trained_spans(tail(F.col("chosen"))).alias("chosen_mask"),
        trained_spans(tail(F.col("rejected"))).alias("rejected_mask"),
    )


def spliced_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from conversations alone (the table has no rejected side): each conversation that has a reply is chosen
    whole, against a branch that leaves it at one of its replies and goes on as another conversation does.

    Conversations are numbered from 0 by conv_id; number z branches at its reply z modulo how many it has, and goes on from
    the reply of that number (or the last) of number z xor 1 (or z - 1 where that is none). So branches leave at any turn,
    and go on alike where two conversations say the same. A conversation that is the only one has no pair."""
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1)), lambda i: i.isNotNull())
    own = ranked(conversations(turns).withColumn("replies", replies).filter(F.size("replies") > 0), [F.col("conv_id")], "z").withColumn("z", F.col("z") - 1)
    n = own.count()
    partner = F.col("z").bitwiseXOR(F.lit(1).cast("long"))
    own = own.withColumn("partner", F.when(partner < n, partner).otherwise(F.col("z") - 1))
    other = own.select(F.col("z").alias("partner"), F.col("turns").alias("other_turns"), F.col("replies").alias("other_replies"))
    which = (F.col("z") % F.size("replies")).cast("int")
    at = F.get("replies", which)
    on = F.get("other_replies", F.least(which, F.size("other_replies") - 1))
    return own.join(other, "partner").select(
        F.col("conv_id").alias("pair_id"),
        F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), at - 1), F.slice("other_turns", on, F.size("other_turns"))).alias("rejected"),
    )


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ";")


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preferences(spliced_pairs(table(spark, sf_dir, "conversations")))
    return found.withColumns({c: _text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


ORACLE = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM (
    SELECT conv_id, turn, replace(replace(coalesce(role, 'none'), '<|', '< |'), '|>', '| >') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations)
), own AS (
  SELECT conv_id, count(*) AS m, row_number() OVER (ORDER BY conv_id NULLS FIRST) - 1 AS z, count(*) OVER () AS n FROM t WHERE role = 'assistant' GROUP BY conv_id
), u AS (SELECT o.z, t.role, t.text, t.i FROM t JOIN own o ON o.conv_id IS NOT DISTINCT FROM t.conv_id),
reply AS (SELECT z, i, row_number() OVER (PARTITION BY z ORDER BY i) - 1 AS k FROM u WHERE role = 'assistant'),
branch AS (
  SELECT a.conv_id, a.z, b.z AS y, x.i AS j, w.i AS on_
  FROM own a JOIN own b ON b.z = CASE WHEN xor(a.z, 1) < a.n THEN xor(a.z, 1) ELSE a.z - 1 END
  JOIN reply x ON x.z = a.z AND x.k = a.z % a.m JOIN reply w ON w.z = b.z AND w.k = least(a.z % a.m, b.m - 1)
), chosen AS (SELECT b.z, u.i, u.role, u.text FROM branch b JOIN u ON u.z = b.z),
rejected AS (
  SELECT b.z, u.i, u.role, u.text FROM branch b JOIN u ON u.z = b.z AND u.i < b.j
  UNION ALL SELECT b.z, b.j + u.i - b.on_, u.role, u.text FROM branch b JOIN u ON u.z = b.y AND u.i >= b.on_
), lcp AS (
  SELECT z, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS n
  FROM (SELECT coalesce(c.z, r.z) AS z, coalesce(c.i, r.i) AS i, coalesce(c.role = r.role AND c.text = r.text, false) AS same FROM chosen c FULL JOIN rejected r ON r.z = c.z AND r.i = c.i) GROUP BY z
), shown AS (
  SELECT side, z, i, role, text, i <= n AS common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM (SELECT 'c' AS side, * FROM chosen UNION ALL SELECT 'r', * FROM rejected) JOIN lcp USING (z)
), placed AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY side, z, common ORDER BY i) - length(line) AS begin_ FROM shown
), made AS (
  SELECT z, coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE common AND side = 'c'), '') AS prompt,
         coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE NOT common AND side = 'c'), '') AS chosen,
         coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE NOT common AND side = 'r'), '') AS rejected,
         coalesce(string_agg(span, ';' ORDER BY i) FILTER (WHERE NOT common AND side = 'c' AND role = 'assistant'), '') AS chosen_mask,
         coalesce(string_agg(span, ';' ORDER BY i) FILTER (WHERE NOT common AND side = 'r' AND role = 'assistant'), '') AS rejected_mask
  FROM (SELECT *, CAST(CAST(begin_ AS BIGINT) + length(role) + 5 AS VARCHAR) || '-' || CAST(CAST(begin_ AS BIGINT) + length(line) - 1 AS VARCHAR) AS span FROM placed) GROUP BY z
)
SELECT b.conv_id AS pair_id, CAST(l.n AS INTEGER) AS prefix_turns, m.prompt, m.chosen, m.rejected, m.chosen_mask, m.rejected_mask
FROM branch b JOIN lcp l ON l.z = b.z JOIN made m ON m.z = b.z
"""
