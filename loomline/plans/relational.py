"""Queries over conversations, documents and labels: pairs, dedup, split, evaluation; each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.rules import ZH
from loomline.functions.text import md5_order
from loomline.operators import prepare, ranking, render, reward, session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.pair_turns(table(spark, sf_dir, "conversations"))


PAIRS = """
SELECT a.conv_id, a.turn, coalesce(s.instruction, '') AS instruction, a.text AS input, b.text AS output
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS instruction FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = a.conv_id
WHERE a.role = 'user'
"""


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return prepare.first_wins(docs, F.sha2(prepare.dedup_key("text"), 256), "doc_id").select("doc_id", "lang", "source", "n_chars")


DEDUP = "SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.complete(pairs(spark, sf_dir), "input", "output")
    return prepare.first_wins(rows, prepare.dedup_key("instruction", "input"), "conv_id", "turn")


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.train_val(prepared(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "instruction", "input", "output", "rank", "split")


PREPARED = f"""
prepared AS (
  SELECT conv_id, turn, instruction, input, output FROM (
    SELECT *, row_number() OVER (PARTITION BY instruction || input ORDER BY conv_id, turn) AS rn FROM ({PAIRS}) p
    WHERE input <> '' AND output <> '') q
  WHERE rn = 1
)"""
SPLIT = f"""
WITH {PREPARED}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn) AS rank, count(*) OVER () AS n FROM prepared
)
SELECT conv_id, turn, instruction, input, output, rank,
       CASE WHEN rank <= greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT)) THEN 'val' ELSE 'train' END AS split
FROM ranked
"""


def grpo_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.grpo_rows(prepared(spark, sf_dir))


GRPO = f"WITH {PREPARED} SELECT instruction, input, '' AS output FROM prepared WHERE instruction <> '' AND input <> ''"


def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: its limit is the feature."""
    return prepare.sample(prepared(spark, sf_dir), 30, "conv_id", "turn").select("conv_id", "turn", "input")


SAMPLED = f"WITH {PREPARED} SELECT conv_id, turn, input FROM prepared ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn LIMIT 30"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four labelled documents with neighbouring ids stand in for the attempts at one question."""
    tries = labelled(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 4).alias("question"),
        (F.col("doc_id") % 4).alias("attempt"),
        F.col("text").alias("answer"),
        F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("leaked"),
        F.col("source").alias("fallback"),
    )
    return prepare.complete(reward.chosen_rejected(tries, "question", most=4), "chosen", "rejected")


PREFERENCE = """
WITH t AS (
  SELECT CAST(floor(doc_id / 4) AS BIGINT) AS question, doc_id % 4 AS attempt, text AS answer,
         coalesce(CASE WHEN quality = 1 THEN toxic = 1 END, false) AS leaked, source AS fallback
  FROM documents JOIN labels USING (doc_id)
), g AS (
  SELECT question, arg_min(answer, attempt) FILTER (WHERE NOT leaked) AS chosen, min(attempt) FILTER (WHERE NOT leaked) AS safe_at,
         arg_min(answer, attempt) FILTER (WHERE leaked) AS leak, min(attempt) FILTER (WHERE leaked) AS leak_at, arg_min(fallback, attempt) AS fallback
  FROM t GROUP BY question
)
SELECT question, chosen, CASE WHEN leak_at < safe_at THEN leak ELSE fallback END AS rejected FROM g
WHERE safe_at IS NOT NULL AND chosen <> '' AND CASE WHEN leak_at < safe_at THEN leak ELSE fallback END <> ''
"""


#: Driver texts hold none of the Chinese phrases, so these rules carry patterns that they do hold.
RULES = replace(ZH, disclaimer="License", third_person="the (of|and)", narration_over=3000, numbered_bold=r"(?md)^[A-Z][a-z]{14,}", first_person="|")


def reward_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(
        "doc_id",
        F.col("text").alias("response"),
        F.array(F.col("text"), F.lit("ab")).alias("facts"),
        F.array(F.col("toxic") * 0.9, F.lit(0.95)).alias("entailment"),
        ((1 - F.col("quality")) * 0.8).alias("contradiction"),
    )
    got = reward.reward(F.col("response"), F.col("facts"), F.col("lang_known"), F.col("entailment"), F.col("contradiction"), RULES)
    return rows.withColumn("lang_known", F.lit("k")).select("doc_id", got.alias("reward"))


LADDER = """
SELECT doc_id, CASE
  WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0.0::DOUBLE
  WHEN contains(text, 'License') THEN 0.0
  WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 3000 AND NOT contains(text, '|') AND regexp_matches(text, 'the (of|and)') THEN 0.0
  WHEN regexp_matches(chr(10) || text, '\\n[A-Z][a-z]{14,}') THEN 0.0
  WHEN toxic = 1 AND length(text) >= 4 THEN 0.2
  WHEN quality = 0 THEN 0.5 ELSE 1.0 END AS reward
FROM documents JOIN labels USING (doc_id)
"""


def hard_rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.functions.text import hard_rules

    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id").alias("id"), hard_rules(F.col("text"), RULES).alias("in_form"), hard_rules(F.col("text"), ZH, True).alias("in_script"))
    said = spark.createDataFrame(SAID, "id bigint, t string")
    return own.unionByName(said.select("id", hard_rules(F.col("t")).alias("in_form"), hard_rules(F.col("t"), ZH, True).alias("in_script")))


#: Invented answers, and whether each is in form (without and with the rule that asks for Chinese).
SAID_JUDGED = [
    ("我今天在河边等你。", True, True),
    ("作为一个ai，我没有感觉。", False, False),
    ("抱歉，我无法告诉你。", False, False),
    ("茶已经凉了，需要我帮忙吗？", False, False),
    ("请注意，这只是传说。", False, False),
    ("1. **第一** 我先走。", False, False),
    ("那天傍晚下着很大的雨，街上没有一个人，他慢慢地走到门前，又停住了，回头看着远处的灯。", False, False),
    ("那天傍晚下着很大的雨，我看见街上没有一个人，他慢慢地走到门前，又停住了，回头看着远处的灯。", True, True),
    ("hello there", True, False),
]
SAID = [(-1 - i, t) for i, (t, _, _) in enumerate(SAID_JUDGED)]
FLAGS = """
SELECT doc_id AS id, NOT (contains(text, 'License')
   OR (length(text) > 3000 AND NOT contains(text, '|') AND regexp_matches(text, 'the (of|and)'))
   OR regexp_matches(chr(10) || text, '\\n[A-Z][a-z]{14,}')) AS in_form, regexp_matches(text, '[一-龥]') AS in_script
FROM documents
""" + "".join(f"UNION ALL SELECT {-1 - i}, {str(a).lower()}, {str(b).lower()}\n" for i, (_, a, b) in enumerate(SAID_JUDGED))


def boundary_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("source", F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("leaked"))
    return reward.boundary(rows, "source")


BOUNDARY = """
SELECT source, count(leaked) AS valid, count(*) FILTER (WHERE leaked) AS leaks,
       CASE WHEN count(leaked) = 0 THEN 0.0::DOUBLE ELSE (count(leaked) - count(*) FILTER (WHERE leaked))::DOUBLE / count(leaked) END AS boundary_rate
FROM (SELECT source, CASE WHEN quality = 1 THEN toxic = 1 END AS leaked FROM documents JOIN labels USING (doc_id)) GROUP BY source
"""


def style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("lang", (F.col("quality") == 1).alias("format_pass"), (1 + F.col("n_chars") % 5).cast("int").alias("score"))
    out = reward.style(rows, "lang")
    return out.select("lang", "total", "passed", *[F.round(c, 9).alias(c) for c in ("avg_score", "format_accuracy", "combined")])


STYLE = """
SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passed,
       round(coalesce(avg((1 + n_chars % 5)::DOUBLE) FILTER (WHERE quality = 1), 0.0), 9) AS avg_score,
       round((count(*) FILTER (WHERE quality = 1))::DOUBLE / count(*), 9) AS format_accuracy,
       round((count(*) FILTER (WHERE quality = 1))::DOUBLE / count(*) * coalesce(avg((1 + n_chars % 5)::DOUBLE) FILTER (WHERE quality = 1), 0.0) / 5, 9) AS combined
FROM documents JOIN labels USING (doc_id) GROUP BY lang
"""


def pairwise_winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two text rules stand in for the scores of two models; the judge sees half of the pairs swapped."""
    a, b = (1 + F.col("n_chars") % 5).cast("int"), (1 + F.col("doc_id") % 5).cast("int")
    seen = labelled(spark, sf_dir).select("lang", "doc_id", reward.swap_flag(F.col("doc_id")).alias("swapped"), a.alias("a"), b.alias("b"))
    s = F.col("swapped")
    judged = seen.select("lang", "swapped", F.when(s, F.col("b")).otherwise(F.col("a")).alias("score_a"), F.when(s, F.col("a")).otherwise(F.col("b")).alias("score_b"))
    winner = F.when(F.col("score_a") > F.col("score_b"), "A").when(F.col("score_a") < F.col("score_b"), "B").otherwise("none")
    out = reward.pairwise(reward.unswapped(judged.withColumn("winner", winner)), "lang")
    return out.select("lang", "total", "wins_a", "wins_b", "ties", *[F.round(c, 9).alias(c) for c in ("avg_a", "avg_b", "win_rate_b")])


PAIRWISE = """
SELECT lang, count(*) AS total, count(*) FILTER (WHERE a > b) AS wins_a, count(*) FILTER (WHERE a < b) AS wins_b, count(*) FILTER (WHERE a = b) AS ties,
       round(avg(a::DOUBLE), 9) AS avg_a, round(avg(b::DOUBLE), 9) AS avg_b, round((count(*) FILTER (WHERE a < b))::DOUBLE / count(*), 9) AS win_rate_b
FROM (SELECT lang, 1 + n_chars % 5 AS a, 1 + doc_id % 5 AS b FROM documents JOIN labels USING (doc_id)) GROUP BY lang
"""


def swap_unswap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", reward.swap_flag(F.col("doc_id")).alias("swapped"))


SWAP = "SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 2 = 1 AS swapped FROM labels"


def judge_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(
        "lang", F.when(F.col("n_chars") % 7 == 0, F.lit(0.0)).when(F.col("n_chars") % 3 == 0, F.lit(0.2)).otherwise(F.lit(1.0)).alias("reward"), F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("judged_leak")
    )
    return reward.reward_summary(rows, "lang").withColumn("avg_reward", F.round("avg_reward", 9))


DISAGREE = """
SELECT lang, count(*) AS total, round(avg(reward), 9) AS avg_reward, count(*) FILTER (WHERE reward = 0.2) AS leaks,
       count(*) FILTER (WHERE judged IS NOT NULL AND judged <> (reward = 0.2)) AS disagreements
FROM (SELECT lang, CASE WHEN n_chars % 7 = 0 THEN 0.0::DOUBLE WHEN n_chars % 3 = 0 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS reward,
             CASE WHEN quality = 1 THEN toxic = 1 END AS judged FROM documents JOIN labels USING (doc_id)) GROUP BY lang
"""


def model_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = style_scores(spark, sf_dir)
    return reward.model_delta(per, "lang", "avg_score", "en", "fr").select(*[F.round(c, 9).alias(c) for c in ("a", "b", "delta")], "sign")


DELTA = f"""
SELECT round(a, 9) AS a, round(b, 9) AS b, round(b - a, 9) AS delta, CAST(sign(b - a) AS INTEGER) AS sign
FROM (SELECT max(avg_score) FILTER (WHERE lang = 'en') AS a, max(avg_score) FILTER (WHERE lang = 'fr') AS b FROM ({STYLE}))
"""


def history_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    return session.compaction(turns, 2).select("conv_id", "turn", "n", F.coalesce("round", F.lit(0)).alias("round"), "kept")


COMPACTION = """
WITH t AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE role <> 'system'
), g AS (SELECT *, CASE WHEN total - total % 2 <= 4 THEN 0 ELSE 3 + ((total - total % 2 - 6) // 2) * 2 END AS gone FROM t)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CAST(CASE WHEN n <= gone THEN CASE WHEN n <= 3 THEN 1 ELSE (n - 4) // 2 + 2 END ELSE 0 END AS INTEGER) AS round, n > gone AS kept
FROM g
"""


def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    return session.history_text(session.compaction(turns, 2), name="A")


HISTORY = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE role <> 'system'
), g AS (SELECT *, CASE WHEN total - total % 2 <= 4 THEN 0 ELSE 3 + ((total - total % 2 - 6) // 2) * 2 END AS gone FROM t)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE 'A' END || '：' || text, chr(10) ORDER BY n) AS history FROM g WHERE n > gone GROUP BY conv_id
"""


def intent_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("int").alias("chapter")).distinct()
    return ranking.intent_plan(chapters, 10).select("chapter", "intent", "quota")


INTENT = """
SELECT CAST(c.chapter AS INTEGER) AS chapter, CAST(i AS INTEGER) AS intent, CAST(1 + CASE WHEN ((i - c.chapter % 8) % 8 + 8) % 8 < 2 THEN 1 ELSE 0 END AS INTEGER) AS quota
FROM (SELECT DISTINCT conv_id AS chapter FROM conversations) c, range(8) r(i)
"""


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform(ranking.even_sample(F.col("turns"), 3), lambda x: x.cast("string")), ",").alias("picked"))


EVEN = """
SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS picked
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
WHERE n <= 3 OR p IN (0, n // 3, 2 * n // 3) GROUP BY conv_id
"""


def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.chat_messages(prepared(spark, sf_dir)).select("prompt", "instruction", "input")


PROMPTS = f"""
WITH {PREPARED} SELECT '<|system|>' || chr(10) || instruction || chr(10) || '<|user|>' || chr(10) || input || chr(10) || '<|assistant|>' || chr(10) AS prompt, instruction, input
FROM prepared WHERE instruction <> '' AND input <> ''
"""


def accepted_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = labelled(spark, sf_dir).select(F.floor(F.col("doc_id") / 3).alias("question"), (F.col("doc_id") % 3).alias("attempt"), F.col("text").alias("answer"), (F.col("toxic") == 1).alias("ok"))
    return reward.accepted_attempt(tries, "question")


ACCEPTED = """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS question, coalesce(arg_min(text, doc_id % 3) FILTER (WHERE toxic = 1), arg_max(text, doc_id % 3)) AS answer
FROM documents JOIN labels USING (doc_id) GROUP BY 1
"""


def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [md5_order("doc_id").alias("h"), F.col("doc_id")]
    return prepare.ranked(table(spark, sf_dir, "labels").select("doc_id"), order).select("doc_id", "rank")


SHUFFLED = "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM labels"

QUERIES = {
    "pair_turns": (pairs, PAIRS),
    "dedup_first_wins": (dedup_first_wins, DEDUP),
    "train_val_split": (train_val_split, SPLIT),
    "grpo_projection": (grpo_projection, GRPO),
    "sampled_pairs": (sampled_pairs, SAMPLED),
    "preference_rows": (preference_rows, PREFERENCE),
    "reward_ladder": (reward_ladder, LADDER),
    "hard_rule_flags": (hard_rule_flags, FLAGS),
    "boundary_rate": (boundary_rate, BOUNDARY),
    "style_scores": (style_scores, STYLE),
    "pairwise_winrate": (pairwise_winrate, PAIRWISE),
    "swap_unswap": (swap_unswap, SWAP),
    "judge_disagreement": (judge_disagreement, DISAGREE),
    "model_delta": (model_delta, DELTA),
    "history_compaction": (history_compaction, COMPACTION),
    "history_text": (history_text, HISTORY),
    "intent_plan": (intent_plan, INTENT),
    "even_sample": (even_sample, EVEN),
    "chat_prompts": (chat_prompts, PROMPTS),
    "accepted_attempt": (accepted_attempt, ACCEPTED),
    "shuffled_order": (shuffled_order, SHUFFLED),
}
