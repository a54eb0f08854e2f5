"""Chat sessions: history text and compaction, per conversation, without state outside the table of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER = "user"


def speaker(role: Column, name: Column, user: str = "用户") -> Column:
    return F.when(role == USER, F.lit(user)).otherwise(name)


def compaction(turns: DataFrame, most_turns: int = 10) -> DataFrame:
    """turns: conv_id, turn, role, text, without system turns. Adds n (place in the conversation), round (the compaction
    that took the message to the summary; null while it is kept) and kept.

    A turn adds two messages; when a history then has over 2 * most_turns, the older half (rounded down) goes to a
    summary. The first such step takes most_turns + 1 messages; what is kept then comes round again after a fixed number
    of messages, so that how many are gone depends on the count alone. A last message without reply has not ended a
    turn."""
    limit, first = 2 * most_turns, most_turns + 1
    step = most_turns if most_turns % 2 == 0 else most_turns + 1
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    total = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    whole = total - total % 2
    gone = F.when(whole <= limit, 0).otherwise(first + F.floor((whole - limit - 2) / step) * step)
    placed = turns.withColumn("n", n).withColumn("gone", gone)
    round_ = F.when(F.col("n") <= first, 1).otherwise(F.floor((F.col("n") - first - 1) / step) + 2).cast("int")
    return placed.withColumn("round", F.when(F.col("n") <= F.col("gone"), round_)).withColumn("kept", F.col("n") > F.col("gone")).drop("gone")


def history_text(compacted: DataFrame, summaries: DataFrame | None = None, name: str = "角色") -> DataFrame:
    """conv_id, history: the summary, if any, then `speaker：text` lines of the kept turns. summaries: conv_id, round, summary."""
    line = F.concat(speaker(F.col("role"), F.lit(name)), F.lit("："), F.coalesce("text", F.lit("")))
    kept = compacted.filter("kept").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    if summaries is None:
        return kept.withColumnRenamed("lines", "history")
    told = summaries.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("round", "summary"))), lambda x: x["summary"]), "\n").alias("early"))
    head = F.when(F.col("early").isNotNull(), F.concat(F.lit("【早期对话摘要】\n"), F.col("early"), F.lit("\n\n"))).otherwise(F.lit(""))
    return kept.join(told, "conv_id", "left").select("conv_id", F.concat(head, "lines").alias("history"))


def to_summarise(compacted: DataFrame, name: str = "角色") -> DataFrame:
    """conv_id, round, text: what each compaction gives to the summariser."""
    line = F.concat(speaker(F.col("role"), F.lit(name)), F.lit("："), F.coalesce("text", F.lit("")))
    return compacted.filter("not kept").groupBy("conv_id", "round").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def guarded_reply(replies: DataFrame, *keys: str) -> DataFrame:
    """replies: keys, attempt (0, then 1), reasoning, response, leaked (nullable: the check failed and counts as clean).
    A first reply that leaks gives way to the second, which is not checked again. (The original swaps the second's
    reasoning and response; here each keeps its name.)"""
    first = F.max_by(F.struct("reasoning", "response", F.coalesce("leaked", F.lit(False)).alias("leaked"), F.coalesce("leak_reason", F.lit("")).alias("leak_reason")), F.when(F.col("attempt") == 0, 1))
    second = F.max_by(F.struct("reasoning", "response"), F.when(F.col("attempt") == 1, 1))
    out = replies.groupBy(*keys).agg(first.alias("f"), second.alias("s"))
    again = F.col("f.leaked") & F.col("s").isNotNull()
    return out.select(
        *keys,
        F.when(again, F.col("s.response")).otherwise(F.col("f.response")).alias("response"),
        F.when(again, F.col("s.reasoning")).otherwise(F.col("f.reasoning")).alias("reasoning"),
        F.col("f.leaked").alias("leaked"),
        F.col("f.leak_reason").alias("leak_reason"),
    )


def pair_turns(turns: DataFrame) -> DataFrame:
    """instruction (the conversation's system turn, or empty), input (a user turn), output (the assistant turn after it)."""
    ask = turns.filter(F.col("role") == USER).select("conv_id", "turn", F.col("text").alias("input"))
    reply = turns.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    system = turns.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("instruction"))
    return ask.join(reply, ["conv_id", "turn"]).join(system, "conv_id", "left").select("conv_id", "turn", F.coalesce("instruction", F.lit("")).alias("instruction"), "input", "output")
