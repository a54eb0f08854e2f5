"""Checkpoints, quotas, even samples and ranking of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.rules import INTENT_SCOPE, INTENTS
from loomline.functions.text import count_of


def total_chapters(deltas: DataFrame, override: int | None = None) -> DataFrame:
    """One row: the last chapter, 1 if there is none."""
    last = deltas.agg(F.max("chapter").alias("chapter"))
    return last.select((F.lit(override) if override else F.coalesce("chapter", F.lit(1))).alias("total"))


def checkpoints(total: Column, stride: int = 5) -> Column:
    """stride, 2 * stride, ... below total, then total."""
    below = F.when(total > stride, F.sequence(F.lit(stride), total - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.concat(below, F.array(total))


def changed_only(states: DataFrame, *character: str) -> DataFrame:
    """States whose chapter moved since the checkpoint before."""
    first = F.row_number().over(Window.partitionBy(*character, "chapter").orderBy("cp"))
    return states.withColumn("__first", first).filter("__first = 1").drop("__first")


def has_material(facts: Column, memories: Column, goals: Column, relations: Column, emotion: Column) -> Column:
    enough = (F.size(facts) >= 2) | (F.size(memories) >= 1)
    return enough & ((F.size(goals) > 0) | (F.size(relations) > 0) | F.coalesce(emotion != "", F.lit(False)))


def intent_quota(intent: Column, chapter: Column, questions: int = 4, kinds: int = len(INTENTS)) -> Column:
    """How many of the questions, dealt in turn from the chapter's own intent on, an intent gets."""
    k = max(1, questions)
    return F.lit(k // kinds) + F.when(F.pmod(intent - F.pmod(chapter, F.lit(kinds)), F.lit(kinds)) < k % kinds, 1).otherwise(0)


def intent_plan(chapters: DataFrame, questions: int = 4, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """chapter, intent (its number), name, quota, without those that get none."""
    each = chapters.select("chapter", F.posexplode(F.array(*[F.lit(i) for i in intents])).alias("intent", "name"))
    return each.withColumn("quota", intent_quota(F.col("intent"), F.col("chapter"), questions, len(intents)).cast("int")).filter("quota > 0")


def intent_about(intent: Column, scope: tuple[str, ...] = INTENT_SCOPE) -> Column:
    """What an intent (its number) asks for, in a few words for the prompt."""
    return F.get(F.array(*[F.lit(s) for s in scope]), intent)


def quota_pick(candidates: DataFrame, group: str, wanted: int, top_up: bool = True) -> DataFrame:
    """candidates: group, intent, quota, pos, question, bad. Per intent at most its quota of good, new questions, in
    order, wanted in all; top_up: if short, a second round takes other good ones in order."""
    good = candidates.filter("not bad")
    first = good.groupBy(group, "question").agg(F.min_by(F.struct("intent", "quota", "pos"), F.struct("intent", "pos")).alias("c")).select(group, "question", "c.*")
    place = F.row_number().over(Window.partitionBy(group, "intent").orderBy("pos"))
    round_ = F.when(F.col("place") <= F.col("quota"), 0).otherwise(1)
    ordered = first.withColumn("place", place).withColumn("round", round_)
    if not top_up:
        ordered = ordered.filter("round = 0")
    overall = F.row_number().over(Window.partitionBy(group).orderBy("round", "intent", "pos"))
    return ordered.withColumn("n", overall).filter(F.col("n") <= wanted).select(group, "n", "intent", "question")


def even_sample(items: Column, most: int = 6) -> Column:
    """At most so many of an array's elements, evenly spaced."""
    n = F.size(items)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(items, F.floor(i * n / most).cast("int")))
    return F.when(n <= most, items).otherwise(picked)


def richness(known: Column, memories: Column, unknown: Column, relations: Column, mentions: Column) -> Column:
    """How much there is to work with in a character."""
    return known * 3 + memories * 2 + unknown * 4 + relations + F.least(mentions, F.lit(200)) * 2


def mention_counts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """name, mentions over all texts. names: a short list, checked, so it travels inside the expression; every text is
    read once and the counts add up before the shuffle."""
    listed = [r.name for r in names.select("name").distinct().limit(10_001).collect()]
    if len(listed) > 10_000:
        raise ValueError("more than 10,000 names: split the list")
    each = F.transform(F.array(*[F.lit(n) for n in listed]).cast("array<string>"), lambda n: F.struct(n.alias("name"), count_of(F.col("text"), n).cast("long").alias("k")))
    return texts.select(F.inline(F.filter(each, lambda x: x["k"] > 0))).groupBy("name").agg(F.sum("k").alias("mentions"))


def top_characters(scored: DataFrame, n: int = 20, explicit: list[str] | None = None) -> DataFrame:
    """scored: name, score, first_seen. The n best, ties by first appearance; 0 means all; an explicit list wins."""
    if explicit:
        return scored.filter(F.col("name").isin(explicit))
    best = scored.orderBy(F.desc("score"), "first_seen")
    return best.limit(n) if n else best


def capped(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first rows overall; none and 0 mean all."""
    return rows.orderBy(*order).limit(most) if most else rows
