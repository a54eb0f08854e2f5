"""Rewards, retries and evaluation aggregates. Model scores come in as columns; nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.rules import KNOWN_SECTION, UNKNOWN_SECTION, ZH, Pack
from loomline.functions.text import bullets, hard_rules, md5_order, ratio, section, strip

# fixed values: thresholds are strict
ENTAILED, CONTRADICTED = 0.7, 0.7
LEAST_FACT = 4


def unknown_facts(instruction: Column) -> Column:
    return bullets(section(instruction, UNKNOWN_SECTION), least=LEAST_FACT)


def known_text(instruction: Column) -> Column:
    return section(instruction, KNOWN_SECTION)


def reward(response: Column, facts: Column, known: Column, entailment: Column, contradiction: Column, pack: Pack = ZH) -> Column:
    """The ladder: 0.0 out of form, 0.2 a fact leaked, 0.5 known facts contradicted, 1.0 else; the first that holds.
    entailment: a probability per fact (same order); contradiction: one probability. Facts under LEAST_FACT are skipped."""
    r = strip(F.coalesce(response, F.lit("")))
    leaked = F.exists(
        F.arrays_zip(facts.alias("fact"), entailment.alias("p")),
        lambda x: (F.length(x["fact"]) >= LEAST_FACT) & (F.coalesce(x["p"], F.lit(0.0)) > ENTAILED),
    )
    return (
        F.when((r == "") | ~hard_rules(r, pack), F.lit(0.0))
        .when(leaked, F.lit(0.2))
        .when((known != "") & (F.coalesce(contradiction, F.lit(0.0)) > CONTRADICTED), F.lit(0.5))
        .otherwise(F.lit(1.0))
    )


def scored_answers(rows: DataFrame, pack: Pack = ZH) -> DataFrame:
    """rows: answer, facts, entailment. Adds reward (without the contradiction step), reason and the first leaked fact."""
    r = strip(F.coalesce("answer", F.lit("")))
    pairs = F.arrays_zip(F.col("facts").alias("fact"), F.col("entailment").alias("p"))
    leaks = F.filter(pairs, lambda x: (F.length(x["fact"]) >= LEAST_FACT) & (F.coalesce(x["p"], F.lit(0.0)) > ENTAILED))
    first = F.get("leaks", F.lit(0))
    return (
        rows.withColumn("leaks", leaks)
        .withColumn("reward", F.when((r == "") | ~hard_rules(r, pack), F.lit(0.0)).when(F.size("leaks") > 0, F.lit(0.2)).otherwise(F.lit(1.0)))
        .withColumn("leaked_fact", F.when(F.col("reward") == 0.2, first["fact"]))
        .withColumn("reason", F.when(r == "", "空回答").when(F.col("reward") == 0.0, "格式不通过").when(F.col("reward") == 0.2, F.format_string("泄漏: %s... (p=%.3f)", F.left(first["fact"], F.lit(40)), first["p"])).otherwise("通过"))
        .drop("leaks")
    )


def accepted_attempt(attempts: DataFrame, *keys: str) -> DataFrame:
    """attempts: keys, attempt, answer, ok. The first acceptable answer, else the last one whatever it is."""
    return attempts.groupBy(*keys).agg(F.coalesce(F.min_by("answer", F.when(F.col("ok"), F.col("attempt"))), F.max_by("answer", "attempt")).alias("answer"))


def retry_temperature(base: float, attempt: Column) -> Column:
    return F.least(F.lit(base) + attempt * 0.08, F.lit(0.75))


def chosen_rejected(attempts: DataFrame, *keys: str, most: int = 2) -> DataFrame:
    """attempts: keys, attempt (from 0), answer, leaked, fallback (a rejected answer written on purpose). The first
    answer that doesn't leak is chosen; rejected is the first that leaked before it, else the fallback. A failed check
    counts as no leak; where all leak, there is no row."""
    leaked = F.coalesce("leaked", F.lit(False))
    safe = F.when(~leaked, F.col("attempt"))
    out = attempts.filter(F.col("attempt") < most).groupBy(*keys).agg(
        F.min_by("answer", safe).alias("chosen"),
        F.min(safe).alias("at"),
        F.min_by(F.struct("attempt", "answer"), F.when(leaked, F.col("attempt"))).alias("leak"),
        F.min_by("fallback", "attempt").alias("fallback"),
    )
    rejected = F.when(F.col("leak.attempt") < F.col("at"), F.col("leak.answer")).otherwise(F.col("fallback"))
    return out.filter(F.col("at").isNotNull()).select(*keys, "chosen", rejected.alias("rejected"))


# --- evaluation


def boundary(rows: DataFrame, *group: str) -> DataFrame:
    """rows: leaked (nullable: the judge failed). The share that did not leak among those judged, 0 if none was."""
    return rows.groupBy(*group).agg(
        F.count("leaked").alias("valid"), F.count_if("leaked").alias("leaks"), ratio(F.count("leaked") - F.count_if("leaked"), F.count("leaked")).alias("boundary_rate")
    )


def style(rows: DataFrame, *group: str) -> DataFrame:
    """rows: format_pass, score. Scores average over the rows in form alone."""
    score = F.when(F.col("format_pass"), F.col("score"))
    base = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if("format_pass").alias("passed"), F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_score"))
    return base.withColumn("format_accuracy", ratio(F.col("passed"), F.col("total"))).withColumn("combined", F.col("format_accuracy") * F.col("avg_score") / 5)


def swap_flag(id_: Column) -> Column:
    """A coin toss per sample that comes out the same every time."""
    return F.pmod(F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1


def unswapped(rows: DataFrame) -> DataFrame:
    """rows: swapped, score_a, score_b, winner as the judge saw them. What was swapped is put back; there, a winner that
    is neither A nor B is a tie."""
    s = F.col("swapped")
    back = F.when(F.col("winner") == "A", "B").when(F.col("winner") == "B", "A").otherwise("tie")
    return rows.withColumns(
        {
            "score_a": F.when(s, F.col("score_b")).otherwise(F.col("score_a")),
            "score_b": F.when(s, F.col("score_a")).otherwise(F.col("score_b")),
            "winner": F.when(s, back).otherwise(F.col("winner")),
        }
    )


def pairwise(rows: DataFrame, *group: str) -> DataFrame:
    """rows: score_a, score_b, winner. Ties, and winners of no known name, stay in the denominator."""
    out = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("winner") == "A").alias("wins_a"),
        F.count_if(F.col("winner") == "B").alias("wins_b"),
        F.coalesce(F.avg("score_a"), F.lit(0.0)).alias("avg_a"),
        F.coalesce(F.avg("score_b"), F.lit(0.0)).alias("avg_b"),
    )
    return out.withColumn("ties", F.col("total") - F.col("wins_a") - F.col("wins_b")).withColumn("win_rate_b", ratio(F.col("wins_b"), F.col("total")))


def reward_summary(rows: DataFrame, *group: str) -> DataFrame:
    """rows: reward, judged_leak (nullable). Leaks are rewards of 0.2: an answer out of form leaked nothing."""
    leak = F.col("reward") == 0.2
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("avg_reward"),
        F.count_if(leak).alias("leaks"),
        F.count_if(F.col("judged_leak").isNotNull() & (F.col("judged_leak") != leak)).alias("disagreements"),
    )


def model_delta(summary: DataFrame, model: str, metric: str, a: str, b: str) -> DataFrame:
    """metric of b less that of a, and its sign."""
    of = lambda m: F.max(F.when(F.col(model) == m, F.col(metric)))
    return summary.agg(of(a).alias("a"), of(b).alias("b")).withColumn("delta", F.col("b") - F.col("a")).withColumn("sign", F.signum("delta").cast("int"))


def same_samples(a: DataFrame, b: DataFrame, key: str = "sample_id", n: int | None = None, seed: int = 42) -> DataFrame:
    """Both models' answers to the same questions, the same n of them."""
    both = a.withColumnRenamed("answer", "answer_a").join(b.select(key, F.col("answer").alias("answer_b")), key)
    return both.orderBy(md5_order(key, seed=seed), key).limit(n) if n else both


def batch_reward(rows: DataFrame, pack: Pack = ZH) -> DataFrame:
    """rows: instruction (null counts as empty), response, entailment, contradiction. The trainer's reward per row."""
    instruction = F.coalesce("instruction", F.lit(""))
    return rows.withColumn("reward", reward(F.col("response"), unknown_facts(instruction), known_text(instruction), F.col("entailment"), F.col("contradiction"), pack))
