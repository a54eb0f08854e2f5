"""The drivers that turn states into supervised and preference items, with model calls behind a provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.rules import INTENTS
from loomline.functions.text import bad_answer, bad_question, clean_answer, clean_dialogues, confirmed, recover_json, string_items
from loomline.operators.dialogue import attributed, candidate_chapters, validated
from loomline.operators.fold import states_as_of
from loomline.operators.ranking import capped, changed_only, checkpoints, even_sample, has_material, intent_about, intent_plan, quota_pick
from loomline.operators.render import fill, state_prompt
from loomline.operators.reward import accepted_attempt, chosen_rejected, retry_temperature
from loomline.sources.providers import Provider
from loomline.sources.tables import cut

#: Prompts are our own wording; {name} places are filled from columns.
QUESTIONS = "你在采访角色 {name}（第{cp}章）。角色资料：\n{state}\n请以「{intent}」（{about}）为题写 {quota} 个问题，只输出 JSON 字符串数组。"
MORE_QUESTIONS = "你在采访角色 {name}（第{cp}章）。角色资料：\n{state}\n请再写 {quota} 个彼此不同的问题，只输出 JSON 字符串数组。"
FACT_QUESTIONS = "角色 {name} 不知道这件事：{fact}\n请写 {quota} 个会触及它的问题，只输出 JSON 字符串数组。"
SUGGEST = "请从下文列出 {name} 说过的话，一行一句，最多 {n} 句，没有就写无。\n{text}"
WHOSE = "下面这句话是不是 {name} 说的？只回答是或否。\n话：{line}\n上下文：{context}"
ANSWER = "请以 {name} 的身份回答，只依据资料。\n资料：\n{state}\n台词示例：\n{few_shot}\n问题：{question}"
LEAKY = "请以 {name} 的身份回答，并有意说出：{fact}\n资料：\n{state}\n问题：{question}"
LEAKED = "资料之外的事实：{fact}\n回答：{answer}\n回答是否透露了它？只输出 JSON：{\"leaked\": true 或 false}"


def checkpoint_states(deltas: DataFrame, stride: int = 5, names: list[str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """States at every checkpoint of the story, for all or the named characters. wanted (column cp): the checkpoints whose
    states will be read, where that is not all; states at others are not written then."""
    total = deltas.agg(F.coalesce(F.max("chapter"), F.lit(1)).alias("total"))
    cps = total.select(F.explode(checkpoints(F.col("total"), stride)).alias("cp"))
    if wanted is not None:
        cps = cps.join(wanted, "cp", "left_semi")
    states = states_as_of(deltas, cps)
    return states.filter(F.col("name").isin(names)) if names else states


def sft_states(states: DataFrame) -> DataFrame:
    fit = has_material(*[F.col(c) for c in ("known_facts", "key_memories", "goals", "relationships", "emotional_state")])
    return changed_only(states.filter(fit), "doc_id", "name")


def preference_states(states: DataFrame) -> DataFrame:
    return changed_only(states.filter(F.size("unknown_facts") > 0), "doc_id", "name")


def few_shot(states: DataFrame, chapters: DataFrame, examples: int = 8, most: int = 6, read: int = 2500, provider: Provider | None = None) -> DataFrame:
    """doc_id, name, cp, few_shot: lines from evenly sampled chapters, computed once per character and checkpoint. With a
    provider its own suggestions join the candidates, and each candidate with a context is put to it for a yes or no."""
    keys = states.select("doc_id", "name", "cp").distinct()
    picked = candidate_chapters(keys, chapters).select("doc_id", "name", "cp", F.posexplode(even_sample(F.col("indexes"), most)).alias("at", "index"))
    parts = picked.join(chapters.select("doc_id", "index", F.left("content", F.lit(read)).alias("part")), ["doc_id", "index"])
    text = parts.groupBy("doc_id", "name", "cp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n\n---\n\n").alias("text"))
    found = attributed(keys.join(text, ["doc_id", "name", "cp"], "left"), examples)
    candidates = F.array_distinct(F.concat("strict", "ambiguous"))
    if provider is None:
        found = found.withColumn("lines", F.slice(candidates, 1, examples))
    else:
        told = _asked(found, provider, fill(SUGGEST, name=F.col("name"), text=F.col("text"), n=F.lit(examples))).drop("prompt", "attempt")
        said = F.filter(F.split(clean_dialogues(F.coalesce(told["text"], F.lit("")), 2 * examples), "\n", -1), lambda x: F.length(x) >= 3)
        found = _validated_lines(told.withColumn("candidates", F.array_distinct(F.concat(candidates, said))), keys.join(text, ["doc_id", "name", "cp"], "left"), provider, examples)
    lines = F.col("lines")
    none = F.concat(F.lit("（暂无"), F.col("name"), F.lit("的台词示例）"))
    return found.select("doc_id", "name", "cp", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(none).alias("few_shot"))


def _validated_lines(found: DataFrame, texts: DataFrame, provider: Provider, examples: int) -> DataFrame:
    keys = ["doc_id", "name", "cp"]
    each = found.select(*keys, F.posexplode("candidates").alias("at", "line")).join(texts, keys)
    first = validated(each.withColumn("reply", F.lit(None).cast("string"))).filter("keep").drop("reply", "keep")
    ask = first.filter("context <> ''").withColumn("chapter_text", F.col("text")).drop("text")
    replies = _asked(ask, provider, fill(WHOSE, name=F.col("name"), line=F.col("line"), context=F.col("context"))).select(*keys, "at", F.col("text").alias("reply"))
    kept = first.join(replies, [*keys, "at"], "left").filter((F.col("context") == "") | F.coalesce(confirmed(F.col("reply")), F.lit(True)))
    lines = kept.groupBy(*keys).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), 1, examples).alias("lines"))
    return found.select(*keys).join(lines, keys, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def _asked(rows: DataFrame, provider: Provider, prompt: Column, *kept: str | Column) -> DataFrame:
    """The replies (text) beside the kept columns, of all columns if none are named. States and prompts are long: where
    many rows share one, they are better not kept."""
    rows = rows if "attempt" in rows.columns else rows.withColumn("attempt", F.lit(0))
    told = provider.complete(rows.withColumn("prompt", prompt))
    return cut(told.select(*kept, "text") if kept else told)  # written at once: a reply is asked for once


def _attempts(rows: DataFrame, provider: Provider, prompt: Column, retries: int, fails: Column, temperature: float, told: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """One attempt at a time: only rows on whose answer `fails` holds go on to the next one, warmer each time. Every
    attempt that was made is a row (attempt, answer, failed). told: what prompt and fails read besides rows, met by the
    columns `by` anew at each attempt, so that it is not written once for every row and attempt."""
    done, todo = None, rows
    for k in range(retries + 1):
        asked = todo.join(told, by) if told is not None else todo
        asked = asked.withColumns({"attempt": F.lit(k), "temperature": retry_temperature(temperature, F.lit(k))})
        answered = provider.complete(asked.withColumn("prompt", prompt)).withColumn("answer", clean_answer(F.coalesce("text", F.lit(""))))
        # written at once: an answer is asked for once
        tried = cut(answered.select(*rows.columns, "attempt", "answer", F.coalesce(fails, F.lit(False)).alias("failed")))
        done = tried if done is None else done.unionByName(tried)
        todo = tried.filter("failed").select(*rows.columns)
    return done


def sft_items(states: DataFrame, examples: DataFrame, provider: Provider, questions: int = 4, retries: int = 2) -> DataFrame:
    """doc_id, character, chapter, question, answer, few_shot."""
    own = ["doc_id", "name", "cp"]
    targets = F.transform("relationships", lambda r: r["target"]).alias("targets")
    # read several times: the fold behind it is done once
    chosen = cut(sft_states(states).join(examples, own).select(*own, "few_shot", "known_facts", "key_memories", targets, state_prompt().alias("state")))
    plan = intent_plan(chosen.select(F.col("cp").alias("chapter")).distinct(), questions).withColumnRenamed("chapter", "cp").withColumnRenamed("name", "intent_name")
    about = chosen.select(*own, "targets", "state")
    slots = about.join(F.broadcast(plan), "cp")  # a few rows for each checkpoint
    asked = _asked(slots, provider, fill(QUESTIONS, name=F.col("name"), cp=F.col("cp"), state=F.col("state"), intent=F.col("intent_name"), about=intent_about(F.col("intent")), quota=F.col("quota") + 1), *own, "targets", "intent", "quota")
    key = F.concat_ws("\x1f", F.col("doc_id").cast("string"), "name", F.col("cp").cast("string"))

    def candidates(replies: DataFrame, intent: Column, quota: Column) -> DataFrame:
        each = replies.withColumn("slice", key).select("slice", "name", "targets", intent.alias("intent"), quota.alias("quota"), F.posexplode(string_items(recover_json(F.col("text")))).alias("pos", "question"))
        return each.withColumn("bad", bad_question(F.col("question"), F.col("name"), F.col("targets")))

    first = cut(quota_pick(candidates(asked, F.col("intent"), F.col("quota")), "slice", questions, top_up=False))
    # who is short is asked once more, without an intent, for what is lacking
    have = first.groupBy("slice").agg(F.count(F.lit(1)).alias("have"))
    short = about.withColumn("slice", key).join(have, "slice", "left").withColumn("lack", F.lit(max(1, questions)) - F.coalesce("have", F.lit(0))).filter("lack > 0")
    again = _asked(short, provider, fill(MORE_QUESTIONS, name=F.col("name"), cp=F.col("cp"), state=F.col("state"), quota=F.col("lack") + 2), *own, "targets", "lack")
    extra = candidates(again, F.lit(len(INTENTS)), F.col("lack")).join(first.select("slice", "question"), ["slice", "question"], "left_anti")
    more = quota_pick(extra, "slice", questions, top_up=False)
    picked = first.unionByName(more.join(have, "slice", "left").withColumn("n", F.col("n") + F.coalesce("have", F.lit(0))).drop("have"))
    base = cut(chosen.select(*own, key.alias("slice")).join(picked, "slice").select(*own, "n", "question"))
    keys = [*own, "n"]
    fails = bad_answer(F.col("answer"), F.col("known_facts"), F.col("key_memories"))
    told = chosen.select(*own, "state", "few_shot", "known_facts", "key_memories")
    tried = _attempts(base, provider, fill(ANSWER, name=F.col("name"), state=F.col("state"), few_shot=F.col("few_shot"), question=F.col("question")), retries, fails, 0.55, told, own)
    judged = tried.withColumn("ok", ~F.col("failed"))
    answers = accepted_attempt(judged, *keys)
    found = base.join(answers, keys).filter("answer <> ''").join(chosen.select(*own, "few_shot"), own)
    return found.select("doc_id", F.col("name").alias("character"), F.col("cp").alias("chapter"), "question", "answer", "few_shot")


def preference_items(states: DataFrame, examples: DataFrame, provider: Provider, questions: int = 2, attempts: int = 2) -> DataFrame:
    """doc_id, character, chapter, unknown_fact, question, chosen, rejected, few_shot."""
    own = ["doc_id", "name", "cp"]
    # read several times: the fold behind it is done once
    chosen = cut(preference_states(states).join(examples, own).select(*own, "unknown_facts", "few_shot", state_prompt().alias("state")))
    told = chosen.select(*own, "state", "few_shot")  # met anew at each request, not written beside every question
    facts = chosen.select(*own, F.posexplode("unknown_facts").alias("fact_no", "fact"))
    asked = _asked(facts, provider, fill(FACT_QUESTIONS, name=F.col("name"), fact=F.col("fact"), quota=F.lit(questions)), *own, "fact_no", "fact")
    each = asked.select(*own, "fact_no", "fact", F.posexplode(F.slice(string_items(recover_json(F.col("text"))), 1, questions)).alias("pos", "question"))
    keys = [*own, "fact_no", "pos"]
    done, todo = None, cut(each)
    each = todo
    for k in range(attempts):  # an answer that leaks is kept as the rejected one, and asks for another
        asked = _asked(todo.join(told, own).withColumn("attempt", F.lit(k)), provider, fill(ANSWER, name=F.col("name"), state=F.col("state"), few_shot=F.col("few_shot"), question=F.col("question")), *each.columns, "attempt")
        tried = asked.withColumn("answer", clean_answer(F.coalesce("text", F.lit("")))).drop("text")
        verdicts = _asked(tried, provider, fill(LEAKED, fact=F.col("fact"), answer=F.col("answer")), *tried.columns)
        leaked = F.try_variant_get(F.try_parse_json(recover_json(F.col("text"))), "$.leaked", "boolean")
        judged = cut(verdicts.withColumn("leaked", F.coalesce(leaked, F.lit(False))).drop("text"))
        done = judged if done is None else done.unionByName(judged)
        todo = judged.filter("leaked").select(*each.columns)
    # a rejected answer is written on purpose only where the first one was safe already
    alone = done.filter("attempt = 0 and not leaked").select(*each.columns)
    spare = _asked(alone.join(told, own), provider, fill(LEAKY, name=F.col("name"), fact=F.col("fact"), state=F.col("state"), question=F.col("question")), *keys)
    spare = spare.select(*keys, clean_answer(F.coalesce("text", F.lit(""))).alias("fallback"))
    pairs = chosen_rejected(done.join(spare, keys, "left"), *keys, most=attempts)
    found = each.join(pairs, keys).join(chosen.select(*own, "few_shot"), own)
    return found.select("doc_id", F.col("name").alias("character"), F.col("cp").alias("chapter"), F.col("fact").alias("unknown_fact"), "question", "chosen", "rejected", "few_shot")


def within_limits(items: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """The first `most` items overall, characters in the order of names (name, first_seen), each taking what those before
    it left; none and 0 mean all. An index over items alone: it needs no model."""
    if not most:
        return items
    order = names.select(F.col("name").alias("character"), "first_seen")
    return capped(items.join(order, "character", "left"), ["first_seen", "character", "chapter", "question"], most).drop("first_seen")
