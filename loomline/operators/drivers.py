"""The drivers that call models: extraction, compression, patches, chat turns and evaluation. Each is a plan over a provider;
a model is called once per row, after the cheap filters, and retries are rows with an attempt number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.rules import UNKNOWN_SECTION, ZH, Pack
from loomline.functions.text import clean_answer, hard_rules, labelled_field, recover_json, response_or_raw, section, string_items, truncate_middle
from loomline.operators import extraction, fold, prepare, reward, session
from loomline.operators.render import compact_profile, fill, state_prompt
from loomline.sources.providers import Provider
from loomline.sources.tables import cut

#: Prompts are our own wording; {name} places are filled from columns.
EXTRACT = "已知人物：{names}\n请从第{chapter}章提取摘要、出场人物、事件、人物变化与新人物，只输出 JSON。\n{content}"
AGAIN = "\n上次的每个人物变化都缺少 unknown_facts_updated，请补全。"
COMPRESS = "请压缩角色 {name} 的状态，只输出 JSON。\n{profile}"
PATCH = "角色资料：{profile}\n请列出此人此时不可能知道的事，只输出 JSON 字符串数组。"
CHAT = "你是 {name}。\n{state}\n对话：\n{history}\n用户：{input}\n先在 think 标签里思考，再回复。"
STRONGER = "\n注意：上次的回复透露了不该知道的内容（{reason}），请避免。"
LEAKED = "不该知道的事：\n{facts}\n回复：{response}\n是否透露？只输出 JSON：{\"leaked\": true 或 false, \"reason\": \"\"}"
STYLE = "角色 {name}，第{chapter}章。问题：{question}\n回答：{answer}\n给说话风格打 1 到 5 分，只输出 JSON：{\"score\": 3, \"reason\": \"\"}"
COMPARE = "角色 {name}，第{chapter}章。问题：{question}\n甲：{a}\n乙：{b}\n各打 1 到 5 分并选优，只输出 JSON：{\"score_a\": 3, \"score_b\": 3, \"winner\": \"A\"}"


def _ask(rows: DataFrame, provider: Provider, prompt: Column, into: str = "text", attempt: int = 0, **settings: float) -> DataFrame:
    asked = rows.withColumn("prompt", prompt).withColumn("attempt", F.lit(attempt))
    for name, value in settings.items():
        asked = asked.withColumn(name, F.lit(value))
    # written at once: two branches that read a reply must not ask twice
    return cut(provider.complete(asked).drop("prompt", "attempt", *settings).withColumnRenamed("text", into))


def _said(reply: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(recover_json(reply)), path, kind)


def extract_chapters(chapters: DataFrame, provider: Provider, names: DataFrame | None = None) -> DataFrame:
    """chapters: doc_id, index, content. names: doc_id, names (an array, a hint in the prompt). Deltas, one per chapter:
    where every change of the first reply lacks its unknown facts there is a second, and the better one counts. A
    chapter whose replies hold no JSON is left out, to be taken up by the next run."""
    base = chapters.join(names, "doc_id", "left") if names is not None else chapters.withColumn("names", F.array().cast("array<string>"))
    ask = fill(EXTRACT, names=extraction.known_names(F.coalesce("names", F.array().cast("array<string>"))), chapter=F.col("index"), content=truncate_middle(F.col("content")))
    keys = ["doc_id", "index"]
    first = extraction.normalise(_ask(base, provider, ask, "raw")).withColumn("attempt", F.lit(0))
    retry = first.filter(extraction.should_retry(F.col("stats"))).select(*base.columns)
    second = extraction.normalise(_ask(retry, provider, F.concat(ask, F.lit(AGAIN)), "raw", 1)).withColumn("attempt", F.lit(1))
    both = first.unionByName(second).filter(recover_json(F.col("raw")).isNotNull())
    best = extraction.best_attempt(both, *keys)
    return best.select("doc_id", F.col("index").cast("long").alias("seq"), F.col("index").alias("chapter"), "extraction")


def compress_states(states: DataFrame, provider: Provider, threshold: int = 20) -> DataFrame:
    """The states with those over the threshold replaced by the model's; a reply without JSON changes nothing."""
    kind = f"struct<identity:string,personality_traits:array<string>,speech_style:string,known_facts:array<string>,unknown_facts:array<string>,emotional_state:string,goals:array<string>,key_memories:array<string>,relationships:{fold.RELATIONS}>"
    states = cut(states)  # read for the requests and for what stays
    over = fold.to_compress(states, threshold).select("doc_id", "name", compact_profile().alias("profile"))
    replies = _ask(over, provider, fill(COMPRESS, name=F.col("name"), profile=F.col("profile")))
    compact = replies.withColumn("json", recover_json(F.col("text"))).filter("json is not null").select("doc_id", "name", F.from_json("json", kind).alias("compact"))
    return fold.apply_compression(states, compact)


def patch_facts(states: DataFrame, provider: Provider, chapter: int, least_facts: int = 2, overwrite: bool = False) -> DataFrame:
    """Delta rows with what characters can't know, for those that lack such facts. An unusable reply gives no facts."""
    fit = states.filter(fold.patch_eligible(least_facts, overwrite))
    asked = _ask(fit.select("doc_id", "name", compact_profile().alias("profile")), provider, fill(PATCH, profile=F.col("profile")))
    facts = F.coalesce(string_items(recover_json(F.col("text"))), F.array().cast("array<string>"))
    return fold.patches_of(asked.select("doc_id", "name", facts.alias("facts")), chapter)  # only who may be patched was asked


def chat_turn(inputs: DataFrame, states: DataFrame, turns: DataFrame, provider: Provider, most_turns: int = 10, check: bool = True) -> DataFrame:
    """inputs: conv_id, name, input. states: name and a state's fields. turns: the conversations so far. Each input's
    response and reasoning, and whether the first reply leaked: then there is one more, which is not checked again."""
    asked = states.join(inputs.select("name").distinct(), "name", "left_semi")  # no state is written out for nothing
    told = asked.select("name", state_prompt().alias("state"), "unknown_facts")
    history = session.history_text(session.compaction(turns.filter("role <> 'system'"), most_turns))
    base = inputs.join(told, "name").join(history, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit("（对话刚开始）")))
    ask = fill(CHAT, name=F.col("name"), state=F.col("state"), history=F.col("history"), input=F.col("input"))
    first = _ask(base, provider, ask, "raw", 0, temperature=0.7).withColumn("r", response_or_raw(F.coalesce("raw", F.lit(""))))
    first = first.select(*base.columns, F.col("r.response").alias("response"), F.col("r.reasoning").alias("reasoning"))
    guarded = first.filter(F.lit(check) & (F.size("unknown_facts") > 0))
    facts = F.array_join(F.transform("unknown_facts", lambda f: F.concat(F.lit("- "), f)), "\n")
    verdict = _ask(guarded.withColumn("facts", facts), provider, fill(LEAKED, facts=F.col("facts"), response=F.col("response")), "verdict", 0, temperature=0.0)
    judged = verdict.select("conv_id", F.coalesce(_said(F.col("verdict"), "$.leaked", "boolean"), F.lit(False)).alias("leaked"), F.coalesce(_said(F.col("verdict"), "$.reason", "string"), F.lit("")).alias("leak_reason"))
    replies = first.join(judged, "conv_id", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))
    again = replies.filter("leaked").select(*base.columns, "leak_reason")
    stronger = F.concat(ask, fill(STRONGER, reason=F.col("leak_reason")))
    second = _ask(again, provider, stronger, "raw", 1, temperature=0.5).withColumn("r", response_or_raw(F.coalesce("raw", F.lit(""))))
    rows = replies.select("conv_id", F.lit(0).alias("attempt"), "reasoning", "response", "leaked", "leak_reason").unionByName(
        second.select("conv_id", F.lit(1).alias("attempt"), F.col("r.reasoning").alias("reasoning"), F.col("r.response").alias("response"), F.lit(None).cast("boolean").alias("leaked"), F.lit(None).cast("string").alias("leak_reason"))
    )
    return session.guarded_reply(rows, "conv_id")


def append_turn(turns: DataFrame, inputs: DataFrame, replies: DataFrame) -> DataFrame:
    """The conversations with the user's message and the reply added."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    both = inputs.join(replies, "conv_id").join(last, "conv_id", "left").withColumn("at", F.coalesce("last", F.lit(-1)))
    new = both.select("conv_id", F.explode(F.array(F.struct((F.col("at") + 1).alias("turn"), F.lit("user").alias("role"), F.col("input").alias("text")), F.struct((F.col("at") + 2).alias("turn"), F.lit("character").alias("role"), F.col("response").alias("text")))).alias("t"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(new.select("conv_id", "t.*"))


def _subject(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"name": labelled_field(F.col("instruction"), "角色名", "角色"), "chapter": labelled_field(F.col("instruction"), "当前章节", "?")})


def _answers(rows: DataFrame, model: Provider, into: str = "answer") -> DataFrame:
    return _ask(rows, model, F.concat_ws("\n", "instruction", "input"), into).withColumn(into, clean_answer(F.coalesce(into, F.lit(""))))


def evaluate_boundary(rows: DataFrame, model: Provider, judge: Provider, n: int = 30, seed: int = 42) -> DataFrame:
    """rows: sample_id, instruction, input. A row per sampled question with leaked (null where the judge failed)."""
    asked = _answers(prepare.sample(rows, n, "sample_id", seed=seed), model)
    facts = section(F.col("instruction"), UNKNOWN_SECTION, min_one=True)
    judged = _ask(asked.withColumn("facts", facts), judge, fill(LEAKED, facts=F.col("facts"), response=F.col("answer")), "verdict", 0, temperature=0.0)
    return judged.select("sample_id", F.col("input").alias("question"), "answer", F.col("facts").alias("unknown_facts"), _said(F.col("verdict"), "$.leaked", "boolean").alias("leaked"), _said(F.col("verdict"), "$.reason", "string").alias("reason"))


def evaluate_style(rows: DataFrame, model: Provider, judge: Provider, n: int = 30, seed: int = 42, pack: Pack = ZH) -> DataFrame:
    """A row per sampled question with format_pass and score; an answer out of form gets 1 and is not judged."""
    asked = _subject(_answers(prepare.sample(rows, n, "sample_id", seed=seed), model)).withColumn("format_pass", hard_rules(F.col("answer"), pack, require_script=True))
    good = _ask(asked.filter("format_pass"), judge, fill(STYLE, name=F.col("name"), chapter=F.col("chapter"), question=F.col("input"), answer=F.col("answer")), "verdict", 0, temperature=0.0)
    score = F.least(F.greatest(F.coalesce(_said(F.col("verdict"), "$.score", "int"), F.lit(1)), F.lit(1)), F.lit(5))
    kept = ["sample_id", F.col("input").alias("question"), "answer", "format_pass"]
    return good.select(*kept, score.alias("score"), _said(F.col("verdict"), "$.reason", "string").alias("reason")).unionByName(
        asked.filter("not format_pass").select(*kept, F.lit(1).alias("score"), F.lit(None).cast("string").alias("reason"))
    )


def evaluate_pairwise(rows: DataFrame, model_a: Provider, model_b: Provider, judge: Provider, n: int = 30, seed: int = 42) -> DataFrame:
    """Both models on the same sample; the judge sees half of the pairs swapped, and what it says is put back."""
    picked = prepare.sample(rows, n, "sample_id", seed=seed)
    both = _subject(_answers(_answers(picked, model_a, "answer_a"), model_b, "answer_b")).withColumn("swapped", reward.swap_flag(F.col("sample_id")))
    s = F.col("swapped")
    shown = {"a": F.when(s, F.col("answer_b")).otherwise(F.col("answer_a")), "b": F.when(s, F.col("answer_a")).otherwise(F.col("answer_b"))}
    judged = _ask(both, judge, fill(COMPARE, name=F.col("name"), chapter=F.col("chapter"), question=F.col("input"), **shown), "verdict", 0, temperature=0.0)
    said = judged.select(
        "sample_id",
        F.col("input").alias("question"),
        "answer_a",
        "answer_b",
        hard_rules(F.col("answer_a"), require_script=True).alias("format_pass_a"),
        hard_rules(F.col("answer_b"), require_script=True).alias("format_pass_b"),
        "swapped",
        F.coalesce(_said(F.col("verdict"), "$.score_a", "int"), F.lit(1)).alias("score_a"),
        F.coalesce(_said(F.col("verdict"), "$.score_b", "int"), F.lit(1)).alias("score_b"),
        F.coalesce(_said(F.col("verdict"), "$.winner", "string"), F.lit("tie")).alias("winner"),
    )
    return reward.unswapped(said)

