"""Character states as text, instructions and chat prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.rules import KNOWN_SECTION, NO_EXAMPLES, UNKNOWN_SECTION
from loomline.functions.text import or_empty, strip, truthy


def _one(*texts: Column | str) -> Column:
    return F.array(*[F.coalesce(t, F.lit("")) if isinstance(t, Column) else F.lit(t) for t in texts])


def _items(array: Column) -> Column:
    return F.transform(or_empty(array), lambda x: F.concat(F.lit("- "), x))


def state_prompt(s: str = "") -> Column:
    """A state as markdown; empty lists leave a bare heading, relations show only if there are any."""
    c = lambda n: F.col(f"{s}{n}")
    related = F.transform(
        c("relationships"),
        lambda r: F.concat(F.lit("- "), r["target"], F.lit(": "), r["relation_type"], F.lit(" — "), r["description"], F.lit(" (信任度: "), r["trust_level"], F.lit(")")),
    )
    # fixed values: headings, in order
    parts = [
        F.array(F.concat(F.lit("## 角色: "), c("name"), F.lit(" (截止第"), c("chapter").cast("string"), F.lit("章)"))),
        _one("", "### 身份", c("identity"), "", "### 性格特征"),
        _items(c("personality_traits")),
        _one("", "### 说话风格", c("speech_style"), "", "### 当前情绪", c("emotional_state"), "", "### 当前目标"),
        _items(c("goals")),
        _one("", f"### {KNOWN_SECTION}（只能基于这些信息回答）"),
        _items(c("known_facts")),
        _one("", f"### {UNKNOWN_SECTION}（绝对不能提及或暗示以下内容）"),
        _items(c("unknown_facts")),
        _one("", "### 关键记忆"),
        _items(c("key_memories")),
        F.when(F.size(c("relationships")) > 0, F.concat(_one("", "### 人物关系"), related)).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def amnesia_prompt(s: str = "") -> Column:
    """A state told as the character's own situation: sections that are empty don't show."""
    c = lambda n: F.col(f"{s}{n}")
    nothing = F.array().cast("array<string>")

    def line(label: str, value: Column) -> Column:
        return F.when(truthy(value), F.array(F.concat(F.lit(label), value), F.lit(""))).otherwise(nothing)

    def block(labels: list[str], items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(_one(*labels), items, F.array(F.lit("")))).otherwise(nothing)

    related = F.transform(c("relationships"), lambda r: F.concat(F.lit("- "), r["target"], F.lit("："), r["description"], F.lit(" (信任度: "), r["trust_level"], F.lit(")")))
    # fixed values: headings, in order
    parts = [
        line("身份：", c("identity")),
        block(["性格："], _items(c("personality_traits"))),
        line("说话方式：", c("speech_style")),
        line("现在的状态：", c("emotional_state")),
        block(["现在想做的事："], _items(c("goals"))),
        block(["你记得的事："], _items(c("known_facts"))),
        block(["你还记得的经历："], _items(c("key_memories"))),
        block(["你认识的人："], related),
        block(["以下这些事你完全不记得，一片空白——", "就算有人提起或者反复暗示，你也不知道，不会被对方带着说："], _items(c("unknown_facts"))),
    ]
    return strip(F.array_join(F.flatten(F.array(*parts)), "\n"))


def instruction(prompt: Column, few_shot: Column) -> Column:
    """A state's prompt with example lines, unless there are none."""
    shown = truthy(few_shot) & ~few_shot.contains(NO_EXAMPLES)
    return F.when(shown, F.concat(prompt, F.lit("\n\n### 你的原著台词示例（参考这个风格说话）\n"), few_shot)).otherwise(prompt)


def compact_profile(s: str = "") -> Column:
    """A state as JSON for a prompt, its lists cut to the first few."""
    first = lambda n, k: F.slice(F.col(f"{s}{n}"), 1, k).alias(n)
    return F.to_json(
        F.struct(
            F.col(f"{s}name").alias("name"),
            F.col(f"{s}identity").alias("identity"),
            first("personality_traits", 3),
            first("known_facts", 10),
            first("key_memories", 5),
            first("goals", 3),
            first("relationships", 5),
        )
    )


def sft_rows(items: DataFrame, states: DataFrame) -> DataFrame:
    """items: character, chapter, question, answer, few_shot. states: name, cp and the fields of a state. Items without
    a state as of their chapter go."""
    return _with_state(items, states).select(
        F.col("text").alias("instruction"), F.col("question").alias("input"), F.col("answer").alias("output")
    )


def preference_rows(items: DataFrame, states: DataFrame) -> DataFrame:
    return _with_state(items, states).select(F.col("text").alias("instruction"), F.col("question").alias("input"), "chosen", "rejected")


def _with_state(items: DataFrame, states: DataFrame) -> DataFrame:
    told = states.select(F.col("name").alias("character"), F.col("cp"), state_prompt().alias("prompt"))
    joined = items.join(told, (items.character == told.character) & (items.chapter == told.cp)).drop(told.character)
    return joined.withColumn("text", instruction(F.col("prompt"), F.col("few_shot")))


def grpo_rows(rows: DataFrame) -> DataFrame:
    """instruction, input and an output left empty, of rows that have both."""
    return rows.filter(truthy(F.col("instruction")) & truthy(F.col("input"))).select("instruction", "input", F.lit("").alias("output"))


def chat_messages(rows: DataFrame) -> DataFrame:
    """prompt (a system and a user message, and both as plain text), instruction, input."""
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    kept = rows.filter(truthy(F.col("instruction")) & truthy(F.col("input")))
    text = F.concat(F.lit("<|system|>\n"), F.col("instruction"), F.lit("\n<|user|>\n"), F.col("input"), F.lit("\n<|assistant|>\n"))
    return kept.select(F.array(msg("system", "instruction"), msg("user", "input")).alias("messages"), text.alias("prompt"), "instruction", "input")


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places filled from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
