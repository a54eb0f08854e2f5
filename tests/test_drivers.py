"""The model drivers with rule and local providers in place of models."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import drivers, extraction, fold, synthesis
from loomline.sources.providers import LocalProvider, RuleProvider

def has(text):
    """Whether a prompt contains the text."""
    return F.col("prompt").contains(text)


def opens(text):
    return F.col("prompt").startswith(text)


@pytest.fixture(scope="module")
def states(spark):
    record = {"new_characters": [{"name": "A", "identity": "船夫"}], "character_changes": [{"name": "A", "new_facts_learned": [f"f{i}" for i in range(25)], "unknown_facts_updated": ["河底有一座旧桥"]}, {"name": "B", "new_facts_learned": ["x", "y"], "relationship_changes": [{"target": "A", "change": "r"}]}]}
    raw = spark.createDataFrame([("d", 0, 1, json.dumps(record))], "doc_id string, seq bigint, chapter int, raw string")
    return fold.current_states(extraction.normalise(raw).select("doc_id", "seq", "chapter", "extraction"))


def test_extraction_retries_and_resumes(spark):
    chapters = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two"), ("d", 3, "three")], "doc_id string, index int, content string")
    good = '```json\n{"character_changes":[{"name":"a","unknown_facts_updated":["u"]}]}\n```'
    rule = F.when(has("one"), F.lit(good)).when(has("three"), F.lit("sorry")).when(F.col("attempt") == 1, F.lit(good)).otherwise(F.lit('{"character_changes":[{"name":"a"}]}'))
    got = {r.chapter: r.extraction.character_changes[0].unknown_facts_updated for r in drivers.extract_chapters(chapters, RuleProvider(rule)).collect()}
    assert got == {1: ["u"], 2: ["u"]}


def test_compression_and_patches(spark, states):
    after = {r.name: r for r in drivers.compress_states(states, RuleProvider(F.lit('{"known_facts":["k"],"goals":["g"]}'))).collect()}
    assert after["A"].known_facts == ["k"] and after["A"].goals == ["g"] and after["A"].identity == "船夫"
    assert after["B"].known_facts == ["x", "y"] and len(after["B"].relationships) == 1
    got = drivers.patch_facts(states, RuleProvider(F.lit('x ["p", 1, "q"]')), 2).collect()
    assert [(r.name, r.unknown_facts_updated) for r in got] == [("B", ["p", "q"])]
    none = drivers.patch_facts(states, RuleProvider(F.lit("?")), 2, overwrite=True).collect()
    assert {r.name: r.unknown_facts_updated for r in none} == {"A": [], "B": []}


def test_chat_turn_regenerates_once(spark, states):
    rule = (
        F.when(opens("不该知道的事"), F.when(has("桥"), '{"leaked": true, "reason": "r"}').otherwise('{"leaked": false}'))
        .when(has("上次的回复"), F.lit("<think>t2</think>A：我不知道。"))
        .otherwise(F.lit("<think>t1</think>A：河底有桥。"))
    )
    inputs = spark.createDataFrame([(1, "A", "你好"), (2, "B", "你好")], "conv_id int, name string, input string")
    turns = spark.createDataFrame([(1, 0, "user", "早"), (1, 1, "character", "早啊")], "conv_id int, turn int, role string, text string")
    replies = drivers.chat_turn(inputs, states, turns, RuleProvider(rule))
    got = {r.conv_id: (r.response, r.reasoning, r.leaked) for r in replies.collect()}
    assert got == {1: ("我不知道。", "t2", True), 2: ("河底有桥。", "t1", False)}
    now = drivers.append_turn(turns, inputs, replies).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role) for r in now] == [(1, 0, "user"), (1, 1, "character"), (1, 2, "user"), (1, 3, "character"), (2, 0, "user"), (2, 1, "character")]


def test_evaluations(spark):
    rows = spark.createDataFrame([(i, "角色名：A\n当前章节：3\n### 未知信息\n- 河底有桥", f"q{i}") for i in range(40)], "sample_id int, instruction string, input string")
    model = RuleProvider(F.when(F.col("sample_id") % 2 == 0, "我在这里。").otherwise("作为AI，我不知道"))
    leak = drivers.evaluate_boundary(rows, model, RuleProvider(F.when(F.col("sample_id") % 4 == 0, '{"leaked": true}').when(F.col("sample_id") % 4 == 1, "broken").otherwise('{"leaked": false}'))).collect()
    assert len(leak) == 30 and {r.leaked for r in leak} == {True, False, None} and leak[0].unknown_facts == "- 河底有桥"
    style = drivers.evaluate_style(rows, model, RuleProvider(F.when(has("A，第3章"), '{"score": 9}'))).collect()
    assert len(style) == 30 and {(r.format_pass, r.score) for r in style} == {(True, 5), (False, 1)}
    pairs = drivers.evaluate_pairwise(rows, RuleProvider(F.lit("我是甲")), RuleProvider(F.lit("我是乙")), RuleProvider(F.when(has("甲：我是甲"), '{"score_a": 4, "score_b": 2, "winner": "A"}').otherwise('{"score_a": 2, "score_b": 4, "winner": "B"}'))).collect()
    assert {r.swapped for r in pairs} == {True, False} and {(r.score_a, r.score_b, r.winner) for r in pairs} == {(4, 2, "A")}


def test_few_shot_with_a_provider(spark):
    keys = spark.createDataFrame([("d", "阿明", 2)], "doc_id string, name string, cp int")
    story = spark.createDataFrame([("d", 1, "阿明说道：“我们先回家吧。”\n老李点头。"), ("d", 2, "“今天的风真大啊。”没有人回应。阿明走了。")], "doc_id string, index int, content string")
    rule = F.when(opens("请从下文列出"), "从没写过的话\n短").when(has("话：今天的风"), "否").otherwise("是")
    # before the verb 道 the run of name characters is 阿明说, which is not the name: the line counts as another's
    assert synthesis.few_shot(keys, story, provider=RuleProvider(rule)).first().few_shot == "从没写过的话"
    assert synthesis.few_shot(keys, story).first().few_shot == "我们先回家吧。\n今天的风真大啊。"
    nobody = spark.createDataFrame([("d", "无名", 2)], "doc_id string, name string, cp int")
    assert synthesis.few_shot(nobody, story.limit(0)).first().few_shot == "（暂无无名的台词示例）"


def test_local_provider(spark):
    got = LocalProvider("upper", lambda: lambda prompts: [p.upper() for p in prompts]).complete(spark.createDataFrame([("a", 1)], "prompt string, k int")).first()
    assert (got.text, got.k) == ("A", 1)


class Counting(RuleProvider):
    """Keeps the attempts that it was asked for."""

    def complete(self, requests):
        self.asked = [*getattr(self, "asked", []), *[(r.attempt, round(r.temperature, 2)) for r in requests.select("attempt", "temperature").collect()]]
        return super().complete(requests)


def test_attempts_go_on_only_after_a_bad_answer_and_warm_up(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, q string")
    rule = F.when((F.col("k") == 2) & (F.col("attempt") < 2), "走").otherwise("我在河边等你。")
    provider = Counting(rule)
    got = synthesis._attempts(rows, provider, F.col("q"), 3, F.length("answer") < 2, 0.65).collect()
    assert sorted((r.k, r.attempt, r.failed) for r in got) == [(1, 0, False), (2, 0, True), (2, 1, True), (2, 2, False)]
    assert sorted(provider.asked) == [(0, 0.65), (0, 0.65), (1, 0.73), (2, 0.75)]


def test_sample_limit_goes_by_the_order_of_characters(spark):
    items = spark.createDataFrame([("B", 1, "q1"), ("A", 2, "q2"), ("A", 1, "q3")], "character string, chapter int, question string")
    names = spark.createDataFrame([("A", 5), ("B", 1)], "name string, first_seen int")
    got = synthesis.within_limits(items, names, 2).collect()
    assert [(r.character, r.question) for r in got] == [("B", "q1"), ("A", "q3")]
    assert synthesis.within_limits(items, names, 0).count() == 3
