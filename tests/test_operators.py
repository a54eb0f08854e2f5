"""Operators on invented rows: worked expectations, properties and edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as t
from loomline.functions.rules import CHAPTER_MARKERS_EXTENDED
from loomline.operators import dialogue, extraction, fold, prepare, ranking, render, reward, segment, session, synthesis
from loomline.sources import files, providers
from loomline.streaming import ingest


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


# --- segmentation


def chapters(spark, text, **kw):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return [(r["index"], r.title, r.content, r.char_count) for r in segment.split_chapters(docs, **kw).orderBy("index").collect()]


def test_greedy_chunks(spark):
    parts = F.array(*[F.lit("x" * n) for n in (5, 4, 3, 9, 1)])
    got = spark.range(1).select(F.explode(segment.greedy_chunks(parts, 8)).alias("c")).collect()
    assert [(r.c["size"], [len(p) for p in r.c["parts"]]) for r in got] == [(5, [5]), (7, [4, 3]), (9, [9]), (1, [1])]


def test_markers_last_wins_and_gapless(spark):
    text = "preface\n第一章 a\n第二章 b\n第三章 c\n第一章 a\n one\n第二章 b\n　\n第三章　c\nthree\nmore"
    got = chapters(spark, text)
    assert [(i, t_) for i, t_, _, _ in got] == [(1, "第一章 a"), (2, "第三章　c")]
    assert got[1][2:] == ("three\nmore", 10)


def test_two_markers_go_by_length(spark):
    got = chapters(spark, "第一章\nx\n\n第二章\ny")
    assert got == [(1, "段落 1", "第一章\nx\n\n第二章\ny", 10)]


@pytest.mark.parametrize("line,hit", [("第十二章 雨", True), ("第一百零一章", False), ("Chapter 7", True), ("chapter 7", False), ("第3回", True), ("第一回那天下雨", False), ("第１２章", True), ("第二部 x 第4章", True), ("", False)])
def test_marker_lines(spark, line, hit):
    assert one(spark, t.is_marker(F.lit(line))) is hit


def test_extended_numerals(spark):
    assert one(spark, t.is_marker(F.lit("第一百零一章"), CHAPTER_MARKERS_EXTENDED)) is True


def test_chunks_keep_all_paragraphs(spark):
    text = "\n\n".join(f"p{i}" + "w" * (i * 37 % 90) for i in range(40))
    got = chapters(spark, text, limit=120)
    assert "\n\n".join(c for _, _, c, _ in got) == text


def test_first_chapters_and_truncation(spark):
    frame = spark.createDataFrame([(i,) for i in range(1, 6)], "index int")
    assert segment.first_chapters(frame, 2).count() == 2 and segment.first_chapters(frame, 0).count() == 5
    assert one(spark, t.truncate_middle(F.lit("abcdefghij"), 5)) == "ab\n\n[...中间省略约6字...]\n\nij"


# --- text


@pytest.mark.parametrize("a,b", [("（笑）阿明说：走吧", "走吧"), ('"先坐下"', "先坐下"), ("“先坐下”", "“先坐下”"), ("  空的　", "空的")])
def test_clean_line(spark, a, b):
    assert one(spark, t.clean_line(F.lit(a))) == b


def test_clean_dialogues(spark):
    raw = "甲：走吧走吧\n走吧走吧\n短\n（一二三四五六七八九十一二三四五六七八九十一二三四五六七八九十一二）好的好的\n你好吗"
    assert one(spark, t.clean_dialogues(F.lit(raw), 5)) == "走吧走吧\n你好吗"


def test_clean_answer(spark):
    assert one(spark, t.clean_answer(F.lit("（看着远处）\n我叹了口气，走吧。\n（停）好"))) == "走吧。\n好"


def test_bullets(spark):
    assert one(spark, t.bullets(F.lit("- a\n* b\n\nc"))) == ["a", "b", "c"]
    assert one(spark, t.bullets(F.lit("-- abcd\n- abc\n•* 四个字的"), all_marks=True, least=4)) == ["abcd", "四个字的"]


def test_sections(spark):
    text = "### 已知信息\n\n### 未知信息\n- x"
    assert one(spark, t.section(F.lit(text), "已知信息")) == ""
    assert one(spark, t.section(F.lit(text), "未知信息")) == "- x"
    assert one(spark, t.section(F.lit("### 甲\na\n## 乙\nb"), "甲", min_one=True)) == "a"
    assert one(spark, t.labelled_field(F.lit("角色名： 阿明 \nx"), "角色名")) == "阿明"
    assert one(spark, t.labelled_field(F.lit("x"), "角色名", "角色")) == "角色"


def test_model_output(spark):
    assert tuple(one(spark, t.split_reasoning(F.lit("no tags: here")))) == ("", "no tags: here")
    assert tuple(one(spark, t.split_reasoning(F.lit("<think> a </think>阿明：b: c")))) == ("a", "b: c")
    assert tuple(one(spark, t.split_reasoning(F.lit("<think>a</think>b: c")))) == ("a", "c")
    assert tuple(one(spark, t.response_or_raw(F.lit("<think>a</think>b:")))) == ("", "<think>a</think>b:")


@pytest.mark.parametrize("raw,ok", [('```json\n{"a":1}\n```', True), ('so: {"a":1}', True), ('{"a":1} tail', False), ("none", False), ("[1,2]", True)])
def test_recover_json(spark, raw, ok):
    assert (one(spark, t.recover_json(F.lit(raw))) is not None) is ok


def test_string_items(spark):
    assert one(spark, t.string_items(F.lit('["a", " b ", 3, "", {"x":1}, null]'))) == ["a", "b"]


def test_counts(spark):
    assert one(spark, t.count_of(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, t.count_of(F.lit("aaaa"), F.lit(""))) == 0


# --- extraction and fold

CH1 = {"new_characters": [{"name": "A", "personality_traits": ["t0"]}], "character_changes": [{"name": "A", "new_facts_learned": ["f1", "f2"], "key_event": "e1", "relationship_changes": [{"target": "B", "change": "r1"}]}]}
CH2 = {"character_changes": [{"name": "B", "emotional_shift": "m1"}, {"character_name": "A", "new_facts_learned": ["f2", "f3", ""], "personality_development": "t1", "relationship_changes": [{"target": "B", "change": "r2"}, {"target": ""}]}]}
CH3 = {"new_characters": [{"name": "B", "identity": "I"}, {"name": ""}], "character_changes": [{"name": "A", "personality_development": "None"}, {"name": "A", "personality_development": "x" * 21}]}


@pytest.fixture(scope="module")
def deltas(spark):
    raw = spark.createDataFrame([("d", i, i + 1, json.dumps(c)) for i, c in enumerate((CH1, CH2, CH3))], "doc_id string, seq bigint, chapter int, raw string")
    return extraction.normalise(raw).select("doc_id", "seq", "chapter", "extraction", "stats")


def test_fold_as_of(spark, deltas):
    cps = spark.createDataFrame([(1,), (2,), (3,)], "cp int")
    got = {(r.cp, r.name): r for r in fold.states_as_of(deltas, cps).collect()}
    a1, a2, b2, b3 = got[1, "A"], got[2, "A"], got[2, "B"], got[3, "B"]
    assert (1, "B") not in got
    assert (a1.chapter, a1.known_facts, a1.key_memories, a1.personality_traits, a1.emotional_state) == (1, ["f1", "f2"], ["[第1章] e1"], ["t0"], "初始状态")
    assert [tuple(r) for r in a1.relationships] == [("B", "相关", "r1", "中")]
    assert (a2.known_facts, a2.personality_traits, [tuple(r) for r in a2.relationships]) == (["f1", "f2", "f3"], ["t0", "t1"], [("B", "相关", "r2", "中")])
    assert (b2.chapter, b2.identity, b2.emotional_state) == (2, "", "m1")
    assert (b3.identity, b3.emotional_state) == ("", "m1")
    assert got[3, "A"].personality_traits == ["t0", "t1"] and got[3, "A"].chapter == 3


def test_fold_is_prefix_monotone(spark, deltas):
    cps = spark.createDataFrame([(1,)], "cp int")
    full = fold.states_as_of(deltas, cps).drop("first_seen").collect()
    cut = fold.states_as_of(deltas.filter("chapter <= 1"), cps).drop("first_seen").collect()
    assert sorted(map(str, full)) == sorted(map(str, cut))


def test_current_equals_last_checkpoint(spark, deltas):
    now = fold.current_states(deltas).drop("first_seen")
    last = fold.states_as_of(deltas, spark.createDataFrame([(3,)], "cp int")).drop("first_seen", "cp")
    assert sorted(map(str, now.collect())) == sorted(map(str, last.select(*now.columns).collect()))
    assert [r.name for r in fold.names_in_order(fold.current_states(deltas)).collect()] == ["A", "B"]


def test_stats_and_retry(spark):
    raws = ['{"character_changes":[{"name":"a"},{"name":"b","unknown_facts_updated":null}]}', '{"character_changes":[{"name":"a"}]}', "broken", '{"character_changes":[{"name":"a","unknown_facts_updated":["u","v"]}]}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "attempt int, raw string")
    done = extraction.normalise(rows).withColumn("retry", extraction.should_retry(F.col("stats"))).orderBy("attempt").collect()
    assert [tuple(r.stats) for r in done] == [(2, 1, 0), (1, 1, 0), (0, 0, 0), (1, 0, 2)]
    assert [r.retry for r in done] == [False, True, False, False]
    best = extraction.best_attempt(extraction.normalise(rows.filter("attempt in (1, 3)").withColumn("k", F.lit(1))), "k").first()
    assert best.stats.unknown_facts_updated == 2


def test_compression(spark, deltas):
    states = fold.current_states(deltas)
    assert fold.to_compress(states, 2).count() == 1
    short = {r.name: r for r in fold.compressed(states, 2, facts=2).collect()}
    assert short["A"].known_facts == ["f2", "f3"] and short["B"].known_facts == []
    replies = spark.createDataFrame([("d", "A", (["only"],))], "doc_id string, name string, compact struct<known_facts:array<string>>")
    replies = replies.withColumn("compact", F.struct("compact.known_facts", F.lit(None).cast(fold.RELATIONS).alias("relationships")))
    after = {r.name: r for r in fold.apply_compression(states, replies).collect()}
    assert after["A"].known_facts == ["only"] and after["A"].relationships == [] and after["A"].personality_traits == ["t0", "t1"]


def test_patches(spark, deltas):
    states = fold.current_states(deltas)
    patches = spark.createDataFrame([("d", "A", [str(i) for i in range(9)]), ("d", "B", ["x"])], "doc_id string, name string, facts array<string>")
    got = fold.patch_deltas(states, patches, 4).collect()
    assert [(r.name, len(r.unknown_facts_updated)) for r in got] == [("A", 8)]


def test_prompts(spark, deltas):
    states = fold.current_states(deltas)
    got = {r.name: (r.p, r.a) for r in states.select("name", render.state_prompt().alias("p"), render.amnesia_prompt().alias("a")).collect()}
    assert got["B"][0] == "## 角色: B (截止第2章)\n\n### 身份\n\n\n### 性格特征\n\n### 说话风格\n\n\n### 当前情绪\nm1\n\n### 当前目标\n\n### 已知信息（只能基于这些信息回答）\n\n### 未知信息（绝对不能提及或暗示以下内容）\n\n### 关键记忆"
    assert got["B"][1] == "现在的状态：m1"
    assert got["A"][0].endswith("### 人物关系\n- B: 相关 — r2 (信任度: 中)")
    assert one(spark, render.instruction(F.lit("p"), F.lit("（暂无x）"))) == "p"


def test_state_file_round_trip(spark, deltas, tmp_path):
    states = fold.current_states(deltas)
    files.state_json(states, deltas).select("value").write.text(str(tmp_path / "s"))
    back, history = files.read_state_file(spark, str(tmp_path / "s"))
    key = lambda frame: sorted(str(r) for r in frame.select("name", "chapter", "known_facts", "key_memories", "relationships").collect())
    assert key(back) == key(states) and history.count() == 3


# --- ranking


@pytest.mark.parametrize("total,want", [(12, [5, 10, 12]), (5, [5]), (3, [3]), (11, [5, 10, 11])])
def test_checkpoints(spark, total, want):
    assert one(spark, ranking.checkpoints(F.lit(total), 5)) == want


@pytest.mark.parametrize("k,chapter,want", [(4, 10, {2: 1, 3: 1, 4: 1, 5: 1}), (10, 5, {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 1}), (0, 7, {7: 1})])
def test_intents(spark, k, chapter, want):
    got = ranking.intent_plan(spark.createDataFrame([(chapter,)], "chapter int"), k).collect()
    assert {r.intent: r.quota for r in got} == want


def test_even_sample(spark):
    assert one(spark, ranking.even_sample(F.sequence(F.lit(0), F.lit(12)))) == [0, 2, 4, 6, 8, 10]
    assert one(spark, ranking.even_sample(F.sequence(F.lit(0), F.lit(3)))) == [0, 1, 2, 3]


def test_totals_and_tops(spark):
    none = spark.createDataFrame([], "chapter int")
    assert ranking.total_chapters(none).first().total == 1 and ranking.total_chapters(none, 9).first().total == 9
    scored = spark.createDataFrame([("a", 3, 2), ("b", 3, 1), ("c", 5, 3)], "name string, score int, first_seen int")
    assert [r.name for r in ranking.top_characters(scored, 2).collect()] == ["c", "b"]
    assert ranking.top_characters(scored, 0).count() == 3 and ranking.top_characters(scored, 1, ["a", "b"]).count() == 2


# --- preparation


@pytest.mark.parametrize("n,val", [(1, 1), (20, 1), (41, 2)])
def test_split_sizes(spark, n, val):
    rows = prepare.train_val(spark.range(n), "id")
    assert rows.filter("split = 'val'").count() == val and rows.count() == n
    assert sorted(r["rank"] for r in rows.collect()) == list(range(1, n + 1))


def test_split_of_nothing(spark):
    assert prepare.train_val(spark.range(0), "id").count() == 0


def test_first_wins_without_separator(spark):
    rows = spark.createDataFrame([("ab", "c", 2), ("a", "bc", 1)], "instruction string, input string, o int")
    assert [r.o for r in prepare.first_wins(rows, prepare.dedup_key("instruction", "input"), "o").collect()] == [1]
    assert prepare.first_wins(rows, prepare.dedup_key("instruction", "input", separator="|"), "o").count() == 2


def test_tolerant_and_strict_lines(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"x":"1"}\n\nbad{\n {"x":"2"} \n')
    b.write_text('{"x":"3"}')
    got = files.read_jsonl_tolerant(spark, [str(a), str(tmp_path / "missing"), str(b)], "x string").orderBy("file_ord", "line_no").collect()
    assert [(r.file_ord, r.line_no, r.x) for r in got] == [(0, 0, "1"), (0, 3, "2"), (2, 0, "3")]
    with pytest.raises(Exception):
        files.read_jsonl_strict(spark, str(a), "x string").collect()
    files.write_train_val(prepare.train_val(files.read_jsonl_strict(spark, str(b), "x string"), "x").drop("rank"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


# --- rewards and evaluation


def test_reward_ladder(spark):
    rows = [("", [], "", [], 0.0, 0.0), ("作为一个AI，我不知道", [], "", [], 0.0, 0.0), ("我知道", ["秘密的事"], "k", [0.71], 0.9, 0.2), ("我知道", ["秘密的事"], "k", [0.7], 0.71, 0.5), ("我知道", ["三个字"], "", [0.99], 0.99, 1.0), ("我知道", ["秘密的事"], "k", [None], 0.7, 1.0)]
    frame = spark.createDataFrame(rows, "r string, f array<string>, k string, e array<double>, c double, want double")
    got = frame.select(reward.reward(*[F.col(c) for c in "rfkec"]).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_scored_answers(spark):
    frame = spark.createDataFrame([("", ["abcd"], [0.9]), ("我说", ["abc", "abcde", "fghij"], [0.9, 0.8, 0.95]), ("我说", ["abcd"], [0.1])], "answer string, facts array<string>, entailment array<double>")
    assert [(r.reward, r.leaked_fact) for r in reward.scored_answers(frame).collect()] == [(0.0, None), (0.2, "abcde"), (1.0, None)]


def test_attempts(spark):
    tries = spark.createDataFrame([(1, 0, "a", True, "f"), (1, 1, "b", False, "f"), (2, 0, "a", True, "f"), (2, 1, "b", True, "f"), (3, 0, "a", None, "f")], "q int, attempt int, answer string, leaked boolean, fallback string")
    got = {r.q: (r.chosen, r.rejected) for r in reward.chosen_rejected(tries, "q").collect()}
    assert got == {1: ("b", "a"), 3: ("a", "f")}
    bad = tries.withColumn("ok", F.col("attempt") > 5)
    assert {r.q: r.answer for r in reward.accepted_attempt(bad, "q").collect()} == {1: "b", 2: "b", 3: "a"}
    assert one(spark, reward.retry_temperature(0.6, F.lit(9))) == 0.75


def test_rates(spark):
    leaked = spark.createDataFrame([(True,), (False,), (False,), (None,)], "leaked boolean")
    assert reward.boundary(leaked).first().boundary_rate == pytest.approx(2 / 3)
    assert reward.boundary(leaked.filter("leaked is null")).first().boundary_rate == 0
    s = reward.style(spark.createDataFrame([(True, 2), (True, 4), (False, 1)], "format_pass boolean, score int")).first()
    assert (s.avg_score, s.format_accuracy, s.combined) == (3.0, pytest.approx(2 / 3), pytest.approx(0.4))
    p = reward.pairwise(spark.createDataFrame([(1, 2, w) for w in ("A", "B", "tie", "x")], "score_a int, score_b int, winner string")).first()
    assert (p.wins_a, p.wins_b, p.ties, p.win_rate_b) == (1, 1, 2, 0.25)
    u = reward.unswapped(spark.createDataFrame([(True, 1, 2, "x"), (False, 1, 2, "x"), (True, 1, 2, "A")], "swapped boolean, score_a int, score_b int, winner string")).collect()
    assert [(r.score_a, r.winner) for r in u] == [(2, "tie"), (1, "x"), (2, "B")]
    d = reward.reward_summary(spark.createDataFrame([(0.2, False), (0.0, True), (1.0, None)], "reward double, judged_leak boolean")).first()
    assert (d.leaks, d.disagreements) == (1, 2)


# --- sessions


@pytest.mark.parametrize("most", [1, 2, 3, 4, 10])
def test_compaction_is_the_loop(spark, most):
    rows = [(c, i, "user" if i % 2 == 0 else "character", f"m{i}") for c in range(1, 48) for i in range(c)]
    got = session.compaction(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), most).collect()
    for c in range(1, 48):
        history, gone = [], {}
        rounds = 0
        for i in range(0, c - c % 2, 2):
            history += [i, i + 1]
            if len(history) > 2 * most:
                rounds += 1
                half = len(history) // 2
                gone |= {m: rounds for m in history[:half]}
                history = history[half:]
        own = {r.turn: r["round"] for r in got if r.conv_id == c}
        assert own == {i: gone.get(i) for i in range(c)}


def test_history_and_guard(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "character", f"m{i}") for i in range(6)]
    done = session.compaction(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 2)
    sums = spark.createDataFrame([(1, 1, "S")], "conv_id int, round int, summary string")
    assert session.history_text(done, sums, "A").first().history == "【早期对话摘要】\nS\n\nA：m3\n用户：m4\nA：m5"
    assert session.to_summarise(done, "A").first().text == "用户：m0\nA：m1\n用户：m2"
    tries = spark.createDataFrame([(1, 0, "r", "a", True), (1, 1, "s", "b", None), (2, 0, "r", "a", None)], "k int, attempt int, reasoning string, response string, leaked boolean").withColumn("leak_reason", F.lit("x"))
    assert {r.k: r.response for r in session.guarded_reply(tries, "k").collect()} == {1: "b", 2: "a"}


# --- dialogue


def test_attribution_and_validation(spark):
    text = "阿明说道：“我们先回家吧。”\n老李点头。\n“今天的风真大啊。”"
    cands = spark.createDataFrame([("阿明", "今天的风真大啊。", text, "否"), ("阿明", "从没说过的话", text, "否"), ("老李", "我们先回家吧。", text, "是"), ("阿明", "我们先回家吧。", text, None)], "name string, line string, text string, reply string")
    got = [(r.line, r.keep) for r in dialogue.validated(cands).collect()]
    assert got[0][1] is False and got[1][1] is True and got[2][1] is False and got[3][1] in (True, False)
    assert one(spark, dialogue.supported(F.lit("阿明"), F.lit("我们先回家"), F.lit(text))) is True
    assert one(spark, dialogue.nearby_lines(F.lit("阿明"), F.lit(text), 1)) == "我们先回家吧。"
    assert one(spark, dialogue.paragraph_context(F.lit("a\nb1\nc"), F.lit("b1"))) == "a\nb1\nc"
    assert one(spark, dialogue.paragraph_context(F.lit("a\nb1\nc"), F.lit("zz"))) == ""


# --- drivers with a rule provider


def test_synthesis_end_to_end(spark, deltas):
    facts = {"character_changes": [{"name": "A", "unknown_facts_updated": ["河底有一座旧桥"]}]}
    more = extraction.normalise(spark.createDataFrame([("d", 3, 4, json.dumps(facts))], "doc_id string, seq bigint, chapter int, raw string")).select(*deltas.columns)
    states = synthesis.checkpoint_states(deltas.unionByName(more), 2)
    story = spark.createDataFrame([("d", i, f"A说道：“这是第{i}天的话。”") for i in range(1, 5)], "doc_id string, index int, content string")
    shots = synthesis.few_shot(states, story)
    assert shots.filter(F.col("name") == "A").orderBy(F.desc("cp")).first().few_shot.startswith("这是第1天的话。")
    rule = (
        F.when(F.col("prompt").contains("问题，只输出"), F.lit('["你今天去了哪里呢？", "你明天打算做什么？", "你喜欢什么样的天气？", "你最近过得怎么样？", 5]'))
        .when(F.col("prompt").contains("是否透露"), F.concat(F.lit('{"leaked": '), F.when(F.col("attempt") == 0, "true").otherwise("false"), F.lit("}")))
        .otherwise(F.concat(F.lit("我在河边，第"), F.col("attempt").cast("string"), F.lit("次。")))
    )
    provider = providers.RuleProvider(rule)
    sft = synthesis.sft_items(states, shots, provider, 2)
    assert sft.count() > 0 and sft.filter("character <> 'A'").count() == 0
    pref = synthesis.preference_items(states, shots, provider).collect()
    assert len(pref) == 2 and {(r.chosen, r.rejected) for r in pref} == {("我在河边，第1次。", "我在河边，第0次。")}
    rows = render.preference_rows(spark.createDataFrame(pref), states)
    assert rows.count() == 2 and "### 未知信息" in rows.first().instruction


def test_table_provider_and_scores(spark):
    table = spark.createDataFrame([("hello",)], "p string").select(F.md5("p").alias("prompt_md5"), F.lit(0).alias("attempt"), F.lit("hi").alias("text"))
    got = providers.TableProvider(table).complete(spark.createDataFrame([("hello",), ("other",)], "prompt string")).collect()
    assert {r.prompt: r.text for r in got} == {"hello": "hi", "other": None}
    pairs = spark.createDataFrame([("a b c", "b d")], "premise string, hypothesis string")
    assert providers.overlap_scores(pairs).first().entailment == 0.5


# --- streams


def test_incremental_ingest(spark, deltas, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    rows = deltas.select("doc_id", "seq", "chapter", F.to_json(F.struct("doc_id", "seq", "chapter", "extraction")).alias("j")).orderBy("seq").collect()
    (source / "1.json").write_text(rows[0].j + "\n" + rows[2].j)
    ingest.stream_deltas(spark, str(source), str(out), str(tmp_path / "cp")).awaitTermination()
    story = spark.createDataFrame([("d", i) for i in (1, 2, 3, 4)], "doc_id string, index int")
    have = ingest.read_deltas(spark, str(out))
    assert sorted(r["index"] for r in ingest.pending(story, have).collect()) == [2, 4]
    assert sorted(r["index"] for r in ingest.pending(story, have, strict=True).collect()) == [4]
    (source / "2.json").write_text(rows[1].j)
    ingest.stream_deltas(spark, str(source), str(out), str(tmp_path / "cp")).awaitTermination()
    batch, stream = fold.current_states(deltas), fold.current_states(ingest.read_deltas(spark, str(out)))
    assert sorted(map(str, batch.drop("first_seen").collect())) == sorted(map(str, stream.drop("first_seen").collect()))
    assert ingest.read_deltas(spark, str(tmp_path / "none")).count() == 0


def test_streams_dedup_and_count(spark, tmp_path):
    source = tmp_path / "rows"
    source.mkdir()
    (source / "a.json").write_text('{"k":1,"v":"a"}\n{"k":1,"v":"a"}\n{"k":2,"v":"b"}')
    run = lambda: ingest.stream_first_wins(spark, str(source), "k int, v string", str(tmp_path / "t"), str(tmp_path / "cp"), ["k"]).awaitTermination()
    run()
    (source / "b.json").write_text('{"k":2,"v":"late"}\n{"k":3,"v":"c"}')
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    events = tmp_path / "events"
    events.mkdir()
    (events / "a.json").write_text("\n".join('{"ts":"2024-01-0%dT10:00:00Z","user_id":1,"event_type":"x"}' % d for d in (1, 1, 2, 3)))
    rows = spark.readStream.schema("ts timestamp, user_id bigint, event_type string").json(str(events))
    stream = ingest.stream_day_counts(rows).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted(r["count"] for r in spark.table("days").collect()) == [1, 1, 2]


def test_edges_of_text_functions(spark):
    assert one(spark, t.strip(F.lit("　 a b "))) == "a b"
    assert one(spark, t.truncate_middle(F.lit(""), 5)) == ""
    assert one(spark, t.clean_dialogues(F.lit(""), 3)) == ""
    assert one(spark, t.string_items(F.lit(None).cast("string"))) == []
    assert one(spark, t.recover_json(F.lit(None).cast("string"))) is None
    assert one(spark, t.bad_question(F.lit("老李(a.b)怎么了呢今天"), F.lit("阿明"), F.array(F.lit("李(a.b)")))) is True
    assert one(spark, t.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, segment.greedy_chunks(F.array().cast("array<string>"), 5)) == []
