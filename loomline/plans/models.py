"""Queries over the drivers that call models, with rules over the request in place of a model; each with its SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.rules import INTENTS
from loomline.operators import drivers, reward, synthesis
from loomline.plans import characters, speech
from loomline.plans.narrative import STRIP
from loomline.plans.relational import RULES, labelled, table
from loomline.sources.providers import LocalProvider, Provider, RuleProvider, score_pairs
from loomline.sources.tables import cut

_OUT_OF_FORM = """contains(text, 'License') OR (length({0}) > 3000 AND NOT contains(text, '|') AND regexp_matches(text, 'the (of|and)')) OR regexp_matches(chr(10) || {0}, '\\n[A-Z][a-z]{{14,}}')""".format(STRIP % "text")


def _has(text: str):
    return F.col("prompt").contains(text)


def _opens(text: str):
    return F.col("prompt").startswith(text)


@dataclass
class Staged(Provider):
    """One provider for requests that ask for questions, another for those about a question (pos)."""

    ask: Provider
    tell: Provider

    def complete(self, requests: DataFrame) -> DataFrame:
        return (self.tell if "pos" in requests.columns else self.ask).complete(requests)


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference scores by table: whole texts as premises, half of the pairs scored."""
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("premise"), F.col("source").alias("hypothesis"))
    scored = pairs.filter("doc_id % 2 = 0").select(F.md5(F.concat_ws("\x1f", "premise", "hypothesis")).alias("pair_md5"), F.lit(0.5).alias("entailment"), F.lit(0.25).alias("neutral"), F.lit(0.25).alias("contradiction")).distinct()
    return score_pairs(pairs, scored).select("doc_id", "entailment", "contradiction")


PAIR_SCORES = """WITH p AS (SELECT DISTINCT text, source FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN p.text IS NOT NULL THEN CAST(0.5 AS DOUBLE) END AS entailment, CASE WHEN p.text IS NOT NULL THEN CAST(0.25 AS DOUBLE) END AS contradiction FROM documents d LEFT JOIN p ON p.text = d.text AND p.source = d.source"""


def _lengths():
    return lambda prompts: [str(len(p)) for p in prompts]


def local_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model loaded once per worker (here: it counts characters)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return LocalProvider("lengths", _lengths).complete(turns).select("conv_id", "turn", F.col("text").cast("long").alias("n"))


LOCAL = "SELECT conv_id, turn, length(text) AS n FROM conversations"


def batch_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as responses; every fifth row has no instruction, so nothing to leak and nothing to contradict."""
    instruction = F.concat(F.lit("## x\n### 已知信息\n- "), "source", F.lit("\n### 未知信息\n- long fact\n- abc"))
    rows = labelled(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 5 > 0, instruction).alias("instruction"),
        F.col("text").alias("response"),
        F.array(F.col("toxic") * 0.9).alias("entailment"),
        ((1 - F.col("quality")) * 0.8).alias("contradiction"),
    )
    return reward.batch_reward(rows, RULES).select("doc_id", "reward")


REWARDS = f"""SELECT doc_id, CAST(CASE WHEN {STRIP % 'text'} = '' OR {_OUT_OF_FORM} THEN 0.0 WHEN doc_id % 5 > 0 AND toxic = 1 THEN 0.2 WHEN doc_id % 5 > 0 AND quality = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS reward
FROM documents JOIN labels USING (doc_id)"""


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("doc_id", F.col("text").alias("answer"), F.array(F.lit("first fact"), F.lit("abc"), F.col("source")).alias("facts"), F.array(F.col("toxic") * 0.5, F.lit(0.99), F.col("toxic") * 0.95).alias("entailment"))
    return reward.scored_answers(rows, RULES).select("doc_id", "reward", "reason", "leaked_fact")


SCORED = f"""
WITH x AS (SELECT doc_id, source, {STRIP % 'text'} = '' AS none, {_OUT_OF_FORM} AS bad, toxic = 1 AND length(source) >= 4 AS leak FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CAST(CASE WHEN none OR bad THEN 0.0 WHEN leak THEN 0.2 ELSE 1.0 END AS DOUBLE) AS reward, CASE WHEN NOT (none OR bad) AND leak THEN source END AS leaked_fact,
       CASE WHEN none THEN '空回答' WHEN bad THEN '格式不通过' WHEN leak THEN '泄漏: ' || source || '... (p=0.950)' ELSE '通过' END AS reason FROM x
"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.concat(F.lit("角色名：A\n当前章节：3\n### 未知信息\n- "), "role").alias("instruction"), F.col("text").alias("input"))


_SAMPLE = "SELECT conv_id * 1000 + turn AS sample_id, role, text FROM conversations ORDER BY md5('42:' || (conv_id * 1000 + turn)), 1 LIMIT 30"


def boundary_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation's sample (a sampling operator), its answers, and a judge that sometimes fails."""
    k = F.col("sample_id") % 3
    judge = F.when(k == 0, '{"leaked": true, "reason": "r"}').when(k == 1, "broken").otherwise('so: {"leaked": false}')
    got = drivers.evaluate_boundary(_samples(spark, sf_dir), RuleProvider(F.concat(F.lit("（笑）我"), "input")), RuleProvider(judge))
    return got.select("sample_id", "question", "answer", "unknown_facts", F.col("leaked").cast("string").alias("leaked"), "reason")


BOUNDARY_JUDGED = f"""SELECT sample_id, text AS question, {STRIP % "('我' || text)"} AS answer, '- ' || role AS unknown_facts, CASE sample_id % 3 WHEN 0 THEN 'true' WHEN 2 THEN 'false' END AS leaked,
  CASE WHEN sample_id % 3 = 0 THEN 'r' END AS reason FROM ({_SAMPLE})"""


def style_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sample_id")
    model, judge = F.when(k % 2 == 0, "我在这里。").otherwise("作为AI，我不知道"), F.concat(F.lit('{"score": '), (k % 9).cast("string"), F.lit("}"))
    return drivers.evaluate_style(_samples(spark, sf_dir), RuleProvider(model), RuleProvider(judge)).select("sample_id", "format_pass", "score")


STYLE_JUDGED = f"SELECT sample_id, sample_id % 2 = 0 AS format_pass, CAST(CASE WHEN sample_id % 2 = 0 THEN least(greatest(sample_id % 9, 1), 5) ELSE 1 END AS INTEGER) AS score FROM ({_SAMPLE})"


def pairwise_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on one sample; the judge sees half of the pairs swapped and knows only which it saw first."""
    judge = F.when(_has("甲：我是甲"), '{"score_a": 4, "score_b": 2, "winner": "A"}').when(F.col("sample_id") % 2 == 0, '{"score_a": 1, "score_b": 5, "winner": "none"}').otherwise('{"score_a": 2, "score_b": 3, "winner": "B"}')
    got = drivers.evaluate_pairwise(_samples(spark, sf_dir), RuleProvider(F.lit("我是甲")), RuleProvider(F.lit("我是乙")), RuleProvider(judge))
    return got.select("sample_id", "swapped", "score_a", "score_b", "winner", "format_pass_a")


PAIRWISE_JUDGED = f"""WITH x AS (SELECT sample_id, ('0x' || substr(md5(CAST(sample_id AS VARCHAR)), 1, 8))::BIGINT % 2 = 1 AS swapped FROM ({_SAMPLE}))
SELECT sample_id, swapped, CAST(CASE WHEN NOT swapped THEN 4 WHEN sample_id % 2 = 0 THEN 5 ELSE 3 END AS INTEGER) AS score_a, CAST(CASE WHEN NOT swapped THEN 2 WHEN sample_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS score_b,
       CASE WHEN NOT swapped THEN 'A' WHEN sample_id % 2 = 0 THEN 'tie' ELSE 'A' END AS winner, true AS format_pass_a FROM x"""


def same_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' answers, not to quite the same questions."""
    rows = table(spark, sf_dir, "documents")
    a = rows.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("answer"))
    b = rows.filter("doc_id % 2 > 0").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("answer"))
    return reward.same_samples(a, b).select("sample_id", F.md5("answer_a").alias("a_md5"), "answer_b")


SAME = "SELECT doc_id AS sample_id, md5(text) AS a_md5, source AS answer_b FROM documents WHERE doc_id % 3 > 0 AND doc_id % 2 > 0"


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn for each conversation whose character exists: a first reply that leaks gives way to a second."""
    turns = table(spark, sf_dir, "conversations")
    inputs = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("input")).withColumn("name", (F.col("conv_id") % 20).cast("string"))
    verdict = F.when(F.col("conv_id") % 2 == 0, '{"leaked": true, "reason": "r"}').otherwise('{"leaked": false}')
    rule = F.when(_opens("不该知道的事"), verdict).when(_has("上次的回复"), F.lit("<think>t2</think>A：不知道。")).otherwise(F.concat(F.lit("<think> t1 </think>A："), "input"))
    return drivers.chat_turn(inputs, characters.current(spark, sf_dir), turns, RuleProvider(rule)).select("conv_id", "response", "reasoning", "leaked", "leak_reason")


CHAT = characters.CURRENT + f""", i AS (SELECT conv_id, arg_max(text, turn) AS input, CAST(conv_id % 20 AS VARCHAR) AS name FROM conversations WHERE role = 'user' GROUP BY conv_id),
k AS (SELECT i.*, conv_id % 2 = 0 AND nu > 0 AS leaked FROM i JOIN lists l ON l.name = i.name)
SELECT conv_id, CASE WHEN leaked THEN '不知道。' ELSE {STRIP % 'input'} END AS response, CASE WHEN leaked THEN 't2' ELSE 't1' END AS reasoning, leaked, CASE WHEN leaked THEN 'r' ELSE '' END AS leak_reason FROM k"""


def _even():
    return F.col("name").cast("int") % 2 == 0


def sft_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every checkpoint: characters of even number get their questions by intent, the others only when asked
    again; a first answer is always too short."""
    states = cut(characters.at(spark, sf_dir, 15))  # the items and the examples read them
    examples = states.select("doc_id", "name", "cp", F.concat(F.lit("ex "), "name").alias("few_shot"))
    intent = F.regexp_extract("prompt", "请以「([^」]+)」", 1)
    asked = F.when(intent == "", '["补问第一个问题吗？", "补问第二个问题吗？", "补", "补问第一个问题吗？", "补问第三个问题吗？", "补问第四个问题吗？", "补问第五个问题吗？"]')
    asked = asked.when(_even(), F.concat(F.lit('ok ["坏", "关于'), intent, F.lit('的一个问题是什么？", "关于'), intent, F.lit('的又一个问题呢？"]'))).otherwise('["坏"]')
    rule = F.when(_opens("你在采访角色"), asked).when(F.col("attempt") == 0, "走").otherwise("（笑）我在河边等你。")
    return synthesis.sft_items(states, examples, RuleProvider(rule)).select("character", "chapter", "question", "answer", "few_shot")


SFT_DIALOGUES = characters.states_sql(15) + f""", a AS (SELECT name, cp FROM (SELECT *, row_number() OVER (PARTITION BY name, chapter ORDER BY cp) AS k FROM lists WHERE (nf >= 2 OR nm >= 1) AND (nr > 0 OR emotion <> '')) WHERE k = 1),
i AS (SELECT i, [{', '.join(f"'{x}'" for x in INTENTS)}][i + 1] AS intent FROM range({len(INTENTS)}) r(i))
SELECT name AS character, cp AS chapter, '关于' || intent || '的一个问题是什么？' AS question, '我在河边等你。' AS answer, 'ex ' || name AS few_shot FROM a JOIN i ON ((i - cp % 8) % 8 + 8) % 8 < 4 WHERE CAST(name AS INTEGER) % 2 = 0
UNION ALL SELECT name, cp, '补问第' || k || '个问题吗？', '我在河边等你。', 'ex ' || name FROM a, (SELECT unnest(['一', '二', '三', '四']) AS k) WHERE CAST(name AS INTEGER) % 2 <> 0"""


def preference_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for every unknown fact of every checkpoint. First answers to first questions leak; every fifth character leaks
    whenever the second question comes, and has no item then."""
    states = cut(characters.at(spark, sf_dir, 15))  # the items and the examples read them
    examples = states.select("doc_id", "name", "cp", F.lit("ex").alias("few_shot"))
    leaks = ((F.col("pos") == 0) & (F.col("attempt") == 0)) | ((F.col("pos") == 1) & (F.col("name").cast("int") % 5 == 0))
    verdict = F.when(leaks, '{"leaked": true}').when(F.col("pos") == 1, "broken").otherwise('{"leaked": false}')
    answer = F.when(_has("有意说出"), F.concat(F.lit("其实"), "fact")).otherwise(F.concat(F.lit("回答第"), F.col("attempt").cast("string"), F.lit("次")))
    model = Staged(RuleProvider(F.lit('["问题一吗？", "问题二吗？", "多余的问题"]')), RuleProvider(F.when(_opens("资料之外的事实"), verdict).otherwise(answer)))
    return synthesis.preference_items(states, examples, model).select("character", "chapter", "unknown_fact", "question", "chosen", "rejected")


PREFERENCE_DIALOGUES = characters.states_sql(15) + """, a AS (SELECT name, cp FROM (SELECT *, row_number() OVER (PARTITION BY name, chapter ORDER BY cp) AS k FROM lists WHERE nu > 0) WHERE k = 1)
SELECT a.name AS character, a.cp AS chapter, u.item AS unknown_fact, '问题一吗？' AS question, '回答第1次' AS chosen, '回答第0次' AS rejected FROM a JOIN u ON u.cp = a.cp AND u.name = a.name
UNION ALL SELECT a.name, a.cp, u.item, '问题二吗？', '回答第0次', '其实' || u.item FROM a JOIN u ON u.cp = a.cp AND u.name = a.name WHERE CAST(a.name AS INTEGER) % 5 <> 0"""


def few_shot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example lines of 阿明 from each scene, read whole, or the note that there are none."""
    s = speech.scenes(spark, sf_dir)
    keys = s.select(F.col("conv_id").alias("doc_id"), "name", F.lit(9).alias("cp"))
    chapters = s.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("index"), F.col("text").alias("content"))
    return synthesis.few_shot(keys, chapters, read=1_000_000_000).select("doc_id", "few_shot")


FEW_SHOT = speech.speakers_sql(8, 8) + "SELECT conv_id AS doc_id, coalesce(lines, '（暂无阿明的台词示例）') AS few_shot FROM g"


def extracted_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chapters: a first record may lack its unknown facts and be asked for again, a reply may hold no record."""
    chapters = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("index"), F.col("text").alias("content"))
    lacking, good = '{"character_changes":[{"name":"a"}]}', 'ok ```json\n{"character_changes":[{"name":"a","unknown_facts_updated":["u","v"]}]}\n```'
    k, n = F.col("attempt"), F.col("index")
    rule = F.when((k == 0) & (n % 3 == 0), lacking).when((k == 1) & (n % 4 == 0), lacking).when((k == 0) & (n % 5 == 4), "sorry").otherwise(good)
    got = drivers.extract_chapters(chapters, RuleProvider(rule))
    return got.select("doc_id", "seq", "chapter", F.size(F.get("extraction.character_changes", F.lit(0))["unknown_facts_updated"]).alias("unknown"))


EXTRACTED = """SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS seq, CAST(turn AS INTEGER) AS chapter, CAST(CASE WHEN turn % 3 = 0 AND turn % 4 = 0 THEN 0 ELSE 2 END AS INTEGER) AS unknown
FROM conversations WHERE turn % 3 = 0 OR turn % 5 <> 4"""


def compressed_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those with too many facts are sent to the model; what it gives back for odd numbers holds no JSON."""
    rule = F.when(_even(), 'so {"known_facts": ["k", "l"], "goals": ["g"], "relationships": [{"target": "t", "relation_type": "r", "description": "d", "trust_level": "w"}]}').otherwise("sorry")
    got = drivers.compress_states(characters.current(spark, sf_dir), RuleProvider(rule))
    return got.select("name", "identity", F.size("known_facts").alias("facts"), F.array_join("goals", ",").alias("goals"), F.size("relationships").alias("relations"))


BY_MODEL = characters.CURRENT + """SELECT name, identity, CAST(CASE WHEN done THEN 2 ELSE nf END AS INTEGER) AS facts, CASE WHEN done THEN 'g' ELSE '' END AS goals, CAST(CASE WHEN done THEN 1 ELSE nr END AS INTEGER) AS relations
FROM (SELECT *, nf > 20 AND CAST(name AS INTEGER) % 2 = 0 AS done FROM lists)"""


def sample_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items over all characters, in the characters' order: the limit is the feature."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("character"), F.dayofmonth("ts").alias("chapter"), F.concat(F.lit("q"), "event_id").alias("question"), "event_id")
    names = e.groupBy(F.col("character").alias("name")).agg(F.min("event_id").alias("first_seen"))
    return synthesis.within_limits(e.drop("event_id"), names, 100)


LIMITED = """SELECT character, chapter, question FROM (SELECT CAST(user_id AS VARCHAR) AS character, CAST(day(ts) AS INTEGER) AS chapter, 'q' || event_id AS question, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)
ORDER BY f, character, chapter, question LIMIT 100"""

QUERIES = {
    "pair_scores": (pair_scores, PAIR_SCORES),
    "local_answers": (local_answers, LOCAL),
    "batch_rewards": (batch_rewards, REWARDS),
    "scored_answers": (scored_answers, SCORED),
    "boundary_judged": (boundary_judged, BOUNDARY_JUDGED),
    "style_judged": (style_judged, STYLE_JUDGED),
    "pairwise_judged": (pairwise_judged, PAIRWISE_JUDGED),
    "same_samples": (same_samples, SAME),
    "chat_turns": (chat_turns, CHAT),
    "sft_dialogues": (sft_dialogues, SFT_DIALOGUES),
    "preference_dialogues": (preference_dialogues, PREFERENCE_DIALOGUES),
    "few_shot_lines": (few_shot_lines, FEW_SHOT),
    "extracted_chapters": (extracted_chapters, EXTRACTED),
    "compressed_by_model": (compressed_by_model, BY_MODEL),
    "sample_limit": (sample_limit, LIMITED),
}
