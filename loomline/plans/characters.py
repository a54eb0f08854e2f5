"""Queries over character states: profiles, relations, compression, prompts, items; each with its SQL.

An event is a chapter's extraction record: the user is the character, the day of the month the chapter, event_id the order.
Every fourth event introduces its user, every event changes them; some changes name them in the other field, leave a kind
or a trust level out, or bring a development that is too long, or the word None."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import extraction, fold, prepare, ranking, render, synthesis
from loomline.operators.drivers import patch_facts
from loomline.plans.relational import table
from loomline.sources.providers import RuleProvider


def deltas(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """doc_id (one story, or one a user), seq, chapter, extraction: a record for each event."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("name"), F.dayofmonth("ts").alias("chapter"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"))
    o, name, kind = F.col("event_id"), F.col("name"), F.col("kind")
    some = lambda ok, value: F.when(ok, F.array(value)).otherwise(F.array().cast("array<string>"))
    told = F.array(F.struct(name.alias("name"), kind.alias("identity"), F.array(kind, F.lit("calm")).alias("personality_traits"), F.col("k").alias("speech_style")))
    development = F.when(o % 6 == 0, F.concat(F.lit("grew "), kind)).when(o % 6 == 1, "a development of more than twenty").when(o % 6 == 2, " None ")
    change = F.struct(
        F.when(o % 2 == 0, name).alias("name"),
        F.when(o % 2 == 1, name).alias("character_name"),
        F.array(F.concat(kind, F.lit("-"), "k")).alias("new_facts_learned"),
        some(o % 5 == 0, F.concat(F.lit("u"), "k")).alias("unknown_facts_updated"),
        F.when(o % 3 == 0, kind).alias("emotional_shift"),
        F.array(F.struct(kind.alias("target"), F.when(o % 3 > 0, o.cast("string")).alias("change"), F.when(o % 2 == 0, F.concat(F.lit("t"), (o % 5).cast("string"))).alias("type"), F.when(o % 7 > 0, F.concat(F.lit("w"), (o % 3).cast("string"))).alias("trust_level"))).alias("relationship_changes"),
        F.when(kind == "purchase", o.cast("string")).otherwise("").alias("key_event"),
        development.alias("personality_development"),
    )
    record = F.struct(
        F.lit("").alias("chapter_summary"),
        F.array(name).alias("characters_appeared"),
        F.array().cast("array<string>").alias("key_events"),
        F.array(change).alias("character_changes"),
        F.when(o % 4 == 0, told).otherwise(F.array().cast(f"array<{extraction.NEW}>")).alias("new_characters"),
    ).cast(extraction.EXTRACTION)
    return e.select((name if by_user else F.lit("events")).alias("doc_id"), o.alias("seq"), "chapter", record.alias("extraction"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.current_states(deltas(spark, sf_dir))


def at(spark: SparkSession, sf_dir: str, stride: int, wanted: DataFrame | None = None) -> DataFrame:
    return synthesis.checkpoint_states(deltas(spark, sf_dir), stride, wanted=wanted)


def states_sql(stride: int | None = None) -> str:
    """States as of every checkpoint (cp), or as of the end: s has a row for each, f known facts, u unknown facts, m memories,
    t traits, r relations, each item with its place n among the character's."""
    cps = f"SELECT unnest(range({stride}, last, {stride}) || [last]) AS cp FROM (SELECT max(chapter) AS last FROM e)" if stride else "SELECT 99 AS cp"

    def listed(name: str, item: str, where: str) -> str:
        return f"""{name} AS (SELECT cp, name, item, row_number() OVER (PARTITION BY cp, name ORDER BY o, i) AS n, count(*) OVER (PARTITION BY cp, name) AS size
  FROM (SELECT cp, name, item, min(o) AS o, arg_min(i, o) AS i FROM (SELECT cp, name, {item} AS item, o, 0 AS i FROM x WHERE {where}) GROUP BY cp, name, item))"""

    return f"""
WITH e AS (SELECT event_id AS o, CAST(user_id AS VARCHAR) AS name, CAST(day(ts) AS INTEGER) AS chapter, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events),
c AS ({cps}), x AS (SELECT CAST(c.cp AS INTEGER) AS cp, e.* FROM e JOIN c ON e.chapter <= c.cp),
born AS (SELECT cp, name, min(o) AS first, arg_min(kind, o) AS kind, arg_min(k, o) AS k, min(o) % 4 = 0 AS told FROM x GROUP BY cp, name),
s AS (SELECT b.cp, b.name, b.first, max(x.chapter) AS chapter, CASE WHEN b.told THEN b.kind ELSE '' END AS identity, CASE WHEN b.told THEN b.k ELSE '' END AS speech,
             coalesce(arg_max(x.kind, x.o) FILTER (WHERE x.o % 3 = 0), CASE WHEN b.told THEN '初始状态' ELSE '' END) AS emotion
      FROM born b JOIN x ON x.cp = b.cp AND x.name = b.name GROUP BY b.cp, b.name, b.first, b.kind, b.k, b.told),
{listed('f', "kind || '-' || k", 'true')},
{listed('u', "'u' || k", 'o % 5 = 0')},
{listed('m', "'[第' || chapter || '章] ' || o", "kind = 'purchase'")},
t AS (SELECT cp, name, item, row_number() OVER (PARTITION BY cp, name ORDER BY o) AS n, count(*) OVER (PARTITION BY cp, name) AS size FROM (
  SELECT cp, name, item, min(o) AS o FROM (SELECT cp, name, kind AS item, -2 AS o FROM born WHERE told UNION ALL SELECT cp, name, 'calm', -1 FROM born WHERE told
    UNION ALL SELECT cp, name, 'grew ' || kind, o FROM x WHERE o % 6 = 0) GROUP BY cp, name, item)),
r AS (SELECT *, row_number() OVER (PARTITION BY cp, name ORDER BY o) AS n, count(*) OVER (PARTITION BY cp, name) AS size FROM (
  SELECT cp, name, kind AS target, min(o) AS o, arg_min(CASE WHEN o % 2 = 0 THEN 't' || o % 5 ELSE '相关' END, o) AS type,
         coalesce(arg_max(CAST(o AS VARCHAR), o) FILTER (WHERE o % 3 > 0), '') AS description, arg_min(CASE WHEN o % 7 > 0 THEN 'w' || o % 3 ELSE '中' END, o) AS trust
  FROM x GROUP BY cp, name, kind)),
lists AS (SELECT s.*, coalesce(lf, '') AS lf, coalesce(lu, '') AS lu, coalesce(lm, '') AS lm, coalesce(lt, '') AS lt, lr, lq, coalesce(nf, 0) AS nf, coalesce(nu, 0) AS nu, coalesce(nm, 0) AS nm, coalesce(nr, 0) AS nr FROM s
  LEFT JOIN (SELECT cp, name, string_agg('- ' || item, chr(10) ORDER BY n) AS lf, count(*) AS nf FROM f GROUP BY ALL) USING (cp, name)
  LEFT JOIN (SELECT cp, name, string_agg('- ' || item, chr(10) ORDER BY n) AS lu, count(*) AS nu FROM u GROUP BY ALL) USING (cp, name)
  LEFT JOIN (SELECT cp, name, string_agg('- ' || item, chr(10) ORDER BY n) AS lm, count(*) AS nm FROM m GROUP BY ALL) USING (cp, name)
  LEFT JOIN (SELECT cp, name, string_agg('- ' || item, chr(10) ORDER BY n) AS lt FROM t GROUP BY ALL) USING (cp, name)
  LEFT JOIN (SELECT cp, name, count(*) AS nr, string_agg('- ' || target || ': ' || type || ' — ' || description || ' (信任度: ' || trust || ')', chr(10) ORDER BY n) AS lr,
                    string_agg('- ' || target || '：' || description || ' (信任度: ' || trust || ')', chr(10) ORDER BY n) AS lq FROM r GROUP BY ALL) USING (cp, name))
"""


_NL = "chr(10)"


def _shown(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


def _opt(column: str) -> str:
    """A list under its heading: nothing, or a new line and the list."""
    return f"CASE WHEN {column} = '' THEN '' ELSE {_NL} || {column} END"


STATE_TEXT = _shown(
    "'## 角色: ' || name || ' (截止第' || chapter || '章)'", "''", "'### 身份'", "identity", "''", f"'### 性格特征' || {_opt('lt')}", "''", "'### 说话风格'", "speech", "''", "'### 当前情绪'", "emotion", "''", "'### 当前目标'",
    "''", f"'### 已知信息（只能基于这些信息回答）' || {_opt('lf')}", "''", f"'### 未知信息（绝对不能提及或暗示以下内容）' || {_opt('lu')}", "''", f"'### 关键记忆' || {_opt('lm')}", "''", "'### 人物关系'", "lr",
)
CURRENT = states_sql()


def character_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select("name", "chapter", "identity", "speech_style", "emotional_state", F.array_join("personality_traits", ",").alias("traits"))


PROFILES = CURRENT + "SELECT name, chapter, identity, speech AS speech_style, emotion AS emotional_state, coalesce(replace(replace(lt, '- ', ''), chr(10), ','), '') AS traits FROM lists"


def relationship_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select("name", F.posexplode("relationships").alias("place", "r")).select("name", "place", "r.*")


KINDS = CURRENT + "SELECT name, CAST(n - 1 AS INTEGER) AS place, target, type AS relation_type, description, trust AS trust_level FROM r"


def compression_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.to_compress(current(spark, sf_dir)).select("name", F.size("known_facts").alias("facts"))


DUE = CURRENT + "SELECT name, CAST(nf AS INTEGER) AS facts FROM lists WHERE nf > 20"


def compressed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.compressed(current(spark, sf_dir)).select("name", F.array_join("known_facts", ",").alias("known"), F.array_join("key_memories", ",").alias("memories"), F.size("relationships").alias("relations"))


COMPRESSED = CURRENT + """
SELECT l.name, a.known, coalesce(b.memories, '') AS memories, CAST(CASE WHEN l.nf > 20 THEN least(l.nr, 8) ELSE l.nr END AS INTEGER) AS relations FROM lists l
JOIN (SELECT name, string_agg(item, ',' ORDER BY n) AS known FROM f WHERE size <= 20 OR n > size - 15 GROUP BY name) a ON a.name = l.name
LEFT JOIN (SELECT m.name, string_agg(m.item, ',' ORDER BY m.n) AS memories FROM m JOIN lists k ON k.name = m.name WHERE k.nf <= 20 OR m.size <= 10 OR m.n > m.size - 10 GROUP BY m.name) b ON b.name = l.name
"""


def compression_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with two fields for every third character: their other fields stay, but relations, which such a reply empties."""
    states = current(spark, sf_dir)
    compact = F.struct(F.array(F.lit("k1"), F.col("name")).alias("known_facts"), F.array(F.lit("g")).alias("goals"), F.lit(None).cast(fold.RELATIONS).alias("relationships"))
    replies = states.filter(F.col("name").cast("int") % 3 == 0).select("doc_id", "name", compact.alias("compact"))
    return fold.apply_compression(states, replies).select("name", "identity", F.array_join("known_facts", ",").alias("known"), F.array_join("goals", ",").alias("goals"), F.size("relationships").alias("relations"))


APPLIED = CURRENT + """
SELECT name, identity, CASE WHEN CAST(name AS INTEGER) % 3 = 0 THEN 'k1,' || name ELSE replace(replace(lf, '- ', ''), chr(10), ',') END AS known,
       CASE WHEN CAST(name AS INTEGER) % 3 = 0 THEN 'g' ELSE '' END AS goals, CAST(CASE WHEN CAST(name AS INTEGER) % 3 = 0 THEN 0 ELSE nr END AS INTEGER) AS relations FROM lists
"""


def character_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = fold.names_in_order(current(spark, sf_dir))
    return prepare.ranked(listed, [F.col("first_seen")]).select("name", "rank")


NAMES = CURRENT + "SELECT name, row_number() OVER (ORDER BY first) AS rank FROM s"


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.summary(current(spark, sf_dir)).select("name", "facts", "memories", "relations")


SUMMARY = CURRENT + "SELECT name, CAST(nf AS INTEGER) AS facts, CAST(nm AS INTEGER) AS memories, CAST(nr AS INTEGER) AS relations FROM lists"


def sft_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint states with material for questions that differ from the checkpoint before."""
    return synthesis.sft_states(at(spark, sf_dir, 10)).select("name", "cp")


MATERIAL = states_sql(10) + "SELECT name, cp FROM (SELECT *, row_number() OVER (PARTITION BY name, chapter ORDER BY cp) AS k FROM lists WHERE (nf >= 2 OR nm >= 1) AND (nr > 0 OR emotion <> '')) WHERE k = 1"


def preference_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.preference_states(at(spark, sf_dir, 3)).select("name", "cp", F.size("unknown_facts").alias("facts"))


GUARDED = states_sql(3) + "SELECT name, cp, CAST(nu AS INTEGER) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY name, chapter ORDER BY cp) AS k FROM lists WHERE nu > 0) WHERE k = 1"


def patched_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those who know enough are asked; a reply's strings are their new unknown facts, at most eight."""
    reply = F.concat(F.lit('so: ["p", 1, " q "'), F.when(F.col("name").cast("int") % 2 == 0, F.lit(', "a", "b", "c", "d", "e", "f", "g"')).otherwise(F.lit("")), F.lit("]"))
    got = patch_facts(current(spark, sf_dir), RuleProvider(reply), 31, 30, True)
    return got.select("name", "chapter", F.array_join("unknown_facts_updated", "|").alias("facts"))


PATCHED = CURRENT + "SELECT name, 31 AS chapter, 'p|q' || CASE WHEN CAST(name AS INTEGER) % 2 = 0 THEN '|a|b|c|d|e|f' ELSE '' END AS facts FROM lists WHERE nf >= 30"


def amnesia_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select("name", F.md5(render.amnesia_prompt()).alias("prompt_md5"))


_END = f"{_NL} || {_NL}"
AMNESIA = CURRENT + "SELECT name, md5(regexp_replace(" + " || ".join(
    [f"CASE WHEN {c} = '' THEN '' ELSE '{label}' || {c} || {_END} END" for label, c in (("身份：", "identity"),)]
    + [f"CASE WHEN lt = '' THEN '' ELSE '性格：' || {_NL} || lt || {_END} END"]
    + [f"CASE WHEN {c} = '' THEN '' ELSE '{label}' || {c} || {_END} END" for label, c in (("说话方式：", "speech"), ("现在的状态：", "emotion"))]
    + [f"CASE WHEN {c} = '' THEN '' ELSE '{label}' || {_NL} || {c} || {_END} END" for label, c in (("你记得的事：", "lf"), ("你还记得的经历：", "lm"), ("你认识的人：", "lq"))]
    + [f"CASE WHEN lu = '' THEN '' ELSE '以下这些事你完全不记得，一片空白——' || {_NL} || '就算有人提起或者反复暗示，你也不知道，不会被对方带着说：' || {_NL} || lu || {_END} END"]
) + r", '^\s+|\s+$', '', 'g')) AS prompt_md5 FROM lists"


def _few_shot():
    n = F.col("name").cast("int") % 3
    return F.when(n == 0, "").when(n == 1, "（暂无台词）").otherwise(F.concat(F.lit("line of "), "name"))


_FEW = "CASE CAST(name AS INTEGER) % 3 WHEN 0 THEN '' WHEN 1 THEN '（暂无台词）' ELSE 'line of ' || name END"
_INSTRUCTION = f"{STATE_TEXT} || CASE WHEN CAST(name AS INTEGER) % 3 = 2 THEN chr(10) || chr(10) || '### 你的原著台词示例（参考这个风格说话）' || chr(10) || 'line of ' || name ELSE '' END"


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select("name", F.md5(render.instruction(render.state_prompt(), _few_shot())).alias("text_md5"))


INSTRUCTIONS = CURRENT + f"SELECT name, md5({_INSTRUCTION}) AS text_md5 FROM lists"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all characters at three checkpoints, whether they exist by then or not, and at one that is none."""
    names = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name")).distinct()
    each = names.withColumn("cp", F.explode(F.array(*[F.lit(c) for c in (1, 2, 7, 30)])))
    return each.select(F.col("name").alias("character"), F.col("cp").alias("chapter"), F.concat(F.lit("q"), "name").alias("question"), F.lit("a").alias("answer"), F.lit("good").alias("chosen"), F.lit("bad").alias("rejected"), _few_shot().alias("few_shot"))


def _states_of(items: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all checkpoints that items have."""
    return at(spark, sf_dir, 1, items.select(F.col("chapter").alias("cp")).distinct())


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return render.sft_rows(items, _states_of(items, spark, sf_dir)).select(F.md5("instruction").alias("instruction_md5"), "input", "output")


def preference_items_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return render.preference_rows(items, _states_of(items, spark, sf_dir)).select(F.md5("instruction").alias("instruction_md5"), "input", "chosen", "rejected")


SFT_ROWS = states_sql(1) + f"SELECT md5({_INSTRUCTION}) AS instruction_md5, 'q' || name AS input, 'a' AS output FROM lists WHERE cp IN (1, 2, 7, 30)"
PREFERENCE_ROWS = states_sql(1) + f"SELECT md5({_INSTRUCTION}) AS instruction_md5, 'q' || name AS input, 'good' AS chosen, 'bad' AS rejected FROM lists WHERE cp IN (1, 2, 7, 30)"


def fact_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each unknown fact of each character."""
    each = current(spark, sf_dir).select("name", F.posexplode("unknown_facts").alias("fact_no", "fact"))
    return each.select("name", "fact_no", render.fill(synthesis.FACT_QUESTIONS, name=F.col("name"), fact=F.col("fact"), quota=F.lit(2)).alias("prompt"))


FACT_PROMPTS = CURRENT + "SELECT name, CAST(n - 1 AS INTEGER) AS fact_no, '角色 ' || name || ' 不知道这件事：' || item || chr(10) || '请写 2 个会触及它的问题，只输出 JSON 字符串数组。' AS prompt FROM u"


def compact_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = current(spark, sf_dir).select("name", render.compact_profile().alias("p"))
    items = lambda c: F.array_join(F.from_json(F.get_json_object("p", f"$.{c}"), "array<string>"), "|").alias(c)
    return p.select("name", F.get_json_object("p", "$.identity").alias("identity"), *map(items, ("personality_traits", "known_facts", "key_memories")), F.size(F.from_json(F.get_json_object("p", "$.relationships"), "array<map<string,string>>")).alias("relations"))


_FIRST = "coalesce((SELECT string_agg(item, '|' ORDER BY n) FROM {0} WHERE {0}.name = l.name AND n <= {1}), '')"
COMPACT = CURRENT + f"SELECT name, identity, {_FIRST.format('t', 3)} AS personality_traits, {_FIRST.format('f', 10)} AS known_facts, {_FIRST.format('m', 5)} AS key_memories, CAST(least(nr, 5) AS INTEGER) AS relations FROM lists l"


def total_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deltas(spark, sf_dir)
    told = [("read", None, d), ("none", None, d.filter("chapter < 0")), ("given", 7, d)]
    out = [ranking.total_chapters(x, n).select(F.lit(how).alias("how"), F.col("total").cast("int").alias("total")) for how, n, x in told]
    return out[0].unionByName(out[1]).unionByName(out[2])


TOTAL = "SELECT 'read' AS how, CAST(max(day(ts)) AS INTEGER) AS total FROM events UNION ALL SELECT 'none', 1 UNION ALL SELECT 'given', 7"


def extraction_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.progress(deltas(spark, sf_dir)).groupBy("chapter").agg(*[F.sum(c).alias(c) for c in ("appeared", "changed", "introduced", "unknown")])


PROGRESS = "SELECT CAST(day(ts) AS INTEGER) AS chapter, count(*) AS appeared, count(*) AS changed, count(*) FILTER (WHERE event_id % 4 = 0) AS introduced, count(*) FILTER (WHERE event_id % 5 = 0) AS unknown FROM events GROUP BY 1"


def known_name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hint of a chapter: its characters whose number ends in 0."""
    e = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("chapter")).agg(F.sort_array(F.collect_set(F.when(F.col("user_id") % 10 == 0, F.col("user_id").cast("string")))).alias("names"))
    return e.select("chapter", extraction.known_names(F.col("names")).alias("names"))


KNOWN = "SELECT CAST(day(ts) AS INTEGER) AS chapter, coalesce(string_agg(DISTINCT CAST(user_id AS VARCHAR), '、' ORDER BY CAST(user_id AS VARCHAR)) FILTER (WHERE user_id % 10 = 0), '（暂无）') AS names FROM events GROUP BY 1"


def best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as attempts at one record, with up to two changes that lack their unknown facts."""
    o = F.col("event_id")
    raw = F.concat(F.lit('{"chapter_summary":"'), o, F.lit('","character_changes":[{"name":"a","unknown_facts_updated":[]}'), F.repeat(F.lit(',{"name":"b"}'), (o % 3).cast("int")), F.lit("]}"))
    tried = extraction.normalise(table(spark, sf_dir, "events").select("user_id", o.alias("attempt"), raw.alias("raw")))
    return extraction.best_attempt(tried, "user_id").select("user_id", F.col("extraction.chapter_summary").cast("long").alias("event_id"), F.col("stats.missing_unknown_fields").alias("missing"))


BEST = "SELECT user_id, arg_min(event_id, (event_id % 3) * 1000000000000 + event_id) AS event_id, CAST(min(event_id % 3) AS INTEGER) AS missing FROM events GROUP BY user_id"

QUERIES = {
    "character_profiles": (character_profiles, PROFILES),
    "relationship_kinds": (relationship_kinds, KINDS),
    "compression_due": (compression_due, DUE),
    "compressed_states": (compressed_states, COMPRESSED),
    "compression_applied": (compression_applied, APPLIED),
    "character_names": (character_names, NAMES),
    "state_summary": (state_summary, SUMMARY),
    "sft_material": (sft_material, MATERIAL),
    "preference_material": (preference_material, GUARDED),
    "patched_facts": (patched_facts, PATCHED),
    "amnesia_prompts": (amnesia_prompts, AMNESIA),
    "instructions": (instructions, INSTRUCTIONS),
    "sft_rows": (sft_rows, SFT_ROWS),
    "preference_items_rows": (preference_items_rows, PREFERENCE_ROWS),
    "fact_prompts": (fact_prompts, FACT_PROMPTS),
    "compact_profiles": (compact_profiles, COMPACT),
    "total_chapters": (total_chapters, TOTAL),
    "extraction_progress": (extraction_progress, PROGRESS),
    "known_name_lists": (known_name_lists, KNOWN),
    "best_attempts": (best_attempts, BEST),
}
