"""Queries over dialogue and text rules; each with its SQL, which applies the same patterns to the same rows.

The driver's tables hold no Chinese prose. Conversations become scenes in which 阿明 (the user), 老李 (the assistant) and
others speak their whole turns, with and without a verb of speech; texts get openings and endings that the rules look for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as t
from loomline.functions.rules import CHAPTER_MARKERS, ZH
from loomline.operators import dialogue, segment
from loomline.plans.narrative import BY_MARKER, CLEAN, LINES, STRIP, _marker
from loomline.plans.relational import table

NAME, OTHER = "阿明", "老李"
VERBS = ("说道", "低声说", "点点头", "")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    """A Java pattern's flags are its own: (?U), (?d) change nothing for these rows."""
    for flags in ("(?iU)", "(?Umd)", "(?Ud)", "(?sU)", "(?U)", "(?d)"):
        pattern = pattern.replace(flags, "(?i)" if "i" in flags else "(?m)" if "m" in flags else "")
    return _sql(pattern)


# --- scenes


def _speaker():
    return F.when(F.col("role") == "user", NAME).when(F.col("role") == "assistant", OTHER).otherwise("王教授")


def scene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, quote, line: 名字 + 动词 + ：“quote”, the verb by turn."""
    verb = F.get(F.array(*[F.lit(v) for v in VERBS]), (F.col("turn") % 4).cast("int"))
    said = F.concat(_speaker(), verb, F.lit("：“"), F.col("text"), F.lit("”"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("问"), F.lit(OTHER))).otherwise(F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("quote"), said.alias("line"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scene_lines(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    return rows.select("conv_id", F.lit(NAME).alias("name"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


_VERB = ZH.speech_verbs
_STOP = "[^。！？\\n]"
_OWN = " OR ".join(
    f"regexp_matches({side}, {_sql(p)})" for p in (f"{NAME}{_STOP}{{0,10}}{_VERB}", f"{_VERB}{_STOP}{{0,6}}{NAME}") for side in ("right(l, 80)", "left(r, 80)")
)
_OTHER = f"len(list_filter(regexp_extract_all(right(l, 60) || ' ' || left(r, 60), {_sql(f'({ZH.name_run}){_STOP}{{0,8}}{_VERB}')}, 1), lambda x: x <> '{NAME}')) > 0"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[（(][^）)]{{1,30}}[）)]', '', 'g'), '^[\p{{L}}\p{{M}}\p{{N}}_·]{{1,8}}[说：:][\s　]*', ''),
  '^["'']+|["'']+$', '', 'g'), '^[\s　]+|[\s　]+$', '', 'g')"""
SCENES = f"""
WITH l AS (
  SELECT conv_id, turn, text AS quote, CASE role WHEN 'user' THEN '{NAME}' WHEN 'assistant' THEN '{OTHER}' ELSE '王教授' END || [{', '.join(map(_sql, VERBS))}][turn % 4 + 1] || '：' AS head,
         CASE WHEN turn % 3 = 0 THEN '问{OTHER}' ELSE '' END AS tail FROM conversations
), w AS (
  SELECT *, coalesce(string_agg(head || '“' || quote || '”' || tail, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(10), '') || head AS l,
         tail || coalesce(chr(10) || string_agg(head || '“' || quote || '”' || tail, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM l
), q AS (
  SELECT conv_id, turn, quote, {_CLEAN.format(STRIP % 'quote')} AS line, right(l, 90) AS l, left(r, 90) AS r, right(l, 40) AS l40, left(r, 24) AS r24, length(quote) AS n FROM w
), j AS (SELECT *, {_OWN} AS own, {_OTHER} AS other FROM q)
"""


def speech_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote of every scene, with what speaks for 阿明 and for others."""
    s = scenes(spark, sf_dir)
    each = s.select("conv_id", "name", F.explode(dialogue.quotes(F.col("text"), 2000)).alias("q"))
    return each.select("conv_id", F.col("q.pos").alias("pos"), F.col("q.line").alias("line"), dialogue.target_evidence(F.col("name"), F.col("q.left"), F.col("q.right")).alias("own"), dialogue.other_evidence(F.col("name"), F.col("q.left"), F.col("q.right")).alias("other"))


EVIDENCE = SCENES + """, p AS (SELECT *, CAST(sum(length(head) + length(quote) + 2 + length(tail) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - (length(quote) + 2 + length(tail)) AS INTEGER) AS pos FROM l)
SELECT j.conv_id, p.pos, j.line, own, other FROM j JOIN p ON p.conv_id = j.conv_id AND p.turn = j.turn WHERE n BETWEEN 2 AND 2000"""


def scene_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are 阿明's, and those that could be anyone's."""
    got = dialogue.attributed(scenes(spark, sf_dir), 3)
    return got.select("conv_id", F.array_join("strict", "|").alias("strict"), F.array_join("ambiguous", "|").alias("ambiguous"), F.array_join(F.slice(F.array_distinct(F.concat("strict", "ambiguous")), 1, 4), "|").alias("together"))


def speakers_sql(most: int, both: int) -> str:
    """strict, ambiguous and what a prompt shows of both, for each scene."""
    return SCENES + f""", k AS (SELECT *, length(line) >= 3 AND n BETWEEN 2 AND 160 AS fit FROM j),
a AS (SELECT conv_id, line, own, not own AND not other AS anyone, min(turn) AS turn FROM k WHERE fit AND (own OR not other) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn) AS i FROM a), c AS (SELECT * FROM b WHERE i <= CASE WHEN own THEN {most} ELSE {2 * most} END),
d AS (SELECT conv_id, line, min(CASE WHEN own THEN turn ELSE 1000000 + turn END) AS o FROM c GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS i FROM d),
g AS (SELECT s.conv_id, coalesce((SELECT string_agg(line, '|' ORDER BY turn) FROM c WHERE own AND c.conv_id = s.conv_id), '') AS strict,
       coalesce((SELECT string_agg(line, '|' ORDER BY turn) FROM c WHERE anyone AND c.conv_id = s.conv_id), '') AS ambiguous,
       coalesce((SELECT string_agg(line, '|' ORDER BY o) FROM f WHERE i <= {both} AND f.conv_id = s.conv_id), '') AS together,
       (SELECT string_agg(line, chr(10) ORDER BY o) FROM f WHERE i <= {both} AND f.conv_id = s.conv_id) AS lines
FROM (SELECT DISTINCT conv_id FROM conversations) s)
"""


SPEAKERS = speakers_sql(3, 4) + "SELECT conv_id, strict, ambiguous, together FROM g"


def nearby_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).select("conv_id", dialogue.nearby_lines(F.col("name"), F.col("text"), 5).alias("lines"))


NEARBY = SCENES + f""", a AS (SELECT conv_id, line, min(turn) AS turn FROM j WHERE n BETWEEN 2 AND 120 AND length(line) >= 3 AND contains(l40 || r24, '{NAME}') GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM a)
SELECT s.conv_id, coalesce((SELECT string_agg(line, chr(10) ORDER BY turn) FROM b WHERE i <= 5 AND b.conv_id = s.conv_id), '') AS lines FROM (SELECT DISTINCT conv_id FROM conversations) s"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put to their scene: the first ten characters of each turn as they are cleaned, and a line found nowhere."""
    own = scene_lines(spark, sf_dir).select("conv_id", "turn", F.left(t.clean_line(t.strip(F.col("quote"))), F.lit(10)).alias("line")).filter("length(line) >= 3")
    nowhere = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("@nowhere@").alias("line"))
    return own.unionByName(nowhere).join(scenes(spark, sf_dir), "conv_id")


_CANDIDATES = SCENES + """, c AS (SELECT conv_id, turn, left(line, 10) AS line FROM j WHERE length(left(line, 10)) >= 3 UNION ALL SELECT DISTINCT conv_id, -1, '@nowhere@' FROM conversations),
met AS (SELECT c.conv_id, c.turn, c.line, j.own, j.other FROM c JOIN j ON j.conv_id = c.conv_id AND j.n BETWEEN 2 AND 200 AND j.line <> '' AND (contains(j.line, c.line) OR contains(c.line, j.line)))
"""


def supported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("conv_id", "turn", dialogue.supported(F.col("name"), F.col("line"), F.col("text")).alias("supported"))


SUPPORTED = _CANDIDATES + "SELECT c.conv_id, c.turn, coalesce(bool_or(met.own), false) AS supported FROM c LEFT JOIN met ON met.conv_id = c.conv_id AND met.turn = c.turn GROUP BY ALL"


def validated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after the rules and a judge that says yes, no, both, or fails. Scenes are read whole."""
    reply = F.get(F.array(F.lit("是"), F.lit("否"), F.lit("是或否"), F.lit(None).cast("string")), (F.abs("turn") % 4).cast("int"))
    got = dialogue.validated(_candidates(spark, sf_dir).withColumn("reply", reply), read=1_000_000_000)
    return got.select("conv_id", "turn", "keep")


VALIDATED = _CANDIDATES + """SELECT c.conv_id, c.turn, CASE WHEN coalesce(bool_or(met.other), false) THEN false WHEN count(met.line) = 0 THEN true ELSE abs(c.turn) % 4 IN (0, 3) END AS keep
FROM c LEFT JOIN met ON met.conv_id = c.conv_id AND met.turn = c.turn GROUP BY c.conv_id, c.turn"""


def paragraph_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood of one of each document's lines, and of a text that none has."""
    lines = F.split("text", "\n", -1)
    quote = F.when(F.col("doc_id") % 7 == 6, "@nowhere@").otherwise(F.get(lines, (F.col("doc_id") % F.size(lines)).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", dialogue.paragraph_context(F.col("text"), quote).alias("context"))


CONTEXTS = """
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), q AS (SELECT doc_id, p, left(CASE WHEN doc_id % 7 = 6 THEN '@nowhere@' ELSE p[doc_id % len(p) + 1] END, 15) AS k FROM x),
a AS (SELECT *, coalesce(list_position(list_transform(p, lambda y: contains(y, k)), true), 0) AS i FROM q)
SELECT doc_id, CASE WHEN i = 0 THEN '' ELSE array_to_string(p[greatest(i - 1, 1):i + 1], chr(10)) END AS context FROM a
"""

# --- rules

OPENINGS = ("你", f"{OTHER}，", f"{NAME}，", "王教授，", "（笑）", f"{OTHER}会不会", "作为一个AI，", "为什么？")
ENDINGS = ("？", "……", "，你说呢？", "", "，不是风而是雨。", "。从七岁那年开始，我就在这里。", "，难道不是？", "...")


def _dressed(openings: tuple[str, ...], endings: tuple[str, ...]):
    pick = lambda xs, by: F.get(F.array(*[F.lit(x) for x in xs]), by.cast("int"))
    return F.concat(pick(openings, F.col("turn") % len(openings)), "text", pick(endings, (F.col("conv_id") + F.col("turn")) % len(endings)))


def _dressed_sql(openings: tuple[str, ...], endings: tuple[str, ...]) -> str:
    return f"[{', '.join(map(_sql, openings))}][turn % {len(openings)} + 1] || text || [{', '.join(map(_sql, endings))}][(conv_id + turn) % {len(endings)} + 1]"


def question_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as questions to 阿明, who knows 老李."""
    q = _dressed(OPENINGS, ENDINGS[:4])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.bad_question(q, F.lit(NAME), F.array(F.lit(OTHER), F.lit(""))).alias("bad"))


_ASIDE = _re(ZH.stage_direction)
_DOTS = "contains(q, '...') OR contains(q, '……')"
FITNESS = f"""
WITH x AS (SELECT conv_id, turn, {STRIP % ('(' + _dressed_sql(OPENINGS, ENDINGS[:4]) + ')')} AS q FROM conversations),
y AS (SELECT *, {STRIP % "regexp_extract(q, '^\\s*([^，,：:。！？!?]{1,20})[，,：:。！？!?]', 1)"} AS clause FROM x)
SELECT conv_id, turn, CASE WHEN length(q) < 6 OR {_DOTS} OR regexp_matches(q, {_ASIDE}) OR regexp_matches(q, {_re(ZH.as_model)}) THEN true
  WHEN clause <> '' AND (contains(clause, '{NAME}') OR contains(clause, '你') OR contains(clause, '您')) THEN false
  WHEN clause <> '' AND (clause = '{OTHER}' OR regexp_matches(clause, {_re(ZH.title_words)})) THEN true
  ELSE regexp_matches(q, {_sql(OTHER + '[^，。！？\\n]{0,6}' + ZH.asked_of_others)}) END AS bad FROM y
"""


def answer_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as answers; every third character has a childhood among the known facts."""
    known = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("童年在河边"))).otherwise(F.array().cast("array<string>"))
    a = F.when(F.col("turn") % 11 == 10, "走").otherwise(_dressed(OPENINGS, ENDINGS))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.bad_answer(a, known, F.array().cast("array<string>")).alias("bad"))


_OWN_PAST = " OR ".join(f"regexp_matches(q, {_re(p)})" for p in ZH.autobiography)
ANSWERS = f"""
WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 11 = 10 THEN '走' ELSE {STRIP % ('(' + _dressed_sql(OPENINGS, ENDINGS) + ')')} END AS q FROM conversations)
SELECT conv_id, turn, length(q) < 2 OR {_DOTS} OR regexp_matches(q, {_ASIDE}) OR regexp_matches(q, {_re(ZH.rhetorical_opening)}) OR regexp_matches(q, {_re(ZH.as_model)})
  OR regexp_matches(q, {_re(ZH.not_but)}) OR regexp_matches(q, {_re(ZH.closing_question)}) OR (({_OWN_PAST}) AND conv_id % 3 <> 0) AS bad FROM x
"""


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.get(F.array(*[F.lit(x) for x in ("是", "否", "", "是，不，否", "不是")]), (F.col("doc_id") % 5).cast("int")), "text")
    return table(spark, sf_dir, "documents").select("doc_id", t.confirmed(reply).alias("yes"))


CONFIRMED = "WITH x AS (SELECT doc_id, ['是', '否', '', '是，不，否', '不是'][doc_id % 5 + 1] || text AS r FROM documents) SELECT doc_id, contains(r, '是') AND NOT contains(r, '否') AS yes FROM x"


def dialogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_dialogues(F.col("text"), 4).alias("lines"))


DIALOGUE = f"""
WITH c AS (SELECT * FROM ({CLEAN}) WHERE line_no >= 0 AND length(line) >= 3 AND NOT regexp_matches(line, '[（(][^）)]{{5,}}[）)]')),
d AS (SELECT doc_id, line, min(line_no) AS o FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i FROM d)
SELECT x.doc_id, coalesce(string_agg(k.line, chr(10) ORDER BY o) FILTER (WHERE i <= 4), '') AS lines FROM documents x LEFT JOIN k ON k.doc_id = x.doc_id GROUP BY x.doc_id
"""


def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dressed = F.concat(F.get(F.array(*[F.lit(x) for x in ("", "（笑）", "他沉默了一会儿，", "  (aside) ", "苦笑了一下。")]), (F.col("doc_id") % 5).cast("int")), F.regexp_replace("text", "\n", "\n（又笑） "))
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_answer(dressed).alias("answer"))


_DRESSED = "['', '（笑）', '他沉默了一会儿，', '  (aside) ', '苦笑了一下。'][doc_id % 5 + 1] || replace(text, chr(10), chr(10) || '（又笑） ')"
CLEANED = f"""
WITH a AS (SELECT doc_id, regexp_replace({STRIP % ('(' + _DRESSED + ')')}, '^[（(][^）)]{{1,30}}[）)]\\s*', '') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(x, '\\n[（(][^）)]{{1,30}}[）)]\\s*', chr(10), 'g') AS x FROM a)
SELECT doc_id, {STRIP % ('regexp_replace(x, ' + _re(ZH.gesture).replace('??', '?') + ", '')")} AS answer FROM b
"""


def fields_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions put together around whole texts: labelled fields, sections in the evaluation's reading (an empty one
    runs on into the next), and bullets of which every mark goes."""
    d = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("角色名： "), "source", F.lit("\n当前章节:"), F.col("doc_id").cast("string"))).otherwise("无")
    unknown = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("- • "), F.regexp_replace("text", "\n", "\n* ")))
    made = d.select("doc_id", F.concat(head, F.lit("\n### 未知信息（x）\n"), unknown, F.lit("\n### 关键记忆\n- m1\n- mem2")).alias("i"))
    body = t.section(F.col("i"), "未知信息", min_one=True)
    return made.select("doc_id", t.labelled_field(F.col("i"), "角色名", "角色").alias("name"), t.labelled_field(F.col("i"), "当前章节", "?").alias("chapter"), body.alias("body"), F.array_join(t.bullets(body, all_marks=True, least=4), "|").alias("items"))


FIELDS = f"""
WITH x AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '### 关键记忆' || chr(10) || '- m1' || chr(10) || '- mem2' ELSE {STRIP % "('- • ' || replace(text, chr(10), chr(10) || '* '))"} END AS body FROM documents),
b AS (SELECT doc_id, line, i FROM (SELECT doc_id, string_split(body, chr(10)) AS p, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM x) y, LATERAL (SELECT {STRIP % ("regexp_replace(" + STRIP % 'p[i]' + ", '^[-*•][-*•\\s]*', '')")} AS line) z)
SELECT x.doc_id, CASE WHEN x.doc_id % 2 = 0 THEN source ELSE '角色' END AS name, CASE WHEN x.doc_id % 2 = 0 THEN CAST(x.doc_id AS VARCHAR) ELSE '?' END AS chapter, body,
       coalesce((SELECT string_agg(line, '|' ORDER BY i) FROM b WHERE b.doc_id = x.doc_id AND length(line) >= 4), '') AS items FROM x
"""


def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of mixed kinds after talk: the strings, trimmed."""
    raw = F.concat(F.lit("here: [1, "), F.lit('" a ", "", null, {"x": "y"}, '), F.concat(F.lit('"'), "role", F.lit(' "')), F.lit("]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(t.string_items(t.recover_json(raw)), "|").alias("items"))


STRINGS = "SELECT conv_id, turn, 'a|' || role AS items FROM conversations"

# --- chapters

TITLES = ("第%d章 开始", "第%d回", "Chapter %d", "chapter %d", "第一百零%d章", "第二十三卷　末", "第%d章的故事", "第一部 雪 第%d章", "　第九节 ", "第%d章　")


def chapter_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which title lines the real patterns take, beside every line of the documents."""
    docs = table(spark, sf_dir, "documents")
    made = docs.select("doc_id", F.posexplode(F.array(*[F.format_string(x, "doc_id") if "%d" in x else F.lit(x) for x in TITLES])).alias("line_no", "line")).withColumn("line_no", -1 - F.col("line_no"))
    return segment.lines(docs).unionByName(made).select("doc_id", "line_no", t.is_marker(F.col("line")).alias("hit"))


_HIT = " OR ".join(f"regexp_matches({{0}}, {_sql(p)})" for p in CHAPTER_MARKERS)
_UNI = r"regexp_replace(%s, '^[\s　]+|[\s　]+$', '', 'g')"
MARKERS = f"""
WITH x AS (SELECT doc_id, line_no, line FROM ({LINES}) UNION ALL
  SELECT doc_id, -i, replace([{', '.join(map(_sql, TITLES))}][i], '%d', CAST(doc_id AS VARCHAR)) FROM documents, range(1, {len(TITLES) + 1}) r(i))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {_HIT.format(_UNI % 'line')} AS hit FROM x
"""


def pattern_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books put together from whole documents: a table of contents, a preface, an empty chapter, a marker in the text; and
    texts with too few markers, which go by length."""
    docs = table(spark, sf_dir, "documents")
    book = F.concat(F.lit("第1章 甲\n第2章 乙\npreface\n第1章 甲\n"), "text", F.lit("\n第2章  乙\nsecond\n第3章\n\n第4章\nlast"))
    return segment.split_chapters(docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, book).otherwise(F.concat(F.lit("第1章 甲\n"), "text")).alias("text")), 6000)


PATTERN_CHAPTERS = f"""
WITH t AS (SELECT doc_id, {STRIP % 'text'} AS body, {STRIP % "('第1章 甲' || chr(10) || text)"} AS alone FROM documents)
SELECT doc_id, CAST(1 AS INTEGER) AS index, '第1章 甲' AS title, body AS content, CAST(length(body) AS INTEGER) AS char_count FROM t WHERE doc_id % 3 > 0 AND body <> ''
UNION ALL SELECT doc_id, CASE WHEN body = '' THEN 1 ELSE 2 END, '第2章  乙', 'second', 6 FROM t WHERE doc_id % 3 > 0
UNION ALL SELECT doc_id, CASE WHEN body = '' THEN 2 ELSE 3 END, '第4章', 'last', 4 FROM t WHERE doc_id % 3 > 0
UNION ALL SELECT doc_id, 1, '段落 1', alone, length(alone) FROM t WHERE doc_id % 3 = 0
"""


def first_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two chapters of each document: the limit is the feature."""
    docs = table(spark, sf_dir, "documents")
    return segment.first_chapters(segment.split_by_markers(docs, _marker), 2).select("doc_id", "index", "title", "char_count")


FIRST_TWO = f"SELECT doc_id, index, title, char_count FROM ({BY_MARKER}) WHERE index <= 2"


def text_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt reads of a chapter: the prefix is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.head(F.col("text"), 2500)).alias("head_md5"), F.length(t.head(F.col("text"), 8000)).alias("n"))


HEADS = "SELECT doc_id, md5(left(text, 2500)) AS head_md5, CAST(length(left(text, 8000)) AS INTEGER) AS n FROM documents"

QUERIES = {
    "speech_evidence": (speech_evidence, EVIDENCE),
    "scene_speakers": (scene_speakers, SPEAKERS),
    "nearby_lines": (nearby_lines, NEARBY),
    "supported_lines": (supported_lines, SUPPORTED),
    "validated_lines": (validated_lines, VALIDATED),
    "paragraph_contexts": (paragraph_contexts, CONTEXTS),
    "question_fitness": (question_fitness, FITNESS),
    "answer_fitness": (answer_fitness, ANSWERS),
    "confirmations": (confirmations, CONFIRMED),
    "dialogue_lines": (dialogue_lines, DIALOGUE),
    "clean_answers": (clean_answers, CLEANED),
    "fields_and_sections": (fields_and_sections, FIELDS),
    "string_lists": (string_lists, STRINGS),
    "chapter_markers": (chapter_markers, MARKERS),
    "pattern_chapters": (pattern_chapters, PATTERN_CHAPTERS),
    "first_chapters": (first_chapters, FIRST_TWO),
    "text_heads": (text_heads, HEADS),
}
