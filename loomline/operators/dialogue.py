"""Quoted speech: extraction with speaker attribution, candidates and their validation.

Quotes with their contexts come from one regular-expression pass inside the JVM: the text is cut at each quote into
(before, quote) steps, so the 90 characters on either side are substrings. Names differ per row; attribution builds its
patterns from the name column, with the name quoted as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.rules import ZH, Pack
from loomline.functions.text import clean_line, quoted, strip

STOP = r"[^。！？\n]"


def quotes(text: Column, most: int = 160, left: int = 90, right: int = 90, pack: Pack = ZH) -> Column:
    """Array of (pos, raw, line, left, right) for every quote of 2 to most characters, scanned from the left."""
    o, c = pack.quote_open, pack.quote_close
    found = F.regexp_extract_all(text, F.lit(f"{o}([^{c}]{{2,{most}}}){c}"), F.lit(0))
    kind = "array<struct<pos:int,raw:string>>"
    start = F.struct(F.lit(1).alias("from"), F.array().cast(kind).alias("out"))

    def add(seen: Column, q: Column) -> Column:
        at = F.call_function("locate", q, text, seen["from"])
        return F.struct((at + F.length(q)).alias("from"), F.concat(seen["out"], F.array(F.struct(at.alias("pos"), q.alias("raw")))).alias("out"))

    placed = F.aggregate(found, start, add, lambda s: s["out"])

    def around(q: Column) -> Column:
        first = F.greatest(q["pos"] - left, F.lit(1))
        end = q["pos"] + F.length(q["raw"])
        inner = F.substring(q["raw"], F.lit(2), F.length(q["raw"]) - 2)
        return F.struct(q["pos"].alias("pos"), inner.alias("raw"), clean_line(strip(inner)).alias("line"), F.substring(text, first, q["pos"] - first).alias("left"), F.substring(text, end, F.lit(right)).alias("right"))

    return F.transform(placed, around)


def target_evidence(name: Column, left: Column, right: Column, pack: Pack = ZH) -> Column:
    """The name, then a verb of speech (or the other way round) in the last or first 80 characters around."""
    a, b = F.right(left, F.lit(80)), F.left(right, F.lit(80))
    says = F.concat(quoted(name), F.lit(f"{STOP}{{0,10}}{pack.speech_verbs}"))
    said = F.concat(F.lit(f"{pack.speech_verbs}{STOP}{{0,6}}"), quoted(name))
    return F.regexp_like(a, says) | F.regexp_like(b, says) | F.regexp_like(a, said) | F.regexp_like(b, said)


def other_evidence(name: Column, left: Column, right: Column, pack: Pack = ZH) -> Column:
    """Another run of name characters before a verb of speech, within 60 characters around. The run is greedy."""
    around = F.concat(F.right(left, F.lit(60)), F.lit(" "), F.left(right, F.lit(60)))
    runs = F.regexp_extract_all(around, F.lit(f"({pack.name_run}){STOP}{{0,8}}{pack.speech_verbs}"), F.lit(1))
    return F.exists(runs, lambda r: strip(r) != name)


def attributed(texts: DataFrame, most: int, pack: Pack = ZH) -> DataFrame:
    """texts: name, text. strict (lines with evidence for the name) and ambiguous (with none for anyone), each distinct
    in order, at most `most` and twice that."""
    q = F.filter(quotes(F.col("text"), pack=pack), lambda x: F.length(x["line"]) >= 3)
    judged = F.transform(q, lambda x: F.struct(x["line"].alias("line"), target_evidence(F.col("name"), x["left"], x["right"], pack).alias("own"), other_evidence(F.col("name"), x["left"], x["right"], pack).alias("other")))
    pick = lambda f, n: F.slice(F.array_distinct(F.transform(F.filter("judged", f), lambda x: x["line"])), 1, n)
    return texts.withColumn("judged", judged).withColumns({"strict": pick(lambda x: x["own"], most), "ambiguous": pick(lambda x: ~x["own"] & ~x["other"], 2 * most)}).drop("judged")


def _matching(line: Column, found: Column) -> Column:
    return F.filter(found, lambda q: (q["line"] != "") & (F.contains(q["line"], line) | F.contains(line, q["line"])))


def supported(name: Column, line: Column, text: Column, pack: Pack = ZH) -> Column:
    """Some quote that holds the line, or that it holds, has evidence for the name."""
    return F.exists(_matching(line, quotes(text, 200, pack=pack)), lambda q: target_evidence(name, q["left"], q["right"], pack))


def nearby_lines(name: Column, text: Column, most: int, pack: Pack = ZH) -> Column:
    """The fallback: lines of quotes with the name within 40 characters before or 24 after."""
    near = F.filter(quotes(text, 120, 40, 24, pack), lambda q: F.contains(F.concat(q["left"], q["right"]), name) & (F.length(q["line"]) >= 3))
    return F.array_join(F.slice(F.array_distinct(F.transform(near, lambda q: q["line"])), 1, most), "\n")


def paragraph_context(text: Column, quote: Column, around: int = 1) -> Column:
    """The first line that has the quote's first 15 characters, and its neighbours; empty if none has."""
    paragraphs = F.split(text, "\n", -1)
    key = F.left(quote, F.lit(15))
    at = F.array_position(F.transform(paragraphs, lambda p: F.contains(p, key)), F.lit(True)).cast("int")
    first = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(paragraphs, first, at + around - first + 1), "\n")).otherwise(F.lit(""))


def candidate_chapters(names: DataFrame, chapters: DataFrame) -> DataFrame:
    """names: doc_id, name, cp (few per document). doc_id, name, cp, indexes: the chapters up to cp that contain the name, else all up to cp."""
    upto = names.join(chapters.select("doc_id", "index", "content"), "doc_id").filter(F.col("index") <= F.col("cp"))
    has = F.contains("content", F.col("name"))
    got = upto.groupBy("doc_id", "name", "cp").agg(F.sort_array(F.collect_list(F.when(has, F.col("index")))).alias("with"), F.sort_array(F.collect_list("index")).alias("every"))
    return got.select("doc_id", "name", "cp", F.when(F.size("with") > 0, F.col("with")).otherwise(F.col("every")).alias("indexes"))


def validated(candidates: DataFrame, pack: Pack = ZH, read: int = 8000) -> DataFrame:
    """candidates: name, line, text, reply (the judge's, null if it failed or was not asked). Adds context and keep: a
    line goes where a matching quote before any that settles it is another's, stays where no quote matches, else the
    judge decides and a failed judge keeps."""
    window = F.left("text", F.lit(read))
    found = _matching(F.col("line"), quotes(window, 200, pack=pack))
    other = F.exists(found, lambda q: other_evidence(F.col("name"), q["left"], q["right"], pack))
    around = lambda q: F.substring(window, F.greatest(q["pos"] - 150, F.lit(1)), F.length(q["raw"]) + 302)
    context = paragraph_context(window, F.col("line"))
    context = F.when(F.size(found) == 0, F.lit("")).when(context != "", context).otherwise(around(F.element_at(found, -1)))
    says = F.col("reply").contains(pack.yes) & ~F.col("reply").contains(pack.no)
    judged = candidates.withColumn("__other", other).withColumn("context", F.when(F.size(found) > 0, context).otherwise(F.lit("")))
    keep = F.when(F.col("__other"), F.lit(False)).when(F.col("context") == "", F.lit(True)).otherwise(F.coalesce(says, F.lit(True)))
    return judged.withColumn("keep", keep).drop("__other")
