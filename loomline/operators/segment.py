"""Segmentation of text into chapters: by marker lines, or by length at paragraph borders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.rules import CHAPTER_MARKERS
from loomline.functions.text import is_marker, squeeze, strip

CHAPTERS = "index int, title string, content string, char_count int"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


Marker = Callable[[Column], Column]


def marker_of(patterns: Sequence[str] = CHAPTER_MARKERS) -> Marker:
    """Whether a line is a chapter's title by the patterns."""
    return lambda line: is_marker(line, patterns)


def _marked(docs: DataFrame, hit: Marker) -> DataFrame:
    """docs with their lines and marks: marker lines with their place, title and key."""
    placed = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), line.alias("line"))), lambda m: hit(m["line"]))
    return docs.withColumn("lines", F.split("text", "\n", -1)).withColumn("marks", F.transform(placed, lambda m: F.struct(squeeze(m["line"]).alias("key"), m["at"].alias("at"), strip(m["line"]).alias("title"))))


def _between_marks(marked: DataFrame) -> DataFrame:
    """marked with starts: of marks with one key the last, in the text's order."""
    keyed = marked.withColumn("keyed", F.sort_array("marks"))
    last = F.filter("keyed", lambda m, i: F.coalesce(F.get("keyed", i + 1)["key"] != m["key"], F.lit(True)))
    return keyed.withColumn("starts", F.sort_array(F.transform(last, lambda m: F.struct(m["at"].alias("at"), m["title"].alias("title"))))).drop("keyed")


def _chapters() -> Column:
    """The chapters (title, content, size) between starts that have content."""

    def chapter(m: Column, i: Column) -> Column:
        end = F.coalesce(F.get("starts", i + 1)["at"], F.size("lines"))
        content = strip(F.array_join(F.slice("lines", m["at"] + 2, end - m["at"] - 1), "\n"))
        return F.struct(m["title"].alias("title"), content.alias("content"))

    return F.filter(F.transform("starts", chapter), lambda c: c["content"] != "")


def split_by_markers(docs: DataFrame, marker: Marker | None = None) -> DataFrame:
    """Chapters of docs (doc_id, text) between marker lines. Of markers with one title (but for white space) the last
    counts, so that a table of contents gives way to the body; sections without content go before chapters are numbered.
    All of it is within the row: no text is shuffled."""
    found = _between_marks(_marked(docs.select("doc_id", "text"), marker or marker_of())).select("doc_id", F.posexplode(_chapters()).alias("i", "c"))
    return found.select("doc_id", (F.col("i") + 1).alias("index"), F.col("c.title").alias("title"), F.col("c.content").alias("content"), F.length("c.content").alias("char_count"))


def paragraphs(text: Column, separator: str = r"(?U)\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), strip), lambda p: p != "")


def greedy_chunks(parts: Column, limit: int) -> Column:
    """Array of (size, parts): parts in order, a new chunk where the next part would pass the limit; a part over the
    limit stays whole. size is the sum of the parts' lengths."""
    kind = "array<struct<size:int,parts:array<string>>>"
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("parts"), F.array().cast(kind).alias("done"))

    def add(seen: Column, part: Column) -> Column:
        n = F.length(part)
        opens = (seen["size"] + n > limit) & (F.size(seen["parts"]) > 0)
        closed = F.concat(seen["done"], F.array(F.struct(seen["size"].alias("size"), seen["parts"].alias("parts"))))
        return F.struct(
            F.when(opens, n).otherwise(seen["size"] + n).alias("size"),
            F.when(opens, F.array(part)).otherwise(F.concat(seen["parts"], F.array(part))).alias("parts"),
            F.when(opens, closed).otherwise(seen["done"]).alias("done"),
        )

    def finish(seen: Column) -> Column:
        last = F.array(F.struct(seen["size"].alias("size"), seen["parts"].alias("parts")))
        return F.when(F.size(seen["parts"]) > 0, F.concat(seen["done"], last)).otherwise(seen["done"])

    return F.aggregate(parts, start, add, finish)


def split_by_length(docs: DataFrame, limit: int = 6000, separator: str = r"(?U)\n\s*\n", joiner: str = "\n\n", title: str = "段落 %d") -> DataFrame:
    """Chapters of about limit characters. char_count counts the paragraphs alone, without what joins them."""
    chunks = docs.select("doc_id", F.posexplode(greedy_chunks(paragraphs(F.col("text"), separator), limit)).alias("at", "chunk"))
    index = F.col("at") + 1
    return chunks.select(
        "doc_id",
        index.alias("index"),
        F.format_string(title, index).alias("title"),
        F.array_join("chunk.parts", joiner).alias("content"),
        F.col("chunk.size").alias("char_count"),
    )


def split_chapters(docs: DataFrame, limit: int = 6000, marker: Marker | None = None, least: int = 3) -> DataFrame:
    """Chapters of docs (doc_id, text): by markers where a text has `least` of them, else by length. Texts are read and
    their lines judged once for both ways."""
    marked = _marked(docs.select("doc_id", "text"), marker or marker_of())
    routed = _between_marks(marked.withColumn("marks", F.when(F.size("marks") >= least, F.col("marks"))))
    kind = "array<struct<title:string,content:string,char_count:int>>"
    by_marker = F.transform(_chapters(), lambda c: F.struct(c["title"].alias("title"), c["content"].alias("content"), F.length(c["content"]).alias("char_count")))
    chunks = greedy_chunks(paragraphs(F.col("text")), limit)
    by_length = F.transform(chunks, lambda c, i: F.struct(F.format_string("段落 %d", i + 1).alias("title"), F.array_join(c["parts"], "\n\n").alias("content"), c["size"].alias("char_count")))
    found = routed.select("doc_id", F.posexplode(F.when(F.col("marks").isNotNull(), by_marker.cast(kind)).otherwise(by_length.cast(kind))).alias("i", "c"))
    return found.select("doc_id", (F.col("i") + 1).alias("index"), "c.title", "c.content", "c.char_count")


def first_chapters(chapters: DataFrame, n: int | None) -> DataFrame:
    """The first n; none and 0 mean all."""
    return chapters.filter(F.col("index") <= n) if n else chapters
