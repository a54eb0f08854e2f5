"""Text is read once: for both ways of cutting into chapters, at its ends for white space, and up to where a section ends."""

import re
import time

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as t
from loomline.operators import segment
from loomline.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_blank_texts_are_one_empty_chapter_as_in_the_sql(spark, tmp_path):
    rows = [(0, ""), (1, " \n\t\n "), (2, None), (3, "one line")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["split_chapters"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.chapters, r.chars) for r in got) == [(0, 1, 0), (1, 1, 0), (3, 1, 8)]


def test_both_ways_are_one_scan(spark, tmp_path):
    spark.createDataFrame([(0, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = segment.split_chapters(spark.read.parquet(str(tmp_path / "d")))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_many_markers_cost_no_more_than_their_number(spark):
    """The last of each title counts, over thousands of marker lines."""
    text = "\n".join(f"第{i % 6000}章\n{i}" for i in range(12000))
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    began = time.time()
    got = segment.split_by_markers(docs).orderBy("index").collect()
    assert [(r.title, r.content) for r in got] == [(f"第{i}章", str(i + 6000)) for i in range(6000)]
    assert time.time() - began < 30


@pytest.mark.parametrize("text", ["", " ", "a", "　 a b\xa0\n", "​a​", "\x1ca\x1c", " \u0085a\r\n", "\n\n", "x\n y", None])
def test_strip_takes_what_the_pattern_takes(spark, text):
    c = F.lit(text).cast("string")
    assert one(spark, t.strip(c)) == one(spark, F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


TEXTS = ["### t\nx\n### u\ny", "## a t b\n\n x \n####\ny", "### t\n### u\ny", "### t\n", "### t", "no", "### s\nx\n### \n t\n z ## \n##x", None, "###\n\nt\nq\n###"]


@pytest.mark.parametrize("text", TEXTS)
def test_sections_are_what_the_pattern_takes(spark, text):
    c = F.lit(text).cast("string")
    plain = F.regexp_replace(F.regexp_extract(c, r"(?sU)###?\s*[^\n]*\Qt\E[^\n]*\n(.*?)(?=\n###|\z)", 1), r"(?U)^\s+|\s+$", "")
    assert one(spark, t.section(c, "t")) == one(spark, plain)


def test_long_sections_are_read_in_linear_time(spark):
    began = time.time()
    assert one(spark, F.length(t.section(F.concat(F.lit("### t\n"), F.repeat(F.lit(" x"), 2_000_000), F.lit("\n### u\n")), "t"))) == 3_999_999
    assert time.time() - began < 30


@pytest.mark.parametrize("text", ["a\r\nb\rc\nd", "a\x0bb\x0cc\x1cd\x85e f g", "", "\r\n", "a\n\n"])
def test_lines_end_where_they_did(spark, text):
    assert one(spark, t.lines_of(F.lit(text))) == re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text)
