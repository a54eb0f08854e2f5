"""The whole-text queries reach what the queries over prefixes do not."""

from loomline.plans import catalog


def test_whole_texts_and_all_lines_are_read(spark, tmp_path):
    text = "Word\n" + "\n".join(f"line {i}" for i in range(14)) + "\na word (aside) at the end " + "x" * 90
    spark.createDataFrame([(0, text, "s"), (1, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r.indexes for r in got("contains_join") if r.name == "word"} == {"16"}
    assert len(got("clean_line")) == 32 + 7 and any(r.line.startswith("a word  at") for r in got("clean_line"))
    assert [(r.chosen, r.rejected) for r in got("preference_rows")] == [(text, text)]
    assert [r.answer for r in got("accepted_attempt")] == [text]
