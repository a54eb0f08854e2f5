"""Steps whose cost must not grow with more than the input: files."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import extraction, fold
from loomline.plans import catalog
from loomline.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["state_file_states", "state_file_history"])
def test_state_files_are_not_a_file_for_each_character(spark, name):
    got = catalog.queries()[name](spark, SF)
    assert len(got.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_state_lines_keep_what_a_state_file_keeps(spark, tmp_path):
    """Line breaks, quotes and records out of order, of several stories."""
    told = F.from_json(F.lit('{"character_changes":[{"name":"A \\"x\\"","new_facts_learned":["a\\nb"],"key_event":"e"}]}'), extraction.EXTRACTION)
    deltas = spark.range(6).select(F.concat(F.lit("d"), F.col("id") % 2).alias("doc_id"), (5 - F.col("id")).alias("seq"), (F.col("id") + 1).cast("int").alias("chapter"), told.alias("extraction"))
    states = fold.current_states(deltas)
    files.write_state_lines(states, deltas, str(tmp_path / "s"))
    back, history = files.read_state_lines(spark, str(tmp_path / "s"))
    key = lambda frame: sorted(str(r) for r in frame.select("doc_id", "name", "chapter", "known_facts", "key_memories").collect())
    assert key(back) == key(states) and back.first().known_facts == ["a\nb"]
    assert [(r.doc_id, r.seq, r.chapter) for r in history.orderBy("doc_id", "seq").collect()] == [("d0", 0, 5), ("d0", 1, 3), ("d0", 2, 1), ("d1", 0, 6), ("d1", 1, 4), ("d1", 2, 2)]
