"""The fold reads its deltas once, whatever it is asked for."""

from pyspark.sql import functions as F

from loomline.operators import extraction, fold
from loomline.plans import characters

SF = "/root/testdata/sf0.001"


def scans(frame):
    """How often the events are read in a plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan parquet")


def test_current_states_are_one_pass_over_the_events(spark):
    assert scans(fold.current_states(characters.deltas(spark, SF))) == 1


def test_states_as_of_are_one_pass_over_the_events(spark):
    cps = spark.range(3).select((F.col("id") * 10).cast("int").alias("cp"))
    got = fold.states_as_of(characters.deltas(spark, SF), cps)
    assert scans(got) == 1
    # only writing the states grows with the checkpoints: nothing is dealt out by checkpoint
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and not any("hashpartitioning" in line and "cp#" in line for line in plan.split("\n"))


def test_equal_memories_are_all_kept(spark):
    """A chapter may bring one event twice, and a record may come twice."""
    record = '{"character_changes":[{"name":"A","key_event":"e"},{"name":"A","key_event":"e"}]}'
    raw = spark.createDataFrame([("d", 1, 1, record), ("d", 1, 1, record)], "doc_id string, seq bigint, chapter int, raw string")
    deltas = extraction.normalise(raw).select("doc_id", "seq", "chapter", "extraction")
    want = ["[第1章] e"] * 4
    assert fold.current_states(deltas).first().key_memories == want
    assert fold.states_as_of(deltas, spark.createDataFrame([(2,)], "cp int")).first().key_memories == want
