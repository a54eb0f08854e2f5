"""Steps whose cost must not grow with more than the input: folds behind the drivers' requests."""

from pyspark.sql import functions as F

from loomline.operators import drivers
from loomline.plans import characters
from loomline.sources.providers import RuleProvider

SF = "/root/testdata/sf0.001"


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("event_type")


def test_drivers_fold_once(spark):
    states = characters.current(spark, SF)
    assert scans(states)
    assert not scans(drivers.patch_facts(states, RuleProvider(F.lit('["p"]')), 31, 2, True))
    assert not scans(drivers.compress_states(states, RuleProvider(F.lit("sorry")), 2))


def test_chat_turns_fold_only_who_is_spoken_to(spark):
    asked = []

    class Names(RuleProvider):
        def complete(self, requests):
            asked.append(requests._jdf.queryExecution().optimizedPlan().toString())
            return super().complete(requests)

    inputs = spark.createDataFrame([(1, "3", "hello")], "conv_id int, name string, input string")
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    got = drivers.chat_turn(inputs, characters.current(spark, SF), turns, Names(F.lit("x")))
    assert "LeftSemi" in asked[0] and got.count() == 1
