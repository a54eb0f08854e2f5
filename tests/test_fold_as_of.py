"""States as of checkpoints in one pass, against events repeated for every checkpoint."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import extraction, fold


def records(seed):
    """Deltas whose chapters go back and forth, with ties, repeats, late introductions and empty fields."""
    rng = random.Random(seed)
    rows = []
    for seq in range(60):
        names = [rng.choice("ABC") for _ in range(rng.randint(0, 3))]
        change = lambda n: {
            rng.choice(["name", "character_name"]): n,
            "new_facts_learned": [f"f{rng.randint(0, 6)}" for _ in range(rng.randint(0, 3))],
            "unknown_facts_updated": [f"u{rng.randint(0, 3)}"],
            "emotional_shift": rng.choice([None, "", "glad", "sad"]),
            "relationship_changes": [{"target": rng.choice(["x", "y", ""]), "change": rng.choice([None, f"c{seq}"]), "type": rng.choice([None, "kin"]), "trust_level": rng.choice([None, "low"])} for _ in range(rng.randint(0, 2))],
            "key_event": rng.choice(["", f"e{seq}"]),
            "personality_development": rng.choice([None, "None", "bold", "a development of more than twenty", f"d{rng.randint(0, 3)}"]),
        }
        told = [{"name": rng.choice("ABCD"), "identity": f"i{seq}", "personality_traits": ["bold", f"t{seq}"], "speech_style": "s"}] if rng.random() < 0.3 else []
        rows.append(("d" if seq % 2 else "e", seq, rng.randint(1, 9), json.dumps({"character_changes": [change(n) for n in names], "new_characters": told})))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_states_as_of_match_the_plain_way(spark, seed):
    raw = spark.createDataFrame(records(seed), "doc_id string, seq bigint, chapter int, raw string")
    deltas = extraction.normalise(raw).select("doc_id", "seq", "chapter", "extraction")
    events = fold.character_events(deltas)
    cps = spark.createDataFrame([(c,) for c in (1, 3, 4, 8, 20, 20)], "cp int")
    got = sorted(map(str, fold.states_as_of(deltas, cps).collect()))
    want = sorted(map(str, fold.fold(fold.as_of(events, cps.distinct()), ["doc_id", "cp", "name"]).collect()))
    assert got == want and len(got) > 20
    assert fold.states_as_of(deltas, cps.limit(0)).count() == 0
    assert fold.states_as_of(deltas.filter(F.col("chapter") > 99), cps).count() == 0
