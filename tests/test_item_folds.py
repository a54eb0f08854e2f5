"""Steps whose cost must not grow with more than the input: what is folded and written for items."""

import pytest

from loomline.operators import synthesis
from loomline.plans import catalog, models
from loomline.sources.providers import RuleProvider

SF = "/root/testdata/sf0.001"


def test_items_take_only_the_states_of_their_chapters(spark, monkeypatch):
    seen = []
    plain = synthesis.states_as_of

    def states_as_of(deltas, cps):
        seen.append(sorted(r.cp for r in cps.collect()))
        return plain(deltas, cps)

    monkeypatch.setattr(synthesis, "states_as_of", states_as_of)
    for name in ("sft_rows", "preference_items_rows"):
        catalog.queries()[name](spark, SF)
    assert seen == [[1, 2, 7, 30]] * 2


class Reading(RuleProvider):
    """Counts how often the events stand behind a request."""

    def complete(self, requests):
        told = requests._jdf.queryExecution().optimizedPlan().toString()
        self.folds = [*getattr(self, "folds", []), told.count("event_type")]
        return super().complete(requests)


@pytest.mark.parametrize("name", ["sft_dialogues", "preference_dialogues"])
def test_no_request_folds_the_story_again(spark, monkeypatch, name):
    asked = []

    def provider(rule):
        asked.append(Reading(rule))
        return asked[-1]

    monkeypatch.setattr(models, "RuleProvider", provider)
    assert catalog.queries()[name](spark, SF).count()
    assert [p.folds for p in asked] and not any(n for p in asked for n in p.folds)


@pytest.mark.parametrize("name", ["sft_dialogues", "preference_dialogues"])
def test_states_are_not_written_beside_every_reply(spark, monkeypatch, name):
    written = []
    plain = synthesis.cut

    def cut(rows, *args, **kw):
        written.append(rows.columns)
        return plain(rows, *args, **kw)

    monkeypatch.setattr(synthesis, "cut", cut)
    catalog.queries()[name](spark, SF)
    assert sum("state" in c for c in written) == 1 and not any("prompt" in c for c in written)
