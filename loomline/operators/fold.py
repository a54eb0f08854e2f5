"""The ordered fold of extraction records into character states, current or as of any chapter.

Events are ordered by ord = (seq, section, place): a chapter's new characters come before its changes. Each event is read
once, into a row for each thing that it says of a character (a fact, a relation, a memory, a development, and what it does
to the single-valued fields); these rows are folded by character, kind and item, and what is left of them is gathered by
character. For states as of several chapters the rows are first folded within a chapter, then over the chapters (running
minima and maxima), and each is kept with the span of chapters for which it holds; a state picks those that hold at its
checkpoint, after the last shuffle, so that only writing the states grows with the number of checkpoints. Deltas are never
altered, so a state as of a chapter depends on nothing later; deltas that arrive out of order are sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.rules import DEFAULT_RELATION, DEFAULT_TRUST, INITIAL_EMOTION
from loomline.functions.text import or_empty, strip, truthy

RELATIONS = "array<struct<target:string,relation_type:string,description:string,trust_level:string>>"

#: What a row of _items() is about.
FIELDS, KNOWN, UNKNOWN, RELATION, MEMORY, TRAIT = range(6)
_ITEMS = "array<struct<kind:int,i:int,item:string>>"


def character_events(deltas: DataFrame) -> DataFrame:
    """deltas: doc_id, seq, chapter, extraction. One row per introduction or change of a character."""
    kinds = deltas.schema["extraction"].dataType
    new, change = (kinds[f].dataType.elementType for f in ("new_characters", "character_changes"))

    def told(field: str, section: int, row: Callable[[Column, Column], Column]) -> Column:
        return F.coalesce(F.transform(F.col(f"extraction.{field}"), row), F.array().cast(f"array<struct<section:int,place:int,name:string,new:{new.simpleString()},change:{change.simpleString()}>>"))

    def introduced(x: Column, i: Column) -> Column:
        return F.struct(F.lit(0).alias("section"), i.alias("place"), x["name"].alias("name"), x.alias("new"), F.lit(None).cast(change).alias("change"))

    def changed(x: Column, i: Column) -> Column:
        return F.struct(F.lit(1).alias("section"), i.alias("place"), F.coalesce(x["character_name"], x["name"]).alias("name"), F.lit(None).cast(new).alias("new"), x.alias("change"))

    each = deltas.select("doc_id", "seq", "chapter", F.inline(F.concat(told("new_characters", 0, introduced), told("character_changes", 1, changed))))
    return each.filter(truthy(F.col("name"))).select("doc_id", "chapter", F.struct("seq", "section", "place").alias("ord"), "name", "new", "change")


def as_of(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """events repeated for every checkpoint (column cp) at or after their chapter: the plain way, by which tests judge
    fold_as_of()."""
    return events.join(F.broadcast(checkpoints), F.col("chapter") <= F.col("cp"))


def _first_seen(rows: DataFrame, keys: list[str], item: str, into: str) -> DataFrame:
    """Distinct items in order of first appearance."""
    first = rows.groupBy(*keys, item).agg(F.min("at").alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", item))), lambda x: x[item]).alias(into))


def _items(events: DataFrame, keys: list[str], longest: int = 20) -> DataFrame:
    """A row for each thing that an event says of a character: keys, kind, item, tie (a memory's own ord: memories are not
    merged), and what a fold keeps of it: the least first, the greatest last and changed."""
    change = F.col("change")
    none = F.array().cast(_ITEMS)

    def thing(kind: int, i: Column, item: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), item.alias("item"))

    def each(kind: int, array: Column, item: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.filter(F.transform(array, lambda x, i: thing(kind, i, item(x))), lambda x: truthy(x["item"])), none)

    def alone(kind: int, said: Column, item: Column) -> Column:
        return F.when(said, F.array(thing(kind, F.lit(0), item))).otherwise(none)

    memory = F.concat(F.lit("[第"), F.col("chapter").cast("string"), F.lit("章] "), change["key_event"])
    d = change["personality_development"]
    short = d.isNotNull() & ~F.lower(strip(d)).isin("null", "none", "") & (F.length(d) <= longest)
    said = F.concat(
        F.array(thing(FIELDS, F.lit(0), F.lit(""))),
        each(KNOWN, change["new_facts_learned"], lambda x: x),
        each(UNKNOWN, change["unknown_facts_updated"], lambda x: x),
        each(RELATION, change["relationship_changes"], lambda r: r["target"]),
        alone(MEMORY, truthy(change["key_event"]), memory),
        alone(TRAIT, short, d),
    )
    emotion = change["emotional_shift"]
    told = events.select(
        *dict.fromkeys([*keys, "chapter"]),
        "ord",
        "new",
        change.isNotNull().alias("changes"),
        F.when(truthy(emotion), emotion).alias("emotion"),
        change["relationship_changes"].alias("related"),
        F.inline(said),
    )
    is_ = lambda kind, value: F.when(F.col("kind") == kind, value)
    at, r = F.struct("ord", "i").alias("at"), F.get("related", F.col("i"))
    text = F.when(F.col("kind") == FIELDS, F.col("emotion")).when(F.col("kind") == RELATION, r["change"])
    return told.select(
        *keys,
        "kind",
        "item",
        is_(MEMORY, F.col("ord")).alias("tie"),
        F.struct(
            at,
            is_(RELATION, F.coalesce(r["type"], F.lit(DEFAULT_RELATION))).alias("relation_type"),
            is_(RELATION, F.coalesce(r["trust_level"], F.lit(DEFAULT_TRUST))).alias("trust_level"),
            is_(FIELDS, F.col("chapter")).alias("chapter"),
            is_(FIELDS, F.col("new")).alias("new"),
        ).alias("first"),
        F.when(text.isNotNull(), F.struct(at, text.alias("text"))).alias("last"),
        F.when((F.col("kind") == FIELDS) & F.col("changes"), F.struct("ord", "chapter")).alias("changed"),
    )


def _gathered(folded: DataFrame, keys: list[str], *span: str) -> DataFrame:
    """keys and a list for each kind, in order, of what was folded, with the columns of span."""

    def listed(kind: int, *columns: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns, *span))))

    at, item = F.col("first.at").alias("at"), F.col("item").alias("x")
    # the first mention of a target fixes its place, kind and trust; the last that has a description gives that
    relation = F.struct(F.col("item").alias("target"), "first.relation_type", F.coalesce("last.text", F.lit("")).alias("description"), "first.trust_level").alias("x")
    return folded.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("kind") == FIELDS, F.struct("first", "last", "changed", *span))).alias("fields"),
        listed(KNOWN, at, item).alias("known"),
        listed(UNKNOWN, at, item).alias("unknown"),
        listed(RELATION, at, relation).alias("related"),
        listed(MEMORY, F.col("tie"), item, F.col("n")).alias("remembered"),
        listed(TRAIT, at, item).alias("grown"),
    )


def _states(gathered: DataFrame, keys: list[str], held: Callable[[Column], Column] = lambda listed: listed) -> DataFrame:
    """A state for each row that has one, in the fields of a character state, of what is held of the row's lists."""
    now = gathered.withColumn("f", F.get(held(F.col("fields")), F.lit(0))).filter("f is not null")
    new, taken = F.col("f.first.new"), lambda c: F.transform(held(F.col(c)), lambda v: v["x"])
    return now.select(
        *keys,
        F.col("f.first.at.ord").alias("first_seen"),
        F.coalesce("f.changed.chapter", "f.first.chapter").alias("chapter"),
        F.coalesce(new["identity"], F.lit("")).alias("identity"),
        F.array_distinct(F.concat(or_empty(new["personality_traits"]), taken("grown"))).alias("personality_traits"),
        F.coalesce(new["speech_style"], F.lit("")).alias("speech_style"),
        taken("known").alias("known_facts"),
        taken("unknown").alias("unknown_facts"),
        F.coalesce("f.last.text", F.when(new.isNotNull(), F.lit(INITIAL_EMOTION)).otherwise(F.lit(""))).alias("emotional_state"),
        F.array().cast("array<string>").alias("goals"),
        taken("related").alias("relationships"),
        F.flatten(F.transform(held(F.col("remembered")), lambda v: F.array_repeat(v["x"], v["n"].cast("int")))).alias("key_memories"),
    )


def _kept() -> list[Column]:
    return [F.min("first").alias("first"), F.max("last").alias("last"), F.max("changed").alias("changed"), F.count(F.lit(1)).alias("n")]


def fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """A state for each value of keys (name among them), in the fields of a character state; first_seen orders names."""
    return _states(_gathered(_items(events, keys).groupBy(*keys, "kind", "item", "tie").agg(*_kept()), keys), keys)


def fold_as_of(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """States by doc_id, cp and name at each checkpoint (column cp), as fold(as_of(events, checkpoints)) has them."""
    own = ["doc_id", "name"]
    cps = F.broadcast(checkpoints.agg(F.array_sort(F.collect_set("cp")).alias("__cps")))  # one row
    # dealt by item for both the fold within a chapter and the one over chapters
    dealt = _items(events, [*own, "chapter"]).repartition(*own, "kind", "item")
    within = dealt.groupBy(*own, "kind", "item", "chapter", "tie").agg(*_kept())
    chapters = Window.partitionBy(*own, "kind", "item").orderBy("chapter")
    upto = chapters.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row holds until the next chapter that has one of its item; a memory stays
    until = F.when(F.col("kind") != MEMORY, F.lead("chapter").over(chapters))
    running = within.withColumns({c: f(c).over(upto) for c, f in (("first", F.min), ("last", F.max), ("changed", F.max))} | {"until": until})
    told = _gathered(running.withColumnRenamed("chapter", "from"), own, "from", "until")

    def held(listed: Column) -> Column:
        return F.filter(listed, lambda v: (v["from"] <= F.col("cp")) & (v["until"].isNull() | (F.col("cp") < v["until"])))

    return _states(told.crossJoin(cps).withColumn("cp", F.explode("__cps")).drop("__cps"), ["doc_id", "cp", "name"], held)


def current_states(deltas: DataFrame) -> DataFrame:
    return fold(character_events(deltas), ["doc_id", "name"])


def states_as_of(deltas: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """States at each checkpoint (column cp) of the characters that exist by then."""
    return fold_as_of(character_events(deltas), checkpoints)


def to_compress(states: DataFrame, threshold: int = 20) -> DataFrame:
    """The characters whose known facts outgrew the threshold."""
    return states.filter(F.size("known_facts") > threshold)


def compressed(states: DataFrame, threshold: int = 20, facts: int = 15, memories: int = 10, goals: int = 3, relations: int = 8) -> DataFrame:
    """The deterministic stand-in for a model's compression: the latest of each list, within the caps."""
    over = F.size("known_facts") > threshold
    last = lambda c, n: F.when(over & (F.size(c) > n), F.slice(c, -n, n)).otherwise(F.col(c)).alias(c)
    caps = {"known_facts": facts, "key_memories": memories, "goals": goals, "relationships": relations}
    return states.select(*[last(c, caps[c]) if c in caps else c for c in states.columns])


def apply_compression(states: DataFrame, replies: DataFrame) -> DataFrame:
    """replies: doc_id, name, compact (a struct of fields). Fields that a reply lacks stay, but relationships, which a
    reply without them empties."""
    joined = states.join(replies, ["doc_id", "name"], "left")
    fields = ("identity", "personality_traits", "speech_style", "known_facts", "unknown_facts", "emotional_state", "goals", "key_memories")
    has = F.col("compact").isNotNull()
    out = joined
    for f in fields:
        if f in replies.schema["compact"].dataType.fieldNames():
            out = out.withColumn(f, F.coalesce(F.col(f"compact.{f}"), F.col(f)))
    relations = F.coalesce("compact.relationships", F.array().cast(RELATIONS))
    return out.withColumn("relationships", F.when(has, relations).otherwise(F.col("relationships"))).select(*states.columns)


def names_in_order(states: DataFrame) -> DataFrame:
    return states.select("doc_id", "name", "first_seen").orderBy("doc_id", "first_seen")


def patch_eligible(least_facts: int = 2, overwrite: bool = False) -> Column:
    """Whether a state lacks unknown facts (or they may be overwritten) and knows enough to be asked about."""
    return (F.size("known_facts") >= least_facts) & (F.lit(overwrite) | (F.size("unknown_facts") == 0))


def patch_deltas(states: DataFrame, patches: DataFrame, chapter: int, least_facts: int = 2, overwrite: bool = False) -> DataFrame:
    """Patched unknown facts as delta rows of their own chapter, so every view sees them. patches: doc_id, name, facts."""
    return patches_of(states.filter(patch_eligible(least_facts, overwrite)).join(patches, ["doc_id", "name"]), chapter)


def patches_of(patches: DataFrame, chapter: int) -> DataFrame:
    """Delta rows of patches (doc_id, name, facts), at most eight facts each."""
    return patches.select("doc_id", F.lit(chapter).alias("chapter"), "name", F.slice("facts", 1, 8).alias("unknown_facts_updated"))


def summary(states: DataFrame) -> DataFrame:
    return states.select("doc_id", "name", F.size("known_facts").alias("facts"), F.size("key_memories").alias("memories"), F.size("relationships").alias("relations"))
