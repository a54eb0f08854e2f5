"""Per-chapter extraction records: schema, defaults, quality counts, choice between attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import or_empty, recover_json

CHANGE = (
    "struct<name:string,character_name:string,new_facts_learned:array<string>,unknown_facts_updated:array<string>,emotional_shift:string,"
    "relationship_changes:array<struct<target:string,change:string,type:string,trust_level:string>>,key_event:string,personality_development:string>"
)
NEW = "struct<name:string,identity:string,personality_traits:array<string>,speech_style:string>"
EXTRACTION = (
    f"struct<chapter_summary:string,characters_appeared:array<string>,key_events:array<string>,character_changes:array<{CHANGE}>,new_characters:array<{NEW}>>"
)


def parse_extraction(raw: Column) -> Column:
    """A model's reply as an extraction; a reply without JSON gives an empty one."""
    json = F.coalesce(recover_json(raw), F.lit("{}"))
    return F.from_json(json, EXTRACTION)


def _missing_unknown(raw: Column) -> Column:
    """How many changes lack the key of unknown facts (one that is explicitly null has it)."""
    changes = F.from_json(F.get_json_object(F.coalesce(recover_json(raw), F.lit("{}")), "$.character_changes"), "array<string>")
    keyed = F.transform(F.coalesce(changes, F.array().cast("array<string>")), lambda c: F.from_json(c, "map<string,string>"))
    return F.size(F.filter(keyed, lambda m: ~F.map_contains_key(m, "unknown_facts_updated")))


def normalise(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds extraction (defaults filled in) and stats to a column of raw replies."""
    e = F.col("parsed")
    change = lambda c: F.struct(
        c["name"].alias("name"),
        c["character_name"].alias("character_name"),
        or_empty(c["new_facts_learned"]).alias("new_facts_learned"),
        or_empty(c["unknown_facts_updated"]).alias("unknown_facts_updated"),
        c["emotional_shift"].alias("emotional_shift"),
        F.coalesce(c["relationship_changes"], F.array().cast("array<struct<target:string,change:string,type:string,trust_level:string>>")).alias("relationship_changes"),
        F.coalesce(c["key_event"], F.lit("")).alias("key_event"),
        c["personality_development"].alias("personality_development"),
    )
    changes = F.transform(F.coalesce(e["character_changes"], F.array().cast(f"array<{CHANGE}>")), change)
    filled = F.struct(
        F.coalesce(e["chapter_summary"], F.lit("")).alias("chapter_summary"),
        or_empty(e["characters_appeared"]).alias("characters_appeared"),
        or_empty(e["key_events"]).alias("key_events"),
        changes.alias("character_changes"),
        F.coalesce(e["new_characters"], F.array().cast(f"array<{NEW}>")).alias("new_characters"),
    )
    unknown = F.aggregate(F.col("extraction.character_changes"), F.lit(0), lambda n, c: n + F.size(c["unknown_facts_updated"]))
    stats = F.struct(
        F.size("extraction.character_changes").alias("character_changes"),
        _missing_unknown(F.col(raw)).alias("missing_unknown_fields"),
        unknown.alias("unknown_facts_updated"),
    )
    return frame.withColumn("parsed", parse_extraction(F.col(raw))).withColumn("extraction", filled).withColumn("stats", stats).drop("parsed")


def should_retry(stats: Column) -> Column:
    """Every change lacks its unknown facts, and there are changes."""
    return (stats["character_changes"] > 0) & (stats["missing_unknown_fields"] == stats["character_changes"])


def best_attempt(attempts: DataFrame, *keys: str) -> DataFrame:
    """Of the attempts at a key, the one with the fewest missing fields, the first of equals."""
    rank = F.struct(F.col("stats.missing_unknown_fields"), F.col("attempt"))
    return attempts.groupBy(*keys).agg(F.min_by("extraction", rank).alias("extraction"), F.min_by("stats", rank).alias("stats"))


def known_names(names: Column, none: str = "（暂无）") -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, "、")).otherwise(F.lit(none))


def progress(deltas: DataFrame) -> DataFrame:
    """What each chapter brought, in counts."""
    e = F.col("extraction")
    return deltas.select(
        "chapter",
        F.size(e["characters_appeared"]).alias("appeared"),
        F.size(e["character_changes"]).alias("changed"),
        F.size(e["new_characters"]).alias("introduced"),
        F.aggregate(e["character_changes"], F.lit(0), lambda n, c: n + F.size(or_empty(c["unknown_facts_updated"]))).alias("unknown"),
    )
