"""Scalar text functions on Columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.rules import CHAPTER_MARKERS, ZH, Pack


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


#: Unicode's white space, what (?U)\\s stands for.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included. Only the ends are looked at; a pattern tries every place."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Without any white space (the key by which titles are compared)."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def truthy(text: Column) -> Column:
    """Neither null nor empty; white space alone counts."""
    return F.coalesce(text != "", F.lit(False))


def or_empty(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def is_marker(line: Column, patterns: Sequence[str] = CHAPTER_MARKERS) -> Column:
    s = strip(line)
    return (s != "") & any_of(*[s.rlike(f"(?Ud){p}") for p in patterns])


def truncate_middle(text: Column, limit: int = 8000, share: float = 0.4, mark: str = "\n\n[...中间省略约%s字...]\n\n") -> Column:
    """Head and tail of a text over limit, with the number of characters left out."""
    head = tail = int(limit * share)
    before, after = mark.split("%s")
    n = F.length(text)
    cut = F.concat(F.substring(text, 1, head), F.lit(before), (n - head - tail).cast("string"), F.lit(after), F.right(text, F.lit(tail)))
    return F.when(n <= limit, text).otherwise(cut)


def head(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def count_of(text: Column, part: Column) -> Column:
    """Occurrences that don't overlap; 0 for an empty part."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(F.lit(0))


# --- dialogue lines and answers


def clean_line(line: Column) -> Column:
    """A dialogue line without asides, the speaker's name before it and plain quotation marks around it."""
    t = F.regexp_replace(line, r"[（(][^）)]{1,30}[）)]", "")
    t = F.regexp_replace(t, r"(?U)^[\w·]{1,8}[说：:]\s*", "")
    return strip(F.regexp_replace(t, "^[\"']+|[\"']+$", ""))


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]", -1)


def distinct_kept(lines: Column) -> Column:
    """Distinct, by first appearance."""
    return F.array_distinct(lines)


def clean_dialogues(raw: Column, most: int) -> Column:
    kept = F.filter(F.transform(lines_of(raw), clean_line), lambda x: (F.length(x) >= 3) & ~x.rlike(r"[（(][^）)]{5,}[）)]"))
    return F.array_join(F.slice(distinct_kept(kept), 1, most), "\n")


def clean_answer(text: Column, pack: Pack = ZH) -> Column:
    t = F.regexp_replace(strip(text), r"(?U)^[（(][^）)]{1,30}[）)]\s*", "")
    t = F.regexp_replace(t, r"(?U)\n[（(][^）)]{1,30}[）)]\s*", "\n")
    return strip(F.regexp_replace(t, pack.gesture, ""))


def first_clause(text: Column) -> Column:
    """The 1 to 20 characters before the first clause mark, or empty."""
    return strip(F.regexp_extract(strip(text), r"(?U)^\s*([^，,：:。！？!?]{1,20})[，,：:。！？!?]", 1))


def has_ellipsis(text: Column, pack: Pack = ZH) -> Column:
    return any_of(*[text.contains(e) for e in pack.ellipses])


def stage_direction(text: Column, pack: Pack = ZH) -> Column:
    return text.rlike(pack.stage_direction)


def rhetorical_opening(text: Column, pack: Pack = ZH) -> Column:
    return text.rlike(pack.rhetorical_opening)


def confirmed(reply: Column, pack: Pack = ZH) -> Column:
    """A yes-or-no reply that says yes and not no."""
    return reply.contains(pack.yes) & ~reply.contains(pack.no)


def hard_rules(answer: Column, pack: Pack = ZH, require_script: bool = False) -> Column:
    """True for an answer in form. require_script: it must contain the pack's script (the evaluation's rule)."""
    narrated = (F.length(answer) > pack.narration_over) & ~answer.contains(pack.first_person) & answer.rlike(pack.third_person)
    bad = any_of(
        answer.rlike(pack.self_disclosure),
        answer.rlike(pack.refusal),
        answer.rlike(pack.closing_phrase),
        answer.rlike(pack.disclaimer),
        narrated,
        answer.rlike(pack.numbered_bold),
    )
    return ~bad & answer.rlike(pack.native_script) if require_script else ~bad


def quoted(text: Column) -> Column:
    """As a literal inside a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def bad_question(question: Column, name: Column, targets: Column, pack: Pack = ZH) -> Column:
    """A question that is not fit to be put to the named character. targets: names the character has relations with."""
    q = strip(question)
    clause = first_clause(q)
    targets = F.filter(or_empty(targets), truthy)
    others = F.exists(
        F.filter(targets, lambda t: F.length(t) >= 2),
        lambda t: F.regexp_like(q, F.concat(quoted(t), F.lit(r"[^，。！？\n]{0,6}" + pack.asked_of_others))),
    )
    return (
        F.when((F.length(q) < 6) | has_ellipsis(q, pack) | stage_direction(q, pack) | q.rlike(pack.as_model), True)
        .when((clause != "") & (F.contains(clause, name) | any_of(*[clause.contains(w) for w in pack.second_person])), False)
        .when((clause != "") & (F.array_contains(targets, clause) | clause.rlike(pack.title_words)), True)
        .otherwise(others)
    )


def bad_answer(text: Column, facts: Column | None = None, memories: Column | None = None, pack: Pack = ZH) -> Column:
    """An answer to generate again. With facts and memories, personal history must have support in them."""
    t = strip(text)
    bad = any_of(
        F.length(t) < 2,
        has_ellipsis(t, pack),
        stage_direction(t, pack),
        rhetorical_opening(t, pack),
        t.rlike(pack.as_model),
        t.rlike(pack.not_but),
        t.rlike(pack.closing_question),
    )
    if facts is None:
        return bad
    known = F.array_join(F.concat(or_empty(facts), or_empty(memories)), " ")
    supported = any_of(*[known.contains(w) for w in pack.personal_words])
    return bad | (any_of(*[t.rlike(p) for p in pack.autobiography]) & ~supported)


# --- instructions, bullets, model output


def section(text: Column, title: str, min_one: bool = False) -> Column:
    """The text under the first ### heading that contains title. min_one: at least one character, so that an empty
    section runs on into the next, and any deeper or equal heading ends it."""
    head = rf"###?\s*[^\n]*\Q{title}\E[^\n]*\n"
    if min_one:
        return strip(F.regexp_extract(text, rf"(?sU){head}([\s\S]+?)(?=\n###?|\z)", 1))
    # where the body ends is found as plain text: a pattern would look ahead at every character of it
    return strip(F.substring_index(F.regexp_extract(text, rf"(?sU){head}(.*)", 1), "\n###", 1))


def labelled_field(text: Column, label: str, default: str = "") -> Column:
    """What follows `label:` to the end of the line."""
    found = strip(F.regexp_extract(text, rf"(?Ud)\Q{label}\E[：:]\s*(.+)", 1))
    return F.when(found != "", found).otherwise(F.lit(default))


def bullets(text: Column, all_marks: bool = False, least: int = 1) -> Column:
    """Items of a bullet list. all_marks: every leading mark goes, not the first alone."""
    mark = r"(?U)^[-*•][-*•\s]*" if all_marks else r"(?U)^[-*•]\s*"
    items = F.transform(lines_of(text), lambda x: strip(F.regexp_replace(strip(x) if all_marks else x, mark, "")))
    return F.filter(items, lambda x: F.length(x) >= least)


def split_reasoning(raw: Column) -> Column:
    """(reasoning, response) of a model's output: what stands between think tags; after them, what follows the first
    full-width colon, else the first plain one. Without the tags the whole output is the response."""
    opened, closed = F.instr(raw, "<think>"), F.instr(raw, "</think>")
    inside = strip(F.substring(raw, opened + 7, F.greatest(closed - opened - 7, F.lit(0))))
    after = strip(F.substring(raw, closed + 8, F.length(raw)))
    wide, plain = F.instr(after, "："), F.instr(after, ":")
    colon = F.when(wide > 0, wide).otherwise(plain)
    reply = F.when(colon > 0, strip(F.substring(after, colon + 1, F.length(after)))).otherwise(after)
    both = (opened > 0) & (closed > 0)
    return F.struct(F.when(both, inside).otherwise(F.lit("")).alias("reasoning"), F.when(both, reply).otherwise(raw).alias("response"))


def response_or_raw(raw: Column) -> Column:
    """(reasoning, response), the stripped raw output where the response would be blank."""
    both = split_reasoning(raw)
    blank = strip(both["response"]) == ""
    return F.struct(F.when(blank, F.lit("")).otherwise(both["reasoning"]).alias("reasoning"), F.when(blank, strip(raw)).otherwise(both["response"]).alias("response"))


def recover_json(raw: Column) -> Column:
    """The JSON in a model's reply: a fenced block, else from the first brace or bracket on; null if neither parses."""
    fenced = F.regexp_extract(raw, r"(?sU)```json\s*(.*?)\s*```", 1)
    brace, bracket = F.nullif(F.instr(raw, "{"), F.lit(0)), F.nullif(F.instr(raw, "["), F.lit(0))
    first = F.least(brace, bracket)
    text = F.when(raw.rlike(r"(?sU)```json\s*(.*?)\s*```"), fenced).when(first.isNotNull(), F.substring(raw, first, F.length(raw))).otherwise(raw)
    # inside an array, so that what follows a value makes it malformed
    alone = F.concat(F.lit("["), text, F.lit("]"))
    return F.when(F.try_parse_json(alone).isNotNull() & (F.size(F.from_json(alone, "array<variant>")) == 1), text)


def string_items(json_array: Column) -> Column:
    """The strings of a JSON array, trimmed, blank ones and other kinds left out."""
    items = F.from_json(json_array, "array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: strip(F.try_variant_get(v, "$", "string")))
    return F.filter(or_empty(texts), truthy)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def md5_order(*keys: Column | str, seed: int = 42) -> Column:
    """A reproducible shuffle: sort by this."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
