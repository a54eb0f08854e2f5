"""URL filter: path-template trees per host, with policy rules first.

A rule (host and path) fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
Pages that a rule decides are the labels of the tree, which decides the others:

1. Every path is cut into segments; runs of digits generalise to one mark at once. Whatever lies deeper than DEPTH is one
   segment, whole. Pages collapse to distinct (host, template) with counts of pages, good and bad labels. All that
   follows is on this table, level by level as far as any path goes.
2. From the root down, a segment that fewer than SHARE of the pages below the same parent have is variable and becomes a
   wildcard.
3. From the leaves up, sibling branches (equal but for one segment) whose share of bad labels does not differ from the
   siblings' pooled share by more than Z standard errors merge into a wildcard. A branch without labels stays apart:
   nothing says that it is like one sibling rather than another.
4. Purity is smoothed towards the branch above: (good + WEIGHT * purity above) / (good + bad + WEIGHT), from one half above
   the host down to the template itself. So a branch without labels has its parent's purity, and one with few leans on
   it. A template is rejected where its purity is under PURITY.

A null url, or one without ://, has an empty host and path; no rule fits it, so that its host has no label and it is
allowed. page_id may be null or repeat. An empty table gives no rows. Columns besides page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import LOWER, UPPER, cut, table

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
DEPTH, SHARE, Z, WEIGHT, PURITY = 6, 0.02, 1.96, 4.0, 0.4
MAX_RULES = 500
ANY = "*"


def _rest(url: Column) -> Column:
    """What follows the first ://, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. Rules are a policy of at most MAX_RULES entries."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def template_of(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments, digits generalised, those past depth together as one."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"\d+", "#"), "/", depth + 1)


def _generalised(templates: DataFrame, depth: int) -> DataFrame:
    """Rare segments below a parent become wildcards, level by level."""
    for d in range(depth):
        parent = F.concat_ws("/", F.slice("template", 1, d)) if d else F.lit("")
        here = templates.withColumn("parent", parent).withColumn("segment", F.get("template", F.lit(d)))
        below = here.filter("segment is not null").groupBy("host", "parent", "segment").agg(F.sum("n").alias("n"))
        whole = below.groupBy("host", "parent").agg(F.sum("n").alias("whole"))
        rare = below.join(whole, ["host", "parent"]).filter(F.col("n") < SHARE * F.col("whole")).select("host", "parent", "segment", F.lit(True).alias("rare"))
        swapped = F.transform("template", lambda x, i: F.when(i == d, F.lit(ANY)).otherwise(x))  # noqa: B023
        templates = (
            here.join(rare, ["host", "parent", "segment"], "left")
            .select("host", "shape", F.when(F.col("rare"), swapped).otherwise(F.col("template")).alias("template"), "n", "good", "bad")
        )
        templates = cut(templates)
    return templates


def _merged(templates: DataFrame, depth: int) -> DataFrame:
    """Siblings of like purity become one branch, from the leaves up."""
    for d in range(depth - 1, -1, -1):
        swapped = F.transform("template", lambda x, i: F.when(i == d, F.lit(ANY)).otherwise(x))  # noqa: B023
        branch = templates.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).filter(F.size("template") > d).withColumn("family", swapped)
        family = branch.groupBy("host", "family").agg(F.sum("g").alias("fg"), F.sum("b").alias("fb"), F.sum((F.col("g") + F.col("b") > 0).cast("int")).alias("labelled"))
        n, pool = F.col("g") + F.col("b"), F.col("fb") / (F.col("fg") + F.col("fb"))
        alike = (n > 0) & (F.col("labelled") > 1) & (F.pow(F.col("b") / n - pool, F.lit(2)) * n <= Z * Z * pool * (1 - pool) + 1e-12)
        # guarded: labelled > 1 makes every divisor positive
        merge = branch.join(family, ["host", "family"]).filter("g + b > 0 and labelled > 1").filter(alike).select("host", "template", "family")
        templates = cut(templates.join(merge, ["host", "template"], "left").select("host", "shape", F.coalesce("family", "template").alias("template"), "n", "good", "bad"))
    return templates


def purities(final: DataFrame) -> DataFrame:
    """host, template, purity: good and bad labels of every branch down to the template, folded from the host on."""
    branches = F.transform(F.sequence(F.lit(0), F.size("template") + 1), lambda k: F.struct(k.alias("k"), F.slice(F.concat("template", F.array(F.lit("$"))), 1, k).alias("branch")))
    each = final.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select("*", F.inline(branches))
    total = each.groupBy("host", "branch").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    levels = each.select("host", "template", "k", "branch").join(total, ["host", "branch"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("k", "g", "b"))).alias("levels"))
    smoothed = F.aggregate("levels", F.lit(0.5), lambda above, x: (x["g"] + F.lit(WEIGHT) * above) / (x["g"] + x["b"] + F.lit(WEIGHT)))
    return levels.select("host", "template", smoothed.alias("purity"))


def template_verdicts(labelled: DataFrame) -> DataFrame:
    """labelled: host, shape (template as text), template, good, bad per page. Returns host, shape, template, purity, reject."""
    shapes = cut(labelled.groupBy("host", "shape").agg(F.first("template").alias("template"), F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    depth = shapes.agg(F.max(F.size("template"))).first()[0] or 0
    final = _merged(_generalised(shapes, depth), depth)
    joined = final.join(purities(final), ["host", "template"])
    return joined.select("host", "shape", F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "purity", (F.col("purity") < PURITY).alias("reject"))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages (page_id, url)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("parts", template_of(F.col("path")))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    seen = seen.withColumn("said", by_rule).withColumn("shape", F.concat_ws("/", "parts"))
    labels = [F.coalesce((F.col("said") == v).cast("long"), F.lit(0)).alias(k) for v, k in (("allow", "good"), ("block", "bad"))]
    trees = cut(template_verdicts(seen.select("host", "shape", F.col("parts").alias("template"), *labels)))
    # a row per (host, shape): Spark broadcasts it while small, and splits hot hosts otherwise
    own = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(trees, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle(rules: dict[str, str] = RULES) -> str:
    """The same in SQL, level by level."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, p = rule.split("/", 1)
        fits.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule}'")
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items())
    share, z, weight, purity = (f"CAST({x} AS DOUBLE)" for x in (SHARE, Z * Z, WEIGHT, PURITY))
    parts = "string_split(regexp_replace(regexp_replace(path, '^/', ''), '\\d+', '#', 'g'), '/')"
    swap = lambda d: f"list_concat(list_concat(tpl[1:{d}], ['*']), tpl[{d + 2}:])"
    ctes = [
        "u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS (SELECT *, CASE {' '.join(fits)} END AS rule, {parts} AS parts FROM h)",
        f"s AS (SELECT page_id, host, path, rule, CASE rule {said} END AS said, CASE WHEN len(parts) > {DEPTH} THEN list_concat(parts[1:{DEPTH}], [array_to_string(parts[{DEPTH + 1}:], '/')]) ELSE parts END AS tpl FROM r)",
        "g0 AS MATERIALIZED (SELECT host, array_to_string(tpl, '/') AS shape, any_value(tpl) AS tpl, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS good, count(*) FILTER (WHERE said = 'block') AS bad FROM s GROUP BY 1, 2)",
    ]
    for d in range(DEPTH + 1):
        parent = f"array_to_string(tpl[1:{d}], '/')" if d else "''"
        ctes += [
            f"k{d} AS (SELECT host, {parent} AS parent, tpl[{d + 1}] AS seg, sum(n) AS n FROM g{d} WHERE len(tpl) > {d} GROUP BY 1, 2, 3)",
            f"w{d} AS (SELECT host, parent, sum(n) AS whole FROM k{d} GROUP BY 1, 2)",
            f"x{d} AS (SELECT k.host, k.parent, k.seg FROM k{d} k JOIN w{d} w ON k.host = w.host AND k.parent = w.parent WHERE k.n < {share} * w.whole)",
            f"g{d + 1} AS MATERIALIZED (SELECT g.host, g.shape, CASE WHEN x.seg IS NULL THEN g.tpl ELSE {swap(d).replace('tpl', 'g.tpl')} END AS tpl, g.n, g.good, g.bad "
            f"FROM g{d} g LEFT JOIN x{d} x ON x.host = g.host AND x.parent = {parent.replace('tpl', 'g.tpl')} AND x.seg = g.tpl[{d + 1}] AND len(g.tpl) > {d})",
        ]
    last = f"g{DEPTH + 1}"
    for d in range(DEPTH, -1, -1):
        ctes += [
            f"b{d} AS (SELECT host, tpl, {swap(d)} AS family, sum(good) AS g, sum(bad) AS b FROM {last} WHERE len(tpl) > {d} GROUP BY host, tpl)",
            f"f{d} AS (SELECT host, family, sum(g) AS fg, sum(b) AS fb, count(*) FILTER (WHERE g + b > 0) AS labelled FROM b{d} GROUP BY host, family)",
            f"j{d} AS (SELECT b.host, b.tpl, b.family, b.g + b.b AS n, b.b / CAST(nullif(b.g + b.b, 0) AS DOUBLE) AS own, f.fb / CAST(nullif(f.fg + f.fb, 0) AS DOUBLE) AS pool, f.labelled "
            f"FROM b{d} b JOIN f{d} f ON b.host = f.host AND b.family = f.family)",
            f"m{d} AS (SELECT host, tpl, family FROM j{d} WHERE n > 0 AND labelled > 1 AND (own - pool) * (own - pool) * n <= {z} * pool * (1 - pool) + 1e-12)",
            f"t{d} AS MATERIALIZED (SELECT g.host, g.shape, coalesce(m.family, g.tpl) AS tpl, g.n, g.good, g.bad FROM {last} g LEFT JOIN m{d} m ON m.host = g.host AND m.tpl = g.tpl)",
        ]
        last = f"t{d}"
    ctes += [
        f"e AS (SELECT host, tpl, k, list_concat(tpl, ['$'])[1:k] AS branch, good, bad FROM (SELECT host, tpl, sum(good) AS good, sum(bad) AS bad, unnest(range(len(tpl) + 2)) AS k FROM {last} GROUP BY host, tpl))",
        "v AS (SELECT host, branch, CAST(sum(good) AS DOUBLE) AS g, CAST(sum(bad) AS DOUBLE) AS b FROM e GROUP BY host, branch)",
        "w AS MATERIALIZED (SELECT e.host, e.tpl, e.k, v.g, v.b FROM e JOIN v ON v.host = e.host AND v.branch = e.branch)",
        f"d AS (SELECT host, tpl, k, (g + {weight} * 0.5) / (g + b + {weight}) AS purity FROM w WHERE k = 0 "
        f"UNION ALL SELECT w.host, w.tpl, w.k, (w.g + {weight} * d.purity) / (w.g + w.b + {weight}) FROM d JOIN w ON w.host = d.host AND w.tpl = d.tpl AND w.k = d.k + 1)",
        "p AS (SELECT host, tpl, purity FROM d WHERE k = len(tpl) + 1)",
        f"q AS (SELECT t.host, t.shape, '/' || array_to_string(t.tpl, '/') AS template, p.purity FROM {last} t JOIN p ON p.host = t.host AND p.tpl = t.tpl)",
    ]
    return (
        f"WITH RECURSIVE {', '.join(ctes)} SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.said, CASE WHEN q.purity < {purity} THEN 'block' ELSE 'allow' END) AS verdict, q.template, q.purity "
        "FROM s JOIN q ON q.host = s.host AND q.shape = array_to_string(s.tpl, '/')"
    )


ORACLE = _oracle()
