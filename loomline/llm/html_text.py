"""HTML extraction by consensus host paths.

Each page is parsed into containers, named by their path of tags and classes with digits generalised. A container's score
is the text in it that is prose, less the text in it that belongs to boilerplate (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments, and lists that are all links); article and main count for more. A page votes
for the path of its best container; Spark sums the votes per host, and every page of the host is extracted again from
the containers on the winning path. A page without any of these falls back to its own best container.

A tag, a role, or a class or id of which every word speaks of boilerplate or says nothing (ad, cookie-notice, sidebar-left,
comment-list) makes a container boilerplate. One that has such a word among others (notice-of-award, share-price) only
counts less when containers are scored; its text stays.

Text: character references decoded, white space inside a block one space, trimmed, blocks in page order joined by one
newline; nothing else is dropped and nothing is capped. A container without prose gives an empty text.

Null html counts as empty, a null url belongs to the empty host; page_id may be null or repeat. Markup may be cut off or
wrongly nested anywhere: what is left open ends with its parent, a script too, and svg or math where a block begins. Time
and memory grow in proportion to a page's length, however deep its lists nest. Of paths with as many votes the one of
higher score wins, then the first by name. Empty tables give no rows. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import cut, small_batches, table
from loomline.llm.url_filter import host_of

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[/a-zA-Z][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is not markup; an open one ends with the element that it stands in.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What these hold is markup that no reader sees.
_UNSEEN = frozenset("template noscript svg math".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_JUNK_TAGS = frozenset("nav header footer aside form button select dialog menu object canvas audio video template noscript svg math".split())
#: Words of a class or id that speak of boilerplate, and words that say nothing of what a container holds.
_JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond replies notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer hidden skip".split()
)
_MUTE_WORDS = frozenset(
    "a area bar block box bottom btn button center col column container content desktop div el element fixed float frame group holder id inner item items js large left link links list main mobile module new outer page panel post posts primary region right row section secondary site slot small space sticky top unit wrap wrapper zone".split()
)
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_MAIN = frozenset(("article", "main"))
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


_HTML = _ENDS_P | frozenset("html body li td th tr dt dd".split())
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_ANY_END = re.compile(r"</([a-zA-Z][^\s/>]*)")


@dataclass
class Node:
    name: str
    parent: int
    path: str
    junk: bool
    marked: bool
    #: Some word of its class or id speaks of boilerplate, but not all of it does.
    doubtful: bool = False
    main: bool = False
    #: (place in the page, text, characters of it inside links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _says(token: str) -> int:
    """Of one class or id: 2 if it speaks of boilerplate alone, 1 if among other things, 0 if not."""
    words = [w.lower() for w in _WORD.findall(token)]
    if not any(w in _JUNK_WORDS for w in words):
        return 0
    return 2 if all(w in _JUNK_WORDS or w in _MUTE_WORDS for w in words) else 1


def _attributes(rest: str) -> tuple[list[str], int]:
    """Classes with digits generalised, and how far class, id or role speak of boilerplate."""
    classes, junk = [], 0
    for key, value in _ATTR.findall(rest):
        value = value.strip("\"'")
        if key.lower() == "role":
            junk = max(junk, 2 * (value.strip().lower() in _JUNK_ROLES))
            continue
        junk = max([junk, *map(_says, value.split())])
        if key.lower() == "class":
            classes = [re.sub(r"\d+", "#", c) for c in value.split()]
    return classes, junk


def _path(above: str, own: str) -> str:
    """A container's path; a long one is named by a digest, so that paths of deep pages stay short."""
    return f"{above if len(above) < 1000 else '~' + hashlib.md5(above.encode('utf-8', 'replace')).hexdigest()}>{own}"


def parse(page: str) -> list[Node]:
    """The containers of a page in page order; the first is the page itself."""
    nodes = [Node("", -1, "", False, False)]
    stack: list[tuple[str, int]] = [("", 0)]
    tops = [0]  # the containers in the stack
    opened: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # inline elements open within each of them
    buffer: list[str] = []
    links = in_link = place = 0

    def flush() -> None:
        nonlocal links, place
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                nodes[tops[-1]].blocks.append((place, text, min(links, len(text))))
                place += 1
            buffer.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal in_link
        if any(n >= 0 for _, n in stack[depth:]):
            flush()
        for name, n in reversed(stack[depth:]):
            opened[name] -= 1
            in_link -= name == "a"
            if n >= 0:
                tops.pop()
                inline.pop()
            else:
                inline[-1][name] -= 1
        del stack[depth:]

    def text(t: str) -> None:
        nonlocal links
        if t:
            buffer.append(t)
            if in_link:
                links += len(t)

    missing: set[str] = set()

    def skip(name: str, at: int) -> int:
        """Where what a raw element holds ends: after its end tag; without one, before that of an open element."""
        if name not in missing:
            if end := _END_OF[name].search(page, at):
                return end.end()
            missing.add(name)  # none from here on
        for end in _ANY_END.finditer(page, at):
            if opened[end[1].lower()] > 0:
                return end.start()
        return len(page)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            # an inline element ends within its container only; what isn't open needs no search
            if opened[name] and (name not in _INLINE or inline[-1][name]):
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name))
            continue
        rest = m["rest"] if m["name"] else m["rest2"]
        if name in _RAW:
            at = skip(name, at)
            continue
        if name in _INLINE:
            if name == "br" or name == "wbr" or name == "img":
                if name != "wbr":
                    text(" ")
                continue
            stack.append((name, -1))
            opened[name] += 1
            inline[-1][name] += 1
            in_link += name == "a"
            continue
        if name in _ENDS_P and (opened["svg"] or opened["math"]):
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in ("svg", "math"):
                    close(d)
                    break
                if stack[d][0] in _HTML:
                    break
        if name in _ENDS_P and nodes[tops[-1]].name == "p":
            close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "p"))
        if name in _CLOSES:
            ended, bound = _CLOSES[name]
            for d in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ended) else ():
                if stack[d][0] in bound:
                    break
                if stack[d][0] in ended:
                    close(d)
                    if name != "tr":
                        break
        flush()
        if name in _VOID:
            continue
        if rest.endswith("/") and (name in ("svg", "math") or opened["svg"] or opened["math"]):
            continue
        classes, junk = _attributes(rest) if rest else ([], 0)
        parent = tops[-1]
        nodes.append(Node(name, parent, _path(nodes[parent].path, ".".join([name, *classes])), False, junk == 2, junk == 1))
        stack.append((name, len(nodes) - 1))
        opened[name] += 1
        tops.append(len(nodes) - 1)
        inline.append(Counter())
    close(1)
    flush()
    _mark(nodes)
    return nodes


def _mark(nodes: list[Node]) -> None:
    for n in reversed(nodes[1:]):
        p = nodes[n.parent]
        p.main |= n.main or n.name in _MAIN
    for n in nodes[1:]:
        boilerplate = (n.marked or n.name in _JUNK_TAGS) and not n.main and n.name not in _MAIN and n.name not in ("html", "body")
        n.junk = nodes[n.parent].junk or boilerplate
    # lists that are all links are menus; sums of what stands below, from the leaves up
    blocks, chars, linked = ([0] * len(nodes) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        blocks[i] += len(n.blocks)
        chars[i] += sum(len(t) for _, t, _ in n.blocks)
        linked[i] += sum(x for _, _, x in n.blocks)
        if i:
            for of in (blocks, chars, linked):
                of[n.parent] += of[i]
    for i, n in enumerate(nodes):
        if i:
            menu = n.name in ("ul", "ol") and blocks[i] > 1 and chars[i] and linked[i] >= 0.9 * chars[i]
            n.junk = n.junk or nodes[n.parent].junk or bool(menu)


def scores(nodes: list[Node]) -> list[float]:
    good, bad = [0.0] * len(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        for _, t, linked in n.blocks:
            if n.junk:
                bad[i] += len(t)
            else:
                good[i] += len(t) - linked
                bad[i] += linked
        if i:
            good[n.parent] += good[i]
            bad[n.parent] += bad[i]
    # a container that may be boilerplate by its name has to be twice as good as another
    return [0.0 if n.junk else (g - b) * (1.5 if n.name in _MAIN else 0.5 if n.doubtful else 1.0) for n, g, b in zip(nodes, good, bad)]


def best(nodes: list[Node]) -> tuple[str, float]:
    """Path and score of the best container, the innermost of equals."""
    found = scores(nodes)
    at = max(range(len(nodes)), key=lambda i: (found[i], i if nodes[i].name not in ("p", "li", "h1") else -1))
    while at and nodes[at].name in ("p", "b", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "pre", "blockquote"):
        at = nodes[at].parent
    return nodes[at].path, found[at]


def text_at(nodes: list[Node], path: str) -> str | None:
    """The text in the containers on a path, or None where the page has none."""
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = (n.path == path and not n.junk) or (i > 0 and inside[n.parent])
    if not any(inside):
        return None
    blocks = sorted((b[0], b[1]) for n, i in zip(nodes, inside) if i and not n.junk for b in n.blocks)
    return "\n".join(t for _, t in blocks)


def extract(page: str, path: str | None) -> str:
    nodes = parse(page)
    found = text_at(nodes, path) if path is not None else None
    if found is None:
        found = text_at(nodes, best(nodes)[0])
    return found or ""


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))


def votes(pages: DataFrame) -> DataFrame:
    """host, path: the path that most pages of a host name (of equals the one of higher score, then the first by name)."""
    small_batches(pages.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best(parse(h)) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["host", "path", "score"])

    counted = (
        _pages(pages)
        .select("host", "html")
        .mapInArrow(of, "host string, path string, score double")
        .filter("score > 0")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("score")).alias("score"))
    )
    rank = F.struct(-F.col("n"), -F.col("score"), F.col("path"))
    return cut(counted.groupBy("host").agg(F.min_by("path", rank).alias("path")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's) for each row of pages."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    winners = votes(pages)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(3)],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    # a row per host: Spark broadcasts it while small, and splits hosts of many pages otherwise
    joined = _pages(pages).join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(of, f"page_id {kind}, url string, text string, n_chars long, path string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
