"""HTML extraction, URL filter, language ID, decontamination, packing, preference formatting."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import decontamination, html_text, language, packing, preference, url_filter

# --- html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="sidebar-2"><p>side text</p></div>
<div class="notice">cookies!</div><article class="post-17"><h1>Title &amp; more</h1><!-- ad --><div class=ad>buy</div>
<p><b>One&nbsp; two<br>three<p>Second <a href=x>link</a> a &lt; b &copy;&#x41;</p><form><input><p>form text</p></form>
<ul><li>x item</li><li>y item</li></ul><pre>a
  b</pre><table><tr><td>c1<td>c2</table><aside>aside</aside></article>
<section id="comments"><p>first!</p></section><footer>&copy; me</footer></body></html>"""


def test_extract_page():
    nodes = html_text.parse(PAGE)
    path, score = html_text.best(nodes)
    assert path == ">html>body>article.post-#" and score > 0
    want = "Title & more\nOne two three\nSecond link a < b ©A\nx item\ny item\na b\nc1\nc2"
    assert html_text.extract(PAGE, path) == want == html_text.extract(PAGE, ">no>such") == html_text.extract(PAGE, None)


@pytest.mark.parametrize("page,text", [("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ("<div><p>cut off te", "cut off te"), ("<article>x</article", "x"), ("<p>1 < 2 <b", "1 < 2"), ("<!-- open", ""), ("<nav>menu</nav>", ""), ("<article><p>a</i></p></div>b</article>", "a\nb"), ('<p title="a>b">c</p>', "c"), ("<P CLASS='x'>UP</P>", "UP"), ("<script>never closed", "")])
def test_odd_markup(page, text):
    assert html_text.extract(page, None) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>before</p><svg><path d=1/><p>after body", "before\nafter body"),
        ("<div><p>a</p><svg><g><path d=1></div><p>b", "a\nb"),
        ("<article><p>a</p><template><p>no</article><p>b</p>", "a"),
        ("<body><article><p>long enough to win</p><iframe src=x></article></body>", "long enough to win"),
        ("<body><article><p>long enough to win</p><textarea>typed</article><p>x</body>", "long enough to win"),
        ("<body><div><p>one<noscript>no</noscript></p><p>two</p></div></body>", "one\ntwo"),
        ("<head><script>never closed </head><body><p>text</p>", "text"),
        ("<article><p>Some article.</p><div class='notice-of-award'><p>Important sentence.</p></div><p class=share-price>3.14</p><ul class=menu-of-the-day><li>soup</li></ul></article>", "Some article.\nImportant sentence.\n3.14\nsoup"),
        ("<article><p>Some article.</p><div class='ad slot-3'>buy</div><div id=cookie-notice-2>ok?</div><div class='related posts'>more</div><section class=comment-list>first!</section></article>", "Some article."),
    ],
)
def test_what_is_dropped_and_what_is_not(page, text):
    assert html_text.extract(page, None) == text


@pytest.mark.parametrize("part", ["<ul><li>x ", "<b>", "<div class=a>t", "<textarea>", "<svg>", "<p><a href=x>y", "</section><div>", "<b><p>x</p>", "<b>x</i>"])
def test_time_is_linear(part):
    """300 KB of any of these take seconds."""
    import time

    began = time.time()
    html_text.extract(part * (300_000 // len(part)), None)
    assert time.time() - began < 10


def test_votes_match_brute_force(spark):
    rng = random.Random(4)
    shapes = ["<div class=main-{0}><p>{1}</p></div>", "<article><p>{1}</p></article><div class=x><p>{1}</p></div>", "<section class=b{0}><p>{1}</p></section>", "<nav><p>{1}</p></nav>"]
    pages = [(i, f"http://{rng.choice('abc')}.org/{i}", "<body>" + rng.choice(shapes).format(i, "word " * rng.randint(1, 9)) + "</body>") for i in range(150)]
    pages += [(900, "http://tie.org/1", "<body><div class=q><p>same text</p></div></body>"), (901, "http://tie.org/2", "<body><div class=p><p>same text</p></div></body>")]
    want = {}
    for _, url, page in pages:
        path, score = html_text.best(html_text.parse(page))
        if score > 0:
            v = want.setdefault(url.split("/")[2], {}).setdefault(path, [0, 0])
            v[0] += 1
            v[1] += int(score // 1)
    best = {h: min(v, key=lambda p: (-v[p][0], -v[p][1], p)) for h, v in want.items()}
    got = {r.host: r.path for r in html_text.votes(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == best and got["tie.org"] == ">body>div.p"


def test_host_vote_wins_over_a_page_s_own_best(spark):
    usual = "<body><div class=main><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    pages = [(i, f"http://H.example/{i}", usual.format("long words " * 30, "short")) for i in range(9)] + [(99, "http://h.example/x", usual.format("tiny", "long words " * 40))]
    rows = spark.createDataFrame([(*p, "junk") for p in pages] + [(None, None, None, "j"), (5, "no host", "<p>z", "j")], "page_id long, url string, html string, path string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_pages(rows).collect()}
    assert len(got) == 12
    assert got[None, None] == ("", 0) and got[5, "no host"] == ("z", 1)
    assert got[99, "http://h.example/x"][0] in ("tiny", "tiny\n" + ("long words " * 40).strip())
    assert html_text.extract_pages(rows.limit(0)).count() == 0


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>word {i} &amp;</p>" for i in range(20_000)) + "</article>"
    assert html_text.extract(page, None).count("\n") == 19_999


# --- urls


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://x.net/fr/9#top", "x.net", "/fr/9", "net/fr/", "block"),
        ("https://x.net/FR/9", "x.net", "/FR/9", None, "allow"),
        ("ftp://example.com", "example.com", "", None, "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://É.com/É", "É.com", "/É", "com/", "allow"),
        (None, "", "", None, "allow"),
        ("http://x.org?q=/a", "x.org", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash", 3)], "page_id long, url string, host string, n int")
    r = url_filter.judge_urls(pages).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def brute_tree(pages, rules=url_filter.RULES):
    """Page by page and level by level, in plain Python."""
    seen = []
    for url in pages:
        rest = url.split("://", 1)[1]
        host = rest.split("/")[0]
        path = rest[len(host) :]
        fits = [r for r in rules if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith("/" + p))(*r.split("/", 1))]
        rule = max(fits, key=len) if fits else None
        import re

        seg = re.sub(r"\d+", "#", path.removeprefix("/")).split("/")
        seg = [*seg[:6], "/".join(seg[6:])] if len(seg) > 6 else seg
        seen.append([host, seg, rules.get(rule)])
    rows = [[h, list(s), v] for h, s, v in seen]
    for d in range(7):
        kids, all_ = {}, {}
        for h, s, _ in rows:
            if len(s) > d:
                k = (h, "/".join(s[:d]))
                kids[k, s[d]] = kids.get((k, s[d]), 0) + 1
                all_[k] = all_.get(k, 0) + 1
        rare = {(k, x) for (k, x), n in kids.items() if n < url_filter.SHARE * all_[k]}
        for r in rows:
            if len(r[1]) > d and ((r[0], "/".join(r[1][:d])), r[1][d]) in rare:
                r[1] = [*r[1][:d], "*", *r[1][d + 1 :]]
    for d in range(6, -1, -1):
        branch = {}
        for h, s, v in rows:
            b = branch.setdefault((h, tuple(s)), [0, 0])
            b[0] += v == "allow"
            b[1] += v == "block"
        fam = {}
        for (h, s), (g, b) in branch.items():
            if len(s) > d:
                f = fam.setdefault((h, (*s[:d], "*", *s[d + 1 :])), [0, 0, 0])
                f[0] += g
                f[1] += b
                f[2] += g + b > 0
        for r in rows:
            s = tuple(r[1])
            if len(s) > d:
                key = (r[0], (*s[:d], "*", *s[d + 1 :]))
                (g, b), (fg, fb, k) = branch[r[0], s], fam[key]
                n = g + b
                if n and k > 1:
                    pool = fb / (fg + fb)
                    if (b / n - pool) ** 2 * n <= url_filter.Z**2 * pool * (1 - pool) + 1e-12:
                        r[1] = list(key[1])
    total = {}
    for h, s, v in rows:
        full = (*s, "$")
        for k in range(len(full) + 1):
            t = total.setdefault((h, full[:k]), [0, 0])
            t[0] += v == "allow"
            t[1] += v == "block"
    out = []
    for (h, s, v) in rows:
        purity, full = 0.5, (*s, "$")
        for k in range(len(full) + 1):
            g, b = total[h, full[:k]]
            purity = (g + url_filter.WEIGHT * purity) / (g + b + url_filter.WEIGHT)
        out.append((v or ("block" if purity < url_filter.PURITY else "allow"), "/" + "/".join(s)))
    return out


def test_tree_matches_brute_force(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['a.example.com', 'b.net', 'www.example.com', 'c.org'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.choice(['x', 'y', 'z', str(rng.randint(1, 99))])}{rng.choice(['', '/', '/p/q/r/s', '/p/q/r/s/t/u/v/w'])}" for _ in range(400)]
    urls += [f"http://b.net/{w}/1" for w in "abcdefghijklmnopqrst"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.template) for r in url_filter.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(urls))] == brute_tree(urls)


def test_tree_rejects_by_purity(spark):
    """A rare page of a template whose labelled pages are bad goes with them."""
    rows = [("h", "a/#", ["a", "#"], 0, 1)] * 20 + [("h", "a/#", ["a", "#"], 0, 0)] * 3 + [("h", "b/#", ["b", "#"], 1, 0)] * 20 + [("h", "c/#", ["c", "#"], 0, 0)]
    got = {r.shape: r.reject for r in url_filter.template_verdicts(spark.createDataFrame(rows, "host string, shape string, template array<string>, good long, bad long")).collect()}
    assert got == {"a/#": True, "b/#": False, "c/#": False}


def test_branches_without_labels_take_after_what_stands_above(spark):
    """On a host of which the rules block every section that they know, an unknown section goes too; with as many good
    pages beside them it stays. A path's depth doesn't change what it says."""
    urls = [f"http://x.net/{lang}/{i}" for lang in ("es", "fr") for i in range(9)] + ["http://x.net/de/1", "http://other.org/de/1"]
    urls += [f"http://y.com/a/b/c/d/e/f/g/{w}" for w in "xy"]
    got = [r for r in sorted(url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect(), key=lambda r: r.page_id)]
    assert [(r.host, r.verdict, r.rule) for r in got[18:20]] == [("x.net", "block", None), ("other.org", "allow", None)]
    assert got[18].purity < url_filter.PURITY and got[19].purity == 0.5
    mixed = urls + [f"http://www.example.com/en/{i}" for i in range(9)] + [f"http://www.example.com/de/{i}" for i in range(3)]
    rules = {"example.com/en/": "allow", "www.example.com/xx/": "block"}
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(mixed)), "page_id long, url string"), rules).filter("host = 'www.example.com'").collect()} == {"allow"}


def test_templates_keep_whole_paths(spark):
    got = spark.createDataFrame([("/a/b/c/d/e/f/x/1",), ("/a/b/c/d/e/f/y/2",), ("",)], "p string").select(url_filter.template_of(F.col("p")).alias("t")).collect()
    assert [r.t for r in got] == [["a", "b", "c", "d", "e", "f", "x/#"], ["a", "b", "c", "d", "e", "f", "y/#"], [""]]


def test_urls_empty(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError):
        url_filter.rule_of(F.lit(""), F.lit(""), {f"{i}/": "allow" for i in range(501)})


# --- language


def test_code_matrix():
    code = language.code_matrix(4)
    assert code.shape == (4, 7) and len({tuple(c) for c in code.T}) == 7
    assert min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) == 4
    assert language.code_matrix(1).shape == (1, 0) and language.code_matrix(20).shape[0] == 20


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").select("*", language.held_out().alias("h")).collect()
    test = [r for r in got if r.h]
    assert len(test) > 30 and sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "the thing is that the nation of the"), (4, "the thing is that the nation of the"), (None, "le de la que"), (5, "é"), (6, "the of and in " * 50_000)], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    rows = language.predict(odd, model).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and by[1].score == 0 and by[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 1


def test_training_ignores_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert language.fit(spoiled).langs == language.fit(docs).langs
    assert np.array_equal(language.fit(spoiled).odds, language.fit(docs).odds)


def brute_language(text, model):
    """Trigram by trigram, column by column, in plain Python."""
    import math

    data = b"  " + text.encode() + b" "
    fold = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in data]
    classes = [(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 17 for a, b, c in zip(fold, fold[1:], fold[2:])]
    margins = [sum(float(odds[k]) for k in classes) / len(classes) for odds in model.odds]
    losses = [
        len(model.langs) * sum(float(w) * math.log1p(math.exp(-language.SHARPNESS * m * int(bit))) for m, bit, w in zip(margins, code, weights))
        for code, weights in zip(model.code, model.weights)
    ]
    shares = [math.exp(min(losses) - x) for x in losses]
    return model.langs[losses.index(min(losses))], max(shares) / sum(shares)


def test_decoding_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got[:80]:
        lang, score = brute_language(texts[r.doc_id], model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_a_rare_language_is_learned(spark):
    """Five rows in twelve thousand, with a bound of sixty rows."""
    rows = [(i, f"the nation of the thing number {i}", "en") for i in range(6000)] + [(i, f"der wagen und das haus nummer {i}", "de") for i in range(6000, 12_000)] + [(i, "kissa ja koira ovat ystävät", "fi") for i in range(20_000, 20_008)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, 60)
    assert model.langs == ["de", "en", "fi"]
    probe = spark.createDataFrame([(1, "koira ja kissa"), (2, "das haus"), (3, "the thing")], "doc_id long, text string")
    assert [r.lang_pred for r in sorted(language.predict(probe, model).collect())] == ["fi", "de", "en"]


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.predict(none, language.fit(none)).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "abc def", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(one, language.fit(one)).collect()} == {"en"}
    assert language.predict(one.limit(0), language.fit(one)).count() == 0


# --- decontamination


def brute_alignment(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, now[j] - 1))
            best = max(best, now[-1])
        prev = now
    return best


def test_smith_waterman_matches_brute_force():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 5, (60, 9)).astype(np.uint64) + 2, rng.integers(0, 5, (60, 14)).astype(np.uint64) + 2
    assert decontamination.smith_waterman(a, b).tolist() == [brute_alignment(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_leaks_and_clean(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(rng.randint(15, 50)) for _ in range(20)] + [["zq"], ["zx", "zy"]]
    bench = spark.createDataFrame([(i, " ".join(w), "c") for i, w in enumerate(items)] + [(90, None, "c"), (91, "!!", "c")], "item_id long, text string, doc_id string")
    docs, want = [], set()
    for i in range(120):
        w = text(150)
        if i % 4 == 0:
            k = rng.randrange(20)
            leak = list(items[k])
            if i % 8 == 0:  # edited: every seventh word another, one dropped
                leak = [word() if j % 7 == 3 else x for j, x in enumerate(leak)]
                del leak[5]
            w[60:60] = [x.upper() + "," for x in leak]
            want.add((i, k))
        if i % 50 == 1:
            w[3:3] = ["zx", "zy"]
            want.add((i, 21))
        docs.append((i, " ".join(w), 1.0))
    docs += [(900, None, 1.0), (901, "", 1.0), (902, "zq", 1.0), (None, "zq", 1.0), (0, docs[0][1], 1.0)]
    want |= {(902, 20), (None, 20)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    got = decontamination.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want) + sum(d == 0 for d, _ in want)
    assert decontamination.contaminated(frame.limit(0), bench).count() == 0
    assert decontamination.contaminated(frame, bench.limit(0)).count() == 0


def test_contaminated_matches_brute_force(spark):
    """Every document aligned with every item, over whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = decontamination.Items.of(*map(list, zip(*[(r.item_id, r.text) for r in bench.collect()])))
    want = set()
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode() + b" ", np.uint8)
        words, _ = decontamination.word_hashes(data, np.array([0, len(data)]))
        for k, own in enumerate(items.words):
            shared = len(np.intersect1d(own, words))
            if 2 * shared >= len(own) and len(own):  # fewer shared words can't score so much
                score = decontamination.smith_waterman(own[None], words[None])[0] / (2 * len(own))
                if score >= decontamination.MIN_SCORE:
                    want.add((r.doc_id, items.ids[k]))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert len(want) > 20 and got == want


@pytest.mark.parametrize("copies", [1, 4, 5, 50, 1000])
def test_edited_copies_are_found_however_many(spark, copies):
    rng = random.Random(copies)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    item = [word() for _ in range(60)]
    leak = " ".join("other" + str(j) if j % 6 == 5 else w for j, w in enumerate(item))
    docs = [(i, " ".join(word() for _ in range(20)) + " " + leak + " " + word()) for i in range(copies)] + [(10_000 + i, " ".join(word() for _ in range(80))) for i in range(200)]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(copies))


def test_stages_judge_each_row_by_itself(spark, monkeypatch):
    """A clean row stays whatever another row of its doc_id, or of none, holds."""
    item = "seven words that stand in a benchmark item"
    rows = [(1, f"x {item} y", 5), (1, "a clean text", 6), (None, item, 7), (None, "clean as well", 8), (5, "clean", 9), (5, "1234 567", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    monkeypatch.setattr(decontamination, "table", lambda *_: spark.createDataFrame([(3, item, 1)], "item_id long, text string, score int"))
    assert sorted(r.score for r in decontamination.stage(spark, docs, "").collect()) == [6, 8, 9, 10]
    labelled = docs.withColumn("lang", F.lit("en"))
    left = language.stage(spark, labelled, "")
    assert left.columns == labelled.columns and sorted(r.score for r in left.collect()) == [5, 6, 7, 8, 9]


def test_item_in_a_third_of_the_corpus_still_has_seeds(spark):
    item = "one rare passage that somebody copied into very many documents indeed"
    docs = spark.createDataFrame([(i, f"w{i} v{i} " + (item if i % 3 == 0 else "nothing here") + f" u{i}") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(docs, bench).collect()} == set(range(0, 300, 3))


@pytest.mark.parametrize("copies", [10, 300])
def test_excerpts_and_edited_copies_in_many_documents(spark, copies):
    """Seeds that the other seeds of their item make look common still lead to every copy."""
    rng = random.Random(copies)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(60) for _ in range(3)]
    edited = [word() if j % 5 == 2 else x for j, x in enumerate(items[1])]
    leaks = [(0, items[0][:40])] * copies + [(1, edited)] * copies + [(2, items[2][:40])] * copies + [(2, items[2])]
    docs = [(i, " ".join(text(30) + leak + text(30))) for i, (_, leak) in enumerate(leaks)] + [(10_000 + i, " ".join(text(90))) for i in range(50)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, k) for i, (k, _) in enumerate(leaks)]


def test_bound_is_never_below_the_alignment():
    rng = np.random.default_rng(12)
    words = rng.integers(0, 9, 400).astype(np.uint64) + 2
    items = decontamination.Items([0], [rng.integers(0, 9, 12).astype(np.uint64) + 2], *[np.zeros(0, np.int64)] * 5)
    lo = rng.integers(0, 370, 50)
    bound = decontamination.most(items, np.zeros(50, np.int64), words, lo, lo + 30)
    assert all(b >= brute_alignment(items.words[0].tolist(), words[i : i + 30].tolist()) for b, i in zip(bound, lo))


def test_benchmark_in_blocks(spark):
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(9)], "item_id long, text string")
    assert sum(len(b.ids) for b in decontamination.item_blocks(bench, 60)) == 9
    assert len(list(decontamination.item_blocks(bench, 60))) > 3


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = ["", "H̱ İ don't, İx ΣΑΣ.", "a\x01b it's, 3. x., é, <|endoftext|>, a\x1cb \x01", ",", ", , ...", "A.B, C.", "Ḱ,", "a\u00a0b\u3000c\u2028d", "x" * 3000, "the of and " * 9000]


def test_ids_are_the_tokenizer_s(tokenizer):
    words = packing.Words(packing.vocabulary_path())
    for _ in range(2):  # the second time from memory
        got = words.encode([t.encode() for t in ODD])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]


def test_plain_words_go_to_the_merges_alone(tokenizer):
    """Letters, digits and punctuation in any order, without the whole tokenizer; other words with it."""
    rng = random.Random(17)
    alphabet = ["the", "reathash", "größe", "señor", "x", "q", "7", "1984", ".", ",", "***", "&&&", "</", "w>", "_", "#", "(", ")", "~", "ÿ", "ß"]
    plain = ["".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(3000)] + ["</w>", "69.215.74.137", "Reathash&&&,", "THE"]
    odd = ["don't", "l'eau", "É", "÷2", "3×4", "e\u0301a", "ǅ", "²", "日本語", "a\x01b", "\u0301", "İx", "µ", "<|endoftext|>,", "a<|endoftext|>b", "<|EndOfText|>"]
    words = packing.Words(packing.vocabulary_path())
    whole, words.tokenizer = words.tokenizer, None
    texts = [" ".join(plain[i : i + 50]) for i in range(0, len(plain), 50)] * 2
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode([t.encode() for t in texts]) == want
    words.tokenizer = whole
    texts = [" ".join(rng.sample(odd, 5) + rng.sample(plain, 5)) for _ in range(200)]
    assert words.encode([t.encode() for t in texts]) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_beyond_those_remembered_are_encoded_each_time(tokenizer):
    words = packing.Words(packing.vocabulary_path(), remembered=20)
    texts = [" ".join(f"{a}{b}ing, don't" for b in ("load", "fold", "weav")) for a in ("un", "re", "over", "out", "mis")]
    for _ in range(2):
        got = [x for t in texts for x in words.encode([t.encode()])]
        assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert 20 <= len(words.known) < 40


def test_packing_is_whole_and_gapless(docs_of, tokenizer):
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "dup"), (51, "dup"), (None, "n")] + [(100 + i, "word " * rng.randint(1, 3000)) for i in range(60)]
    got = packing.packed(docs_of(rows)).collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            p = ids[s : s + 2048]
            want.append((i, k, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs_of([]).limit(0)).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps[gaps.index(min(fit))] -= n
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_sweep_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 20), 7]) for _ in range(rng.randint(0, 300))]
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    bins, ranks = {}, {}
    for length, low, high, first, each, begin in packing.sweep(counts, 64):
        for r in range(low, high):
            k = r - low
            bins.setdefault(first + k // each, []).append((begin + k % each * length, length))
            ranks.setdefault(length, []).append(r)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(n for _, n in p) for p in bins.values()) == best_fit_decreasing(lengths, 64)


def test_supersteps_read_what_is_placed_in_one_scan(spark):
    """Each superstep adds a table; reading them costs one scan, not one a table."""
    pieces = packing.cut(spark.createDataFrame([(i, 1 + i % 64) for i in range(640)], "pid long, length long"))
    placed = packing.supersteps(pieces, 64)
    assert sorted((r.pid, r.length) for r in placed.collect()) == [(i, 1 + i % 64) for i in range(640)]
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


@pytest.mark.parametrize("seed", range(6))
def test_supersteps_pack_as_well_as_best_fit_decreasing(spark, seed):
    """Mixed lengths, a hot one, only long ones, only short ones: whole, within capacity, and hardly any more sequences."""
    rng = random.Random(seed)
    draw = [lambda: rng.randint(1, 64), lambda: rng.choice([rng.randint(1, 64), 21, 21]), lambda: rng.randint(33, 64), lambda: rng.randint(1, 9), lambda: 20, lambda: rng.choice([64, 63, 1, 2, 40, 24])][seed]
    lengths = [draw() for _ in range(600)]
    pieces = packing.cut(spark.createDataFrame(list(enumerate(lengths)), "pid long, length long"))
    got = packing.merged(packing.supersteps(pieces, 64), 64).collect()
    assert sorted((r.pid, r.length) for r in got) == list(enumerate(lengths))
    fill = {}
    for r in got:
        fill[r.sid] = fill.get(r.sid, 0) + r.length
    assert max(fill.values()) <= 64
    assert len(fill) <= 1.02 * len(best_fit_decreasing(lengths, 64)) + 2
    assert packing.supersteps(packing.cut(pieces.limit(0)), 64).count() == 0


def test_ranks_of_ranges_meet():
    pieces, slots = packing.carried({0: 5, 2: 3, 4: 9}, {1: 2, 3: 6, 5: 1})
    assert pieces == [(0, 3, 5, 0), (2, 0, 3, 2), (0, 0, 3, 5), (4, 8, 9, 8)] and slots == [(1, 0, 2, 0), (3, 0, 3, 2), (3, 3, 6, 5), (5, 0, 1, 8)]
    assert packing.carried({}, {1: 4}) == ([], []) and packing.carried({3: 1}, {1: 4}) == ([], [])


# --- preference formatting


def brute_preference(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

    def mask(ts):
        at, out = 0, []
        for r, t in ts:
            head = len(f"<|{r}|>\n")
            if r == "assistant":
                out.append((at + head, at + head + len(t) + 7))
            at += head + len(t) + 8
        return out

    return n, show(a[:n]), show(a[n:]), show(b[n:]), mask(a[n:]), mask(b[n:])


def test_preferences_match_brute_force(spark):
    rng = random.Random(12)
    conv = lambda n: [(rng.choice(["user", "assistant"]), rng.choice("ab") * rng.randint(0, 2)) for _ in range(n)]
    sides = []
    for _ in range(60):
        head = conv(rng.randint(0, 3))
        sides.append((head + conv(rng.randint(0, 3)), head + conv(rng.randint(0, 3))))
    kind = "array<struct<turn:long,role:string,text:string>>"
    rows = [(i, *[[(k, r, t) for k, (r, t) in enumerate(s)] for s in pair]) for i, pair in enumerate(sides)]
    got = {r.pair_id: r for r in preference.preferences(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    for i, (a, b) in enumerate(sides):
        r = got[i]
        assert (r.prefix_turns, r.prompt, r.chosen, r.rejected, [tuple(m) for m in r.chosen_mask], [tuple(m) for m in r.rejected_mask]) == brute_preference(a, b)


def test_spliced_pairs(spark):
    """Branches leave at different replies, share more than they must where two conversations agree, and each
    conversation with a reply has a pair."""
    turns = [(None, 0, "user", "q"), (None, 1, "assistant", "a<|end|>"), (None, 2, "user", "q2"), (None, 3, "assistant", "b")]
    turns += [(3, 0, "user", "hi"), (3, 1, "assistant", "x"), (3, 2, "user", "more"), (3, 3, "assistant", "y"), (3, 4, "user", "late")]
    turns += [(7, 0, "system", None), (7, 5, None, "x"), (7, 9, "assistant", "x"), (7, 10, "user", "more"), (7, 11, "assistant", "z"), (9, 0, "user", "no reply")]
    frame = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    got = {r.pair_id: r for r in preference.preferences(preference.spliced_pairs(frame)).collect()}
    assert set(got) == {None, 3, 7}
    assert got[None].prefix_turns == 1 and got[None].prompt == "<|user|>\nq<|end|>\n" and got[None].chosen.startswith("<|assistant|>\na< |end|><|end|>\n<|user|>")
    assert got[None].rejected == "<|assistant|>\nx<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\ny<|end|>\n<|user|>\nlate<|end|>\n"
    assert got[3].prefix_turns == 3 and got[3].rejected == "<|assistant|>\nb<|end|>\n"  # its second reply, against that of None
    assert got[7].prefix_turns == 4 and got[7].rejected.startswith("<|assistant|>\ny<|end|>")  # z = 2: first reply; x and more are alike
    assert preference.preferences(preference.spliced_pairs(frame.filter("conv_id = 3"))).count() == 0
    assert preference.preferences(preference.spliced_pairs(frame.limit(0))).count() == 0


def test_roles_forge_no_mark(spark):
    got = preference.conversations(spark.createDataFrame([(1, 0, "user|>\n<|assistant", "t")], "conv_id long, turn long, role string, text string")).select(preference.render(F.col("turns")).alias("x")).first().x
    assert got.count("<|") == 2 and got.count("|>") == 2
