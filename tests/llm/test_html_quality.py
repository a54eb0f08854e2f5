"""Precision and recall of words over hand-labelled pages of different layouts. In each, what the article holds is marked by
the letter that its words begin with: k for words to keep, x for words to drop."""

import pytest

from loomline.llm import html_text


def words(letter, n, at=0):
    return " ".join(f"{letter}{i}" for i in range(at, at + n))


K, X = words("k", 40), words("x", 12)
LONG = "".join(f"<p>{words('k', 30, 100 * i)}.</p>" for i in range(1, 6))
MENU = "<ul>" + "".join(f"<li><a href=/{i}>x{i}</a></li>" for i in range(8)) + "</ul>"

PAGES = {
    "semantic": f"<header>{X}</header><nav>{MENU}</nav><main><article><h1>k title</h1>{LONG}</article></main><aside>{X}</aside><footer>{X}</footer>",
    "divs": f"<div id=header>{X}</div><div class='main-menu'>{MENU}</div><div id=content><h2>k title</h2>{LONG}</div><div class='sidebar right'>{X}</div><div id=footer>{X}</div>",
    "breaks": f"<div class=nav>{MENU}</div><div class=story>{K}<br><br>{words('k', 30, 200)}<br>{words('k', 30, 300)}</div><div class=copyright>{X}</div>",
    "table": f"<table><tr><td class=menu>{MENU}</td><td class=body>{LONG}</td><td class='ads right'>{X}</td></tr></table>",
    "advert inside": f"<article>{LONG}<div class='ad banner'>{X}</div>{LONG}</article>",
    "notice above": f"<div class='cookie-consent'>{X}</div><div role=alert>{X}</div><article>{LONG}</article>",
    "comments below": f"<article>{LONG}</article><section id=comments><h3>x replies</h3><p>{X}</p><p>{X}</p></section>",
    "comments inside": f"<article>{LONG}<div class=comment-list><p>{X}</p></div></article>",
    "form inside": f"<article>{LONG}<form class=newsletter-signup><p>{X}</p><input><button>x go</button></form></article>",
    "code and tables": f"<article>{LONG}<pre>{K}</pre><table><tr><th>k a<td>k b</table><ol><li>k one<li>k two</ol><blockquote><p>{K}</p></blockquote></article>",
    "odd names": f"<article class='post share-price-report'>{LONG}<div class='notice-of-award'><p>{K}</p></div><ul class='menu-of-the-day'><li>k soup<li>k bread</ul></article>",
    "scripts": f"<script>var x1='</div>'</script><style>.x2{{}}</style><noscript>{X}</noscript><article>{LONG}<script>x3()</script><!-- {X} --></article>",
    "unclosed": f"<nav>{MENU}</nav><article><p>{K}<p>{words('k', 30, 200)}<svg><path d=1/><p>{words('k', 30, 300)}",
    "related": f"<article>{LONG}</article><div class='related-posts'>{MENU}</div><div class='social share'><a>x1</a></div><div class=pagination><a>x2</a></div>",
    "links in text": f"<div class=text><p>{K} <a href=/a>k link</a> {K}</p><p><a href=/b>k more</a> {K}</p></div><div class=breadcrumbs><a>x1</a> / <a>x2</a></div>",
}


def kept(page):
    return [w for w in html_text.extract(f"<html><body>{page}</body></html>", None).replace(".", " ").split() if w[0] in "kx" and w not in ("title",)]


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    page = PAGES[name]
    import re

    marked = [w for w in re.findall(r"\b[k][0-9]*\b", re.sub(r"<[^>]*>|<!--.*?-->", " ", page))]
    got = kept(page)
    assert not [w for w in got if w[0] == "x"], "precision"
    assert sorted(w for w in got if w[0] == "k") == sorted(marked), "recall"
