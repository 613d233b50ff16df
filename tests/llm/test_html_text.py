"""Extraction from hand-made layouts and from the whole pages table."""

import html
import re

import numpy as np
import pytest

from conftest import SF_CHECK
from regiflow.llm import html_text

LONG = ("A sentence of the main text that goes on for a good while so that it has a high ratio of text to tags. " * 3).strip()
NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul></nav>"


def page(body, head="<title>T</title><style>p{}</style><script>var x='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (page(f"{NAV}<article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>"), ["Title", LONG, "Short."]),
    "unclosed": (f"<body>{NAV}<article><h1>Title</h1><p><b>Bold start<br><p>{LONG}<p>Tail", ["Title", "Bold start", LONG, "Tail"]),
    "noise inside": (page(f"<article><p>{LONG}</p><div class='ad'>Buy this</div><aside>Side</aside><form>Name <input></form>"
                          f"<p>End &amp; done.</p><section class='comments'><p>{LONG} says a reader</p></section></article>"), [LONG, "End & done."]),
    "divs": (page(f"<div id='top-menu'><a href='/'>Home</a> <a href='/a'>About</a></div><div class='cookie-notice'>{LONG}</div>"
                  f"<div id='body-text'><p>{LONG}</p><p>Two.</p><div>Three.</div></div><div class='sidebar'><p>Side</p></div>"),
             [LONG, "Two.", "Three."]),
    "header": (page(f"<header><h1>Site</h1></header><main><header><h1>Story</h1></header><p>{LONG}</p></main>"), ["Story", LONG]),
    "references": (page(f"<article><p>x&lt;y &#8364; &eacute;&nbsp;z \n\t q &unknown; &amp;amp;</p><p>{LONG}</p></article>"),
                   ["x<y € é z q &unknown; &amp;", LONG]),
    "lists and tables": (page(f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</td><td>d</td></tr></table></article>"),
                         [LONG, "one", "two", "a b", "c d"]),
    "inline": (page(f"<article><p>{LONG}</p><p>a<b>b</b><i>c <u>d</i>e</u> f</p></article>"), [LONG, "abc de f"]),
    "one short article": (page(f"{NAV}<div class='ad'>{LONG}</div><article><h1>Hi</h1><p>Yes.</p></article>"), ["Hi", "Yes."]),
    "roles": (page(f"<div role='navigation'>{LONG}</div><div role='main'><p>{LONG}</p></div><div role='contentinfo'>c</div>"), [LONG]),
    "comment lists": (page(f"<article><h1>T</h1><p>{LONG}</p><ol class='commentlist'><li>{LONG} says a reader</li></ol></article>"), ["T", LONG]),
    "nested comment articles": (page(f"<article><p>{LONG}</p><article class='comment'><p>{LONG} says a reader</p></article><p>End.</p></article>"),
                                [LONG, "End."]),
    "advert sizes": (page(f"<article><p>{LONG}</p><div class='ad-300x250'>Buy this</div><p>End.</p></article>"), [LONG, "End."]),
    "compounds": (page(f"<article><div class='cookie-law-info-bar'>We use cookies</div><p>{LONG}</p><div class='footer-widgets'>More</div>"
                       f"<div class='privacy-law-news'>Law</div></article>"), [LONG, "Law"]),
    "formulas": (page(f"<article><p>{LONG}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>"),
                 [LONG, "so x=2 holds"]),
    "comment and cdata": (page(f"<!-- {LONG} --><article><![CDATA[x]]><![foo[y]]><?pi?><p>{LONG}</p></article>"), [LONG]),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    markup, blocks = CASES[name]
    assert html_text.main_text(markup) == "\n\n".join(blocks)


@pytest.mark.parametrize("markup", [None, "", "   ", "<", "<html", "<p", "&", "<!--", "<script>x", "<![", "<!DOCTYPE", "</b></p>", page(NAV)])
def test_nothing_to_extract(markup):
    assert html_text.main_text(markup) in ("", "<", "&")


WRAPPERS = ["layout has-sidebar", "no-comments", "content-with-sidebar", "social-science", "social", "site-banner"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("key", ["class", "id"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_of_wrappers_hide_no_article(name, key, tag):
    assert html_text.main_text(page(f"{NAV}<div {key}='{name}'><{tag}><h1>Title</h1><p>{LONG}</p></{tag}></div>")) == f"Title\n\n{LONG}"


def test_slugs_keep_their_text_and_names_of_boilerplate_do_not():
    body = (f"<p>{LONG}</p><section id='related-work'><h2 id='menu'>Menu</h2><p id='comment-on-results'>Remark.</p></section>"
            "<section id='notice'><p class='no-ad'>Last.</p></section>")
    assert html_text.main_text(page(f"<article>{body}</article>")) == "\n\n".join([LONG, "Menu", "Remark.", "Last."])
    for name in ("sidebar", "left-sidebar", "topMenu", "cookie_notice", "social-share-buttons", "ad-slot-1", "SIDEBAR", "post-comments"):
        assert html_text.main_text(page(f"<article><p>{LONG}</p><div class='x {name}'>Buy</div></article>")) == LONG, name
    comments = f"<section class='comments'><article class='comment'><p>{LONG} says a reader</p></article></section>"
    assert html_text.main_text(page(f"<article><p>{LONG}</p>{comments}</article>{comments}")) == LONG
    assert html_text.main_text(page(f"<form id='aspnet'><div class='widget'><main><p>{LONG}</p><form>Name</form></main></div></form>")) == LONG


def short(around, inside=""):
    """Three short parts, the last ones too far from a long one to be smoothed up."""
    return "".join(f"<{around}>{inside}<p>{w}.</p></{around.split()[0]}>" for w in ("Two", "Three", "Four"))


PARTS = {
    "unnamed divs": f"<div id='c'><div><p>{LONG}</p></div>{short('div')}</div>",
    "in the body": f"<div><p>{LONG}</p></div>{short('div')}",
    "equal classes": f"<div id='c'><div class='part'><p>{LONG}</p><p>{LONG}</p></div>{short("div class='part'")}</div>",
    "named blocks": f"<div id='c'><div id='a'><p>{LONG}</p></div>{short("div id='b'")}</div>",
    "sections": f"<div id='c'><section id='x'><h2>One</h2><p>{LONG}</p></section>{short('section')}</div>",
    "nested": f"<div id='c'><section><div><p>{LONG}</p></div></section>{short('section', '<div>')}</div>",
    "quote": f"<div id='c'><blockquote><p>{LONG}</p></blockquote><p>Two.</p><p>Three.</p><p>Four.</p></div>",
    "short quote": f"<div id='c'><div><p>{LONG}</p></div>{short('blockquote')}</div>",
    "many divs": "<div id='c'>" + f"<div><p>{LONG}</p></div>" * 5 + short("div") + "</div>",
    "articles": f"<article><p>{LONG}</p></article>{short('article')}",
}


@pytest.mark.parametrize("name", PARTS)
def test_parts_of_one_text_stay_together(name):
    menu = "<div id='x1'><a href='/'>Home</a> <a href='/a'>About</a></div>" if "<div id='c'>" in PARTS[name] else ""
    got = html_text.main_text(page(f"{menu}{NAV}{PARTS[name]}<footer>x</footer>"))
    assert sorted(got.split("\n\n")) == sorted(re.findall(r"<(?:p|h2)>(.*?)</", PARTS[name]))


@pytest.mark.parametrize("before", [
    "<script><!-- code </script>", "<style><!-- p{} </style>", "<textarea><!-- code</textarea>", "<div title='<!-- x'></div>",
    "<title><!-- x</title>", "<!-- x --!>", "<!-->", "<!--->", "<!-- a -- >", "<script>x = '<!--'</script><p title=\"<!--\"></p>"])
def test_comment_marks_outside_comments_cut_nothing(before):
    assert html_text.main_text(page(f"{before}<article><p>{LONG}</p></article>")) == LONG


def test_unclosed_comment_goes_to_the_end():
    assert html_text.main_text(page(f"<article><p>{LONG}</p><!-- x <p>{LONG}</p></article>")) == LONG
    assert html_text.main_text(f"<head><title>T</head><article><p>{LONG}</p><textarea>x</article><textarea>") == LONG


def test_plain_text_and_deep_or_long_pages():
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<div>" * 3000 + LONG) == LONG
    many = "".join(f"<p>{i} {LONG}" for i in range(3000))
    assert html_text.main_text(f"<article>{many}</article>") == "\n\n".join(f"{i} {LONG}" for i in range(3000))


def brute(markup):
    """The article of the table's pages by patterns (independent of the parser)."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", markup, re.S).group(1)
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))) for b in re.split(r"</?(?:p|h1|article)>", inner)]
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    want = sorted([(r.page_id, r.url, brute(r.html)) for r in pages.collect()])
    got = html_text.extracted(pages).collect()
    assert sorted([(r.page_id, r.url, r.text) for r in got]) == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_null_and_repeated_rows(spark):
    rows = [(1, None, CASES["article"][0], "x"), (1, None, CASES["article"][0], "x"), (None, "u", None, None), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted([tuple(r) for r in html_text.extracted(df).collect()], key=str)
    text = "\n\n".join(CASES["article"][1])
    assert got == sorted([(1, None, text, len(text))] * 2 + [(None, "u", "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extracted(df.limit(0)).count() == 0


def test_smoothing_and_threshold():
    assert np.allclose(html_text.smoothed(np.ones(7)), 1)
    peak = html_text.smoothed(np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert peak.argmax() == 3 and peak[2] == peak[4] > peak[1]
    assert 2 < html_text.threshold(np.array([1.0, 2, 1, 50, 60])) < 50
    assert html_text.threshold(np.array([5.0])) == 5
