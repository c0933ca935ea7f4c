"""Main text of pages, against the known parts of made pages."""

import html
import re
import time
import tracemalloc

import pytest

from sceneline.llm import html_text as ht

PARA = "This is a paragraph of the article, with some words in it; it ends here."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a = '<p>no</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


def test_parts_left_out():
    body = (
        "<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies, do you agree?</div>"
        f"<main><h2>Title</h2><p>{PARA}</p><p>Short.</p><ul><li>one<li>two</ul><blockquote>said &amp; done</blockquote></main>"
        f"<aside><p>{PARA}</p></aside><div id=comments><p>{PARA}</p></div><form><label>Mail</label><input></form><div class=ad>{PARA}</div><footer>(c) site</footer><!-- <p>x</p> -->"
    )
    assert ht.main_text(page(body)) == f"Title {PARA} Short. one two said & done"


def test_without_semantic_tags():
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(12))
    body = f"<div><ul>{links}</ul></div><div><div><h2>Title</h2><p>{PARA}</p><p>{PARA}</p><p>Hm.</p></div></div>"
    assert ht.main_text(page(body)) == f"Title {PARA} {PARA} Hm."


def test_broken_markup():
    assert ht.main_text(page(f"<article><p>{PARA}<p><b>{PARA}<br><p>end &lt;x&gt; &eacute;&#233;</article>")) == f"{PARA} {PARA} end <x> éé"
    assert ht.main_text(f"<article><p title='a > b'>{PARA}</p><script>never closed <p>x") == PARA
    assert ht.main_text("no markup at all, only text.") == "no markup at all, only text."
    assert ht.main_text("<p>a <") != ""


@pytest.mark.parametrize("names", ["content no-sidebar", "post social-science", "has-comments", "page has-sidebar", "no-comments", "elementor-widget-container", "entry related-posts-on", "sidebar", "comments", "ad"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<div><div>{}</div></div>"])
def test_no_name_empties_a_page(names, inner):
    text = f"<h1>Title</h1><p>{PARA}</p><p>{PARA}</p>"
    body = f"<nav><a href=x>Home</a></nav><div class='{names}'>{inner.format(text)}</div><footer>(c) site</footer>"
    assert ht.main_text(page(body)) == f"Title {PARA} {PARA}"
    assert ht.main_text(page(f"<form id=all>{body}</form>")) == f"Title {PARA} {PARA}"


@pytest.mark.parametrize("names", ["cookie-notice", "ad", "ad-slot-3", "sidebar-left", "site-header", "comments-area", "newsletter-box", "social-share", "related", "elementor-widget-container"])
def test_named_parts_go(names):
    other = f"<div class='{names}'><p>{PARA}</p></div>"
    text = f"<div><h1>Title</h1><p>{PARA}</p><p>{PARA} {PARA}</p></div>"
    assert ht.main_text(page(f"{other}{text}{other}")) == f"Title {PARA} {PARA} {PARA}"


def test_comments_longer_than_the_article():
    comments = "".join(f"<article class='comment-body'><p>{PARA}</p></article>" for _ in range(9))
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p></article><div id='comments' class='comments-area'>{comments}</div>")) == f"Title {PARA}"


def test_several_articles_and_headers():
    one, two = f"<article><h2>One</h2><p>{PARA}</p></article>", f"<article><h2>Two</h2><p>{PARA} {PARA}</p></article>"
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(9))
    assert ht.main_text(page(f"<div>{one}<ul>{links}</ul>{two}</div>")) == f"One {PARA} Two {PARA} {PARA}"
    assert ht.main_text(page(f"<div class='post-header'><h1>Title</h1></div><div><p>{PARA}</p><p>{PARA}</p></div>")) == f"Title {PARA} {PARA}"
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p><ul>{links}</ul><p>Hm.</p></article>")) == f"Title {PARA} Hm."


SECOND = "A second part stands beside the first one, and it belongs to the text as well."


def test_ends_of_comments():
    for comment in ("<!-- x --!>", "<!-->", "<!--->", "<!-- a > b -->", "<!---->", "<!-- <p>x</p> --!>"):
        assert ht.main_text(page(f"<article><p>{PARA}</p>{comment}<p>tail of it.</p></article>")) == f"{PARA} tail of it."
    assert ht.main_text(page(f"<article><p>{PARA}</p><!-- never closed <p>x</p></article>")) == PARA


@pytest.mark.parametrize("mark", ['id="discussion"', 'id="related-work"', 'class="search"', 'class="legal"', 'id=responses'])
def test_chapters_of_an_article(mark):
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p><section {mark}><h2>Chapter</h2><p>{PARA}</p></section></article>")) == f"Title {PARA} Chapter {PARA}"
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5))
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p><section {mark}><h2>Chapter</h2><ul>{links}</ul></section></article>")) == f"Title {PARA}"


def test_links_that_are_text():
    sources = "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(5))
    said = " ".join(f"Source {i}" for i in range(5))
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p><h2>Sources</h2><ul>{sources}</ul></article>")) == f"Title {PARA} Sources {said}"
    long = "".join(f"<li><a href={i}>A. Smith, {2000 + i}: on words.</a></li>" for i in range(5))
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p><ul>{long}</ul></article>")).endswith("A. Smith, 2004: on words.")
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p><p><a href=x>{PARA}</a></p></article>")) == f"Title {PARA} {PARA}"
    assert ht.main_text(page(f"<article><h1>Title</h1><p>{PARA}</p><div class=x><ul>{sources}</ul></div></article>")) == f"Title {PARA}"


@pytest.mark.parametrize("beside", ["<div><p>{}</p></div>", "<section><p>{}</p></section>", "<section><h2>More of it</h2><p>{}</p></section>"])
def test_beside_the_article(beside):
    text, paragraphs = " ".join([PARA] * 9), f"<p>{PARA}</p>" * 9
    want = re.sub("<[^>]*>", " ", beside.format(SECOND)).split()
    assert ht.main_text(page(f"<nav><a href=x>Home</a></nav><div><article>{paragraphs}</article>{beside.format(SECOND)}</div>")) == " ".join([text, *want])
    assert ht.main_text(page(f"<article>{paragraphs}</article>{beside.format(SECOND)}<footer>(c)</footer>")) == " ".join([text, *want])


@pytest.mark.parametrize("mark", ['class="commentBody"', 'class="cookieBanner"', 'id="userComments"', 'class="responses"', 'class="adSlot"', 'class="siteFooter footerLinks"'])
def test_names_in_camel_case(mark):
    assert ht.main_text(page(f"<div><h1>Title</h1><p>{PARA}</p><p>{PARA} {PARA}</p></div><div {mark}><p>{SECOND}</p></div>")) == f"Title {PARA} {PARA} {PARA}"


def test_scripts_and_formulas():
    assert ht.main_text(page(f'<article><script src="a.js" />var x=1;</script><p>{PARA}</p><svg viewBox="0"/><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>')) == f"{PARA} so x=1."


@pytest.mark.parametrize(
    "source",
    ["<a " * 350_000, "<div>x" * 100_000, "<p title=\"" * 100_000, "<b>" * 50_000 + "<div></div>" * 50_000, "<div>" * 50_000 + "</p></li>" * 50_000, "<td>" + "<div>" * 50_000 + "<li><td>" * 50_000,
     "".join(f"<div class='sidebar-{i}x'>x" for i in range(30_000)), "<!--" * 200_000, "</" * 300_000, "<" * 500_000, "&lt;" * 200_000, "<script>" * 100_000],
    ids=range(12),
)
def test_time_follows_the_length(source):
    begun = time.process_time()
    ht.main_text(source)
    assert time.process_time() - begun < 10  # quadratic scans would take minutes


def test_memory_follows_the_length():
    tracemalloc.start()
    ht.main_text("<div>x" * 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_edges():
    assert ht.main_text(None) == ht.main_text("") == ht.main_text("<html></html>") == ht.main_text("<nav>x</nav>") == ""
    long = " ".join([PARA] * 20000)
    assert ht.main_text(page(f"<article><p>{long}</p></article>")) == long


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in ht.extract(rows).collect()}
    for r in rows.collect():
        article = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])
    odd = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x y.</p>", 5), (2, "u", "", 5), (2, "u", "", 5)], "page_id long, url string, html string, text int")
    assert sorted((tuple(r) for r in ht.extract(odd).collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "x y.", 4), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert ht.extract(odd.limit(0)).count() == 0
