import html
import re

import numpy as np
import pytest

from trawl.llm import op4_html as ex


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in ex.op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1] if article else "")
        clean = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
        want = "\n".join(b for b in clean if b)
        assert got[p.page_id].text == want
        assert ex.main_text((p.html or "").replace("article>", "div>")) == want  # a box like any other
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


LONG = "A fairly long sentence that belongs to the article and says something. " * 2
PAGE = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Home of the site</a></header>
<div class="cookie-notice">We use cookies &amp; more, accept them all please, it is only for your own good, dear reader</div>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div id="page"><div class="post-body"><h1>The Title</h1><p>{LONG}<p>Tiny.</p><p>Fish &#38; chips&nbsp;&eacute; {LONG}</p>
<script>var x = "<p>no</p>";</script><form><label>Name</label><input></form><p>{LONG}</p></div></div>
<aside>{LONG}</aside><section id="comments"><article class="comment"><p>{LONG}</p></article></section>
<footer>&copy; nobody</footer></body></html>"""


def test_page_without_an_article():
    want = " ".join(LONG.split())
    assert ex.main_text(PAGE) == f"The Title\n{want}\nTiny.\nFish & chips é {want}\n{want}"


def test_article_with_parts_that_are_not_text():
    page = PAGE.replace('<div class="post-body">', '<div class="sidebar left"><article>').replace(f"{LONG}</p></div></div>", f"{LONG}</p><div class='ad'>Buy {LONG}</div><aside>See</aside></article></div></div>")
    want = " ".join(LONG.split())
    assert ex.main_text(page) == f"The Title\n{want}\nTiny.\nFish & chips é {want}\n{want}"


def test_odd_pages(spark):
    cases = {None: "", "": "", "plain &lt;text&gt;": "plain <text>", "<p>a  b\n c": "a b c", "<script>var x": "", "<<<>>": "", "<p>" * 3000 + "deep": "deep", "<nav>only a menu": ""}
    rows = [(i, None, k, 7) for i, k in enumerate(cases)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in ex.extract_text(pages).collect()}
    want = list(cases.values())
    assert {i: got[i] for i in got if i != 5} == {i: want[i] for i in got if i != 5}
    assert ex.extract_text(pages.filter("false")).collect() == []
    assert ex.extract_text(pages.unionAll(pages)).count() == 2 * len(cases)


def test_clusters_are_runs_of_high_lines():
    found = ex.clusters(np.array([0, 0, 0, 90, 80, 5, 100, 0, 0, 0, 0, 60, 0.0]))
    assert [(b, e) for b, e, _ in found] == [(3, 6), (11, 11)] and found[0][2] > found[1][2]


#: No tag or class says what belongs to the text: the ratios alone must find it.
PLAIN = f"""<html><body><div><div><a href=/>Home</a></div><div><a href=/a>About</a></div><div><a href=/b>Contact us</a></div></div>
<div><div><b>Hot</b> <i>now</i></div><div><span>12</span> <span>May</span></div></div>
<div><div>The Title</div><div>{LONG}</div><div>Tiny.</div><div>{LONG}<br>{LONG}</div><div>{LONG}</div><div>The end.</div></div>
<div><div><i>Some</i> <b>words</b></div><div><span>a</span><span>b</span></div></div><div><span>Copyright</span> <span>nobody</span></div></body></html>"""


def test_plain_boxes_are_told_by_their_ratios(monkeypatch):
    want = " ".join(LONG.split())
    assert ex.main_text(PLAIN) == f"The Title\n{want}\nTiny.\n{want} {want}\n{want}\nThe end."
    monkeypatch.setattr(ex, "smoothed", lambda ratios, *a: ratios)
    assert ex.main_text(PAGE) != "" and ex.regions([]) == []


def test_a_lone_long_line_among_links_is_smoothed_away(monkeypatch):
    notice = "A notice of some length that stands alone among short ones, as long as a paragraph."
    page = PLAIN.replace("<div><b>Hot</b>", f"<div>{notice}</div><div><b>Hot</b>")
    assert notice not in ex.main_text(page)


def test_switched_off_regions_change_every_page(spark, monkeypatch):
    pages = [p.html for p in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if p.html]
    texts = [ex.main_text(h) for h in [*pages, PLAIN, PAGE]]
    monkeypatch.setattr(ex, "regions", lambda lines: [True] * len(lines))
    assert all(ex.main_text(h) != t for h, t in zip([*pages, PLAIN, PAGE], texts, strict=True))


def test_time_is_linear_in_nesting():
    import time

    took = []
    for n in (4000, 16000):
        page = "<div>x" * n + "</b>" * n + "</i></span>" * n + "</div>" * n
        began = time.process_time()
        assert ex.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


_ARTICLE = "<html><body><div><article><h1>Title of it</h1><p>" + "Some words of prose here. " * 12 + "</p>{}<p>" + "And more words of prose there. " * 12 + "</p></article></div></body></html>"


@pytest.mark.parametrize(
    "part,kept",
    [
        ('<ul><li><a href="x">Short ref A</a></li><li><a>Short ref B</a></li></ul>', "Short ref A\nShort ref B"),
        ("<p>Let <math><mi>x</mi></math> be given.</p>", "Let x be given."),
        ('<section id="search-algorithms"><p>' + "Algorithms of search are old. " * 12 + "</p></section>", ("Algorithms of search are old. " * 12).strip()),
        ('<div class="related-work"><h2>Others</h2><p>' + "It was done before by many. " * 12 + "</p></div>", "Others\n" + ("It was done before by many. " * 12).strip()),
        ('<div class="share"><a>Share</a> this page now</div>', None),
        ('<div class="ad"><p>Buy this thing of ours today.</p></div>', None),
        ('<div class="comments"><p>' + "I like this very much, thanks. " * 12 + "</p></div>", None),
    ],
)
def test_long_prose_outvotes_words_of_a_class(part, kept):
    lines = ex.main_text(_ARTICLE.format(part)).split("\n")
    want = [] if kept is None else kept.split("\n")
    assert lines == ["Title of it", ("Some words of prose here. " * 12).strip(), *want, ("And more words of prose there. " * 12).strip()]
