"""Exact texts of pages written by hand, apart from the layouts that the model is trained on."""

import time

import pytest

from quern.llm import html_text as H
from tests.llm.layouts import LAYOUTS

ARTICLE = "The river rose again on Tuesday, and the old bridge was closed to all traffic before noon."
PAGES = {
    "news": (
        f"""<!doctype html><html><head><title>x</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><body>
<header><a href=/>Daily</a></header><nav class="main-nav"><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav>
<main><article><h1>River rises</h1><p class=lead title=it's>{ARTICLE}</p><p>It&#39;s   closed
&amp; guarded.</p><ul><li>One road<li>Two lanes</ul></article></main>
<aside class="related"><h3>More</h3><p>Read this too.</p></aside><section id="comments"><p>First!</p></section><footer>Copyright 2020</footer></body></html>""",
        ["River rises", ARTICLE, "It's closed & guarded.", "One road", "Two lanes"],
    ),
    "bare": (f"<html><body><div><p>{ARTICLE}</p></div></body></html>", [ARTICLE]),
    "fragment": (f"<p>{ARTICLE}<p>Nobody was hurt.", [ARTICLE, "Nobody was hurt."]),
    "old": (f"<body bgcolor=white><table><tr><td>{ARTICLE}<td>Nobody was hurt, it was said later that day.</table></body>", [ARTICLE, "Nobody was hurt, it was said later that day."]),
    "formula": (f"<article><p>{ARTICLE}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><object><p>Shown if nothing else is.</p></object></article>", [ARTICLE, "Let x=2 hold.", "Shown if nothing else is."]),
    "notice": (f'<div class="cookie-banner"><p>We use cookies.</p><button>Yes</button></div><div class="post"><p>{ARTICLE}</p><div class="ad">Buy!</div></div><form><p>Search</p></form>', [ARTICLE]),
    "unclosed": (f"<article><p>{ARTICLE}<p>a < b <b>and <i>more</b> of it<!-- gone", [ARTICLE, "a < b and more of it"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(name):
    source, want = PAGES[name]
    assert H.default_model().extract(source) == "\n\n".join(want)


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    source, want = LAYOUTS[name]
    assert H.default_model().extract(source) == "\n\n".join(want)


def test_names_tell_by_their_words():
    told = lambda *names: set().union(*(H._told(n) for n in names))
    assert told("main-nav") == told("mainNav") == told("nav_item") == {"w:nav"} and told("comment-body") == {"w:comment"}
    assert told("top-story") == told("search-result-body") == told("text-top") == {"w:main"}
    assert told("with-nav", "no-comments", "menu-closed", "legal-advice", "formatted") == set() and told("page-top") == {"v:header"}


@pytest.mark.parametrize("piece", ['<a "x', '<a b=">" ', "<a b='", "<div>", "<li>", "<ul><li>", "<a<", "&amp;<", "<iframe>", "<script></script ", "<b><div><i></b>", "<div class="])
def test_hostile_pages_take_linear_time(piece):
    model = H.default_model()
    took = []
    for size in (1 << 18, 1 << 20):
        began = time.process_time()
        model.extract(piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1 and took[1] < 20


def test_long_page_is_whole(spark):
    body = [f"<p>Sentence {i} of a very long report, with words enough.</p>" for i in range(20000)]
    df = spark.createDataFrame([(1, "u", "<article>" + "".join(body) + "</article>"), (1, None, "<article>" + "".join(body) + "</article>")], "page_id long, url string, html string")
    rows = H.main_text(df).collect()
    assert [len(r["text"].split("\n\n")) for r in rows] == [20000, 20000] and H.main_text(df.limit(0)).count() == 0
