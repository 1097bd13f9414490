import itertools
import random

import pytest

from answerscope.llm import html_text as H

LONG = "This is a sentence of the article that goes on for a good number of words."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


BOILER = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>', "<footer><p>Copyright somebody, all rights reserved by us.</p></footer>",
    f"<aside><p>{LONG} Aside.</p></aside>", f'<div class="sidebar"><h3>More</h3><p>{LONG} Side.</p></div>', f'<div class="ad">{LONG} Buy.</div>',
    f'<div id="cookie-notice"><p>{LONG} Cookies.</p></div>', f"<form><p>{LONG} Sign up.</p><button>Go</button></form>", f'<section class="comments"><p>{LONG} Bob.</p></section>',
    f"<header><h1>Site name</h1><p>{LONG} Slogan.</p></header>", "<script>var a = '<p>no</p>';</script>", "<!-- <p>hidden</p> -->", f'<div style="display: none">{LONG} Hidden.</div>',
]


@pytest.mark.parametrize("boiler", BOILER)
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_boilerplate_goes_wherever_it_stands(boiler, outer):
    content = f"<h1>Head line of it</h1><p>{LONG} One &amp; two&#33;</p><p>{LONG}\n <b>Bold</b>  end<br>here.</p>"
    want = f"Head line of it\n\n{LONG} One & two!\n\n{LONG} Bold end here."
    assert H.main_text(page(f"{boiler}<{outer}>{content}</{outer}>")) == want
    assert H.main_text(page(f"<{outer}>{content}</{outer}>{boiler}")) == want
    if not boiler.startswith("<header"):
        assert H.main_text(page(f"<{outer}>{content}{boiler}</{outer}>")) == want


def test_unclosed_and_cut_off_markup():
    assert H.main_text(f"<body><article><p><b>{LONG}<br><p>{LONG} Two.<p>{LONG} Three <a hre") == f"{LONG}\n\n{LONG} Two.\n\n{LONG} Three"
    assert H.main_text(f"<article><p>{LONG} <script>x") == LONG
    assert H.main_text("") == H.main_text("<p></p>") == H.main_text("<") == ""
    assert "1 < 2" in H.main_text(f"<article><p>{LONG} 1 < 2 holds.</p></article>")


def test_cut_is_least():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]

        def cost(labels, gain=gain, edges=edges):
            own = sum(g if g > 0 and not x else -g if g < 0 and x else 0 for g, x in zip(gain, labels, strict=True))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(H.minimum_cut(gain, edges)) == pytest.approx(best)


def test_neighbours_decide_what_the_text_does_not():
    """A short line between long paragraphs is content, the same line among links isn't."""
    inside = H.main_text(page(f"<div><p>{LONG}</p><p>Hm ok</p><p>{LONG}</p></div>"))
    links = "".join(f'<p><a href="/{i}">Link {i}</a></p>' for i in range(4))
    assert "Hm ok" in inside and "Hm ok" not in H.main_text(page(f"<div>{links}<p>Hm ok</p>{links}</div>"))


def test_rows(session):
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, None, long, None), (3, "u", f"<article><p>{LONG}", "x"), (3, "u", f"<article><p>{LONG}", "x")]
    pages = session.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 0), (None, 20_000 * (len(LONG) + 2) - 2), (3, len(LONG)), (3, len(LONG))]
    assert H.extract(pages.limit(0)).count() == 0


def test_query_against_the_articles(session):
    import re
    from html import unescape

    from answerscope.llm.common import table

    got = {r.page_id: r for r in H.op1_min_cut(session, "/root/testdata/sf0.001").collect()}
    for r in table(session, "/root/testdata/sf0.001", "pages").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize("first", ["<p>", "<div><p>", "<h1>Head line</h1><p>", "", "<b>Bold</b> "])
def test_head_without_end_tag(first):
    """The end of the head and the start of the body may be left out; title, styles and scripts stay out."""
    got = H.main_text(f'<html><head><meta charset="utf-8"><title>T</title><style>p{{}}</style><link rel="x">{first}{LONG}<p>{LONG} Two.')
    assert got.endswith(f"{LONG}\n\n{LONG} Two.") and "T\n" not in got and "{" not in got
    assert H.main_text(f"<html><head><title>T</title></head><body>{first}{LONG}<p>{LONG} Two.") == got
