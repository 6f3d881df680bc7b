import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from quiltframe.llm.op3_html_text import extract, main_text, surges

LONG = "Words of the article that go on for a while, so that the block is long enough to matter."
CASES = {
    "<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='ad'>Buy this now, it is a very good thing to buy.</div><article><h1>Title &amp; more</h1><p><b>Short.<br><p>One\n  two&nbsp;three</p><p>R&eacute;sum&#233; &am</article><footer>&copy; x</footer>": "Title & more\n\nShort.\n\nOne two three\n\nRésumé &am",
    f"<div id=menu><a>one</a> <a>two</a></div><div><p>{LONG}</p><p>ok</p></div><div class='comment-list'><p>{LONG}</p></div>": f"{LONG}\n\nok",
    f"<h2>Head</h2><p>{LONG}<p>{LONG}<aside>{LONG}</aside><form><p>{LONG}</p></form>": f"Head\n\n{LONG}\n\n{LONG}",
    f"<article><header><h1>T</h1><p>by me</p></header><p>{LONG}</p><section class='comments'><article><p>{LONG}</p></article></section><p>end</p></article>": f"T\n\n{LONG}\n\nend",
    f"<main><p>a <a href='#'>link</a> b</p><div hidden>no</div><div style='display: none'>no</div><script>var t='</p>';</script><p>c</p></main>": "a link b\n\nc",
    "plain words": "plain words",
    "": "",
    "<p>cut <b>off</b> <a href='": "cut off",
    "<script>only": "",
    "<article></article><p></p>": "",
    f"<div class=ad>unclosed<article><p>{LONG}</p></article>": LONG,
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
}


@pytest.mark.parametrize("page", list(CASES))
def test_main_text(page):
    assert main_text(page) == CASES[page]


@pytest.mark.parametrize("name", "has-sidebar comments-open content-with-sidebar related share social notice widget".split())
def test_classes_do_not_empty_an_article(name):
    for open_, close in (("<article class='post %s'>", "</article>"), ("<main id='%s'>", "</main>"), ("<div class='%s' role=main>", "</div>")):
        assert main_text(f"<nav>menu</nav>{open_ % name}<p>{LONG}</p>{close}<div class='ad'>{LONG}</div>") == LONG
    assert main_text(f"<nav>menu</nav><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n\n{LONG}"
    assert main_text(f"<div class='{name}' hidden><p>{LONG}</p></div>") == ""


def test_pages_of_odd_frames():
    two = f"<p>{LONG}</p><p>{LONG}</p>"
    want = f"{LONG}\n\n{LONG}"
    assert main_text(f"<html><head><meta charset=utf-8><title>no</title><body>{two}") == want
    assert main_text(f"<html><head><title>no</title>{two}") == want
    assert main_text(f"<div class='layout has-sidebar'>{two}</div>") == want
    assert main_text(f"<div class='post comments-open'>{two}</div>") == want
    assert main_text(f"<form><nav><a>x</a></nav>{two}<div class=ad>{LONG}</div></form>") == want
    assert main_text(f"<article>{two}<section id='related-work'><p>Works.</p></section></article>") == want + "\n\nWorks."
    assert main_text(f"<article><p>teaser</p></article><div>{two}</div>") == "teaser\n\n" + want
    assert main_text(f"<main><form>{two}</form></main><div class=ad>{LONG}</div>") == want
    assert main_text(f"<article></article><div class=comments>{two}</div>") == main_text(f"<main> </main><form>{two}</form>") == ""
    assert main_text(f"<article><p>short</p></article><div>tagline</div><div class=comments>{two}</div>") == "short"


@pytest.mark.parametrize("page", ["<ul>" * 20_000 + "<b>x</b>" * 20_000, "<span class=ad>x" * 12_000, "<title " * 28_000, "<a '" * 50_000, '<p title="' * 20_000, "<div class=ad><article>" * 9_000, "<p><div>" + "<center>" * 25_000, "<!-- " * 40_000, "</ " * 60_000, "<" * 200_000, "<script>" * 25_000, "&amp" * 50_000, "<a b='\"<" * 20_000])
def test_time_is_linear(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 4  # 200 kB take less than a second each; the machine may be busy


def slow_surges(size, window, surge):
    """Straight from the definition, sum by sum."""
    keep, on = [], False
    for i in range(len(size)):
        s = sum(size[i : i + window])
        on = (on and s > 0) or (s > surge and size[i] > 0)
        if on and size[i]:
            keep.append(i)
    return keep


@pytest.mark.parametrize("seed", range(5))
def test_distribution_against_brute_force(seed):
    g = random.Random(seed)
    size = [g.choice([0, 0, 0, 5, 30, 90, 300]) for _ in range(400)]
    for window in (1, 3, 5):
        for surge in (0, 80, 200):
            assert surges(size, [False] * len(size), window, surge) == slow_surges(size, window, surge)
    page = "".join(f"<div>{'x' * s}</div>" if s else "<div class=ad>menu</div>" for s in size)
    assert main_text(page).split("\n\n") == ["x" * size[i] for i in slow_surges(size, 3, 80)]


def test_table():
    """Pages of the table are of one layout: all between article's tags, by an independent parser."""
    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.inside = [""], False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks += [""] * (tag in ("p", "h1", "article"))
            self.blocks[-1] += " " * (tag == "br")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.blocks += [""] * (tag in ("p", "h1"))

        def handle_data(self, data):
            self.blocks[-1] += data * self.inside

    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        p = Article()
        p.feed(html or "")
        assert main_text(html or "") == "\n\n".join(" ".join(b.split()) for b in p.blocks if b.split())


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, None, "<p>a", "x"), (None, "u", "<p>" + "é " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, "u", ("é " * 50_000).strip(), 99_999), (1, "", "a", 1), (1, "u", "", 0)]
    assert extract(pages.limit(0)).count() == 0
