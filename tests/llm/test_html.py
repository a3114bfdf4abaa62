from __future__ import annotations

import pytest
from loomery.llm import html_text
from loomery.llm.html_text import main_text

PROSE = "The quick brown fox jumps over the lazy dog near the river bank while it rains. "


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


MENU = "<nav><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(8)) + "</ul></nav>"


def test_article_alone():
    html = page(f"<header>Site</header>{MENU}<article><h1>Title &amp; more</h1><p>{PROSE}<b>bold</b>er.<br>Next<p>Short.</article><aside>{PROSE}</aside><footer>&copy; x</footer>")
    assert main_text(html) == f"Title & more {PROSE}bolder. Next Short."


def test_without_semantic_elements():
    html = page(
        f"<div id=menu><a>A</a><a>B</a></div><div class='content'><h2>T</h2><p>{PROSE}</p><p>{PROSE}</p><ul><li>one<li>two</ul></div>"
        f"<div class='comments'><p>{PROSE}</p></div><div class='cookie-notice'>{PROSE}</div><form>{PROSE}</form><div class=sidebar><p>{PROSE * 3}</p></div>"
    )
    assert main_text(html) == f"T {PROSE.strip()} {PROSE.strip()} one two"


def test_noise_inside_the_article():
    html = page(f"<article><header class=entry-header><h1>H</h1></header><p>{PROSE}</p><div class=ad>Buy</div><p>{PROSE}</p><section id=comments><p>{PROSE}</p></section></article>")
    assert main_text(html) == f"H {PROSE.strip()} {PROSE.strip()}"


def test_names_of_blocks():
    html = page(f"<div class='content has-sidebar'><p>{PROSE}</p></div><article class=comment><p>{PROSE}</p></article><div class='sidebar-content'>{PROSE}</div>")
    assert main_text(html) == PROSE.strip()
    assert main_text(page(f"<form><div><p>{PROSE}</p></div></form>")) == PROSE.strip()


@pytest.mark.parametrize("name", ["legal-opinion", "review-text", "discussion-paper", "response-body", "side-story", "notice", "comments", "sidebar"])
def test_a_name_never_cuts_what_density_chose(name):
    body = f"<p>{PROSE * 6}</p>" * 3
    assert main_text(page(f"<div class='{name}'>{body}</div><p>One line.</p>")).startswith((PROSE * 18).strip())


def test_names_weigh():
    article, other = f"<p>{PROSE * 4}</p>" * 2, f"<p>{PROSE * 6}</p>" * 4
    for name in ("comments", "comment-list", "sidebar", "cookie-banner", "ad"):
        assert main_text(page(f"<div>{article}</div><div class='{name}'>{other}</div>")) == (PROSE * 8).strip()
        assert main_text(page(f"<div>{article}<div id='{name}'>{other}</div></div>")) == (PROSE * 8).strip()


def test_density_decides_without_names_and_elements():
    links = "".join(f"<li><a href=/{i}>Read more about {i}</a></li>" for i in range(30))
    html = page(f"<div><ul>{links}</ul></div><div><h2>T</h2><div><p>{PROSE * 3}</p><p>{PROSE}</p></div><div><p>{PROSE * 2}</p><p>End.</p></div></div><div><ul>{links}</ul></div>")
    assert main_text(html) == f"T {PROSE * 6}End."
    root = html_text.parse(html)
    body = next(k for k in root.kids if getattr(k, "tag", "") == "body")
    whole = html_text.text_of(body)
    assert "Read more" in whole  # the body as a whole has the lists: density left them out


def test_density_is_the_formula():
    import math

    html = f"<body><div><p>{'x' * 100}</p><p>{'y' * 40}<a>{'z' * 20}</a></p></div><ul><li><a>{'w' * 30}</a></li></ul></body>"
    blocks = html_text.measure(html_text.parse(html).kids[0])
    got = [(n.tag, n.c, n.t, n.lc, n.lt, n.density, n.dsum) for n in blocks]
    ratio = 50 / 190

    def d(c, t, lc, lt):
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1) / math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)

    p1, p2, li, ul = d(100, 1, 0, 0), d(60, 2, 20, 1), d(30, 2, 30, 1), d(30, 3, 30, 1)
    div, body = d(160, 4, 20, 1), d(190, 8, 50, 2)
    want = [
        ("body", 190, 8, 50, 2, body, div + ul), ("div", 160, 4, 20, 1, div, p1 + p2), ("p", 100, 1, 0, 0, p1, p1),
        ("p", 60, 2, 20, 1, p2, d(40, 1, 0, 0)), ("ul", 30, 3, 30, 1, ul, li), ("li", 30, 2, 30, 1, li, 0.0),
    ]
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:])


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        begin = time.process_time()
        main_text("<div>" * n + PROSE + "<p>" + "<span>" * n + "<li>x" * n + "<a \"" * n)
        return time.process_time() - begin

    seconds(100)
    assert seconds(40_000) < 12 * seconds(10_000)


def test_odd_pages():
    for x in (None, "", "   ", "<html></html>", "<!-- only -->", "<script>x", "<p", "<body><nav>menu</nav></body>"):
        assert main_text(x) == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>a &lt;b&gt; &#233; &unknown; &amp;amp;</p>") == "a <b> é &unknown; &amp;"
    assert len(main_text("<div>" * 3000 + PROSE)) == len(PROSE.strip())


def test_rows(spark):
    rows = [(1, "u", page(f"<p>{PROSE}</p>")), (1, "u", page(f"<p>{PROSE}</p>")), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, PROSE.strip(), len(PROSE) - 1), (1, PROSE.strip(), len(PROSE) - 1), (2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
