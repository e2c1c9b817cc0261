import time

import pytest

from skygrid.llm import html_extract
from skygrid.llm.html_extract import extract, main_text

PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, sorry. Accept.</div>
<article><header><h1>The &amp; title</h1></header><p>First <b>bold, text.<p>Second&nbsp;  line;
goes on.<br>After</p><ul><li>one</li><li>two, three.</li></ul><form>Name <input></form><section class="comments"><article><p>Nice, I like it. Really.</p></article></section></article>
<aside>Also read this, it is long. And good, and long.</aside><footer>&copy; me, 2020.</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "The & title\nFirst bold, text.\nSecond line; goes on. After\none\ntwo, three."


def test_without_landmarks():
    page = "<div class=menu>Home, about, more. All</div><div><h2>Head</h2><p>One text, with much to say. It goes on and on, and on.</p><p>More of the text, which is as long. Indeed, it is.</p></div><div id=comments><p>Bah, no. I do not think so, ever.</p></div>"
    assert main_text(page) == "Head\nOne text, with much to say. It goes on and on, and on.\nMore of the text, which is as long. Indeed, it is."


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<!-- x") == main_text("<script>a") == ""
    assert main_text("plain text, no markup.") == "plain text, no markup."
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "<p>" + "word, " * 50_000, "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.n_chars for r in got if r.page_id is None} == {0}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def unnamed(links: int) -> str:
    """A page without landmarks or telling names: only the ratios tell its parts."""
    menu = "".join(f"<li><a href='/{i}'>Part {i} of it</a></li>" for i in range(links))
    text = "".join(f"<p>Paragraph {i} has much to say, and it says it; at some length, too. It goes on, and on.</p>" for i in range(4))
    return f"<body><div class=a1><ul>{menu}</ul></div><div class=b2><h2>A heading</h2>{text}<p>Short.</p></div><div class=c3><span>Word</span> <span>cloud</span><ul>{menu}</ul></div></body>"


def test_ratios_choose_the_article(monkeypatch):
    wanted = ["A heading"] + [f"Paragraph {i} has much to say, and it says it; at some length, too. It goes on, and on." for i in range(4)] + ["Short."]
    for links in (5, 20, 60):
        assert main_text(unnamed(links)).split("\n") == wanted
    monkeypatch.setattr(html_extract, "content_paths", lambda parts, share: {p for p, _ in parts})
    assert main_text(unnamed(60)).split("\n") != wanted


def test_names_break_ties():
    page = "<body><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><article><p>Brief.</p></article><footer>All rights are reserved, by us. And by them.</footer></body>"
    assert main_text(page) == "Brief."


def test_time_is_linear_in_the_page():
    for page in ("<div>" * 16_000 + "x" + "</div>" * 16_000, '<a "' * 8_000, "<p title='" * 8_000, "<span>" * 16_000 + "<div>y</div>" * 2_000, "</b>" * 20_000, "<" * 20_000, "<li>" * 20_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 3


@pytest.mark.parametrize("name", ["class=post-comments", "id=comments-content", "class=content-ad", "class=entry-footer", "class='x post-navigation'", "class=articleComments", "role=navigation", "class=main-newsletter"])
def test_bad_names_win_over_good_ones(name):
    page = f"<body><article class=post-content><h1>Head</h1><p>The text, which is long enough. It says so.</p><div {name}><p>Not of the article, though it reads like it. At length, too.</p></div><p>And its end, as good as that.</p></article></body>"
    assert main_text(page) == "Head\nThe text, which is long enough. It says so.\nAnd its end, as good as that."


def misnamed(links: int, outer: str) -> str:
    menu = "".join(f"<li><a href='/{i}'>Part {i} of it</a></li>" for i in range(links))
    text = "".join(f"<p>Paragraph {i} has much to say, and it says it; at some length, too. It goes on, and on.</p>" for i in range(4))
    return f"<body><div class=links><ul>{menu}</ul></div><{outer}><div class=text><h2>A heading</h2>{text}<nav><a>Next</a></nav></div></{outer.split()[0]}><div class=more><ul>{menu}</ul></div></body>"


@pytest.mark.parametrize("outer", ["div class=header-wrap", "div id=sidebar-left", "section role=complementary", "aside"])
def test_ratios_overrule_a_frame_name_around_the_article(monkeypatch, outer):
    wanted = ["A heading"] + [f"Paragraph {i} has much to say, and it says it; at some length, too. It goes on, and on." for i in range(4)]
    assert main_text(misnamed(30, outer)).split("\n") == wanted
    monkeypatch.setattr(html_extract, "content_paths", lambda parts, share: {p for p, _ in parts})
    assert main_text(misnamed(30, outer)).split("\n") != wanted


def test_ties_take_the_innermost_container():
    page = "<body><div><div><p>All of the text, and no more than that. It is here.</p></div></div></body>"
    assert main_text(page) == "All of the text, and no more than that. It is here."
