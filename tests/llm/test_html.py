"""Main text of pages made for the purpose."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from sparkloom.llm.html import extract_pages, main_text

LONG = "This is a paragraph of the article, which is long enough to count, with commas, and more words."
PAGE = f"""<!DOCTYPE html><html><head><title>Title &amp; site</title><style>p {{ color: red }}</style><script>var a = "<p>no</p>";</script></head>
<body><header><div id="logo">Site</div><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, and you agree to them, of course, by reading on here.</p></div>
<div id="content"><article><h1>Head &lt;line&gt;</h1><p>{LONG}</p><p>Second&nbsp;one: caf&eacute; &#8364;, <b>bold</b>text   and
 <a href="x">a link</a>.</p><!-- a comment, <p>not text</p> --><div class="ad"><p>Buy this, now, today, and pay less for it.</p></div>
<ul><li>first</li><li>second</li></ul><pre>x  =
  1</pre></article>
<section class="comments"><h2>Comments</h2><p>{LONG} says a reader.</p></section></div>
<aside class="sidebar"><p>{LONG}</p><ul><li><a href="/a">Most read</a></li></ul></aside>
<form><p>Your mail, please, and your name, and your street, and your town.</p></form>
<footer><p>Imprint, terms, privacy, and so on, for all the pages here.</p></footer></body></html>"""
WANT = f"Head <line> {LONG} Second one: café €, boldtext and a link. first second x = 1"


def test_article_alone_is_kept():
    assert main_text(PAGE) == WANT


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<script>x</script>", "<!-- only -->", "<nav><a href='/'>Home</a></nav>", "<", "<>", "</p>", "<p", "<div class='"])
def test_pages_without_text(html):
    assert main_text(html) in ("", "<", "<>", "<p", "<div class='")


def test_plain_text_is_its_own_main_text():
    assert main_text("just  some\n text") == "just some text"


def test_unclosed_markup_and_paragraphs():
    assert main_text(f"<body><div><p>{LONG}<p>{LONG}<p>tail") == f"{LONG} {LONG} tail"


def test_a_container_without_article_element_and_its_siblings():
    html = f"<body><ul class=menu><li><a href=/a>a</a></ul><div class=post><div class=body><p>{LONG}</p><p>{LONG}</p><p>Short one.</p></div></div><div class=links><a href=/1>{LONG}</a><a href=/2>{LONG}</a></div></body>"
    assert main_text(html) == f"{LONG} {LONG} Short one."


@pytest.mark.parametrize(
    "page",
    [
        "<body><h1>T</h1><div class='content with-sidebar'>{}</div></body>", "<body><article class='post comments-open'><h2>T</h2>{}</article></body>", "<body><h1>T</h1><article class='post register'>{}</article></body>",
        "<body><div class='layout sidebar-right'><article>{}</article><div class='sidebar'><p>Read this, too, it is about other things.</p></div></div></body>",
        "<body><div class='rail'>{}</div><div class='comments'><p>Nice, I say, and so do others, all of them.</p></div></body>", "<body><div id='discussion'>{}</div></body>", "<body><div class='notice'>{}</div><div class='box'><p>Some few words, left over here.</p></div></body>",
    ],
)
def test_names_of_layout_do_not_take_the_article(page):
    text = f"<p>{LONG}</p>" * 4
    assert main_text(page.format(text)).removeprefix("T ") == " ".join([LONG] * 4)


def test_names_still_leave_out_what_is_not_the_article():
    for name in ("site-footer", "comments-area", "cookie-notice", "acme-sidebar", "rightsidebar", "ad-slot-3", "postComments", "related-posts"):
        assert main_text(f"<body><div class='text'><p>{LONG}</p><div class='{name}'><p>Other, quite other, words in a part of its own.</p></div></div></body>") == LONG, name
    assert main_text(f"<body><article><p>{LONG}</p></article><div class='comments'>{f'<p>{LONG} I say.</p>' * 9}</div></body>") == LONG


def test_pages_that_are_one_form():
    text = f"<p>{LONG}</p>" * 3
    assert main_text(f"<body><form id=aspnetForm><div>{text}<input name=q></div></form></body>") == " ".join([LONG] * 3)
    assert main_text(f"<body><div class='page-search'>{text}</div></body>") == " ".join([LONG] * 3)
    assert main_text(f"<body><div id=a>{text}</div><form><p>Your mail, please, and your name, and your street, and your town.</p><input></form></body>") == " ".join([LONG] * 3)


def test_a_subject_is_not_a_place():
    text = f"<p>{LONG}</p>" * 3
    assert main_text(f"<body><article>{text}<div class='legal-text'><p>{LONG} Law.</p></div></article></body>") == " ".join([LONG] * 3) + f" {LONG} Law."


def test_two_articles_of_one_page():
    text = f"<p>{LONG}</p>" * 3
    got = main_text(f"<body><main><article>{text}<p>First, the first.</p></article><article>{text}</article></main><div><p>{LONG}</p></div></body>")
    assert got == " ".join([LONG] * 3 + ["First, the first."] + [LONG] * 3)


def test_an_article_element_beside_the_text_does_not_win():
    text = f"<p>{LONG}</p>" * 5
    assert main_text(f"<body><div class=story>{text}</div><article><p>A teaser of another thing, in few words.</p></article></body>") == " ".join([LONG] * 5)


@pytest.mark.parametrize("tag", ["div", "b", "p", "span", "ul", "li", "table", "form"])
def test_time_is_linear_in_nesting(tag):
    def seconds(n: int) -> float:
        page = f"<{tag}>some words, and more " * n + f"<p>{LONG}</p>"
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(48_000) < 12 * max(seconds(12_000), 0.05)


class Plain(HTMLParser):
    """A tree of (tag, children) for well-formed pages; children are trees and strings."""

    def __init__(self, html: str):
        super().__init__()
        self.root = ("html", [])
        self.open = [self.root]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def plain_main_text(html: str) -> str:
    """Tree scoring by its definition, for pages of div, section, p and a."""
    root = Plain(html).root

    def strings(node, link, deep):
        """Stripped lengths of text in links or not, in the node's own block or in all of it."""
        total = commas = 0
        for c in node[1]:
            if isinstance(c, str):
                total, commas = total + len(c.strip()) * (link is None or link is False), commas + c.count(",")
            elif c[0] == "a":
                inner = strings(c, None, True)
                total, commas = total + inner[0] * (link is None or link is True), commas + inner[1]
            elif deep:
                inner = strings(c, link, True)
                total, commas = total + inner[0], commas + inner[1]
        return total, commas

    points: dict[int, float] = {}
    nodes: list[tuple] = []

    def walk(node, path):
        nodes.append((node, path))
        if node[0] != "a":
            size, commas = strings(node, None, False)
            if size >= 25 and node[0] in ("p", "div", "section"):
                gain = (1 + commas + min(size / 100, 3)) * (1 - strings(node, True, False)[0] / size)
                for share, up in enumerate((path if node[0] == "p" else [*path, node])[::-1][:6], 1):
                    points[id(up)] = points.get(id(up), 0) + gain / share
        for c in node[1]:
            if not isinstance(c, str):
                walk(c, [*path, node])

    walk(root, [])

    def score(node):
        return points.get(id(node), 0) * (1 - strings(node, True, True)[0] / max(strings(node, None, True)[0], 1))

    best, path = max(nodes, key=lambda x: (score(x[0]), -[id(n) for n, _ in nodes].index(id(x[0]))))
    out = []
    for c in path[-1][1] if path else [best]:
        if isinstance(c, str):
            continue
        size, links = strings(c, None, True)[0], strings(c, True, True)[0]
        if c is best or (size and (score(c) >= max(4.0, 0.2 * score(best)) or (c[0] == "p" and links < 0.25 * size and size > 80))):
            out.append(c)

    def flat(node):
        return "".join(c if isinstance(c, str) else flat(c) if c[0] == "a" else f" {flat(c)} " for c in node[1])

    return " ".join(" ".join(map(flat, out)).split())


def test_against_a_plain_scorer():
    rng = random.Random(8)

    def sentence():
        return " ".join(rng.choice(["word", "longer", "text,", "it", "is, so"]) for _ in range(rng.choice([2, 6, 25, 60])))

    def part(depth):
        if depth == 0 or rng.random() < 0.4:
            inner = " ".join(f"<a href=x>{sentence()}</a>" if rng.random() < 0.25 else sentence() for _ in range(rng.choice([1, 2, 3])))
            return f"<p>{inner}</p>"
        tag = rng.choice(["div", "section"])
        own = sentence() if rng.random() < 0.2 else ""
        return f"<{tag}>{own}{''.join(part(depth - 1) for _ in range(rng.randint(1, 4)))}</{tag}>"

    for _ in range(400):
        html = "<body>" + "".join(part(4) for _ in range(rng.randint(1, 4))) + "</body>"
        assert main_text(html) == plain_main_text(html), html


def test_very_long_and_deep_pages():
    html = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(20_000)) + "</article>"
    assert len(main_text(html)) > 20_000 * len(LONG)
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000
    assert main_text(deep) == LONG


@pytest.mark.parametrize(
    "page",
    [
        "<script " * 100_000, "<script></script " * 50_000, '<a href="' * 100_000 + "x", "<a b='" * 100_000, "<a b='" * 100_001 + ">", '<a ">"' * 50_000 + "'", '<a ">"' * 50_000 + "' x>", "<a b=\"c>" * 50_001,
        "<" + "a" * 100_000 + ' "' + "x" * 100_000 + ">", "<div " + "a" * 200_000 + ">x</div>", "<!--" * 100_000, "<!-- x " * 100_000 + "-->", "<!" * 200_000, "<" * 300_000, "<title>" * 50_000 + "<p>x",
    ],
)
def test_unclosed_markup_takes_linear_time(page):
    began = time.process_time()
    assert isinstance(main_text(page), str)
    assert time.process_time() - began < 4
    if page.startswith("<script "):
        assert time.process_time() - began < 2


def test_text_after_the_last_tag_is_text():
    assert main_text(f"<body><p>{LONG}</p> and then 1 < 2 <b") == f"{LONG} and then 1 < 2 <b" or main_text(f"<body><p>{LONG}</p> and then 1 < 2 <b").startswith(LONG)
    assert main_text(f"<body><p>{LONG}</p><!-- never closed, {LONG}") == LONG


def test_parts_of_an_article_that_only_sound_like_comments():
    text = f"<p>{LONG}</p>"

    def kept(page: str) -> int:
        return main_text(page).count(LONG)

    assert kept(f"<body><div class=paper><section id=intro>{text}</section><section id='discussion'>{text}{text}</section></div></body>") == 3
    assert kept(f"<body><article>{text}{text}<section class='discussion'>{text}</section></article></body>") == 3
    assert kept(f"<body><article>{text}{text}<p class='comment'>{LONG}</p>{text}</article></body>") == 4
    assert main_text(f"<body><article><header><h2>Title here</h2></header>{text}{text}</article></body>") == f"Title here {LONG} {LONG}"
    assert kept(f"<body><article>{text}<div class='article-footer'>{text}{text}</div></article></body>") == 3


def test_lists_of_comments_go():
    text = f"<p>{LONG}</p>"
    said = "".join(f"<div class='comment'><span class='author'>{who}</span><p>{LONG} I say.</p></div>" for who in ("Al", "Bo", "Cy"))
    for page in (
        f"<body><article>{text}{text}</article><div class='discussion'>{said}</div></body>",
        f"<body><article>{text}{text}<section id='discussion'>{said}</section></article></body>",
        f"<body><article>{text}{text}<section id='feedback'><div><span class='user'>Al</span><time>today</time><p>{LONG} I say.</p></div></section></article></body>",
        f"<body><article>{text}{text}<div class='comment'><p>{LONG} I say.</p></div><div class='comment'><p>{LONG} I say.</p></div></article></body>",
    ):
        assert main_text(page) == f"{LONG} {LONG}", page


def test_table_with_odd_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
