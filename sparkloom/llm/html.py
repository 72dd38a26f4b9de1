"""Main text of web pages by tree scoring (operator 1).

Every page is parsed into a tree. Paragraphs of enough text earn points for their length and commas, less the share of
their text that is links; a paragraph's points go whole to its parent, by halves, thirds and so on to the ancestors above. A
container's sum is discounted by its own link density, and the best container is kept, with those siblings that earn
a fifth of its points or look like parts of the same article. An article or main element above it stands for it where it earns enough itself. Elements that
hold no article (menus, asides, footers, scripts) and lists of links are left out; a form is, unless it holds most of the page's text, as on pages that are one form.

Names of class and id weigh: points earned under a name of layout count a fifth. Inside the container that is kept, parts under such a name are
left out, unless they hold most of its text. Names of what stands beside articles (adverts, consent, lists of comments) leave their part out, unless it holds
an article element with most of the page's text; a footer or what is called related or hidden stays, too, where it holds a third of it. "comment", "discussion" and the like may name
a part of the article: such a part goes only if its form confirms it, being one of several side by side or holding authors, dates or answers twice. If nothing is left then, or
little and no article element is there, all names weigh only. A name counts by what it is a name of: "site-footer" and "comments-area" do, "with-sidebar" and "comments-open" do not.

Time is linear in the length of a page, however deep its tree is: nothing after the last ">" is taken for a tag, and after OPEN_QUOTES tags whose quotes never close, quotes part nothing.

Text is the character data with references decoded; white space in a block becomes one space; blocks are joined in page order by one
space. Nothing is cut to a length.

Defined results: a null or empty page, or one without text, gives the empty text; markup that is never closed is closed at the end
of the page; repeated pages are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches, with_columns

_TAG = re.compile(
    r"""<(?:!--(?:.*?-->|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|[!?/][^>]*>)""",
    re.S,
)
_PLAIN_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|()()()(?!)|(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|[!?/][^>]*>)""", re.S)
#: Tags with a quote that is never closed, after which quotes are not looked for any more.
OPEN_QUOTES = 64
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea title select audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
DROPPED = frozenset("nav aside footer menu dialog button fieldset input head search".split())
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td th thead tfoot tr ul".split()
)
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot tr td th div section article main body html aside nav header footer form blockquote".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body figcaption".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split())
# Words of class and id that name what is not the article.
DROPPED_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer sidebar sidebars aside widget widgets rail
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay disclaimer copyright legal paywall
    newsletter subscribe subscription signup login signin register form search share sharing shares social related recommended recommendations
    recommend comment comments commentlist commentary disqus respond reply replies discussion feedback skip hidden""".split()
)
# Names of parts that may hold more text than the article does.
ELSEWHERE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adbox adslot sponsor sponsored sponsors promo promos promotion
    cookie cookies consent gdpr popup modal overlay related recommended recommendations recommend
    comments commentlist disqus respond reply replies hidden footer""".split()
)
# Of these, a part that holds a third of the page's text is not left out for its name.
SHARED_WORDS = frozenset("related recommended recommendations recommend hidden footer".split())
# Names of parts that only their form tells from parts of an article: a list of comments repeats a part, or authors and dates.
FORM_WORDS = frozenset("comment commentary discussion feedback".split())
SIGNS = frozenset("author user username avatar byline date datetime time timestamp posted permalink ago vote votes upvote downvote reply replies says wrote commenter".split())
# What is in a part of such a name is about that subject, not a part of the layout.
SUBJECT_WORDS, TEXT_WORDS = frozenset("legal copyright notice register search form alert".split()), frozenset("text body article articles story post content main".split())
# Words that tell where or in what form the thing named before them stands, and words that tell of a state.
PLACE_WORDS = frozenset(
    """area areas bar block body bottom box btn button buttons center col column container content entry entries field group head heading holder icon icons
    inner item items label layout left link links list main message module outer page panel part post posts article articles primary region right row secondary
    section site slot stories story text thread title top unit wrap wrapper zone""".split()
)
STATE_WORDS = frozenset("with has have no not non without open opened closed enabled disabled active show hide after before below above allowed off on".split())
# Compound names whose words alone say nothing.
DROPPED_NAMES = re.compile(r"(?:side-?bar|read-?more|most-?(?:read|popular)|see-?also|you-?may|call-?to|back-?to-?top|site-?(?:head|info)|page-?(?:head|foot)|user-?comment)(?:er|s)?", re.I)


def _names(token: str) -> str | None:
    """The word of DROPPED_WORDS that one class or id is a name of."""
    words = [w.lower() for w in _WORD.findall(token)]
    if not STATE_WORDS.isdisjoint(words):
        return None
    about = False
    while len(words) > 1 and (words[-1] in PLACE_WORDS or words[-1].isdigit()):
        about = about or words.pop() in TEXT_WORDS
    if about and words[-1] in SUBJECT_WORDS:
        return None
    return words[-1] if words and words[-1] in DROPPED_WORDS else None


@lru_cache(1 << 14)
def named(label: str) -> int:
    """What the names in class and id say: 0 nothing, 1 layout that is not the article, 2 a part whose form decides, 3 a part that is not the article unless
    it holds much of the text, 4 one that is not it even if it holds most text."""
    found = [_names(t) or _names(DROPPED_NAMES.sub(" sidebar ", t)) for t in label.split()]
    return max((2 if w in FORM_WORDS else 1 if w not in ELSEWHERE_WORDS else 3 if w in SHARED_WORDS else 4 for w in found if w), default=0)


@lru_cache(1 << 14)
def signed(label: str) -> bool:
    """Whether a class or id names what stands at every comment: its author, date or answers."""
    return any(w.lower() in SIGNS for t in label.split() for w in _WORD.findall(t))


class Page:
    """A parsed page: nodes in page order, and the pieces of text with the node that holds each."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs = ["html"], [-1], [""]
        self.pieces: list[tuple[int, str]] = []  # (node, text); (node, "\n") parts two blocks
        self._stack = [0]
        self._open_at: dict[str, list[int]] = {"html": [0]}  # places in the stack of the open elements of each name
        self._parse(html)

    def _add(self, tag: str, attrs: str, opens: bool) -> None:
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.attrs.append(attrs)
        if opens:
            self._open_at.setdefault(tag, []).append(len(self._stack))
            self._stack.append(len(self.tag) - 1)

    def _last(self, names: Iterable[str]) -> int:
        """The place in the stack of the last open element of these names, 0 for none."""
        return max((at[-1] for n in names if (at := self._open_at.get(n))), default=0)

    def _cut(self, place: int) -> None:
        """Closes the element at this place and all in it; the root stays open."""
        while len(self._stack) > max(place, 1):
            self._open_at[self.tag[self._stack.pop()]].pop()

    def _close(self, names: tuple[str, ...], scopes: frozenset[str]) -> None:
        """Closes the last open element of these names, unless one of the scopes was opened after it."""
        if (place := self._last(names)) and place > self._last(scopes.difference(names)):
            self._cut(place)

    def _parse(self, html: str) -> None:
        stack, pieces, at, n = self._stack, self.pieces, 0, len(html)
        search, last, open_quotes = _TAG.search, html.rfind(">") + 1, 0
        while at < n:
            # What follows the last ">" closes no tag; only a comment may still begin there, and takes all the rest.
            m = search(html, at, last) if at < last else None
            if m is None:
                begun = html.find("<!--", at)
                if begun >= 0:
                    pieces.append((stack[-1], html[at:begun]))
                    return
                pieces.append((stack[-1], html[at:]))
                return
            if m.start() > at:
                pieces.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            if m[5] and ('"' in m[6] or "'" in m[6]):
                open_quotes += 1
                if open_quotes == OPEN_QUOTES:
                    search = _PLAIN_TAG.search
            tag, attrs = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                if tag not in INLINE:
                    pieces.append((stack[-1], "\n"))
                if tag == "p" or tag in INLINE:
                    self._close((tag,), SCOPES)
                elif self._open_at.get(tag):
                    self._cut(self._open_at[tag][-1])
                continue
            if tag in VOID:
                if tag not in ("wbr", "img"):
                    pieces.append((stack[-1], "\n"))
                continue
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at, last)
                at = end.end() if end else n
                if tag not in ("svg", "math"):
                    pieces.append((stack[-1], "\n"))
                continue
            if tag in ("html", "body") and self._open_at.get(tag):
                continue
            if tag in CLOSES_P:
                self._close(("p",), SCOPES)
            if tag in CLOSES:
                self._close(CLOSES[tag], SCOPES - frozenset(CLOSES[tag]))
            if tag not in INLINE:
                pieces.append((stack[-1], "\n"))
            self._add(tag, attrs, not attrs.endswith("/") or tag in CLOSES_P)

    def unlikely(self, by_name: bool = True) -> list[bool]:
        """Nodes that are left out by element, role, or the names in class and id, and all below them; ``lowered`` has those whose names only
        weigh, and with by_name false all named ones."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        holds, heads, in_article = [False] * n, [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            holds[parent[k]] |= tag[k] in ("h1", "main") or holds[k]
            heads[parent[k]] |= tag[k] in ("h1", "h2", "h3") or heads[k]
        out, names, forms, signs, like = [False] * n, {}, [], [0] * n, Counter()
        for k in range(1, n):
            p, t = parent[k], tag[k]
            in_article[k] = in_article[p] or t in ("article", "main")
            out[k] = out[p] or t in DROPPED or (t == "header" and not (in_article[p] and heads[k]))
            if out[k]:
                continue
            attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(self.attrs[k])} if self.attrs[k] else {}
            signs[k] = t == "time" or signed(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('rel', '')}")
            if t == "form" or attrs.get("role", "").lower() == "form":
                forms.append(k)
            if not attrs and not self.attrs[k] or t in ("html", "body", "main"):
                continue
            if attrs.get("role", "").lower() in DROPPED_ROLES or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|$|=)", self.attrs[k]):
                out[k] = True
                continue
            label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
            if label != " " and t != "h1" and not holds[k] and t != "form" and (kind := named(label)):
                names[k] = kind
                like[p, t] += kind == 2
        for k in range(n - 1, 0, -1):
            signs[parent[k]] += signs[k]
        # A part whose form decides is a list of comments, or one of several, or it only weighs.
        self.named_parts = {k for k, kind in names.items() if kind == 2 and signs[k] < 2 and like[parent[k], tag[k]] < 2}
        self.lowered = set(names)
        size = self.paragraph_text(out) if forms or names else []
        for k in forms:
            out[k] = not (2 * size[k] > size[0] and (size[k] >= 200 or holds[k]))
        if forms:
            for k in range(1, n):
                out[k] = out[k] or out[parent[k]]
        if not names or not by_name:
            return out
        size = self.paragraph_text(out) if forms else size
        article = [tag[k] == "article" and 2 * size[k] > size[0] for k in range(n)]
        for k in range(n - 1, 0, -1):
            article[parent[k]] = article[parent[k]] or article[k]
        for k in range(1, n):
            kind = names.get(k, 0)
            out[k] = out[k] or out[parent[k]] or (kind > 1 and k not in self.named_parts and not article[k] and not (kind == 3 and 3 * size[k] > size[0]))
        return out

    def paragraph_text(self, out: list[bool]) -> list[int]:
        """Characters of paragraphs, outside links and nodes left out, in each node and all below it."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        block, in_link, size, total = list(range(n)), [False] * n, [0] * n, [0] * n
        for k in range(1, n):
            block[k] = block[parent[k]] if tag[k] in INLINE else k
            in_link[k] = in_link[parent[k]] or tag[k] == "a"
        for k, t in self.pieces:
            if not out[k] and not in_link[k]:
                size[block[k]] += len(t.strip())
        for k in range(n - 1, -1, -1):
            total[k] += size[k] if size[k] >= 25 and tag[k] in PARAGRAPHS else 0
            if k:
                total[parent[k]] += total[k]
        return total

    def text(self, kept: list[bool]) -> str:
        return " ".join("".join([unescape(t) if "&" in t else t for k, t in self.pieces if kept[k]]).split())


#: Weight of points earned under a name of layout, and the share of the best container's points that an article element above it must earn itself.
NAMED, ABOVE = 0.2, 0.2


def best_nodes(page: Page, out: list[bool]) -> list[int]:
    """The best container and the siblings that belong to it."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    chars, linked, commas, direct = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[parent[k]] or tag[k] == "a"
    block = [0] * n  # the nearest node that is not inline
    for k in range(1, n):
        block[k] = block[parent[k]] if tag[k] in INLINE else k
    for k, t in page.pieces:
        if out[k] or not (t := t.strip()):
            continue
        size, own = len(t), block[k]
        chars[own] += size
        direct[own] += size
        commas[own] += t.count(",") + t.count("，") + t.count("、")
        if in_link[k]:
            linked[own] += size
    own_chars, own_linked = chars[:], linked[:]
    for k in range(n - 1, 0, -1):
        chars[parent[k]] += chars[k]
        linked[parent[k]] += linked[k]
    points, weight = [0.0] * n, [1.0] * n
    for k in range(1, n):
        weight[k] = weight[parent[k]] * (NAMED if k in page.lowered else 1)
        if direct[k] < 25 or out[k] or tag[k] not in PARAGRAPHS:
            continue
        gain = (1 + commas[k] + min(own_chars[k] / 100, 3)) * (1 - own_linked[k] / own_chars[k]) * weight[k]
        # Text that stands in a container itself counts for that container as for a parent.
        up, share = (parent[k], 1) if tag[k] in ("p", "pre", "blockquote", "td", "li", "dd", "figcaption") else (k, 1)
        while up >= 0 and share <= 6:
            points[up] += gain / share
            up, share = parent[up], share + 1
    for k in range(n):
        if points[k]:
            points[k] *= 1 - linked[k] / max(chars[k], 1)
    bonus = [5 * weight[k] if points[k] and tag[k] in ("article", "main") else 0 for k in range(n)]
    best = max(range(n), key=lambda k: (points[k] + bonus[k], -k))
    if not points[best]:
        rank = {"article": 0, "main": 1, "body": 2}
        named = [k for k in range(n) if not out[k] and tag[k] in rank and chars[k]]
        return [min(named, key=lambda k: (rank[tag[k]], -chars[k]))] if named else [0]
    # An article or main element that earns enough of the points stands for a container in it: its heading and its other parts belong to it.
    up, whole = best, None
    while up >= 0:
        if tag[up] in ("article", "main") and (whole is None or tag[whole] != "article") and points[up] >= ABOVE * points[best]:
            whole = up if whole is None or tag[up] == "article" else whole
        up = parent[up]
    best = best if whole is None else whole
    found, least = [best], max(4.0, points[best] * 0.2)
    for k in range(1, n):
        if k == best or parent[k] != parent[best] or out[k] or not chars[k]:
            continue
        density = linked[k] / chars[k]
        # Beside sections of one paper, a part that may be one of them is measured by its full points.
        own = points[k] / NAMED if k in page.named_parts and tag[best] not in ("article", "main") else points[k]
        if tag[k] == "h1" or (tag[best] != "main" and own >= least) or (whole is None and tag[k] in ("p", "pre", "blockquote", "h2", "h3") and density < 0.25 and (chars[k] > 80 or tag[k] != "p")):
            found.append(k)
    return found


def main_text(html: str | None) -> str:
    """The article's text of one page; the empty text if there is none."""
    if not html:
        return ""
    page = Page(html)
    out = page.unlikely()
    text = _kept_text(page, out)
    if page.lowered and len(text) < 200:
        was = page.paragraph_text(out)
        if not text or not any(t in ("article", "main") and size for t, size in zip(page.tag, was, strict=True)):
            again = _kept_text(page, page.unlikely(by_name=False))
            return again if not text or len(again) > 4 * len(text) else text
    return text


def _kept_text(page: Page, out: list[bool]) -> str:
    n, tag, parent = len(page.tag), page.tag, page.parent
    roots = best_nodes(page, out)  # the best container first
    kept, above, in_link = [False] * n, set(), [False] * n
    up = roots[0]
    while up >= 0:
        above.add(up)
        up = parent[up]
    links, chars = [0] * n, [0] * n
    for k in range(1, n):
        in_link[k] = in_link[parent[k]] or tag[k] == "a"
    for k, t in page.pieces:
        size = len(t.strip())
        chars[k] += size
        links[k] += size * in_link[k]
    for k in range(n - 1, 0, -1):
        chars[parent[k]] += chars[k]
        links[parent[k]] += links[k]
    held, chosen = page.paragraph_text(out) if page.lowered else [], set(roots)
    for k in range(n):
        listed = tag[k] in ("ul", "ol", "table", "dl") and chars[k] and links[k] > 0.6 * chars[k]  # a list of links
        layout = k in page.lowered and k not in page.named_parts and k not in above and 2 * held[k] <= held[roots[0]]
        kept[k] = not out[k] and not listed and not layout and (k in chosen or (k > 0 and kept[parent[k]]))
    return page.text(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                texts = [main_text(h) for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    small_batches(pages.sparkSession)
    return with_columns(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
