"""Main text of web pages by tag-path ratios.

Every text node hangs at the end of a root-to-leaf tag path. Per page and path, text length and
punctuation are summed; a path's text ratio is its characters per text node, its punctuation ratio
one plus the punctuation per text node. Both are smoothed over the paths in page order (a Gaussian
weighted by the paths' nodes), fused by their product, and paths at or above the page's threshold (a
share of the standard deviation of the fused ratios) are content paths. The innermost element that
holds three quarters of the text on content paths is the article; so headings and short lines between
content nodes stay. Where that is the whole page (a short article in a large frame), names break the
tie: the ratios are taken again without elements that are called navigation, header, footer or sidebar.
Such elements inside of the article go too; one that the article itself lies in, by its ratios, was badly named.
Elements called advert, form, notice or comment go before any ratio, as none tells them from prose.

Pages are independent: one Arrow map over the table, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import small_batches

#: HTML's element groups and the usual names of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FRAME = frozenset("nav header footer aside menu".split())
NEVER = frozenset("form button dialog label head".split())
LANDMARK = frozenset(["article", "main"])
CONTAINER = LANDMARK | frozenset("body center div section td".split())
ENDS_P = BLOCK - frozenset("html body".split())
ENDS_OWN = {"li": {"ul", "ol", "menu"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
BAD_NAME = re.compile(r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?(?:-?(?:banner|notice|consent|bar))?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|comment-list|disqus|replies|respond|reactions?|widget|copyright|legal)(?![a-z])")
FRAME_NAME = re.compile(r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|header|masthead|toolbar|pagination|pager|skip-link)(?![a-z])")
GOOD_END = re.compile(r"(?:^|[^a-z])(?:article|entry|post|story|main|body|content)$")
BAD_ROLE = frozenset("search dialog alert form".split())
FRAME_ROLE = frozenset("navigation banner contentinfo complementary menu menubar toolbar".split())
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|_")


@dataclass(slots=True)
class Node:
    """An open element: its tag path and the container around it as numbers; whether it is no part of an article.

    ``frame``: how many containers had opened when the innermost frame element around it began, -1 for none.
    """

    name: str
    path: int
    container: int
    apart: bool = False
    frame: int = -1


@dataclass(slots=True)
class Block:
    """Text of one block: the pieces of text between block boundaries, with path, container, whether they are apart, and frame."""

    pieces: list[tuple[str, int, int, bool, int]] = field(default_factory=list)


@dataclass
class Page:
    """Blocks in order, and the page's containers by number: the end of the range of numbers that each one holds."""

    blocks: list[Block] = field(default_factory=list)
    ends: list[int] = field(default_factory=lambda: [0])

    def holds(self, container: int, other: int) -> bool:
        return container <= other < self.ends[container]


def _attributes(tag: str) -> tuple[bool, bool, bool]:
    """(says that it is no part of an article, says that it is the page's frame, is hidden)."""
    bad = frame = hidden = False
    for key, value in ATTRIBUTE.findall(tag[NAME.match(tag).end() :]):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden":
            hidden = True
        elif key == "style":
            hidden = hidden or bool(HIDDEN.search(value))
        elif key == "role":
            bad, frame = bad or value.lower() in BAD_ROLE, frame or value.lower() in FRAME_ROLE
        elif key in ("class", "id"):
            for word in value.split():
                word = CAMEL.sub("-", word).lower()
                bad = bad or bool(BAD_NAME.search(word))
                frame = frame or bool(FRAME_NAME.search(word)) and not GOOD_END.search(word)
    return bad, frame, hidden


def tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """End of the tag that starts at ``at``; quotes may hold '>'. last: place of the last quote of each kind."""
    at += 1
    while m := STOP.search(source, at):
        at = m.end()
        if m[0] == ">":
            return at
        if last[m[0]] >= at:  # a quote that is never closed is a character like any other
            at = source.index(m[0], at) + 1
    return len(source)


def parse(source: str) -> Page:
    """The page's text blocks in order, with unclosed elements closed as browsers do. Time is linear in its length."""
    page, stack, current, at, n = Page(), [Node("", 0, 0)], Block(), 0, len(source)
    paths: dict[tuple[int, str], int] = {}
    is_open, inside = Counter(), 0  # open elements by name, open landmarks
    last = {q: source.rfind(q) for q in "\"'"}

    def cut():
        nonlocal current
        if current.pieces:
            page.blocks.append(current)
            current = Block()

    def text(s: str):
        top = stack[-1]
        current.pieces.append((html.unescape(s), top.path, top.container, top.apart, top.frame))

    def close(k: int):
        nonlocal inside
        if any(x.name in BLOCK for x in stack[k:]):
            cut()
        for x in stack[k:]:
            is_open[x.name] -= 1
            inside -= x.name in LANDMARK
        for x in reversed(stack[k:]):
            if x.name in CONTAINER:
                page.ends[x.container] = len(page.ends)
        del stack[k:]

    def close_one(name: str, until) -> None:
        """Close the innermost open element of that name, unless one of ``until`` is inside of it."""
        if is_open[name]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    return close(k)
                if stack[k].name in until:
                    return None
        return None

    while at < n:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        if start > at:
            text(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith("<![CDATA[", start):
            end = source.find("]]>", start)
            text(source[start + 9 : n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        if source[start + 1 : start + 2] in ("!", "?") and start + 1 < n:
            end = source.find(">", start)
            at = n if end < 0 else end + 1
            continue
        name = NAME.match(source, start)
        if not name:
            text("<")
            at = start + 1
            continue
        at = tag_end(source, start, last)
        tag, name = source[start:at], name[1].lower()
        if tag[1] == "/":
            if name == "p" and not is_open["p"]:
                cut()
            close_one(name, () if name in BLOCK else BLOCK)  # an inline end tag stays in its block
            continue
        if name in RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            continue
        if name in ENDS_P:  # a block ends an open paragraph, with what it holds
            close_one("p", BLOCK - {"p"})
        if name in ENDS_OWN:
            close_one(name, ENDS_OWN[name])
        if name in BLOCK:
            cut()
        elif name == "br":
            text(" ")
        if name in VOID or tag.endswith("/>") and name not in BLOCK:
            continue
        bad, frame, hidden = _attributes(tag) if any(c in tag for c in " \n\t\r\f/") else (False, False, False)
        top, container, number = stack[-1], stack[-1].container, len(page.ends)
        if name in CONTAINER:
            container = len(page.ends)
            page.ends.append(n)
        if name in LANDMARK:  # a comment is often an article inside the article
            apart, frame = hidden or bad and inside > 0, frame and inside > 0
        else:
            apart = hidden or bad and name not in ("html", "body") or name in NEVER
            frame = frame and name not in ("html", "body") or name in FRAME and not (name == "header" and inside and not frame)  # an article's own heading
        stack.append(Node(name, paths.setdefault((top.path, name), len(paths) + 1), container, top.apart or apart, number if frame else top.frame))
        is_open[name] += 1
        inside += name in LANDMARK
    cut()
    close(1)
    page.ends[0] = len(page.ends)
    return page


def _smooth(values: list[float], weight: list[int]) -> list[float]:
    """Gaussian over neighbours in page order, radius 1, weighted by the paths' text nodes."""
    g = (math.exp(-0.5), 1.0, math.exp(-0.5))
    out = []
    for i in range(len(values)):
        near = [(g[j - i + 1] * (weight[j] if j != i else max(weight[j], 1)), values[j]) for j in range(max(0, i - 1), min(len(values), i + 2))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_paths(parts: list[tuple[int, str]], share: float) -> set[int]:
    """Content paths of (path, text) parts: fused smoothed ratios at or above the threshold."""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in parts:
        size[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    paths = list(size)
    weight = [count[p] for p in paths]
    length = _smooth([size[p] / count[p] for p in paths], weight)
    points = _smooth([1 + marks[p] / count[p] for p in paths], weight)
    fused = [a * b for a, b in zip(length, points, strict=True)]
    if not fused:
        return set()
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    return {p for p, x in zip(paths, fused, strict=True) if x >= share * deviation}


def article(page: Page, found: list[tuple[str, int, int, int]], share: float) -> int:
    """The innermost container that holds three quarters of the text on content paths of (text, path, container, frame)."""
    paths = content_paths([(p, t) for t, p, _, _ in found], share)
    own = [0] * len(page.ends)
    for t, p, c, _ in found:
        if p in paths:
            own[c] += len(t)
    upto = list(accumulate(own, initial=0))  # containers are numbered as they open, so one holds a range of them
    return max((c for c, end in enumerate(page.ends) if 4 * (upto[end] - upto[c]) >= 3 * upto[-1]), default=0)


def main_text(source: str | None, share: float = 0.5) -> str:
    """The main text: blocks joined by one newline, white space inside a block one space. Null: ''."""
    if not source:
        return ""
    page, found = parse(source), []
    for b in page.blocks:
        for frame in sorted({p[4] for p in b.pieces}):  # a block is of one kind, unless an inline element says otherwise
            pieces = [p for p in b.pieces if not p[3] and p[4] == frame]
            text = SPACE.sub(" ", "".join(p[0] for p in pieces)).strip()
            if text:
                found.append((text, max(pieces, key=lambda p: len(p[0]))[1], pieces[0][2], frame))
    region = article(page, found, share)
    if all(page.holds(region, c) for _, _, c, _ in found):
        region = article(page, [x for x in found if x[3] < 0], share)
    inside = [x for x in found if page.holds(region, x[2])]
    own = [x for x in inside if x[3] <= region]  # frames that begin inside of the region are not the article
    return "\n".join(x[0] for x in own or inside)


def extract(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points). ``share``: threshold in standard deviations.

    A null or empty html has an empty text, as has a page without text; a null page_id or url stays null;
    repeated rows each give one; an empty table gives an empty one. Pages are read whole, however long, in time
    linear in their length. Of containers that hold equal shares the innermost, then the last is the article.
    Other columns are ignored, whatever their names.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, share) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
