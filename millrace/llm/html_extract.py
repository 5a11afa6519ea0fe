"""Main-text extraction by line-block distribution.

Markup is stripped to one line per block element; text inside boilerplate elements leaves its line
empty, as markup does. The lengths of the lines are summed over sliding windows; text is kept from
each surge of that sum to the dive that follows. A page that names its content (article, main) has
every line outside it empty and needs no least sum; elsewhere lines that are mostly links count
nothing, a window must exceed SURGE code points to begin and a quarter of it to go on, in the window
that begins with a line or, for text, in the one that ends with it. A page that never surges keeps the
lines that count: short texts, but no lists of links.

Null or empty html gives an empty text. Unclosed, cut or stray markup is tolerated; a tag with an unclosed quote ends at the next >. Repeated rows
each get their own result; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Lines of a window, and the least sum of a window that starts a kept region on pages without article or main.
WINDOW, SURGE = 3, 86

#: Element names by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|audio|video"
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset(("td", "th", "img", "input"))
DROPPED = frozenset("nav header footer aside form menu dialog select button fieldset label head".split())
ROOT = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
#: Words of a class or id that mark an element as something beside the article, if all its other words are NEUTRAL.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist commentform reply replies respond disqus pagination pager widget toolbar skip".split()
)

NEUTRAL = frozenset(
    "site main page post entry article blog global primary secondary top bottom left right upper lower inner outer mini big small sticky fixed mobile desktop user reader js bar box block list links link buttons button icons section container wrapper wrap holder slot unit area zone item items group thread row col column panel text title label content count id x is has the form".split()
)

RAW_OPEN = re.compile(rf"<({RAW})\b", re.I)
RAW_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
TAG_OPEN = re.compile(r"<(/?)[a-z]", re.I)
#: A tag that never ends as one: up to the next mark of a tag, or the end of the page.
LOOSE = re.compile(r"</?[a-z][^<>]*+(?:>|\Z)", re.I)
NAME_CHARS = 100
NAME, STOP = re.compile(rf"[^\s/>]{{0,{NAME_CHARS}}}+"), re.compile(r"[\s/>]")


class Ends:
    """Where tags end: at the first > that is not between quotes. What is found is kept for all marks on the way, so that
    a page of tags without an end is walked once, not from each of them."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.marks = [m.start() for m in re.finditer("[\"'>]", html)]
        self.known: dict[int, int] = {}
        self.stops: list[int] | None = None

    def tag(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin here; -1 if there is none."""
        way, end = [], -1
        while (i := bisect_left(self.marks, at)) < len(self.marks):
            mark = self.marks[i]
            if mark in self.known:
                end = self.known[mark]
                break
            way.append(mark)
            if self.html[mark] == ">":
                end = mark
                break
            if (closing := self.html.find(self.html[mark], mark + 1)) < 0:
                break
            at = closing + 1
        self.known.update(dict.fromkeys(way, end))
        return end

    def name(self, at: int) -> int:
        """Where a name that begins here ends."""
        end = NAME.match(self.html, at).end()
        if end - at < NAME_CHARS:
            return end
        if self.stops is None:
            self.stops = [m.start() for m in STOP.finditer(self.html)]
        i = bisect_left(self.stops, at)
        return self.stops[i] if i < len(self.stops) else len(self.html)


def tokens(html: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """(text, name, closing, attributes) of a page in order: text, or tags, whose text is null. Comments, declarations and elements
    whose content is no text are left out; what is malformed ends at the next mark of a tag. The time grows with the page alone."""
    ends, at, n = Ends(html), 0, len(html)
    while at < n:
        if html[at] != "<":
            to = html.find("<", at)
            to = n if to < 0 else to
            yield html[at:to], "", False, ""
            at = to
            continue
        if html.startswith("<!--", at):
            to = html.find("-->", at + 4)
            at = n if to < 0 else to + 3
            continue
        if (m := RAW_OPEN.match(html, at)) and (end := ends.tag(m.end())) >= 0:
            close = RAW_CLOSE[m[1].lower()].search(html, end + 1)
            at = close.end() if close else n
            continue
        if m := TAG_OPEN.match(html, at):
            begin = m.end() - 1
            stop = ends.name(begin)
            if (end := ends.tag(stop)) >= 0:
                yield None, html[begin:stop].lower(), m[1] == "/", html[stop:end]
                at = end + 1
                continue
        if html[at + 1 : at + 2] in ("!", "?", "/"):
            to = html.find(">", at + 2)
            at = n if to < 0 else to + 1
        elif m := LOOSE.match(html, at):
            at = m.end()
        else:
            yield "<", "", False, ""
            at += 1


ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@lru_cache(maxsize=4096)
def is_mark(name: str) -> bool:
    """Whether a class name or id marks what stands beside the article: share-buttons does, share-price-history does not."""
    words = set(WORD.findall(name))
    return not MARKS.isdisjoint(words) and words <= MARKS | NEUTRAL


def beside(name: str, attrs: str) -> bool:
    """Whether an element is something beside the article."""
    if name in DROPPED:
        return True
    if not attrs or attrs.isspace():
        return False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if name not in ("body", "html") and any(map(is_mark, value.split())):
                return True
        elif key == "role":
            if value in ROLES:
                return True
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif key == "hidden" or value == "true":
            return True
    return False


def to_lines(html: str) -> tuple[list[tuple[str, int]], bool]:
    """Each block's text with its length inside the content root (0: outside or beside the article,
    text of links not counted where there is no root), and whether the page has such a root."""
    lines: list[list] = []
    now: list[str] = []
    linked = depth = roots = 0
    skip = ""
    in_link = False
    rooted = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(now).split())
        lines.append([text, len(text), min(len(text), linked), roots > 0, False])
        now.clear()
        linked = 0

    for text, name, closing, attrs in tokens(html):
        if text is not None:
            if not skip:
                text = unescape(text)
                now.append(text)
                if in_link:
                    linked += len(text)
            continue
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
                    lines.append(["", 0, 0, False, True])
            elif not closing and name in ROOT and (skip == "form" or skip not in DROPPED and not rooted) or closing and name in ("body", "html"):
                skip, depth = "", 0
            if skip or closing:
                continue
        if name in BLOCK and (now or name != "br"):
            if name == "br" and now:
                now.append(" ")
            elif now:
                flush()
        elif name in SPACED:
            now.append(" ")
        if name == "a":
            in_link = not closing
        if closing:
            if name in ROOT:
                roots = max(0, roots - 1)
            continue
        if name not in VOID and beside(name, attrs):
            if now:
                flush()
            skip, depth = name, 1
            continue
        if name in ROOT:
            roots += 1
            rooted = True
    if now:
        flush()
    out = []
    for text, n, of_links, inside, gap in lines:
        if gap:
            out.append(("", 0))
        elif text:
            out.append((text, (n if inside else 0) if rooted else n if n > 2 * of_links else 0))
    return out, rooted


def keep_regions(lines: list[tuple[str, int]], least: int) -> list[str]:
    """The lines from each surge of the windows' sums to the dive after it. Text also goes on where the window
    that ends with it is large enough, so that short last blocks stay."""
    n = len(lines)
    sums = [sum(x[1] for x in lines[i : i + WINDOW]) for i in range(n)]
    back = [sum(x[1] for x in lines[max(0, i - WINDOW + 1) : i + 1]) for i in range(n)]
    kept, i = [], 0
    while i < n:
        if sums[i] > least and lines[i][1]:
            j = i
            while j < n and max(sums[j], back[j]) > least // 4:
                text, size = lines[j]
                if text and (size or least and sums[j] > least // 4):
                    kept.append(text)
                j += 1
            i = j
        else:
            i += 1
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines, rooted = to_lines(html)
    kept = keep_regions(lines, 0 if rooted else SURGE)
    return "\n".join(kept or [t for t, n in lines if n])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page its main text: blocks in page order, one to a line, and the text's length in code points."""

    def start():
        def work(ids: list, urls: list, htmls: list) -> dict:
            texts = [main_text(h) for h in htmls]
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_rows(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), SCHEMA, start)
