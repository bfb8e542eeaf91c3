"""Operator 2: main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, in page order; what can't be an article
(scripts, menus, headers, footers, sidebars, notices, adverts, forms, comments) leaves no line.
A line's length is its text outside links. Lengths are summed over sliding windows of WINDOW lines.
Where the sum first exceeds SURGE a stretch begins (a surge point), where it falls to nothing it
ends (a dive point). The stretches are the main text, and every line in them is kept. A box (div,
section, cell; else the page) whose own text makes up a stretch is kept from its first to its last
line of text, so links inside an article, and short lines before and after, don't cut it.

An article or main element, or a box named like one, adds weight only: its lines count WEIGHT times,
for the windows and when stretches are held against each other. One without a surge is an ordinary
box. Text of less weight a line goes if a box of more weight a line holds as much; all boxes of the
greatest weight that surge are kept. All work is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.store import small_batches

WINDOW = 3
SURGE = 120
#: How often a line counts outside any such box, in a main element or a box named like one, and in an article element.
WEIGHT = (1, 2, 4)

_NAME = re.compile(r"</?+([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r">|=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

_RAW = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_DROP = frozenset("head nav footer aside form button dialog menu fieldset".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements around which the page changes its subject.
_SECTION = frozenset("section table header".split())
#: Block elements of running text; any other one is a box.
_FLOW = frozenset("html body p ul ol li dl dt dd blockquote pre figure figcaption address details summary center hr table caption tbody thead tfoot tr".split()) | _HEADING
#: Elements that an open p ends at.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words in a class or id that name what isn't the article.
_BOILER = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Beginnings of such words.
_BOILER_BEGIN = ("advert", "adsense", "breadcrumb", "comment", "cookie", "disqus", "newsletter", "popup", "sidebar", "sponsor")
#: Words that deny what they stand with: with-sidebar, has-ads.
_DENY = frozenset("with has no not without".split())
#: Words that name the article's own box, where no element does.
_BOX = frozenset("article articlebody content entry main post story".split())
#: What an article or main element can be besides the article.
_NOT_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted related replies reply sponsored teaser".split())
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_ALWAYS = frozenset("html body".split())


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}


def _names(value: str) -> Iterator[list[str]]:
    """The words of each class or id."""
    for name in value.split():
        parts = [x.lower() for x in _PART.findall(name)]
        if parts and not _DENY.intersection(parts):
            yield parts


def _named(value: str, tag: str) -> bool:
    """Whether a class or id names something else than the article."""
    ends = {x for parts in _names(value) for x in (parts[0], parts[-1])}
    if tag in ("article", "main"):
        return bool(ends & _NOT_ARTICLE)
    return bool(ends & _BOILER) or any(x.startswith(_BOILER_BEGIN) for x in ends)


def _kind(tag: str, raw: str) -> str:
    """'drop', 'head' (only headings stay), 'article', 'main' or ''."""
    if tag in _ALWAYS:
        return ""
    a = _attributes(raw) if raw.strip() else {}
    role = a.get("role", "").lower()
    if tag in _DROP or role in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "").lower()):
        return "drop"
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if tag == "header":
        return "head"
    if names.strip() and _named(names, tag):
        ends = [parts[-1] for parts in _names(names) if parts[0] in _BOILER or parts[-1] in _BOILER]
        return "head" if ends and all(x == "header" for x in ends) else "drop"
    if tag == "article" or "articlebody" in a.get("itemprop", "").lower() or role == "article":
        return "article"
    if tag == "main" or role == "main":
        return "main"
    if tag in ("div", "section", "td") and any(parts[-1] in _BOX or parts[0] in _BOX for parts in _names(names)):
        return "main"
    return ""


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, whether it closes, name, attributes) of all markup in order; comments and declarations have no name.

    A quote after = protects what is in it. Where that leaves a tag without an end, quotes count no
    more from there on, so a page is read about twice at most.
    """
    at, n, last = 0, len(page), page.rfind(">")
    gone, broken = set(), False
    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            yield begin, at, False, "", ""
        elif begin < last:
            m = _NAME.match(page, begin)
            if not m:
                if page[at] in "!?/":
                    at = page.find(">", begin) + 1
                    yield begin, at, False, "", ""
                continue
            end, seek = -1, m.end()
            while not broken and (stop := _STOP.search(page, seek)):
                if not stop[1]:
                    end = stop.start()
                    break
                seek = stop.end()
                if stop[1] not in gone:
                    close = page.find(stop[1], seek)
                    if close < 0:
                        gone.add(stop[1])
                    else:
                        seek = close + 1
            if end < 0:
                broken, end = True, page.find(">", m.end())
            at = end + 1
            yield begin, at, page[begin + 1] == "/", m[1].lower(), page[m.end() : end]


class _Lines:
    """Blocks of text with their length outside links and the article, main element and box they are in."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int, int, int]] = []
        #: Of each box, the one around it and the last one in it; box 0 is the page. Boxes are numbered as they open.
        self.around, self.until = [-1], [0]
        self.box = 0
        self.parts: list[str] = []
        self.plain = 0

    def open(self) -> None:
        self.around.append(self.box)
        self.until.append(0)
        self.box = len(self.around) - 1

    def close(self) -> None:
        self.until[self.box] = len(self.around) - 1
        self.box = self.around[self.box]

    def end(self, article: int, main: int) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.lines.append((text, self.plain, article, main, self.box))
            self.parts, self.plain = [], 0

    def gap(self) -> None:
        if self.lines and self.lines[-1][0]:
            self.lines.append(("", 0, 0, 0, self.box))


class _Open:
    """The open elements, with the places of each tag and of those that are blocks."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []  # tag and kind
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, kind: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, kind))

    def pop(self) -> tuple[str, str]:
        tag, kind = self.stack.pop()
        self.at[tag].pop()
        if tag not in _INLINE:
            self.blocks.pop()
        return tag, kind

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""


def lines(page: str) -> tuple[list[tuple[str, int, int, int, int]], list[int]]:
    """(text, length outside links, article, main, box) of each block; ("", 0, 0, 0, box) where a section changes.

    And of each box the last one in it.
    """
    out, held = _Lines(), _Open()
    dropped = heads = links = articles = mains = headings = 0
    article, main = [0], [0]
    at, n = 0, len(page)

    def pop() -> None:
        nonlocal dropped, heads, links, headings
        tag, kind = held.pop()
        if tag not in _INLINE:
            out.end(article[-1], main[-1])
            if tag not in _FLOW:
                out.close()
        if kind == "drop":
            dropped -= 1
        elif kind == "head":
            heads -= 1
        elif kind == "article":
            article.pop()
        elif kind == "main":
            main.pop()
        if tag == "a":
            links -= 1
        if tag in _HEADING:
            headings -= 1

    for begin, end, closes, tag, raw in tags(page):
        if begin < at:
            continue  # inside a script
        text = page[at:begin]
        if text and not dropped and (not heads or (headings and (article[-1] or main[-1]))):
            out.parts.append(text)
            if not links:
                out.plain += len(text.strip())
        at = end
        if not tag:
            continue
        if not closes:
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = (page.find(">", close.end()) + 1 or n) if close else n
                out.parts.append(" ")
                continue
            if tag == "br":
                out.parts.append(" ")
            if tag in _ENDS_P and held.at.get("p"):
                while held.top() in _INLINE or held.top() == "p":
                    last = held.top()
                    pop()
                    if last == "p":
                        break
            if tag not in _INLINE:
                out.end(article[-1], main[-1])
                if tag in _SECTION:
                    out.gap()
            if tag in _VOID or raw.endswith("/") and tag in ("path", "use"):
                continue
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and held.top() == tag:
                pop()
            kind = _kind(tag, raw)
            held.push(tag, kind)
            if tag not in _INLINE and tag not in _FLOW:
                out.open()
            dropped += kind == "drop"
            heads += kind == "head"
            links += tag == "a"
            headings += tag in _HEADING
            if kind == "article":
                articles += 1
                # An article in an article is part of it.
                article.append(article[-1] or articles)
            elif kind == "main":
                mains += 1
                main.append(main[-1] or mains)
        elif held.at.get(tag):
            if tag in _INLINE and held.blocks and held.blocks[-1] > held.at[tag][-1]:
                # A stray end of an inline element doesn't close blocks opened in it.
                continue
            while held.top() != tag:
                pop()
            pop()
            if tag in _SECTION:
                out.gap()
    text = page[at:]
    if text and not dropped and (not heads or (headings and (article[-1] or main[-1]))):
        out.parts.append(text)
        if not links:
            out.plain += len(text.strip())
    while held.stack:
        pop()
    out.end(0, 0)
    out.until[0] = len(out.around) - 1
    return out.lines, out.until


def surges(lengths: list[int]) -> list[tuple[int, int]]:
    """The stretches: from each surge point to the dive point behind it."""
    total = np.concatenate(([0], np.cumsum(np.array([*lengths, *[0] * WINDOW], np.int64))))
    sums = (total[WINDOW:] - total[:-WINDOW])[: len(lengths)].tolist()
    out, begin = [], None
    for i, s in enumerate([*sums, 0]):
        if begin is None and s > SURGE and lengths[i]:
            begin = i
        elif begin is not None and not s:
            out.append((begin, i))
            begin = None
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by two newlines; empty for null, empty or text-less pages."""
    found, until = lines(page) if page else ([], [])
    regions: dict[tuple[int, int], list[int]] = {}
    for i, (_, _, a, m, _) in enumerate(found):
        if a or m:
            regions.setdefault((2, a) if a else (1, m), []).append(i)
    # A box without a surge of its own is like any other; if nothing surges it is the best there is.
    grown = {key: at for key, at in regions.items() if surges([WEIGHT[key[0]] * found[i][1] for i in at])}
    inside = {i for at in grown.values() for i in at}
    rest = [("", 0, 0, 0, x[4]) if i in inside else x for i, x in enumerate(found)]
    lengths = [0 if _COPYRIGHT.match(x[0]) else x[1] for x in rest]
    spans = surges(lengths)
    if not grown and not spans:
        top = max((key[0] for key in regions), default=0)
        short = sorted(i for key, at in regions.items() if key[0] == top for i in at)
        return "\n\n".join(found[i][0] for i in short or range(len(found)) if found[i][0] and (short or lengths[i]))
    mass = {key: WEIGHT[key[0]] * sum(found[i][1] for i in at) for key, at in grown.items()}
    best = [max((m for key, m in mass.items() if key[0] > k), default=-1) for k in range(3)]
    keep = _stretches(rest, lengths, until, [(a, z) for a, z in spans if sum(lengths[a:z]) > best[0]])
    for key, at in grown.items():
        if mass[key] > best[key[0]]:
            some = [i for i in at if found[i][1]]
            for i in at:
                keep[i] = some[0] <= i <= some[-1]
    return "\n\n".join(x[0] for x, k in zip(found, keep, strict=True) if k and x[0])


def _stretches(found: list, lengths: list[int], until: list[int], spans: list[tuple[int, int]]) -> list[bool]:
    """Which lines stand between surge and dive points, or belong with such."""
    ends: dict[int, tuple[int, int]] = {}
    for i, x in enumerate(found):
        if lengths[i]:
            ends[x[4]] = ends.get(x[4], (i, i))[0], i + 1
    kept = np.zeros(len(found) + 1, np.int64)
    before = 0
    for a, z in spans:
        own: dict[int, int] = {}
        for x, n in zip(found[a:z], lengths[a:z], strict=True):
            own[x[4]] = own.get(x[4], 0) + n
        for first, last in [(_opening(found, lengths, until, a, before), z), *(ends[k] for k, n in own.items() if n > SURGE)]:
            kept[first] += 1
            kept[last] -= 1
        before = z
    return _bridged(found, (np.cumsum(kept) > 0)[:-1].tolist(), until)


def _opening(found: list, lengths: list[int], until: list[int], at: int, stop: int) -> int:
    """Where a stretch from *at* on begins with the lines directly before it in the boxes around it: headline, byline."""
    box, first = found[at][4], at
    for i in range(at - 1, stop - 1, -1):
        if not found[i][0] or not found[i][4] <= box <= until[found[i][4]]:
            break
        if lengths[i]:
            first = i
    return first


def _bridged(found: list, keep: list[bool], until: list[int]) -> list[bool]:
    """*keep*, with the lines between two kept ones that stand in a box around both."""
    at = [i for i, k in enumerate(keep) if k and found[i][0]]
    for a, z in zip(at, at[1:]):
        lo, hi = sorted((found[a][4], found[z][4]))
        between = [found[i][4] for i in range(a + 1, z) if found[i][0]]
        if between and all(b <= lo and hi <= until[b] for b in between):
            keep[a + 1 : z] = [True] * (z - a - 1)
    return keep


def extract(pages: DataFrame, page: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: *carry*, text string, n_chars long.

    Null, empty and text-less pages have an empty text. Broken markup is read as far as it goes:
    an unclosed comment or script hides what follows it. Rows stay as they are, repeated or not.
    """

    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(0)]
            arrays = [*b.columns[1:], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"o{i}" for i in range(len(arrays))])

    rows = pages.select(*(F.col(c).alias(f"i{i}") for i, c in enumerate((page, *carry))))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[1:]] + ["string", "long"]
    out = rows.mapInArrow(run, ", ".join(f"o{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*carry, "text", "n_chars")
