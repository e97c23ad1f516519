"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs its characters outside links; lines inside menus,
footers, adverts, forms and the like weigh nothing. Weights are summed over sliding windows of lines: the main text
begins where the sums surge and ends where they dive to nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines per window, and the characters a window needs for a surge on pages that don't mark their article.
WINDOW_LINES = 3
SURGE = 80

# Names of HTML elements and words that pages use for what is not the article.
RAW = "script style noscript template svg math iframe object canvas audio video title textarea".split()
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog select button fieldset head".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright dialog discussion disqus feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pagination pager popup promo promoted promotion related reply replies respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary "
    "contentinfo alert".split())
HEADER_WORDS = frozenset(("header", "head", "site-header"))
COMMENT_WORDS = frozenset("comment comments reply replies discussion disqus feedback respond".split())
TEASER_WORDS = frozenset("ad ads advert advertisement promo related sponsored teaser".split())
LEAF = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(("article", "main"))
#: What still names furniture on a paragraph, heading or inline element of the article.
SPOT_WORDS = TEASER_WORDS | frozenset("advertising newsletter promoted promotion share sharing social sponsor subscribe".split())
#: Sections of an article get ids from their titles; these are not titles.
SECTION_IDS = frozenset("comment comments disqus respond".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>"
    r"|<[!?][^>]*+>", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_WORDS = re.compile(r"[a-z]+")


def _kind(tag: str, rest: str, in_main: bool) -> str:
    """aside, main or plain; named or part for what is aside by its name only, or by a part of it."""
    words: set[str] = set()
    names: set[str] = set()
    small = tag in LEAF or tag in INLINE
    if rest:
        if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", rest)):
            return "aside"
        for name, *values in _NAMED.findall(rest):
            value = "".join(values).lower()
            if name.lower() == "style":
                if "display:none" in value.replace(" ", ""):
                    return "aside"
            elif name.lower() != "id" or not small and not (in_main and tag == "section" and value not in SECTION_IDS):
                words.update(_WORDS.findall(value))
                names.update(value.split())
    if tag in MAIN_TAGS:
        return "aside" if words & (COMMENT_WORDS | TEASER_WORDS) else "main"
    if tag in ("div", "section") and "main" in words and not words & ASIDE_WORDS:
        return "main"
    if tag in ("html", "body"):
        return "plain"
    if tag in ASIDE_TAGS and tag not in ("form", "fieldset"):
        return "aside"
    if words & (SPOT_WORDS if small and in_main else ASIDE_WORDS):
        return "named" if names & ASIDE_WORDS else "part"
    if tag in ("form", "fieldset") or not in_main and tag not in INLINE and (tag == "header" or words & HEADER_WORDS):
        return "part"
    return "plain"


def lines_of(page: str) -> tuple[list[str], list[int], bool, list[tuple[int, ...]]]:
    """Lines of text, their weights, whether the page marks its main part, and the open elements around each line,
    by where they begin; paragraphs and items, body and html are left out.

    An element that is furniture by its name only, yet holds most of the page's text, wraps the page: if a part of the
    name says so, or if it holds an article. Where nothing has weight names don't count at all.
    """
    lines, weights, marked, around, masses = _read(page, frozenset())
    total = masses.pop(-1)[0]
    wraps = frozenset(at for at, (mass, part, holds) in masses.items() if 2 * mass > total and (part or holds))
    if wraps:
        lines, weights, marked, around, masses = _read(page, wraps)
    if lines and masses and not any(weights):
        lines, weights, marked, around, _ = _read(page, None)
    return lines, weights, marked, around


def _read(page: str, wraps: frozenset[int] | None) -> tuple[list[str], list[int], bool, list[tuple[int, ...]], dict[int, list]]:
    """As ``lines_of``, with the elements that begin at ``wraps`` (None: all) not furniture by name. And by the place of
    such an element, and -1 for the page: characters outside links, whether a part of the name decided, whether it
    holds an article."""
    lines: list[str] = []
    weights: list[int] = []
    piece: list[str] = []
    linked = 0
    stack: list[tuple[str, str, int]] = []
    around: list[tuple[int, ...]] = []
    aside = main = link = 0
    marked = False
    masses: dict[int, list] = {-1: [0, False, False]}
    named: list[int] = []  # open elements that are furniture by name

    def close() -> None:
        nonlocal piece, linked
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                length = len(text)
                lines.append(text)
                around.append(tuple([e for name, _, e in stack if name not in LEAF and name not in INLINE and name not in ("html", "body")]))
                if aside == len(named) and 2 * linked <= length:
                    for e in (-1, *named):
                        masses[e][0] += length
                if aside or marked and not main:
                    weights.append(0)
                else:
                    weights.append(length if main else 0 if 2 * linked > length else length)
            piece = []
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at: m.start()]
            piece.append(text)
            if link:
                linked += len(text.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m["end"] else 1
        if tag in INLINE:
            if m["end"]:
                if not any(name == tag for name, _, _ in stack[-8:]):
                    continue
            elif tag in VOID or not m["rest"] or _kind(tag, m["rest"], main > 0) not in ("aside", "named", "part"):
                continue
        close()
        if tag in VOID:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, kind, _ in stack[i:]:
                        aside -= kind == "aside"
                        main -= kind == "main"
                        if kind == "named":
                            aside -= 1
                            named.pop()
                    del stack[i:]
                    break
            continue
        if stack and tag not in INLINE and (stack[-1][0] == "p" or tag in LEAF and stack[-1][0] == tag):
            kind = stack.pop()[1]  # a new block ends an open paragraph, a new item the last one
            aside -= kind in ("aside", "named")
            if kind == "named":
                named.pop()
        if not m["rest"] and tag in LEAF:
            continue
        kind = _kind(tag, m["rest"], main > 0)
        if kind in ("named", "part"):
            if wraps is None or m.start() in wraps:
                kind = "plain"
            else:
                masses[m.start()] = [0, kind == "part", False]
                named.append(m.start())
                kind = "named"
        if tag in LEAF and kind not in ("aside", "named"):
            continue
        if kind == "main":
            for e in named:
                masses[e][2] = True
        if kind == "main" and not aside and not marked:
            marked = True
            weights = [0] * len(weights)
        stack.append((tag, kind, m.start()))
        aside += kind in ("aside", "named")
        main += kind == "main"
    piece.append(page[at:])
    close()
    return lines, weights, marked, around, masses


def main_text(page: str | None) -> str:
    """Text between the surge and dive points of a page; empty for null, for no text, and for text without a surge.

    What a dive or a slow start leaves out of an element that directly holds kept lines is kept too.
    """
    lines, weights, marked, around = lines_of(page or "")
    if not lines:
        return ""
    w = np.array(weights, np.int64)
    ahead = np.convolve(w, np.ones(WINDOW_LINES, np.int64))[WINDOW_LINES - 1:]  # sum over a line and those after it
    if not marked:
        ahead[ahead < min(SURGE, int(ahead.max()))] = 0
    kept, inside = np.zeros(len(w), bool), False
    behind = np.convolve(w, np.ones(WINDOW_LINES, np.int64))[: len(w)]  # and those before it
    for i in range(len(lines)):
        if not inside and ahead[i] and w[i]:
            inside = True  # surge
        elif inside and not behind[i] and not w[i]:
            inside = False  # dive
        kept[i] = inside and w[i]
    if not marked:
        # an element counts by the kept lines that surged themselves, not by what a window took along
        own = {around[i][-1] if around[i] else -1 for i in np.flatnonzero(kept & (w >= SURGE))}
        kept |= (w > 0) & np.array([not own.isdisjoint(e or (-1,)) for e in around])
    return " ".join([lines[i] for i in np.flatnonzero(kept)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, b.schema.field(2).type), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
