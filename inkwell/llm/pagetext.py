"""Main text of web pages by tag-path ratios.

Each text block has a root-to-leaf tag path (tag names with their classes).
Per path, text length and punctuation are summed over its blocks and divided
by their number: the text ratio and the punctuation ratio.  Both are smoothed
over the blocks in page order (near blocks with similar paths weigh more),
multiplied, and compared with a threshold from their spread: blocks of the
paths above it are content, wherever they stand.  The innermost section that
holds most of them, and the sections around it as long as these hold little
else, are the article; its short blocks (headings, list items) belong to it
although their own paths score low, and so do the headings right before a
piece of content, with what stands between.  Blocks inside navigation, forms,
scripts and the like score zero whatever their ratios; a form, or a section
named like a menu or comments, does so only if the main text lies outside it
(``_free_wrappers``); outside the innermost section, blocks of paths that hold mostly links are left out.

Edge cases: null or empty html, and pages without a text block, give an empty
text; unclosed, crossed and cut-off tags are tolerated; character references
are decoded once; all white space (no-break space included) counts as white
space; repeated rows are extracted one by one; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import only, ship, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？،]")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Element kinds of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
SECTION = frozenset("article main section div td body html blockquote".split())
HOLDER = SECTION - {"blockquote"}                         # a quotation is a part of an article
LINK = "a href"                                            # path part of links; inline elements are in no path
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select article section div body".split())

# Elements and name parts that mark what is not the article.
NOT_TEXT = frozenset("head script style noscript template iframe textarea title svg math select button nav aside "
                     "footer menu dialog object audio video canvas fieldset noembed noframes xmp".split())
NOT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo "
                      "promotion sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs footer "
                      "masthead topbar toolbar comment comments commentlist reply replies disqus discussion "
                      "respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                      "subscription signup login search share sharing social related recommended pagination pager "
                      "widget widgets copyright legal disclaimer alert skip".split())
STATES = frozenset("no not non has with without".split())   # "no-sidebar" names a layout, not a sidebar
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu "
                      "menubar toolbar".split())


NAMED, NEVER = 1, 2                                       # marks of elements


class Block:
    __slots__ = ("path", "nodes", "text", "bad", "links", "linked", "marks", "main", "title")

    def __init__(self, stack: list, text: str, links: int):
        own = [e for e in stack if e[0] not in INLINE]
        self.path, self.nodes = tuple(e[1] for e in own), tuple(e[2] for e in own)
        self.text, self.links = text, links
        self.bad = any(e[3] == NEVER for e in stack)
        self.marks = [e[2] for e in stack if e[3] == NAMED]     # the marked elements, from the outside
        tags = [e[0] for e in own]
        self.main, self.title = "article" in tags or "main" in tags, "h1" in tags


def _named(value: str) -> bool:
    """Does a class or id hold a name of something other than content?"""
    for name in value.split():
        parts = [p.lower() for p in _NAME.findall(name)]
        if not NOT_NAMES.isdisjoint(parts) and parts[0] not in STATES:
            return True
    return False


def _marks(attributes: str) -> tuple[str, int]:
    """(classes, is it named or shown as something other than content)"""
    classes, named, bad = "", False, False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind in ("class", "id"):
            classes += "." + ".".join(sorted(value.split())) if kind == "class" else ""
            named |= _named(value)
        elif kind == "role":
            bad |= value.lower() in NOT_ROLES
        elif kind == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            bad |= kind == "hidden" or value.lower() == "true"
    return classes, NEVER if bad else NAMED if named else 0


def blocks(html: str) -> list[Block]:
    """Text blocks in page order, each with its tag path and its elements."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, int]] = []           # tag, path part, number, mark
    buffer: list[str] = []
    count = at = links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(references.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append(Block(stack, text, links))
        links = 0

    def close(upto: int) -> None:
        if any(e[0] not in INLINE for e in stack[upto:]):
            flush()
        del stack[upto:]

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            buffer.append(html[at:])
            break
        buffer.append(html[at:lt])
        if lt > at and any(e[1] == LINK for e in stack):
            links += len(references.unescape(html[at:lt]).strip())
        m = _TOKEN.match(html, lt)
        if m is None:                                      # a bare "<" is text; an open quote ends at the next ">"
            if html[lt + 1:lt + 2].isalpha() or html[lt + 1:lt + 2] == "/":
                gt = html.find(">", lt)
                at = gt + 1 if gt >= 0 else len(html)
            else:
                buffer.append("<")
                at = lt + 1
            continue
        at = m.end()
        if m[2] is None:                                   # comment, doctype
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break                                  # it was closed with its block already
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSED_BY.get(tag, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends or stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
        classes, mark = _marks(attributes) if attributes else ("", 0)
        if tag in NOT_TEXT or (tag == "header" and not any(e[0] in ("article", "main") for e in stack)):
            mark = NEVER
        elif tag == "form":
            mark = mark or NAMED
        if not attributes.rstrip().endswith("/") or tag in SECTION or tag in ("p", "span"):
            count += 1
            part = LINK if tag == "a" and "href" in attributes.lower() else tag + classes
            stack.append((tag, part, count, 0 if tag in ("body", "html") else mark))
    flush()
    _free_wrappers(out)
    links_of, chars = defaultdict(int), defaultdict(int)
    for b in out:
        links_of[b.path] += b.links
        chars[b.path] += len(b.text)
    for b in out:
        b.linked = 2 * links_of[b.path] > chars[b.path]
    return out


def _free_wrappers(found: list[Block]) -> None:
    """Decides which marked elements (names, forms) are not content, from the
    outside in.  The mark of one that holds more text than all that lies free
    of marks does not count if it wraps the main text: if it holds an <h1>,
    <article> or <main> and none lies free, or 95 % of the text, or if nothing
    else lies free.  One with less than 2 % of the text wraps nothing."""
    able = [b for b in found if not b.bad]
    total = sum(len(b.text) for b in able)
    while True:
        free, main, title = 0, False, False
        held: dict[int, list] = {}                         # has <h1>, has <article> or <main>, characters
        for b in able:
            if b.marks:
                h = held.setdefault(b.marks[0], [False, False, 0])
                h[0], h[1], h[2] = h[0] or b.title, h[1] or b.main, h[2] + len(b.text)
            else:
                free, main, title = free + len(b.text), main or b.main, title or b.title
        wrapper = None
        for node, (has_title, has_main, chars) in sorted(held.items(), key=lambda x: x[1], reverse=True):
            if chars > free and 50 * chars >= total and (
                    has_title and not title and not main or has_main and not main
                    or 20 * chars >= 19 * total or not free):
                wrapper = node
                break
        if wrapper is None:
            break
        for b in able:
            if b.marks and b.marks[0] == wrapper:
                del b.marks[0]
    for b in able:
        b.bad = bool(b.marks)


def _alike(a: tuple, b: tuple) -> float:
    """Share of the path that two blocks have in common from the root."""
    if a == b:
        return 1.0
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return same / max(len(a), len(b), 1)


def scores(found: list[Block], width: int = 3) -> list[float]:
    """Fused and smoothed path ratios of the blocks."""
    chars, points, number = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in found:
        if not b.bad:
            chars[b.path] += len(b.text)
            points[b.path] += len(_PUNCTUATION.findall(b.text))
            number[b.path] += 1
    ratio = {p: (chars[p] / n, (points[p] + 0.1) / n) for p, n in number.items()}
    out = []
    for i, b in enumerate(found):
        if b.bad:
            out.append(0.0)
            continue
        text = mark = weight = 0.0
        for j in range(max(0, i - width), min(len(found), i + width + 1)):
            w = math.exp(-((i - j) ** 2) / 2.0) * _alike(b.path, found[j].path)
            t, p = ratio.get(found[j].path, (0.0, 0.0)) if not found[j].bad else (0.0, 0.0)
            text, mark, weight = text + w * t, mark + w * p, weight + w
        out.append(text / weight * mark / weight if weight else 0.0)
    return out


def main_text(html: str | None, spread: float = 0.5) -> str:
    """The article of a page.  ``spread``: the threshold is this many standard
    deviations of the block scores, and at most half of the best score."""
    found = blocks(html) if html else []
    fused = scores(found)
    good = [s for s in fused if s > 0]
    if not good:
        return ""
    mean = sum(good) / len(good)
    limit = min(spread * math.sqrt(sum((s - mean) ** 2 for s in good) / len(good)), max(good) / 2)
    paths = {b.path for b, s in zip(found, fused) if s > 0 and s >= limit}
    chosen = [not b.bad and b.path in paths for b in found]
    inside: dict[int, float] = defaultdict(float)
    parts: dict[int, str] = {}
    for b, c in zip(found, chosen):
        if c:
            for node, part in zip(b.nodes, b.path):
                inside[node] += len(b.text)
                parts[node] = part.split(".")[0]
    most = 0.8 * sum(len(b.text) for b, c in zip(found, chosen) if c)
    holders = [n for n, v in inside.items() if v >= most and parts[n] in HOLDER]
    whole = [n for n in holders if parts[n] in ("article", "main")]
    core = min(whole) if whole else max(holders, default=-1)
    keep = [c or (not b.bad and core in b.nodes) for b, c in zip(found, chosen)]
    if core >= 0:
        keep = _with_parts(found, [k and (core in b.nodes or not b.linked) for b, k in zip(found, keep)],
                           -1 if whole else core, parts)
    return " ".join(b.text for b, k in zip(found, keep) if k)


def _with_parts(found: list[Block], keep: list[bool], core: int, parts: dict[int, str]) -> list[bool]:
    """``keep`` with the other parts of the sections around ``core`` (of none
    if it is -1) that hold little else than kept text, and with the headings
    right before kept blocks."""
    around = next((b.nodes[:b.nodes.index(core)] for b in found if core in b.nodes), ())
    for node in reversed(around):
        if parts[node] in ("body", "html"):
            break
        if parts[node] not in HOLDER:
            continue
        within = [i for i, b in enumerate(found) if not b.bad and not b.linked and node in b.nodes]
        if sum(len(found[i].text) for i in within if keep[i]) < 0.8 * sum(len(found[i].text) for i in within):
            break
        for i in within:
            keep[i] = True
    top = -1
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if keep[i]:
            top = i
        elif b.bad or b.linked:
            top = -1
        elif top >= 0 and any(p.split(".")[0] in HEADING for p in b.path):
            keep[i:top] = [True] * (top - i)
            top = i
    return keep


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(h) for h in b], dtype=object)

    return only(pages, "page_id", "url", "html").select(
        "page_id", "url", run("html").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
