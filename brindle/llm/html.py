"""Main text of web pages by line-block distribution.

A page becomes lines, one for each block of its markup; only scripts, styles and hidden elements are no text at all. A line weighs
by its text outside links, in characters, and markup is a weight. Elements, roles and names of menus, headers, footers, asides,
notices, adverts, forms, comments and the like cost their lines more than any text is worth; names that real paragraphs bear as
well cost ``DOUBT``, so that a long paragraph outweighs them. Within the page's surest mark of an article a line weighs ``INSIDE``
more; outside it, on a marked page, its text is worth a tenth.

Over the weights of a sliding window of lines, a surge is where the sum rises to a threshold, a dive where it falls to zero or
meets a line of negative weight; the lines between are the main text, with the short and link-only ones among them. A window
reaches neither across a negative line nor across the edge of the marked article, so that what stands apart has to surge by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

WINDOW = 3
#: The weight in a window that makes a surge, unless no window of the page has as much.
SURGE = 60
#: What a line of the marked article weighs besides its text, and the share that a line outside weighs on a marked page.
INSIDE, OUTSIDE = 60, 0.1
#: What a line costs whose markup says boilerplate, and one whose name may say so.
SURE, DOUBT = 1_000_000, 150

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|<|[^<]+", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.S)
# Elements of HTML by kind.
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("head nav footer aside form button select option input menu dialog svg math object audio video canvas map datalist fieldset".split())
_CLOSES_P = _BLOCK - {"body", "html", "head", "br", "option", "optgroup", "caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer\w*|topbar|cookies?|consent|gdpr|notice\w*|notification\w*|popup|modal|overlay|newsletter|subscri\w*|sign-?up|login|share|sharing|social\w*|comments?|commentlist|disqus|respond|replies|widget\w*|toolbar|pagination|pager|copyright|hidden|paywall)(?=$|[\s_-])",
    re.I,
)
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:side|legal|skip|search\w*|related|recommend\w*)(?=$|[\s_-])", re.I)
_TOP = re.compile(r"(?:^|[\s_-])(?:site-?header|page-?header|header|masthead)(?=$|[\s_-])", re.I)
_ARTICLE = re.compile(r"(?:^|\s)(?:article-?(?:body|content|text)?|post-?(?:body|content|text)?|entry-?(?:body|content)?|story-?(?:body)?|main-?(?:content)?|content)(?=$|\s)", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")  # a slash that is not part of an unquoted value
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    """A block's text, its characters outside links, what its markup costs it, and how surely it is in a marked article.

    3: in an article element, 2: in the main element, 1: in an element named like an article, 0: in none.
    """

    text: str
    weight: int
    cost: int
    article: int


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _kind(name: str, attributes: str, inside: int) -> tuple[bool, int, int]:
    """Whether an element is hidden, what it costs its lines, and how surely it marks the article. A header in an article holds its headline."""
    cost = SURE if name in _NEVER or (name == "header" and not inside) else 0
    level = {"article": 3, "main": 2}.get(name, 0)
    if not attributes.strip():
        return False, cost, 0 if cost else level
    a = _attributes(attributes)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True, 0, 0
    names = _CAMEL.sub("-", f"{a.get('class', '')} {a.get('id', '')}")
    level = max(level, {"article": 3, "main": 2}.get(a.get("role", "").lower(), 0), 3 * (a.get("itemprop", "").lower() == "articlebody"), int(bool(_ARTICLE.search(names))))
    if a.get("role", "").lower() in _ROLES:
        cost = SURE
    elif not cost and name not in ("html", "body", "main"):
        cost = SURE if _BOILER.search(names) or not inside and _TOP.search(names) else DOUBT if _DOUBTFUL.search(names) else 0
    return False, cost, 0 if cost else level


def lines(html: str | None, seen: Callable[[str, str], None] | None = None) -> list[Line]:
    """The lines of a page, in order, without empty ones. ``seen`` gets the name and attributes of each opening tag on the way."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, hidden, cost, article: each with what it stands in
    parts: list[str] = []
    plain = 0
    links = 0
    html = html or ""
    at = 0

    def close() -> None:
        nonlocal plain
        text = " ".join("".join(parts).split())
        parts.clear()
        hidden, cost, article = stack[-1][1:] if stack else (False, 0, 0)
        if text and not hidden:
            out.append(Line(text, plain, cost, article))
        plain = 0

    def leave(depth: int) -> None:
        nonlocal links
        for name, *_ in stack[depth:]:
            links -= name == "a"
        del stack[depth:]

    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                text = unescape(m[0])
                parts.append(text)
                plain += 0 if links else len(text.strip())
            elif m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if name in _BLOCK:
            close()
        if m[1]:
            at_depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at_depth is not None and (name in _BLOCK or not any(stack[i][0] in _BLOCK for i in range(at_depth, len(stack)))):
                leave(at_depth)
            continue
        if seen is not None:
            seen(name, m[3] or "")
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _VOID or _EMPTY.search(m[3]) and name not in _BLOCK:
            continue
        if name in _CLOSES_P:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCK), None)
            if i is not None and stack[i][0] == "p":
                leave(i)
        if name in _SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _HOLDS[name]:
                    break
                if stack[i][0] in _SAME[name]:
                    leave(i)
        hidden, cost, article = stack[-1][1:] if stack else (False, 0, 0)
        own_hidden, own_cost, own_article = _kind(name, m[3] or "", article)
        stack.append((name, hidden or own_hidden, max(cost, own_cost), max(article, own_article)))
        links += name == "a"
    close()
    return out


def weights(found: list[Line]) -> list[float]:
    """What lines weigh: text outside links, more inside the surest mark and less outside it, less what markup costs them."""
    surest = max((x.article for x in found if not x.cost), default=0)
    return [(x.weight if not surest else x.weight + INSIDE if x.article == surest else x.weight * OUTSIDE) - x.cost for x in found]


def kept(found: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """The lines between surges and dives."""
    heavy = weights(found)
    surest = max((x.article for x in found if not x.cost), default=0)
    apart = [(x.article == surest, w < 0) for x, w in zip(found, heavy)]
    sums = []
    for i in range(len(found)):
        reach = next((j for j in range(i, min(i + window, len(found))) if apart[j] != apart[i]), min(i + window, len(found)))
        sums.append(sum(heavy[i:reach]))
    least = min(surge, max(sums, default=0))
    out: list[Line] = []
    i = 0
    while i < len(sums):
        if sums[i] < least or heavy[i] <= 0:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] > 0 and apart[j] == apart[i]:
            j += 1
        last = max(k for k in range(i, j) if heavy[k])  # the dive: no text in the windows from here
        out += found[i : last + 1]
        i = j
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: its kept lines joined by one space; empty for null, empty and textless pages."""
    return " ".join(x.text for x in kept(lines(html)))


def extracted(html: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text, na_action=None).astype(object)

    return of(html)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html); n_chars counts code points.

    Null html, like html without any text, gives an empty text. Pages are read whole, however long, and each by itself: repeated
    rows are each a row, an empty table gives none. Other columns, whatever their names, are neither read nor returned.
    """
    bounded_batches(pages.sparkSession)
    out = pages.select("page_id", "url", extracted(F.coalesce("html", F.lit(""))).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
