"""Main text of web pages by line-block distribution.

Markup is stripped into lines: one per block element, white space as one space, character references decoded. Parts
that are boilerplate by their element, role, class or id leave a run of empty lines, unless in an article or between
paragraphs of one parent element, so an advert doesn't split a text; the borders of an article or main element leave one.
The text lengths (link text counts a tenth) are summed over a sliding window of lines. Where the sum surges over a
threshold, text begins; where it dives to nothing, it ends; all lines between are kept. The threshold is a part of the
page's own largest sum, so that short articles are found too. A class counts by whole tokens (`menu-item`, not `has-sidebar`), and a
part that holds nearly all text of the page is a wrapper whatever its class, unless it is named as reader comments. A list of links outside
articles is a menu and goes with its heading. If one article or main element holds most of the kept text,
lines outside such elements count as empty.

If nothing is left, or less than a tenth of an article inside a removed part, the page is read again without the class
rules, then without any. Defined results: a null or empty page, and one without text, gives the empty string. Unclosed elements end with the element around them,
and p, li, dd, dt, option and parts of tables also by the start tags that end them in HTML, kept or removed.
Whole pages are read and nothing is cut. Extra columns are not read; repeated rows return repeatedly.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import table

WINDOW, SURGE, LINK = 3, 0.1, 0.1
RAW = {"script", "style", "noscript", "textarea", "title", "iframe"}
#: Elements that are never text of the page, but hold markup: they end with their parent and leave no empty lines.
UNSEEN = {"template", "svg", "object", "canvas", "math", "select", "button", "option"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
            "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
TRACKED = BLOCK | UNSEEN | {"a", "datalist", "optgroup", "foreignobject"}
ENDS_P = BLOCK - {"body", "br", "head", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SCOPE = {"html", "body", "table", "td", "th", "button", "object", "template", "svg", "math"}
_LIST = BLOCK - {"address", "div", "p"}
#: Open elements that a start tag ends, and the elements beyond which it doesn't look for them.
ENDS = {
    "li": ({"li"}, _LIST | _SCOPE), **dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, _LIST | _SCOPE)), "option": ({"option"}, BLOCK | {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, BLOCK | {"select", "datalist"}), **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table", "template"})),
    "tr": ({"tr"}, {"table", "template", "thead", "tbody", "tfoot"}), **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"table", "template"})),
}
PARAGRAPH = set("blockquote dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table ul".split())
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
WORDS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal "
            "overlay sidebar side aside rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright comment comments commentlist disqus "
            "discussion reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager skip form".split())
#: Words beside those above in a class token that still name the part, not what it is about: `menu-item`, but not `has-sidebar` or `social-impact`.
NEUTRAL = set("main top bottom left right inner outer box block list item items link links bar button buttons icon icons wrapper wrap container area section content contents group row col "
              "column panel unit slot zone space site page post posts entry article articles story stories primary secondary global mobile desktop fixed sticky small large latest more also us this".split())
REMARKS = {"comment", "comments", "commentlist", "disqus", "discussion", "reply", "replies", "respond"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A list outside articles is a menu if links are over this part of its text. A part removed by its class stays if it holds so many times the text of all else.
MENU, MOST, DEPTH = 0.8, 9, 8
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def _named(value: str) -> set[str]:
    """The boilerplate words of the class tokens that consist of such words and neutral ones."""
    found = set()
    for token in value.split():
        words = {w.lower() for w in _PART.findall(token) if not w.isdigit()}
        if words <= WORDS | NEUTRAL:
            found |= words & WORDS
    return found


def _boilerplate(name: str, attrs: str, in_main: bool, rules: int) -> str:
    """Why an element is boilerplate: `element`, `class`, `remarks` (a class of reader comments), or empty. rules: 2 all, 1 without class words, 0 none."""
    if rules and (name in BOILER or name == "header" and not in_main):
        return "element"
    if not rules or not attrs or name in ("html", "body", "article", "main"):
        return ""
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value) or key == "role" and value.lower() in ROLES and not (in_main and value == "banner"):
            return "element"
        if rules > 1 and key in ("class", "id"):
            words = _named(value) - ({"header", "masthead"} if in_main or name in HEADINGS else set())
            if words:
                return "remarks" if words & REMARKS else "class"
    return ""


def lines(page: str, rules: int = 2, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[str, float, int]], int, list[tuple[int, int]]]:
    """(text, weight, number of the article or main element around it or 0) of each line, with empty lines for borders
    and removed parts; the length of the longest article inside a removed part; and (length, number) of the parts removed by class,
    but for reader comments. Elements whose number is spared are not removed by class."""
    out: list[tuple[str, float, int]] = []
    text: list[str] = []
    links = at = 0
    stack: list[str] = []
    ids: list[int] = []  # of the elements on the stack
    dropped = main = link = inner = None  # positions in the stack; inner: an article in a removed part
    opened = articles = size = lost = 0
    place = None  # (id, its parent's id, name, whether the parent is the body) of the element that holds the last line
    lists: list[tuple[int, int]] = []  # (position in the stack, first line) of open lists outside articles
    heads: list[int] = []  # lines of headings
    parts: list[tuple[int, int]] = []
    named = weight = 0  # number and length of the open part that is removed by its class
    removed: list[tuple[int, bool, bool]] = []  # (id of the parent, by class, whether that is the body) of parts since the last line
    end = len(page)

    def top():
        k = len(stack) - 1
        while k > 0 and (stack[k] == "a" or stack[k] in UNSEEN):
            k -= 1
        return (ids[k] if k >= 0 else 0, ids[k - 1] if k > 0 else 0, stack[k] if k >= 0 else "", k < 1 or stack[k - 1] in ("html", "body"))

    def joined(here):
        """Whether the last line and this one go on in the same parent on both sides of each removed part."""
        for parent, by_class, body in removed:
            for own, above, name, _ in (place, here):
                if own != parent and (above != parent or name not in PARAGRAPH and (body or not by_class)):
                    return False
        return True

    def flush():
        nonlocal links, place
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                here = top()
                if removed and place and not joined(here):
                    out.extend([("", 0.0, 0)] * WINDOW)
                removed.clear()
                place = here
                if here[2] in HEADINGS:
                    heads.append(len(out))
                out.append((line, max(1.0, len(line) - (1 - LINK) * min(links, len(line))), articles if main is not None else 0))
        links = 0

    def border():
        flush()
        out.extend([("", 0.0, 0)] * WINDOW)

    def pop(k):
        """End the element at k of the stack and all in it."""
        nonlocal dropped, link, main, inner, lost, named, weight
        if inner is not None and k <= inner:
            inner, lost = None, max(lost, size)
        if dropped is not None and k <= dropped:
            dropped = None
            if named:
                parts.append((weight, named))
            named = weight = 0
        if dropped is None and any(x in BLOCK for x in stack[k:]):
            flush()
        if link is not None and k <= link:
            link = None
        while lists and k <= lists[-1][0]:
            first = lists.pop()[1]
            menu = [x for x in out[first:] if x[0]]
            total = sum(len(x[0]) for x in menu)
            if main is None and len(menu) > 1 and total - sum(x[1] for x in menu) > MENU * (1 - LINK) * total:
                if heads and heads[-1] == first - 1:  # the heading of a menu goes with it
                    first -= 1
                del out[first:]
                heads[:] = [x for x in heads if x < first]
                out.extend([("", 0.0, 0)] * WINDOW)
        if main is not None and k <= main:
            flush()
            main = None
            border()
        del stack[k:], ids[k:]

    def close(names, bounds):
        """End the innermost open element of these names, if it is within the bounds."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                return pop(k)
            if stack[k] in bounds:
                return

    while at < end:
        i = page.find("<", at)
        if i < 0:
            i = end
        if i > at and dropped is None:
            text.append(page[at:i])
            if link is not None:
                links += i - at
        elif inner is not None or named:
            n = len(page[at:i].strip())
            size, weight = size + n, weight + n
        if i == end:
            break
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = end if j < 0 else j + 3
            continue
        if page.startswith(("<!", "<?"), i):
            j = page.find(">", i)
            at = end if j < 0 else j + 1
            continue
        m = _TAG.match(page, i)
        if not m:
            if dropped is None:
                text.append("<")
            at = i + 1
            continue
        at = m.end()
        closing, name, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        name = name.lower()
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                e = _CLOSE[name].search(page, at)
                at = e.end() if e else end
            continue
        if not closing:
            if name in BLOCK:  # markup of the page ends a drawing or formula left open
                close({"svg", "math"}, BLOCK | {"foreignobject"})
            if name in ENDS:
                close(*ENDS[name])
            if name in ENDS_P:
                close({"p"}, _SCOPE)
        if name in BLOCK and dropped is None:
            flush()
        if name in VOID:
            continue
        if closing:
            if name not in stack:
                continue
            k = len(stack) - 1 - stack[::-1].index(name)
            pop(k)
        elif not attrs.endswith("/"):
            opened += 1
            if name in ("article", "main") and rules and main is None and (dropped is None or stack[dropped] == "form"):
                dropped = None  # a form around the article is the page's
                border()
                main = len(stack)
                articles += 1
            elif name in ("article", "main") and dropped is not None and inner is None and stack[dropped] not in ("aside", "footer", "nav"):
                inner, size = len(stack), 0
            elif dropped is None and name in UNSEEN:
                dropped = len(stack)
            elif dropped is None and (why := _boilerplate(name, attrs, main is not None, rules)) and (why == "element" or opened not in spared):
                flush()
                dropped = len(stack)
                named, weight = opened if why == "class" else 0, 0
                if main is None:  # a part taken out of an article doesn't split it
                    removed.append((top()[0], name not in BOILER and name != "header", not stack or stack[-1] in ("html", "body")))
            elif name == "a" and link is None:
                link = len(stack)
            if name in ("ul", "ol") and rules and dropped is None and main is None:
                lists.append((len(stack), len(out)))
            if name in TRACKED or dropped == len(stack):
                stack.append(name)
                ids.append(opened)
    if dropped is None:
        flush()
    elif named:
        parts.append((weight, named))
    return out, max(lost, size if inner is not None else 0), parts


def _surging(size: np.ndarray) -> np.ndarray:
    """Which lines lie between surge and dive points of the window sums."""
    sums = np.convolve(size, np.ones(WINDOW))[WINDOW - 1:]  # of a line and those after it
    threshold, out, i, n = SURGE * sums.max(), np.zeros(len(size), bool), 0, len(size)
    while i < n:
        if not size[i]:
            i += 1
            continue
        j, surge = i, False
        while j < n and sums[j] > 0:
            surge |= sums[j] >= threshold
            j += 1
        out[i:j] = surge
        i = j
    return out & (size > 0)


def kept(found: list[tuple[str, float, int]]) -> list[str]:
    """Texts of the surging lines; if one article holds most of their weight, of those in articles."""
    if not found:
        return []
    size, article = np.array([w for _, w, _ in found]), np.array([m for *_, m in found])
    keep = _surging(size)
    held = np.bincount(article[keep], size[keep])
    if len(held) > 1 and 2 * held[1:].max() > held.sum():
        keep = _surging(np.where(article > 0, size, 0.0))
    return [found[k][0] for k in np.flatnonzero(keep)]


def extract(page: str | None) -> str:
    spared: frozenset[int] = frozenset()
    for rules in (2, 1, 0):
        found, lost, parts = lines(page or "", rules, spared)
        text = " ".join(kept(found))
        for _ in range(DEPTH):
            size, number = max(parts, default=(0, 0))
            if size <= MOST * len(text) or not size:
                break
            spared |= {number}  # a wrapper of the page
            found, lost, parts = lines(page or "", rules, spared)
            text = " ".join(kept(found))
        if text and (not rules or len(text) >= SURGE * lost):
            return text
    return text


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    def run(batches):
        for b in batches:
            out = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
