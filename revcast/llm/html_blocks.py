"""Text blocks of a raw web page, and what its markup says about them."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Elements whose content is never text of the page.
_SILENT = set("head script style noscript template iframe object svg math canvas audio video select textarea button".split())
#: Elements that hold menus, sidebars, forms and the like.
_FRAME = set("nav footer aside form dialog menu fieldset search".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Words of class and id names, and roles, that mark parts around the article.  A name decides
#: if it has no other words; with others it leaves a doubt, and behind a word like "has" nothing.
_FRAME_WORDS = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert popup popover modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer
    comment comments commentlist respond replies reply disqus share sharing social related recommended recommendations
    newsletter subscribe subscription signup signin login search form widget toolbar pagination pager copyright topbar
    sitemap""".split()
)
_NAME_FILLERS = set("site list links buttons posts".split())
_ELSEWHERE = set("has no not non with without".split())
#: Inline elements go by name only where their whole class is one of these.
_AD_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Elements whose names decide; those of other blocks leave a doubt, and those of headings say nothing.
_CONTAINERS = set("div section ul ol dl li table tbody tr td center figure details ins header article".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup summary dt th caption legend figcaption".split())
#: End tags that authors may leave out: a start tag closes open elements of these names, up to one of the others.
_BLOCKS = set(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul""".split()
)
_P_SCOPE = set("table td th caption button object template".split())
_ITEM_SCOPE = (_BLOCKS - set("address div p li dd dt".split())) | set("td th caption body".split())
_IMPLIED = {
    "li": (set(["li"]), _ITEM_SCOPE),
    "dd": (set(["dd", "dt"]), _ITEM_SCOPE),
    "dt": (set(["dd", "dt"]), _ITEM_SCOPE),
    "td": (set(["td", "th"]), set(["table"])),
    "th": (set(["td", "th"]), set(["table"])),
    "tr": (set(["td", "th", "tr", "caption"]), set(["table"])),
    **dict.fromkeys("tbody thead tfoot".split(), (set("td th tr caption tbody thead tfoot".split()), set(["table"]))),
    **dict.fromkeys("option optgroup".split(), (set(["option"]), set(["select", "datalist"]))),
}
#: Elements that end with what holds them.
_MAY_STAY_OPEN = set("p li dd dt td th tr tbody thead tfoot caption option optgroup".split())
_FRAME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_ARTICLE_NAMES = set(
    """article-body article-content article-text article__body post-content post-body entry-content story-body story-content
    main-content page-content articlebody""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD_CUT = re.compile(r"[\s_\-:]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements whose content is read up to their own end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title iframe noscript noframes xmp".split()}

FRAME, OPEN, ARTICLE = 0, 1, 2
#: How surely an element is around the article: not, in doubt, by its name, by its tag, role or style.
NOT, DOUBT, NAMED, SURE = 0, 1, 2, 3


class Block(NamedTuple):
    """``place`` is FRAME (around the article by its markup), ARTICLE (inside it) or OPEN (neither said)."""

    place: int
    text: str


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source)}


def _named(tag: str, a: dict[str, str], in_article: bool) -> int:
    """NOT, DOUBT or NAMED by the class and id of an element."""
    if tag in _HEADINGS or tag == "main":
        return NOT
    if tag in _INLINE:
        return NAMED if a.get("class", "").strip().lower() in _AD_NAMES else NOT
    ids = a.get("id", "").split() if tag in _CONTAINERS else []
    found = NOT
    for name in a.get("class", "").split() + ids:
        words = {w.lower() for w in _WORD_CUT.split(name) if w}
        marks = words & _FRAME_WORDS
        if "header" in words and not in_article and tag != "article":
            marks = marks | {"header"}
        if marks and not words & _ELSEWHERE:
            found = max(found, NAMED if tag in _CONTAINERS and words <= marks | _NAME_FILLERS else DOUBT)
    return found


def _place(tag: str, source: str, in_article: bool) -> tuple[int, int]:
    """How surely an element is around the article, and its rank as an article container
    (2 article, 3 main, 4 by name, 0 none)."""
    if tag in ("html", "body"):
        return NOT, 0
    sure, rank = NOT, 2 if tag == "article" else 3 if tag == "main" else 0
    if tag == "form":  # some pages are one form as a whole
        sure = SURE if in_article else DOUBT
    elif tag in _FRAME or (tag == "header" and not in_article):
        sure = SURE
    if source and not source.isspace():
        a = _attributes(source)
        role = a.get("role", "").lower()
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(a.get("style", "")):
            sure = SURE
        if role in _FRAME_ROLES:
            sure = max(sure, DOUBT if role == "form" and not in_article else SURE)
        sure = max(sure, _named(tag, a, in_article))
        names = f"{a.get('class', '')} {a.get('id', '')}"
        if role == "main":
            rank = 3
        elif a.get("itemprop", "").lower() == "articlebody" or set(names.lower().split()) & _ARTICLE_NAMES:
            rank = 4
    return (NOT if rank and sure == DOUBT else sure), rank


class _Mark(NamedTuple):
    """An element that is around the article or holds it: number of the mark it stands in, and :func:`_place`."""

    outer: int
    sure: int
    rank: int


def _standing(marks: list[_Mark], left_open: set[int]) -> list[tuple[int, dict[int, int], dict[int, int]]]:
    """For each mark: how surely text in it is around the article, and the same by rank of
    container counted from the container on: of containers that no frame holds, and of all.

    A frame that was left open is in doubt, as what follows may not belong to it.
    """
    found: list[tuple[int, dict[int, int], dict[int, int]]] = [(NOT, {}, {})]
    for k, m in enumerate(marks[1:], 1):
        sure, free, held = found[m.outer]
        own = min(m.sure, DOUBT) if k in left_open else m.sure
        sure = max(sure, own)
        free = {r: max(s, own) for r, s in free.items()}
        held = {r: max(s, own) for r, s in held.items()}
        if m.rank:
            if sure <= DOUBT:
                free.setdefault(m.rank, NOT)
            held.setdefault(m.rank, NOT)
        found.append((sure, free, held))
    return found


def blocks(source: str | None) -> list[Block]:
    """The page's visible blocks in order; null and empty pages have none.

    Blocks end at every tag that is not inline, and at line breaks.  White space
    in a block becomes one space, character references are decoded.  Where a page
    has article elements these are the article, else its main part, else elements
    named as one.  Containers inside a frame count only on pages that have no
    others; then the frame around them does not.  Parts of the article, or of a
    page without one, that are frames in doubt are OPEN.  Unclosed and stray tags
    are tolerated: an end tag closes the nearest open element of its name, and
    none if there is none; end tags that HTML lets authors leave out are implied;
    a frame that is not closed by an end tag of its own is in doubt, and does not
    hold the containers in it.
    """
    source = source or ""
    found: list[tuple[int, str]] = []  # mark, text
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # tag, own mark or 0
    marks = [_Mark(0, NOT, 0)]
    at_mark = silent = n_held = 0
    n_open: Counter[str] = Counter()
    left_open: set[int] = set()

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                found.append((at_mark, joined))
            text.clear()

    def shut(depth: int) -> None:
        """Closes the elements from ``depth`` on."""
        nonlocal at_mark, silent, n_held
        while len(stack) > depth:
            t, own = stack.pop()
            n_open[t] -= 1
            silent -= t in _SILENT
            if own:
                at_mark = marks[own].outer
                n_held -= marks[own].rank > 0
                if len(stack) > depth and t not in _MAY_STAY_OPEN:
                    left_open.add(own)

    def shut_implied(tags: set[str], scope: set[str]) -> None:
        left, depth, k = sum(n_open[t] for t in tags), None, len(stack)
        while left:
            k -= 1
            if stack[k][0] in tags:
                depth = k
                left -= 1
            elif stack[k][0] in scope:
                break
        if depth is not None:
            shut(depth)

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            if not silent:
                text.append(source[at:])
            break
        if not silent and m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            if not silent:
                text.append(m["cdata"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag not in _INLINE:
            flush()
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None) if n_open[tag] else None
            if depth is not None and tag == "p" and any(t in _P_SCOPE for t, _ in stack[depth:]):
                depth = None
            if depth is not None:
                if any(own for _, own in stack[depth:]):
                    flush()
                shut(depth)
            continue
        if tag in _RAW and not (tag == "title" and any(t in ("svg", "math") for t, _ in stack)):
            end = _RAW[tag].search(source, at)
            at = end.start() if end else len(source)
            close = source.find(">", at)
            at = close + 1 if close >= 0 else len(source)
            continue
        if tag in _IMPLIED:
            shut_implied(*_IMPLIED[tag])
        if tag in _BLOCKS:
            shut_implied({"p"}, _P_SCOPE)
        if tag in _VOID or m["attrs"].endswith("/") and tag not in ("p", "div", "article", "main", "section", "body"):
            continue
        sure, rank = _place(tag, m["attrs"], n_held > 0)
        if sure or rank:
            flush()
            marks.append(_Mark(at_mark, sure, rank))
            at_mark = len(marks) - 1
            n_held += rank > 0
        stack.append((tag, at_mark if sure or rank else 0))
        n_open[tag] += 1
        if tag == "body" and silent:  # the head was not closed
            silent = 0
            n_open.subtract(t for t, _ in stack if t in _SILENT)
            stack[:] = [x for x in stack if x[0] not in _SILENT]
        silent += tag in _SILENT
    if not silent:
        flush()
    left_open.update(own for t, own in stack if own and t not in _MAY_STAY_OPEN)
    standing = _standing(marks, left_open)
    rows = [(*standing[mark], t) for mark, t in found]
    for which in (1, 2):  # containers that no frame holds, else all
        ranks = {rank for row in rows for rank, sure in row[which].items() if sure <= DOUBT}
        if ranks:
            own = min(ranks)
            places = {NOT: ARTICLE, DOUBT: OPEN}
            return [Block(places.get(row[which].get(own, SURE), FRAME), row[3]) for row in rows]
    # Where names would leave nothing of a page, they do not decide.
    least = min((row[0] for row in rows), default=NOT)
    return [Block(FRAME if row[0] >= (SURE if least == NAMED else NAMED) else OPEN, row[3]) for row in rows]
