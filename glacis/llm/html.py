"""HTML main text by line-block distribution.

Markup is stripped into lines, one for each block of the page; a line weighs the
characters that are not links, menus, notices or other furniture. Weights summed over sliding
windows of lines give the block distribution: the text starts where it surges
and ends where it dives to zero. An article or main element has a distribution of its own; no line
is ever lowered for lying outside.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import blocks
from .common import text_column

BLOCK_CHARS = 4_000_000
#: Lines in a window; the sum at which the distribution surges, if the page reaches it: the values that the method was published with.
WINDOW, SURGE = 3, 86

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""",
    re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)

# Kinds of elements, and words that name furniture in class, id and role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea svg math iframe object canvas xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("nav footer aside form dialog menu head select button fieldset datalist".split())
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs comment comments
cookie cookies consent copyright dialog disqus discussion footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice
notices pagination paywall popup promo promotion recommended related replies reply respond search searchbox share sharing sidebar signup skip
social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets alert complementary contentinfo""".split())
MAIN = frozenset(["article", "main"])


#: Words beside those in a class or id that is furniture as a whole, and such as name the story itself
BESIDE = frozenset("""area bar body block bottom box btn button buttons center col column container content css global group icon icons inner item items js left link links list
lower main mobile module outer panel primary right row secondary section site slot small sticky sub text title top unit upper wrap wrapper x""".split())
STORY = frozenset("article articles blog entry page pages post posts story stories".split())
#: Furniture whose text is not the story, however long it is
OTHERS = frozenset("""nav footer aside header menu comment comments disqus discussion reply replies respond cookie cookies consent copyright gdpr newsletter notice notices
subscribe subscription sponsor sponsored advertisement ads ad adsense navigation complementary contentinfo banner""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NONE, LASTING, OTHER, PLAIN = range(4)
#: Unlinked characters that are much, if they are half of the page's too
MUCH = 300


def _named(value: str, inside_main: bool) -> set[str]:
    """The words that name furniture in a class, id or role: of its tokens that consist of these and their like."""
    out: set[str] = set()
    for token in value.split():
        words = set(re.findall(r"[a-z]+", token))
        named = words & WORDS
        if inside_main or words & STORY:
            named -= {"header"}  # a story has a header of its own
        if named and words <= WORDS | BESIDE | STORY:
            out |= named
    return out


def _furniture(name: str, attributes: str, inside_main: bool, inside_story: bool) -> int:
    """Whether an element is furniture by its name or attributes: NONE; LASTING, whatever it holds; OTHER or PLAIN."""
    kind = NONE
    if name in FURNITURE or name == "header" and not inside_main:
        kind = LASTING if name in ("head", "select", "button", "datalist") else OTHER if name in OTHERS else PLAIN
    if not attributes or name in ("html", "body", "article", "main", "h1"):
        return kind
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return LASTING
        if key == "id" and (name in HEADINGS or name == "section" and inside_story):
            continue  # an anchor made of the heading's words
        if key in ("class", "id", "role") and kind != OTHER and (named := _named(value, inside_main)):
            kind = PLAIN if named.isdisjoint(OTHERS) else OTHER
    return kind


def lines(page: str, spared: frozenset[int] = frozenset()) -> list[tuple[str, int, int]]:
    """(text, weight, number of the outermost article or main element, 0 outside) of each block of the page, in its order.

    Furniture is left out, but not an element that holds a main element; nor one that holds half of the page's
    unlinked text, if that is much or in an article. Furniture whose text is not the story however long it
    is (comments, notices, navigation) is only spared for a page's articles, if all are in it. Such
    elements are known when they end: the page is then read again with their places in ``spared``.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    weight, stack = 0, []  # open elements: (name, furniture, place, and as they began: letters, articles, mains)
    dropped = mains = stories = links = lasting = 0
    units = unit = 0
    letters = all_stories = all_mains = 0  # of the page so far, furniture included
    held: list[tuple[int, int, int, int, int]] = []  # furniture that ended: (kind, place, letters, articles, mains in it)

    def text(raw: str):
        nonlocal weight, unit, letters
        if lasting or not raw:
            return
        got = html.unescape(raw) if "&" in raw else raw
        n = 0 if links else len("".join(got.split()))
        letters += n
        if dropped:
            return
        parts.append(got)
        if mains:
            unit = units
        weight += n

    def flush():
        nonlocal weight, unit
        if parts:
            line = " ".join("".join(parts).split())
            if line:
                out.append((line, weight, unit))
            parts.clear()
        weight = unit = 0

    def leave(count: int):
        nonlocal dropped, mains, stories, links, lasting
        for name, furniture, place, *then in stack[count:]:
            dropped -= furniture > NONE
            lasting -= furniture == LASTING
            mains -= name in MAIN
            stories -= name == "article"
            links -= name == "a"
            if furniture > LASTING:
                held.append((furniture, place, letters - then[0], all_stories - then[1], all_mains - then[2]))
        del stack[count:]

    def close(name: str, stop=()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                leave(i)
                return
            if stop and stack[i][0] not in stop:
                return

    at = 0
    while True:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue  # comment, doctype
        name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in RAW and not ending:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
        if ending:
            close(name)
        elif name not in VOID:
            if name not in INLINE:
                close("p", INLINE | {"p"})
                if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(name, INLINE | {name})
            furniture = _furniture(name, attributes, mains > 0, stories > 0 or mains > 0 and not all_stories)
            if m.start() in spared:
                furniture = NONE
            stack.append((name, furniture, m.start(), letters, all_stories, all_mains))
            dropped += furniture > NONE
            lasting += furniture == LASTING
            units += name in MAIN and not mains
            mains += name in MAIN
            stories += name == "article"
            if not lasting:
                all_stories += name == "article"
                all_mains += name == "main"
            links += name == "a"
        elif name == "hr":
            pass
    flush()
    leave(0)
    if spared:
        return out

    def spare(kind: int, n: int, articles: int, main: int) -> bool:
        if main:
            return True
        half = n > 0 and 2 * n >= letters
        return half and articles == all_stories > 0 if kind == OTHER else half and (n >= MUCH or articles > 0)

    again = frozenset(place for kind, place, *rest in held if spare(kind, *rest))
    return lines(page, again) if again else out


def between(weights: list[int], level: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of lines whose distribution reaches ``level``: the distribution is the sum of each
    line's window (it and those after it). A surge rises from its foot, the first line with text since the
    distribution was zero; the dive is where it is zero again."""
    sums = [sum(weights[i:i + window]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j] > 0:
            j += 1
        if j > i and max(sums[i:j]) >= level:
            while not weights[i]:
                i += 1
            out.append((i, j))
        i = j + 1
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points, blocks joined by one space.

    Windows run over the lines outside articles as one sequence and over those of each article as
    another, so that neither lifts the other; a line of an article weighs one letter more, so that a list of
    links amid it is no dive. A surge is as high as ``surge``, or as the page's highest window if none is.
    """
    units: dict[int, list[int]] = {}
    got = lines(page)
    for i, (_, _, unit) in enumerate(got):
        units.setdefault(unit, []).append(i)
    weights = {unit: [got[i][1] + (unit > 0) for i in at] for unit, at in units.items()}
    most = max((sum(w[i:i + window]) for w in weights.values() for i in range(len(w))), default=0)
    if not any(weight for _, weight, _ in got):
        return ""
    kept = [at[k] for unit, at in units.items() for i, j in between(weights[unit], min(surge, most), window) for k in range(i, j)]
    return " ".join(got[i][0] for i in sorted(kept))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every page.

    A null page counts as empty; an empty text is the result for pages without main
    text. Repeated rows, null keys and null addresses are kept as they are; other
    columns aren't read, whatever their names; an empty table gives no rows. Pages are read whole, however long. Unclosed
    tags and comments end with the page.
    """

    def run(batches):
        for part, texts in blocks(batches, 2, BLOCK_CHARS):
            out = [main_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["id", "url", "text", "n_chars"])

    kind, address = (pages.schema[c].dataType.simpleString() for c in (key, url))
    out = pages.select(pages[key].alias("id"), pages[url].alias("url"), text_column(pages, page).alias("page")).mapInArrow(run, f"id {kind}, url {address}, text string, n_chars long")
    return out.withColumnsRenamed({"id": key, "url": url})
