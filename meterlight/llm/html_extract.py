"""Main-text extraction from HTML by composite text density.

For every node of the DOM the density is its characters per tag, adjusted by the share of characters
and tags that belong to links and by the page's own share. The node whose children's densities have
the greatest sum is the article's trunk, on every page; text in inline elements counts for the block around
it. The least density on the path from the trunk to the body is the threshold that other subtrees must reach
to be content as well. Of the trunk everything is content, blocks below the threshold too, unless more than half of their
characters are links. On pages that have ``article`` elements with text (else ``main``), the trunk is
sought within these, and the same holds for the element around it.

Before densities are taken, subtrees that are never article text go: scripts, styles, menus, footers,
sidebars, forms, hidden elements, and elements with a role, class or id that says notice, advert, comment
and the like, unless they hold the page's ``article`` or ``main``. A class or id says so if all its words are
such or say mere layout: ``ad-box`` does, ``share-price`` and ``related-work`` do not. Page headers go,
headers within the article stay.

Character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space. Nothing else is dropped, and pages are read whole.

Defined cases: null and empty pages, and pages without text, give an empty text; unclosed and
misnested tags are closed as browsers would, near enough; a table without rows gives none. Every row
gives one row, repeated ones too; other columns are not read. There is no shuffle.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("br body caption html legend li dd dt option optgroup tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
#: Start tags that end an open element of these names, up to the nearest of the containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that hold no article text.
NOISE_TAGS = frozenset(
    "script style noscript template head title nav aside footer form button select option optgroup textarea input datalist label"
    " dialog menu iframe object embed applet canvas audio video svg map noembed noframes search".split()
)
NOISE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar banner".split())
#: Words of class and id that mark noise; those of HEADER_WORDS only outside the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promoted promotion sidebar sidebars"
    " menu menus submenu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal"
    " overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond share sharing"
    " sharebar social related recommended recommendations widget widgets toolbar pagination pager paywall toc".split()
)
#: Words that may stand beside these in a class or id.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box buttons container content footer form group head header holder inner item items left link links"
    " list main outer overlay page panel post right row section side site slot small text title top unit wrap wrapper".split()
)
HEADER_WORDS = frozenset("header masthead topbar banner alert".split())
COMMENT_WORDS = frozenset("comment reply".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Dom:
    """Parallel lists with an entry per element, in page order; element 0 is the document."""

    def __init__(self, page: str):
        self.name = [""]
        self.parent = [-1]
        self.attributes = [""]
        #: Texts and block boundaries in page order: (element, text), text None for a boundary.
        self.flow: list[tuple[int, str | None]] = []
        self._parse(page)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.attributes.append(attributes)
        return len(self.name) - 1

    def _parse(self, page: str) -> None:
        flow, names = self.flow, self.name
        stack = [0]
        at, size = 0, len(page)
        find = TOKEN.search
        while at < size:
            token = find(page, at)
            if token is None:
                flow.append((stack[-1], page[at:]))
                break
            if token.start() > at:
                flow.append((stack[-1], page[at : token.start()]))
            at = token.end()
            slash, name, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if slash:
                self._close(name, stack)
                continue
            if name in ENDS_P:
                self._end({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote"} - {name} | {"table"}, stack)
            if name in ENDS:
                self._end(*ENDS[name], stack)
            if name in BLOCK:
                flow.append((stack[-1], None))
            element = self._open(name, attributes, stack[-1])
            if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                stop = end.start() if end else size
                if stop > at:
                    flow.append((element, page[at:stop]))
                at = end.end() if end else size
                continue
            stack.append(element)

    def _end(self, closing: set[str], limits: set[str], stack: list[int]) -> None:
        """Close the innermost open element of these names, if none of the limits lies within it."""
        for k in range(len(stack) - 1, 0, -1):
            name = self.name[stack[k]]
            if name in closing:
                self.flow.append((self.parent[stack[k]], None))
                del stack[k:]
                return
            if name in limits:
                return

    def _close(self, name: str, stack: list[int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.name[stack[k]] == name:
                if name in BLOCK:
                    self.flow.append((self.parent[stack[k]], None))
                del stack[k:]
                return
            if self.name[stack[k]] in ("table", "td", "th") and name not in BLOCK:
                return
        if name in ("p", "br"):
            self.flow.append((stack[-1], None))


def _says(labels: list[str], words: frozenset[str]) -> bool:
    """Whether a class or id consists of such words, with layout words and other noise beside them at most."""
    for label in labels:
        parts = {w.lower() for w in WORDS.findall(label)}
        if parts & words and parts <= LAYOUT_WORDS | NOISE_WORDS | HEADER_WORDS | COMMENT_WORDS:
            return True
    return False


def _noise(dom: Dom) -> list[bool]:
    """Whether each element, or one around it, is never part of the article."""
    n = len(dom.name)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[i] = holds[i] or dom.name[i] in ("article", "main")
        if holds[i]:
            holds[dom.parent[i]] = True
    noise, inside = [False] * n, [False] * n
    for i in range(1, n):
        name, up = dom.name[i], dom.parent[i]
        inside[i] = inside[up] or name in ("article", "main")
        if noise[up]:
            noise[i] = True
            continue
        if name in ("html", "body", "main"):
            continue
        if name in NOISE_TAGS or name == "header" and not inside[up]:
            noise[i] = name not in ("form",) or not holds[i]
            if noise[i]:
                continue
        raw = dom.attributes[i]
        if len(raw) < 3:
            continue
        found = {k.lower(): v[1:-1] if v[:1] in "\"'" else v for k, v in ATTRIBUTE.findall(raw)}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            noise[i] = True
            continue
        role = found.get("role", "").lower()
        labels = (found.get("class", "") + " " + found.get("id", "")).split()
        if name == "article":
            noise[i] = inside[up] and _says(labels, COMMENT_WORDS)
        elif not holds[i]:
            noise[i] = _says(labels, NOISE_WORDS) or role in NOISE_ROLES and (role != "banner" or not inside[up]) or _says(labels, HEADER_WORDS) and not inside[up]
    return noise


def _densities(dom: Dom, noise: list[bool]) -> tuple[list[float], list[float], int, list[bool]]:
    """Composite text density and density sum of every element, the body (or the document), and which elements
    are links for the most part."""
    n = len(dom.name)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[dom.parent[i]] or dom.name[i] == "a"
    for i, text in dom.flow:
        if text is not None and not noise[i]:
            size = len(text.strip())
            chars[i] += size
            if in_link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        if noise[i]:
            continue
        up = dom.parent[i]
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i] + (dom.name[i] == "a")
    body = next((i for i in range(n) if dom.name[i] == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if not c or noise[i]:
            continue
        t, lc, lt = max(tags[i], 1), link_chars[i], max(link_tags[i], 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        ratio = max(c / max(lc, 1) * t / lt, 1.0)
        density[i] = c / t * math.log(ratio) / math.log(base) if base > 1.0000001 else c / t * math.log(ratio)
    for i in range(1, n):
        if dom.name[i] in BLOCK:  # what inline elements hold is their block's
            sums[dom.parent[i]] += density[i]
    return density, sums, body, [c > 0 and 2 * lc > c for c, lc in zip(chars, link_chars, strict=True)]


def _under(dom: Dom, element: int, top: int) -> bool:
    """Whether an element lies in the subtree of another."""
    while element > top:
        element = dom.parent[element]
    return element == top


def _content(dom: Dom, noise: list[bool]) -> list[bool]:
    """Whether each element belongs to the article."""
    density, sums, body, linked = _densities(dom, noise)
    n = len(dom.name)
    below = [False] * n
    below[body] = True
    for i in range(body + 1, n):
        below[i] = below[dom.parent[i]]
    places = [i for i in range(body, n) if below[i] and not noise[i]]
    for name in ("article", "main"):  # a page that marks its article is searched there only
        within = [False] * n
        for i in places:
            within[i] = dom.name[i] == name and bool(density[i]) or within[dom.parent[i]]
        if any(within):
            places = [i for i in places if within[i]]
            break
    trunk = max(places, key=lambda i: (sums[i], -i), default=body)
    path = [trunk]
    while path[-1] != body and dom.parent[path[-1]] >= 0:
        path.append(dom.parent[path[-1]])
    article = next((i for i in path if dom.name[i] == "article"), None) or next((i for i in path if dom.name[i] == "main"), None)
    top, threshold = trunk if article is None else article, min(density[i] for i in path)
    chosen = [False] * n
    for i in range(body, n):
        if i == top:
            chosen[i] = True
        elif i > body and chosen[dom.parent[i]]:
            # Of what lies in the article only blocks of links go, however short the others are.
            links_only = linked[i] and density[i] < threshold and dom.name[i] in BLOCK
            chosen[i] = not links_only or i in path or trunk != top and _under(dom, i, trunk)
        elif article is None and below[i] and not noise[i] and i not in path:
            chosen[i] = 0 < density[i] >= threshold
    return chosen


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    dom = Dom(page)
    noise = _noise(dom)
    chosen = _content(dom, noise)
    parts = []
    for i, text in dom.flow:
        if text is None:
            parts.append(" ")
        elif chosen[i] and not noise[i]:
            parts.append(html.unescape(text) if "&" in text else text)
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and the text of every page."""

    def compute(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(compute, f"{fields}, text string")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
