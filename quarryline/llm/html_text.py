"""Operator 5: main text of web pages by composite text density.

A page becomes a flat tree of elements. For every node, characters per tag, weighed down by the share of link characters
and link tags in it and in the body, are its density; the densities of a node's children add up to its sum. The node of
the largest sum leads: the least density on its path to the body is the threshold, and below every node at or over the
threshold the subtree of the largest sum is content. Where content stands in an article (or else the page's main part), all
of that is, and so are the articles beside it, unless they are mostly links. Before, what is no reading matter by its element, role or name (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, hidden parts) is left out.

Text comes in blocks: character references decoded, white space runs made one space, trimmed, joined by newlines in page
order. ``br`` counts as white space, table cells as blocks.

Defined results: null and empty pages, and pages of markup alone, give empty text; unclosed and misplaced tags close as
browsers close them for these cases; a quote that never closes in a tag doesn't hide the tag's end; very long pages are read
whole, in time that grows with their length; rows are independent; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.shared import small_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
NOISE = frozenset("nav footer aside form script style noscript template iframe svg math button select textarea input label object embed canvas audio video head title menu dialog map search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A start tag closes an open element of these names, within the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Words in class and id names of parts that are no reading matter.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side rail widget widgets footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies share sharing social related recommended recommendations pagination pager toolbar skip hidden sr".split()
)
NAME_PART = re.compile(r"[a-z]+")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CONTAINERS = ("article", "main")


@dataclass
class Tree:
    """Elements in page order: names, parents, whether noise; and texts as (element, text)."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    noise: list[bool] = field(default_factory=lambda: [False])
    #: (element, text), and (element, None) where a block begins or ends.
    flow: list[tuple[int, str | None]] = field(default_factory=list)


def _is_noise(tag: str, attributes: str, inside: bool) -> bool:
    """``inside``: whether an article or main is open."""
    if tag in NOISE:
        return True
    if tag == "header":
        return not inside
    if not attributes or attributes.isspace() or tag in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role", "").lower() in NOISE_ROLES:
        return True
    if tag in BLOCKS or tag == "span":
        for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
            parts = NAME_PART.findall(name)
            if parts and (parts[0] in NOISE_WORDS or parts[-1] in NOISE_WORDS):
                return not (inside and parts[0] in ("header", "side", "foot") and len(parts) > 1)
    return False


class Scanner:
    """Marks of a page in order, each place looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        #: False once quotes took a tag's end away: from there on they count no more.
        self.quotes = True

    def mark(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next mark from a place on; name is empty for comments and the like."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0 or start > self.last[">"] and not page.startswith("<!--", start):
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if page.startswith("<![CDATA[", start) and (end := page.find("]]>", start + 9)) >= 0:
                return start, end + 3, "", "", page[start + 9 : end]
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", "", ""
            m = NAME.match(page, start + 1)
            if m:
                end = self.tag_end(m.end())
                return start, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at = start + 1

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin here; there is one further on."""
        k = at
        while self.quotes and (m := QUOTE_OR_END.search(self.page, k)):
            if m[0] == ">":
                return m.start()
            # The last quote of its kind closes nothing.
            k = m.end() if m.start() == self.last[m[0]] else self.page.find(m[0], m.end()) + 1
        self.quotes = False
        return self.page.find(">", at)


def parse(page: str) -> Tree:
    t = Tree()
    stack = [0]
    # How many elements of a name are open: what isn't open needn't be looked for.
    opened: Counter[str] = Counter()
    scanner = Scanner(page)
    at = 0

    def text(chunk: str) -> None:
        if chunk:
            t.flow.append((stack[-1], html.unescape(chunk)))

    def close(depth: int) -> None:
        while len(stack) > depth:
            if t.tags[stack[-1]] in BLOCKS:
                t.flow.append((stack[-1], None))
            opened[t.tags[stack.pop()]] -= 1

    def open_index(names: set[str], bounds) -> int:
        if not any(opened[n] for n in names):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            name = t.tags[stack[k]]
            if name in names:
                return k
            if name in bounds:
                return 0
        return 0

    while mark := scanner.mark(at):
        start, end, slash, tag, attributes = mark
        text(page[at:start])
        at = end
        if not tag:
            text(attributes)
            continue
        if slash:
            k = open_index({tag}, () if tag in BLOCKS else BLOCKS)
            if k:
                close(k)
            continue
        if tag == "br":
            text(" ")
        if tag in CLOSES_P:
            k = open_index({"p"}, {"article", "section", "div", "li", "td", "th", "table", "body", "blockquote", "button", "main"})
            if k:
                close(k)
        if tag in CLOSES:
            while k := open_index(*CLOSES[tag]):
                close(k)
        n = len(t.tags)
        t.tags.append(tag)
        t.parents.append(stack[-1])
        t.noise.append(t.noise[stack[-1]] or _is_noise(tag, attributes, any(opened[c] for c in CONTAINERS)))
        if tag in BLOCKS:
            t.flow.append((n, None))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(n)
            opened[tag] += 1
    text(page[at:])
    close(1)
    return t


def densities(t: Tree) -> tuple[list[float], list[float], list[bool], int]:
    """Composite density and density sum of each node, whether most of its text isn't links, and the body."""
    n = len(t.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[t.parents[k]] or t.tags[k] == "a"
    for k, s in t.flow:
        if s and not t.noise[k]:
            size = len(" ".join(s.split()))
            chars[k] += size
            if in_link[k]:
                link_chars[k] += size
    for k in range(n - 1, 0, -1):
        p = t.parents[k]
        if not t.noise[k]:
            chars[p] += chars[k]
            link_chars[p] += link_chars[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + (t.tags[k] == "a")
    body = next((k for k in range(n) if t.tags[k] == "body"), 0)
    share = link_chars[body] / chars[body] if chars[body] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        c, lc = chars[k], link_chars[k]
        if c and not t.noise[k]:
            tag = max(1, tags[k])
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[k] = c / tag * math.log(max(1.0, c / max(1, lc) * tag / max(1, link_tags[k]))) / max(math.log(base), 0.1)
        if k:
            sums[t.parents[k]] += density[k]
    return density, sums, [2 * lc < c for c, lc in zip(chars, link_chars, strict=True)], body


def content_nodes(t: Tree) -> set[int]:
    """Roots of the subtrees that are content."""
    density, sums, plain, body = densities(t)
    n = len(t.tags)
    under = [False] * n
    for k in range(n):
        under[k] = k == body or (k > 0 and under[t.parents[k]])
    own = [k for k in range(n) if under[k] and not t.noise[k]]
    lead = max(own, key=lambda k: (sums[k], -k), default=body)
    if not own or sums[lead] == 0:
        return {body}
    path = [lead]
    while path[-1] != body:
        path.append(t.parents[path[-1]])
    threshold = min(density[k] for k in path)
    # The largest sum below each node, itself included.
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        p = t.parents[k]
        if not t.noise[k] and sums[best[k]] > sums[best[p]]:
            best[p] = best[k]
    found, inside = set(), [False] * n
    for k in own:
        inside[k] = k > 0 and (inside[t.parents[k]] or k in found)
        if not inside[k] and density[k] >= threshold:
            pick = best[k] if sums[best[k]] > 0 else k
            found.add(pick)
            inside[pick] = inside[pick] or pick == k
    # Headings beside content belong to it.
    for k in own:
        if t.tags[k] in ("h1", "h2", "h3", "h4", "h5", "h6") and any(t.parents[f] == t.parents[k] for f in found):
            found.add(k)
    # Containers that content stands in are content as a whole; of nested ones of a kind the outermost.
    around: dict[str, list[int]] = {name: [-1] * n for name in CONTAINERS}
    for k in own:
        for name, outer in around.items():
            p = outer[t.parents[k]] if k else -1
            outer[k] = p if p >= 0 else k if t.tags[k] == name else -1
    tops = {x for k in found if (x := next((outer[k] for outer in around.values() if outer[k] >= 0), -1)) >= 0}
    # So are their siblings of the same kind, as a smaller one is less dense; but not lists of links.
    kinds = {(t.parents[k], t.tags[k]) for k in tops}
    return found | tops | {k for k in own if plain[k] and (t.parents[k], t.tags[k]) in kinds}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    t = parse(page)
    roots = content_nodes(t)
    wanted = [False] * len(t.tags)
    for k in range(len(t.tags)):
        wanted[k] = (k in roots or (k > 0 and wanted[t.parents[k]])) and not t.noise[k]
    blocks, parts = [], []
    for k, s in t.flow:
        if s is None:
            blocks.append("".join(parts))
            parts = []
        elif wanted[k]:
            parts.append(s)
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the page's main text."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(docs: pd.Series) -> pd.Series:
        return pd.Series([main_text(d) for d in docs], dtype=object)

    return pages.withColumn(out, extract(F.col(html_col).cast("string")))
