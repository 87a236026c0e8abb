"""Main text of web pages by composite text density.

A page becomes a tree of block elements; inline markup belongs to the block around it. What names itself as no part of the
article (menus, forms, adverts, comments, scripts and so on, by element, role, class or id) is taken out of the tree. Each
node's density is its characters per tag, lowered by the share of its characters and tags that lie in links; the node
with the greatest sum of child densities is the kernel of the text (the deepest of equals). The least density on its path up to the body is
the threshold. Where the kernel lies in an article or main element, that element is the text; else every node of at least the
threshold marks the node of the greatest sum below it, and link-free headings on the path belong to the text as well.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. Null and
empty pages have an empty text. A page is one unit of work, linear in its length. Rows that repeat a page_id are read apart.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import bounded

# No part is scanned from more than a few starts: quotes and attributes never reach over the next bracket they could be.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|</?[A-Za-z][^<>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)|\bhidden\b""")
NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Kinds of elements.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
DROPPED = frozenset("script style noscript template nav footer aside form button select datalist dialog menu svg math canvas audio video object head iframe textarea title".split())
#: Start tags that end others, and the elements they do not reach out of.
CLOSES = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
    "tr": (("td", "th", "tr"), ("table",)), "tbody": (("td", "th", "tr", "thead", "tbody"), ("table",)), "tfoot": (("td", "th", "tr", "tbody"), ("table",)),
}
SCOPES = frozenset("table td th caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login share sharing "
    "social related recommended pagination pager copyright toolbar alert alerts announcement disclaimer paywall widget widgets aside replies adsense adslot adbox".split()
)
#: A header of these is the article's; a class that tells of a page's other parts ("has-sidebar") names no part.
OWN, LAYOUT = frozenset("article post entry content story".split()), frozenset("has have with without no not is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in RAW}


def unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Does an element name itself as no part of the article? Headers count as page headers where no article is around."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "hidden").lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id"):
            for part in value.split():
                words = {w.lower() for w in NAME.findall(part)}
                if not words & LAYOUT and (words & WORDS or ("header" in words and not inside and not words & OWN)):
                    return True
    return False


class Tree:
    """Block elements of a page in page order, without what is unwanted; node 0 stands for the page.

    Per node: parent, name, own characters, own link characters, own links.
    ``parts`` holds (node, text) in page order, with a blank wherever a block begins or ends.
    """

    def __init__(self, page: str):
        self.parent, self.name = [-1], ["#page"]
        self.chars, self.linked, self.links = [0], [0], [0]
        self.parts: list[tuple[int, str]] = []
        stack: list[tuple[str, int, bool]] = [("#page", 0, False)]  # name, node, unwanted
        opened: dict[str, list[int]] = {}
        inside = links = 0
        blocks, scopes = [0], [0]  # places in the stack

        def last(*names: str) -> int:
            return max((opened[n][-1] for n in names if opened.get(n)), default=0)

        def pop_to(k: int) -> None:
            nonlocal inside, links
            while len(stack) > k:
                name, node, _ = stack.pop()
                opened[name].pop()
                if name in ("article", "main"):
                    inside -= 1
                if name == "a":
                    links -= 1
                if blocks[-1] == len(stack):
                    blocks.pop()
                    self.parts.append((node, " "))
                if scopes[-1] == len(stack):
                    scopes.pop()

        def text(raw: str) -> None:
            _, node, bad = stack[-1]
            if bad or not raw:
                return
            raw = html.unescape(raw)
            self.parts.append((node, raw))
            n = len(raw) - raw.count(" ") - raw.count("\n")
            self.chars[node] += n
            if links:
                self.linked[node] += n

        at = 0
        while m := TOKEN.search(page, at):
            text(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                # An inline end tag does not reach out of its block, nor another one out of its table cell.
                floor = blocks[-1] if name in INLINE else last("table") if name in SCOPES or name == "tr" else scopes[-1]
                if opened.get(name) and opened[name][-1] >= floor:
                    pop_to(opened[name][-1])
                continue
            if name not in INLINE:
                if last("p") > scopes[-1]:
                    pop_to(last("p"))
                others, bounds = CLOSES.get(name, ((), ()))
                for other in others:
                    if last(other) > max(last(*bounds), 0 if name[0] == "t" else scopes[-1]):
                        pop_to(last(other))
            _, node, bad = stack[-1]
            if name in RAW:
                close = ENDS[name].search(page, at)
                at = close.start() if close else len(page)
                continue
            if name in VOID:
                if name in ("br", "hr") and not bad:
                    self.parts.append((node, " "))
                continue
            bad = bad or unwanted(name, m[3], inside > 0)
            if name not in INLINE:
                if not bad:
                    self.parent.append(node)
                    self.name.append(name)
                    for column in (self.chars, self.linked, self.links):
                        column.append(0)
                    node = len(self.parent) - 1
                    self.parts.append((node, " "))
                blocks.append(len(stack))
            elif name == "a" and not bad:
                self.links[node] += 1
            if name in SCOPES:
                scopes.append(len(stack))
            inside += name in ("article", "main")
            links += name == "a"
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, node, bad))
        text(page[at:])
        pop_to(1)


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """(density, sum of child densities) of every node. A node's own text counts as a child without tags of its own."""
    n = len(tree.parent)
    chars, linked, links, tags = list(tree.chars), list(tree.linked), list(tree.links), list(tree.links)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
    share = linked[0] / max(1, chars[0])

    def composite(c: int, lc: int, t: int, lt: int) -> float:
        if c <= 0:
            return 0.0
        # The base of the logarithm is e at least: where a page has hardly any links, a smaller one would raise its shortest nodes.
        base = max(math.e, math.log(c / max(1, c - lc) * lc + share * c + math.e))
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)), base)

    density = [composite(c, lc, t, lt) for c, lc, t, lt in zip(chars, linked, tags, links)]
    sums = [composite(c, lc, lt, lt) for c, lc, lt in zip(tree.chars, tree.linked, tree.links)]
    for i in range(1, n):
        sums[tree.parent[i]] += density[i]
    return density, sums


def main_text(page: str | None) -> str:
    """Text of the article of one page."""
    tree = Tree(page or "")
    density, sums = densities(tree)
    n = len(sums)
    kernel = max(range(n), key=lambda i: (sums[i], tree.chars[i], i))
    path = [kernel]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    bounds = [i for i in path if tree.name[i] == "article"] or [i for i in path if tree.name[i] == "main"]
    marked = [False] * n
    if bounds:
        marked[bounds[-1]] = True
    else:
        threshold = min(density[i] for i in path)
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            p = tree.parent[i]
            if (sums[best[i]], best[i]) > (sums[best[p]], best[p]):
                best[p] = best[i]
        for i in range(n):
            if density[i] >= threshold:
                marked[best[i]] = True
        on = set(path)
        for i in range(1, n):
            if tree.name[i] in HEADINGS and tree.parent[i] in on and not tree.links[i]:
                marked[i] = True
    for i in range(1, n):
        marked[i] = marked[i] or marked[tree.parent[i]]
    return " ".join("".join(t for i, t in tree.parts if marked[i] or t == " ").split())


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the article, empty if there is none) and n_chars of every row."""

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    found = bounded(pages.select("page_id", "url", F.col("html").cast("string"))).mapInArrow(run, f"page_id {kind}, url {url}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
