"""Main text of web pages by composite text density.

Each page becomes a tree of elements. For every element four sums over its subtree
give its density: characters C, tags T, characters in links L and link tags K.

    density = C / T * log(C / L * T / K) to the base ln(C * L / (C - L) + l / c * C + e**2)

where l and c are the link characters and characters of the body, and a zero counts
as one. Text per tag is high in an article; the logarithm is zero where all text is
in links and falls as links gain on text (``e**2``, not ``e``, so that the base stays
away from 1 on pages with few links). The densities of an element's children, with the
text that stands directly in it as one child each, are summed; the element below the
body with the greatest sum is the article. The least density on the path from the body
to it is the threshold: outside the article, every highest element whose density
reaches it and that holds text blocks adds its own subtree with the greatest sum.

Around that: an element inside ``article`` stands for that article, and further
content is then looked for in no other part of the page; a page whose text stands
directly in the body is taken whole; headings beside the chosen elements belong to them;
lists of nothing but links are menus. Elements that HTML or their names mark as something other
than content (``nav``, ``footer``, ``form``, class ``ad``, ...) are cut before
anything is counted, unless they hold an article or a main heading themselves.

Rows are pages: nothing is shuffled, and one page is in memory at a time with its
batch. Defined cases: a null or empty html, or one without text, gives the empty
text; cut-off tags, comments and quotes end with the page; unclosed elements end
where their parent does; a repeated row gives equal rows; a null page_id or url stays
null; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.llm.text import slices

SLICE = 1 << 22
RESULT = "page_id long, url string, text string, n_chars long"

# Names of HTML and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 pre dt address figcaption caption summary legend".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_CONTENT = frozenset(
    "head script style noscript template textarea title select button input option datalist svg math canvas object iframe noembed noframes "
    "xmp audio video map nav footer aside menu dialog search fieldset label output progress".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tooltip status".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion promoted "
    "nav navi navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar skip "
    "header masthead footer foot copyright colophon sidebar sidebars aside widget widgets related recommended recommendations "
    "notice notices cookie cookies consent gdpr alert alerts popup modal overlay disclaimer "
    "newsletter subscribe subscription signup login search form share sharing social".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
BESIDE = frozenset("with has have no not without hide hidden show is".split())
ENDED_BY = {
    "li": ("li", {"ul", "ol", "menu", "dir"}),
    "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
    "tr": ("tr", {"table"}), "td": ("td th", {"table", "tr"}), "th": ("td th", {"table", "tr"}),
    "tbody": ("tbody thead tfoot", {"table"}), "tfoot": ("tbody thead tfoot", {"table"}),
}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>?""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


CUT, COMMENT, PART = 3, 2, 1  # never content; unless with an h1; unless with an article, or an h1 and a paragraph


def named_part(name: str, value: str) -> int:
    """What the class names or the id say of an element: one that begins or ends with the name of a part is that part."""
    found = 0
    for x in value.split():
        words = [w.lower() for w in NAME_WORD.findall(x)]
        if not words or BESIDE & set(words):
            continue
        if words[-1] in COMMENTS or words[0] in COMMENTS and (name != "article" or words[1:] == ["body"]):
            return COMMENT
        if name not in ("article", "main") and (words[0] in PARTS or words[-1] in PARTS):
            found = PART
    return found


class Tree:
    """Elements of a page in page order: a subtree is a range. ``runs`` holds (element, block number, text) in page order."""

    def __init__(self, page: str):
        self.name, self.parent, self.marked, self.runs = ["html"], [0], [0], []
        self.block, self._open, self._at = 0, [0], {"html": [0]}
        self._blocks = [0]  # places of block elements among the open ones
        self._read(page)
        n = len(self.name)
        self.end = list(range(1, n + 1))
        for i in range(n - 1, 0, -1):
            self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])

    def _push(self, name: str, marked: int) -> None:
        node = len(self.name)
        self.name.append(name)
        self.parent.append(self._open[-1])
        self.marked.append(marked)
        if name in BLOCK:
            self.block += 1
        if name not in VOID:
            place = len(self._open)
            self._open.append(node)
            self._at.setdefault(name, []).append(place)
            if name in BLOCK:
                self._blocks.append(place)

    def _pop_to(self, place: int) -> None:
        while len(self._open) > place:
            name = self.name[self._open.pop()]
            self._at[name].pop()
            if name in BLOCK:
                self._blocks.pop()
                self.block += 1

    def _last(self, names: tuple[str, ...] | list[str] | set[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((self._at[x][-1] for x in names if self._at.get(x)), default=0)

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self._at.get(name):
            return
        if name in BLOCK and name not in ("html", "body") and (p := self._last(("p",))) and p > self._last(("button", "td", "th", "table", "object", "caption")):
            self._pop_to(p)
        if name in HEADING and self.name[self._open[-1]] in HEADING:
            self._pop_to(len(self._open) - 1)
        if name == "body" and (head := self._last(("head",))):
            self._pop_to(head)
        if name == "a":
            self._end("a")
        if name in ENDED_BY:
            ends, within = ENDED_BY[name]
            place = self._last(ends.split())
            if place > self._last(within):
                self._pop_to(place)
        self._push(name, self._not_content(name, attributes))

    def _end(self, name: str) -> None:
        places = self._at.get(name)
        if not places or name in ("html", "body"):
            return
        place = places[-1]
        if name in BLOCK:
            if name in ("table", "td", "th") or place > self._last(("td", "th")):
                self._pop_to(place)
        elif place > self._blocks[-1] or name in NOT_CONTENT:
            self._pop_to(place)
        elif name == "a":  # a link that ends inside a later block: nothing after it is linked
            self.name[self._open[place]] = "span"
            self._at["a"].pop()
            self._at.setdefault("span", []).append(place)
            self._at["span"].sort()

    @staticmethod
    def _not_content(name: str, attributes: str) -> int:
        if name in NOT_CONTENT:
            return CUT
        found = PART if name == "form" else 0
        if "=" in attributes or "hidden" in attributes:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), entities.unescape(a or b or c)
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
                    return CUT
                if name in ("html", "body"):
                    continue
                if key == "role" and value.lower() in ROLES and name not in ("article", "main"):
                    found = max(found, PART)
                elif key in ("class", "id"):
                    found = max(found, named_part(name, value))
        return found

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self._open[-1], self.block, entities.unescape(text) if "&" in text else text))

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            i = page.find("<", at)
            if i < 0:
                return self._text(page[at:])
            if i > at:
                self._text(page[at:i])
            if page.startswith("<!--", i):
                e = page.find("-->", i + 4)
                at = size if e < 0 else e + 3
                continue
            m = TAG.match(page, i)
            if m is None:
                if page[i + 1:i + 2] in ("!", "?", "/", ""):
                    e = page.find(">", i)
                    at = size if e < 0 else e + 1
                else:
                    self._text("<")
                    at = i + 1
                continue
            at = m.end()
            if page[at - 1] != ">":
                return  # the page ends inside a tag
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            if name == "br":
                self._push("br", 0)
                self.runs.append((self._open[-1], self.block, " "))
                continue
            self._start(name, m[3])
            if name in RAW:
                e = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
                at = size if e is None else e.end()
                self._pop_to(len(self._open) - 1)
            elif name == "plaintext":
                self._text(page[at:])
                return


def density(c: float, t: float, link_c: float, link_t: float, of_body: float) -> float:
    """Composite density from characters, tags, link characters, link tags and the body's share of link characters."""
    if c == 0:
        return 0.0
    base = math.log(c / max(c - link_c, 1) * link_c + of_body * c + math.e**2)
    return c / max(t, 1) * max(math.log(max(c / max(link_c, 1) * max(t, 1) / max(link_t, 1), 1)), 0.0) / math.log(base)


def main_blocks(tree: Tree) -> list[bool]:
    """For every element, whether text directly in it belongs to the main text."""
    name, parent, n = tree.name, tree.parent, len(tree.name)
    holds = [1 if x in ("article", "main") else 2 if x == "h1" else 4 if x == "p" else 0 for x in name]
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    cut, link = [False] * n, [False] * n
    within, main = [0] * n, [0] * n  # the outermost article and the innermost main around an element, or itself
    for i in range(1, n):
        p = parent[i]
        mark = tree.marked[i]
        if name[i] == "header" and not within[p] and name[p] != "main":
            mark = CUT
        has = holds[i]
        cut[i] = cut[p] or mark == CUT or mark == COMMENT and not has & 2 or mark == PART and not has & 1 and has & 6 != 6
        link[i] = link[p] or name[i] == "a"
        within[i] = within[p] or (i if name[i] == "article" and not cut[i] else 0)
        main[i] = i if name[i] == "main" else main[p]
    c, t, link_c, link_t, sums = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
    own = [0] * n
    for node, _, text in tree.runs:
        if not cut[node]:
            size = len(" ".join(text.split()))
            own[node] += size
            c[node] += size
            link_c[node] += size * link[node]
    body = next((i for i in range(n) if name[i] == "body"), 0)
    for i in range(n - 1, 0, -1):
        if not cut[i]:
            p = parent[i]
            c[p] += c[i]
            t[p] += t[i] + 1
            link_c[p] += link_c[i]
            link_t[p] += link_t[i] + (name[i] == "a")
    of_body = link_c[body] / max(c[body], 1)
    dens = [0.0 if cut[i] else density(c[i], t[i], link_c[i], link_t[i], of_body) for i in range(n)]
    holder = [name[i] in BLOCK and name[i] not in TEXT_BLOCK and not cut[i] for i in range(n)]
    for i in range(n):
        if i and not cut[i]:
            sums[parent[i]] += dens[i]
        if holder[i] and own[i]:
            sums[i] += density(own[i], 1, 0, 0, of_body)
    chosen = [False] * n
    inside = range(body + 1, tree.end[body])
    best = max((i for i in inside if holder[i] and c[i]), key=lambda i: (sums[i], -i), default=body)
    beside = own[body] + sum(c[i] - link_c[i] for i in inside if parent[i] == body and name[i] in TEXT_BLOCK)
    if c[best] - link_c[best] < beside:
        best = body
    top = within[best] or main[best] or body  # further content is looked for below it
    best = within[best] or best
    roots = [best]
    if best != top:
        path = [best]
        while path[-1] != top:
            path.append(parent[path[-1]])
        threshold = min(dens[i] for i in path)
        on_path = set(path)
        i = top + 1
        while i < tree.end[top]:
            if i == best or cut[i]:
                i = tree.end[i]
            elif i < best and name[i] in ("h1", "h2") and parent[i] in on_path:
                roots.append(i)
                i = tree.end[i]
            elif i not in on_path and c[i] > link_c[i] and dens[i] >= threshold and name[i] in BLOCK:
                below = [j for j in range(i, tree.end[i]) if holder[j] and c[j]]
                roots.append(max(below, key=lambda j: (sums[j], -j)) if below else i)
                i = tree.end[i]
            else:
                i += 1
    for root in roots:
        for i in range(root, tree.end[root]):
            chosen[i] = True
    for i in range(n - 1, 0, -1):  # menus: lists of two or more links and no other text
        if name[i] in ("ul", "ol") and link_t[i] > 1 and c[i] == link_c[i] and c[i]:
            for j in range(i, tree.end[i]):
                chosen[j] = False
    return [chosen[i] and not cut[i] for i in range(n)]


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by an empty line."""
    if not page:
        return ""
    tree = Tree(page)
    taken = main_blocks(tree)
    blocks: list[str] = []
    last, now = -1, []
    for node, block, text in tree.runs:
        if not taken[node]:
            continue
        if block != last:
            blocks.append("".join(now))
            last, now = block, []
        now.append(text)
    blocks.append("".join(now))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of code points, one row per page."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, RESULT)
