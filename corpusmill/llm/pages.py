"""Main text of web pages by tag-path ratios.

Every text belongs to the path of tags from the root to its element. Text length
and punctuation are summed by path and divided by the number of its elements;
both ratios are smoothed along the page, fused into one score, and the texts of
paths above a share of the mean score are the page's content nodes. The article
is the element that holds them, with the headings and paragraphs before it: all
its blocks count, short ones too. What is marked as something else by its class,
id or role goes, but where the content nodes say that it is most of the article.

Parsing and selection take time and memory in proportion to the page: paths are
numbered, open elements are found by tag, and sums over an element's texts are
differences of running sums.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.kernels import arrow_map

# Kinds of elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
NEVER = frozenset("nav footer aside head script style select option button textarea label fieldset dialog menu object applet audio video canvas map iframe noscript template svg math title".split())
HOLDERS = frozenset("html body div section article main td tr tbody table center span font".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words in class and id that mark what is not the article.
MARKS = frozenset(
    """ad ads adv adbox adslot adsense adsbygoogle googleads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion promoted banner banners taboola outbrain
    nav navbar navigation menu submenu topbar toolbar breadcrumb breadcrumbs masthead header footer bottombar sidebar sidebars sidenav aside rail
    cookie cookies consent gdpr notice notices notification announcement alert popup overlay modal paywall newsletter subscribe subscription signup login
    share sharing social related recommended recommendations widget widgets pagination pager search copyright disclaimer skip""".split()
)
READERS = frozenset("comment comments commentlist disqus discussion reply replies respond reactions".split())
LAYOUT = frozenset("with has no without free".split())
#: A header of one of these is the article's own.
OWN = frozenset("article post entry story content".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，！？¿¡]")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|([^<]+)", re.DOTALL)
#: A tag up to where it can't go on: its end, a quote that does not end, or the end of the page.
_BROKEN = re.compile(r"<(?:\"[^\"]*\"|'[^']*'|[^'\">])*+", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.\-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Texts on either side that smoothing takes in, and the share of the mean score that content nodes need.
RADIUS, SHARE = 2, 0.5
#: Of the content nodes' text, what an element needs to be taken as the article, or to be looked into.
ARTICLE, INSIDE = 0.5, 0.8


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int
    linked: bool = False
    within: bool = False
    out: bool = False
    marked: str = ""


class Open:
    """The open elements, and where those of each tag, and all blocks, stand among them."""

    def __init__(self) -> None:
        self.items: list[tuple[int, str]] = [(0, "")]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: int, tag: str) -> None:
        self.where.setdefault(tag, []).append(len(self.items))
        if tag in BLOCKS:
            self.blocks.append(len(self.items))
        self.items.append((element, tag))

    def last(self, *tags: str) -> int:
        """The innermost of some tags; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def cut(self, at: int) -> None:
        """Close the elements from ``at`` on."""
        while len(self.items) > at:
            _, tag = self.items.pop()
            self.where[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()


def _mark(attributes: str) -> str:
    """What role, class, id and style say: "hidden", "readers", "other" (not the article), or nothing."""
    said = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return "hidden"
        if name == "role" and value.lower() in ROLES:
            said = said or "other"
        if name in ("class", "id"):
            for word in value.split():
                parts = {p.lower() for p in _PART.findall(word)}
                if parts & LAYOUT:
                    continue
                if parts & READERS:
                    said = "readers"
                elif parts & MARKS and not ("header" in parts and parts & OWN):
                    said = said or "other"
    return said


class Page:
    """Elements and texts of a page; a text is (element, block number, decoded text)."""

    def __init__(self, source: str) -> None:
        self.elements = [Element("", -1, 0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self.open = Open()
        at, n, plain = 0, len(source), 0
        while at < n:
            if source[at] == "<" and at < plain:  # inside a tag that does not end
                m = None
            else:
                m = _TOKEN.match(source, at)
            if m is None:
                if at >= plain:
                    plain = _BROKEN.match(source, at).end()
                end = source.find("<", at + 1)
                end = n if end < 0 else end
                self._text(source[at:end])
                at = end
                continue
            at = m.end()
            if m[4] is not None:
                self._text(html.unescape(m[4]))
            elif m[2] is not None:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                else:
                    at = self._start(tag, m[3], source, at)

    def _text(self, text: str) -> None:
        self.texts.append((self.open.items[-1][0], self.block, text))

    def _start(self, tag: str, attributes: str, source: str, at: int) -> int:
        stack = self.open
        if tag in BLOCKS:
            self.block += 1
            if stack.blocks and stack.items[stack.blocks[-1]][1] == "p":
                stack.cut(stack.blocks[-1])
        if tag in CLOSED_BY:
            closes, within = CLOSED_BY[tag]
            own = stack.last(*closes)
            if own > stack.last(*within):
                stack.cut(own)
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return at
        parent = stack.items[-1][0]
        up = self.elements[parent]
        out = up.out or tag in NEVER or tag == "header" and not up.within
        marked = _mark(attributes) if attributes and tag not in ("html", "body", "main") and tag not in HEADINGS else ""
        if tag == "article" and marked == "other":
            marked = ""
        if tag == "form":
            marked = marked or "other"
        path = self.paths.setdefault((up.path, tag), len(self.paths) + 1)
        self.elements.append(Element(tag, parent, path, up.linked or tag == "a", up.within or tag in ("article", "main"), out, marked))
        if tag in RAW:
            if source.find(">", at) < 0:
                return len(source)
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
            return end.end() if end else len(source)
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            stack.push(len(self.elements) - 1, tag)
        return at

    def _end(self, tag: str) -> None:
        stack = self.open
        if tag in BLOCKS:
            self.block += 1
        at = stack.last(tag)
        if at and (tag in BLOCKS or not stack.blocks or stack.blocks[-1] < at):
            stack.cut(at)


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian means of each value and RADIUS values on either side."""
    weights = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / 2)
    total = np.convolve(values, weights, "full")[RADIUS : RADIUS + len(values)]
    return total / np.convolve(np.ones(len(values)), weights, "full")[RADIUS : RADIUS + len(values)]


def content_nodes(page: Page, texts: list[tuple[int, int, str]]) -> np.ndarray:
    """Whether each text is on a path above the threshold."""
    sums: dict[int, list[float]] = {}
    elements: dict[int, set[int]] = {}
    for e, _, t in texts:
        own = page.elements[e]
        total = sums.setdefault(own.path, [0.0, 0.0])
        if not own.linked:
            total[0] += len(t.strip())
            total[1] += len(PUNCTUATION.findall(t))
        elements.setdefault(own.path, set()).add(e)
    paths = [page.elements[e].path for e, _, _ in texts]
    length = np.array([sums[p][0] / len(elements[p]) for p in paths])
    marks = np.array([sums[p][1] / len(elements[p]) for p in paths])
    fused = _smooth(length) * (1 + _smooth(marks))
    return (fused >= SHARE * fused.mean()) & (fused > 0)


class Sums:
    """Sums over the texts under each element: elements are numbered in page order."""

    def __init__(self, page: Page) -> None:
        n = len(page.elements)
        self.n, self.last = n, list(range(n))
        for k in range(n - 1, 0, -1):
            up = page.elements[k].parent
            self.last[up] = max(self.last[up], self.last[k])

    def running(self, own: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(np.bincount(own, values, self.n))])

    def under(self, total: np.ndarray, k: int) -> float:
        return float(total[self.last[k] + 1] - total[k])


def main_text(source: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    page = Page(source or "")
    sums, elements = Sums(page), page.elements
    articles = np.concatenate([[0], np.cumsum([e.tag in ("article", "main", "h1") and not e.marked and not e.out for e in elements])])
    aside = [False] * len(elements)  # under an element that is marked as something else
    for k, e in enumerate(elements[1:], 1):
        e.out |= elements[e.parent].out
        aside[k] = aside[e.parent]
        if e.marked in ("hidden", "readers"):  # readers' comments may be articles to the page
            e.out = True
        elif e.marked and articles[sums.last[k] + 1] == articles[k]:  # what wraps the article is not what its name says
            aside[k] = True
    every = [t for t in page.texts if not elements[t[0]].out]
    texts = [t for t in every if not aside[t[0]]]
    own = np.array([t[0] for t in texts], np.int64)
    weight = np.array([len(t[2].strip()) for t in texts], float)
    weight = weight * content_nodes(page, texts) if weight.any() else weight
    if not weight.any():
        # Of an article the marks would leave nothing: there the ratios decide.
        texts = [t for t in every if elements[t[0]].within]
        aside = [a and not e.within for a, e in zip(aside, elements, strict=True)]
        own = np.array([t[0] for t in texts], np.int64)
        weight = np.array([len(t[2].strip()) for t in texts], float)
        weight = weight * content_nodes(page, texts) if weight.any() else weight
        if not weight.any():
            return ""
    chosen = sums.running(own, weight)
    share = lambda k: sums.under(chosen, k) / chosen[-1]
    named = [k for k, e in enumerate(elements) if e.tag in ("article", "main") and not e.out and share(k) >= ARTICLE]
    best = max(named, key=lambda k: (share(k) >= INSIDE, k), default=0)
    children: dict[int, list[int]] = {}
    for k, e in enumerate(elements[1:], 1):
        children.setdefault(e.parent, []).append(k)
    taken = np.zeros(len(elements), bool)
    if not named:
        while True:
            inner = next((k for k in children.get(best, []) if elements[k].tag in HOLDERS and not elements[k].out and share(k) >= INSIDE), None)
            if inner is None:
                break
            for k in reversed([k for k in children[best] if k < inner and not elements[k].out]):
                if elements[k].tag not in HEADINGS and elements[k].tag != "p":
                    break
                taken[k : sums.last[k] + 1] = True  # the title, and what leads in
            best = inner
    taken[best : sums.last[best] + 1] = True
    if not named:
        length = np.array([len(t[2].strip()) for t in texts], float)
        whole, links = sums.running(own, length), sums.running(own, length * np.array([elements[t[0]].linked for t in texts]))
        for k in children.get(best, []):
            if elements[k].tag in ("div", "section", "ul", "ol", "table") and not share(k) and 2 * sums.under(links, k) > sums.under(whole, k):
                taken[k : sums.last[k] + 1] = False
    # The second vote: what is marked stays out unless the ratios find most of the article in it.
    if len(every) > len(texts):
        own = np.array([t[0] for t in every], np.int64)
        seen = sums.running(own, np.array([len(t[2].strip()) for t in every], float) * content_nodes(page, every))
        for k, e in enumerate(elements):
            if k > best and k <= sums.last[best] and aside[k] and not aside[e.parent] and sums.under(seen, k) >= ARTICLE * sums.under(seen, best) > 0:
                for i in range(k, sums.last[k] + 1):
                    aside[i] = False
    blocks: dict[int, list[str]] = {}
    for e, b, t in every:
        if taken[e] and not aside[e]:
            blocks.setdefault(b, []).append(t)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``.

    Null and empty html have an empty text, as have pages without an article. A
    task's memory grows with the longest page, however deep its elements are.
    Repeated rows give repeated rows; a null url stays null; other columns take
    no part, whatever their names.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def work(batch: pa.RecordBatch) -> dict:
        return {"page_id": batch.column(0), "url": batch.column(1), "text": [main_text(h) for h in batch.column(2).to_pylist()]}

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = own.mapInArrow(arrow_map(work, schema, "html"), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
