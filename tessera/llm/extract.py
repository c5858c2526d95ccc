"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A classifier trained here gives each block's odds of
being content, from its text, its neighbours' and container's, and from what its containers say (element,
role, class and id words). The log-odds are terminal capacities of a flow network; edges join blocks next
to each other, weaker by each step between them in the document tree, and blocks of one container. The
minimum cut, the maximum flow's, labels the blocks; content blocks in page order are the text.

Pages are independent: one pass, no shuffle. The classifier is a logistic regression fitted on the blocks of
a bounded sample of pages. Its labels are distant: pages with article, main or landmark elements teach
which texts are content. Half of its rows hide what containers say, so that text alone must decide there,
as on pages without such markup. What containers say has a prior mean, so that a mark that the sample
lacks still counts.

Parsing and settling the labels take time linear in the page; only blocks that no neighbour settles need flow.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mincut import min_cut

#: Pages whose blocks train the classifier: the documented bound.
TRAIN_PAGES = 400
#: Capacities between neighbours and within a container; each further step in the tree, or a different landmark, divides.
ADJACENT, SIBLING, STEP, ACROSS = 1.2, 0.6, 2.0, 4.0

# HTML's elements by role, and words of class, id and role attributes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select button xmp noembed noframes".split())
NESTING_RAW = frozenset("noscript template object svg math canvas audio video select button".split())
CLOSES_P = BLOCK_TAGS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "html", "body", "option", "optgroup", "legend", "summary", "figcaption"}
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
SCOPES = frozenset("ul ol table div section article main body dl nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LANDMARKS = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist status".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side rail menu menubar nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended widget pagination pager tags disclaimer copyright legal search form "
    "skip hidden outbrain taboola paywall".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
CONTENT_WORDS = frozenset("article content post entry story main body text page".split())

_COMMENT_END = "-->"
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Node:
    """An open or closed element: its parent, and what it says of the text in it."""

    tag: str
    parent: int
    depth: int
    landmark: int  # 1 boilerplate by element or role, 2 by class words, 3 reader comments, 0 none
    content: int  # 1 article or main, 2 by class words
    holds_main: bool = False
    holds_title: bool = False


@dataclass
class Block:
    text: str
    node: int
    links: int  # characters inside links
    heading: bool


def _node(tag: str, attributes: str, parent: int, depth: int) -> Node:
    landmark, content = int(tag in LANDMARKS), int(tag in ("article", "main"))
    if attributes and not attributes.isspace():
        found = {}
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), a or b or c)
        words = {w.lower() for key in ("class", "id") for w in _WORD.findall(found.get(key, ""))} if tag not in ("html", "body") else set()
        if words & COMMENT_WORDS:
            landmark = 3
        elif found.get("role", "").lower() in ROLES or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
            landmark = landmark or 1
        elif words & BOILER_WORDS and tag not in ("article", "main"):
            landmark = landmark or 2
        elif words & CONTENT_WORDS and not content:
            content = 2
    if tag == "header":
        landmark = landmark or 2
    return Node(tag, parent, depth, landmark, content)


class Scanner:
    """Tags of a page, each found from the place where the one before ended. Any page takes linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.ends, self.unclosed = page, None, set()

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ended at `at` has its ">": outside quotes, or the first one where
        quotes do not pair up, or -1."""
        if self.ends is None:
            if found := _REST.match(self.page, at):
                return found.end() - 1
            self._pair_quotes(at)
        else:
            place = self.ends[1][bisect_left(self.ends[0], at)]
            if place >= 0:
                return place
        return self.page.find(">", at)

    def _pair_quotes(self, at: int) -> None:
        """For every mark from `at` on, if read outside quotes, where its tag ends: one walk from the end."""
        marks = [(m.start(), m[0]) for m in _MARK.finditer(self.page, at)]
        n = len(marks)
        ends, following = [-1] * (n + 2), {'"': n, "'": n}
        for k in range(n - 1, -1, -1):
            place, mark = marks[k]
            ends[k] = place if mark == ">" else ends[following[mark] + 1]
            following[mark] = k
        self.ends = [place for place, _ in marks], ends

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag; no name: a comment or declaration."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find(_COMMENT_END, start + 4)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            name = _NAME.match(page, start + 1)
            if name or page[start + 1 : start + 2] in ("!", "?", "/"):
                end = self.tag_end(name.end()) if name else page.find(">", start)
                if end < 0:  # no ">" follows, so at most a comment that runs to the end
                    start = page.find("<!--", start)
                    return (start, len(page), "", False, "") if start >= 0 else None
                return start, end + 1, name[2].lower() if name else "", bool(name and name[1]), page[name.end() : end] if name else ""
            at = start + 1
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the raw element that began before `at` ends, or -1."""
        if tag in self.unclosed:
            return -1
        end = re.compile(rf"</{tag}\s*>", re.I).search(self.page, at)
        if not end:
            self.unclosed.add(tag)
        return end.end() if end else -1


class Elements:
    """The open elements of a page, and all elements there were. Counts of open tags spare walks that find nothing."""

    def __init__(self) -> None:
        self.nodes = [Node("", -1, 0, 0, 0)]
        self.stack, self.counts, self.scopes = [0], Counter(), [Counter()]

    def open(self, tag: str, attributes: str) -> None:
        node = _node(tag, attributes, self.stack[-1], len(self.stack))
        self.nodes.append(node)
        self.stack.append(len(self.nodes) - 1)
        self.counts[tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][tag] += 1
        if tag in ("article", "main", "h1"):
            what, above = "holds_title" if tag == "h1" else "holds_main", node.parent
            while above >= 0 and not getattr(self.nodes[above], what):
                setattr(self.nodes[above], what, True)
                above = self.nodes[above].parent

    def _close_from(self, names: tuple[str, ...]) -> None:
        """Close the innermost open element of these names, and all in it."""
        while True:
            tag = self.nodes[self.stack.pop()].tag
            self.counts[tag] -= 1
            if tag in SCOPES:
                self.scopes.pop()
            else:
                self.scopes[-1][tag] -= 1
            if tag in names:
                return

    def close(self, tag: str) -> bool:
        """An end tag; False if no such element is open."""
        if not self.counts[tag]:
            return False
        self._close_from((tag,))
        return True

    def make_way(self, tag: str) -> None:
        """A start tag ends an open paragraph, item or cell, within the innermost list, table or section."""
        names = ENDS.get(tag) or (("p",) if tag in CLOSES_P else ())
        if any(self.scopes[-1][name] for name in names):
            self._close_from(names)


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """Text blocks of a page in order, and its elements. Unclosed and stray tags are taken as browsers
    roughly do: a block-level tag ends an open paragraph, an end tag closes what is open inside it."""
    scanner, elements = Scanner(page), Elements()
    nodes, stack = elements.nodes, elements.stack
    blocks: list[Block] = []
    pieces: list[str] = []
    links = link_depth = at = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, stack[-1], links, any(nodes[k].tag in HEADINGS for k in stack[-3:])))
        pieces.clear()
        links = 0

    def put(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if link_depth:
                links += len(text)

    while found := scanner.next(at):
        start, end, tag, closes, attributes = found
        put(page[at:start])
        at = end
        if not tag:
            continue
        if closes:
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in BLOCK_TAGS:
                flush()
                if elements.close(tag):
                    link_depth = 0
            continue
        if tag in RAW_TAGS:
            if not attributes.endswith("/"):
                end = scanner.raw_end(tag, at)
                at = end if end >= 0 else len(page) if tag not in NESTING_RAW else at
            continue
        if tag == "a":
            link_depth = 1
        elif tag == "br":
            pieces.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        elements.make_way(tag)
        if tag not in VOID_TAGS:
            elements.open(tag, attributes)
    tail = page[at:]
    put(tail[: tail.rfind("<")] if re.search(r"<[a-zA-Z/!?][^>]*\Z", tail) else tail)
    flush()
    return blocks, nodes


#: What a block's containers say of it: nothing, content by element or class, boilerplate by element or class, comments.
NOTHING, ELEMENT_CONTENT, CLASS_CONTENT, ELEMENT_BOILER, CLASS_BOILER, COMMENTS = range(6)


def structure(nodes: list[Node]) -> list[tuple[int, int]]:
    """For each element, what its containers say and the landmark that it is in (or 0)."""
    out: list[tuple[int, int]] = []
    for k, node in enumerate(nodes):
        says, mark = out[node.parent] if node.parent >= 0 else (NOTHING, 0)
        wrapper = node.holds_main or node.holds_title and node.tag != "header"
        inside = says in (ELEMENT_CONTENT, CLASS_CONTENT) and mark == 0
        if node.landmark == 2 and wrapper or node.tag == "form" and node.holds_main:
            pass  # it holds the article, whatever it is called
        elif node.landmark and not (node.tag == "header" and inside):
            says, mark = (ELEMENT_BOILER, CLASS_BOILER, COMMENTS)[node.landmark - 1], k
        elif node.content and mark == 0 and says != ELEMENT_CONTENT:
            says = ELEMENT_CONTENT if node.content == 1 else CLASS_CONTENT
        out.append((says, mark))
    return out


_STOPS = re.compile(r"[.!?…]")
#: Prior means of the classifier's weights: the bias and what text says, then what containers say from ELEMENT_CONTENT on.
PRIOR = np.array([0.0] * 13 + [5.0, 2.0, -6.0, -4.5, -6.0])
N_TEXT = 13


def features(blocks: list[Block], nodes: list[Node], known: list[tuple[int, int]]) -> np.ndarray:
    """A row for each block: 1, what its text says, what its neighbours and container say, one mark of its containers."""
    n = len(blocks)
    x = np.zeros((n, len(PRIOR)))
    if not n:
        return x
    size = np.array([len(b.text) for b in blocks], float)
    words = np.array([b.text.count(" ") + 1 for b in blocks], float)
    links = np.minimum(size, np.array([b.links for b in blocks], float))
    stops = np.array([len(_STOPS.findall(b.text)) for b in blocks], float)
    commas = np.array([b.text.count(",") for b in blocks], float)
    _, holder = np.unique([nodes[b.node].parent for b in blocks], return_inverse=True)
    held_words, held_size, held_links, held_stops = (np.bincount(holder, v)[holder] for v in (words, size, links, stops))
    x[:, 0] = 1.0
    x[:, 1] = np.log1p(words)
    x[:, 2] = links / size
    x[:, 3] = np.minimum(1.0, 10 * stops / size)
    x[:, 4] = np.minimum(1.0, 5 * commas / words)
    x[:, 5] = [b.heading for b in blocks]
    x[:, 6] = [nodes[b.node].tag == "p" for b in blocks]
    x[:, 7] = [nodes[b.node].tag in ("li", "td", "th", "dd", "dt") for b in blocks]
    x[:, 8] = np.log1p(held_words)
    x[:, 9] = held_links / held_size
    x[:, 10] = np.minimum(1.0, 10 * held_stops / held_size)
    x[1:, 11], x[:-1, 12] = x[:-1, 1], x[1:, 1]
    for k, b in enumerate(blocks):
        if says := known[b.node][0]:
            x[k, N_TEXT + says - 1] = 1.0
    return x


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page in batch.column(0).to_pylist():
            blocks, nodes = blocks_of(page)
            known = structure(nodes)
            says = np.array([known[b.node][0] for b in blocks], int)
            x = np.column_stack([says == ELEMENT_CONTENT, features(blocks, nodes, known)])
            rows += x[(says != NOTHING) & (says != CLASS_CONTENT)].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["row"])


def fit(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weights that maximise the likelihood and the prior: Newton steps. Both labels weigh the same, and so do
    rows with and without what containers say."""
    if not 0 < label.sum() < len(label):
        return PRIOR.copy()
    hidden = x.copy()
    hidden[:, N_TEXT:] = 0.0
    share = np.where(label == 1, 0.25 / label.sum(), 0.25 / (len(label) - label.sum()))
    x, label, share = np.vstack([x, hidden]), np.tile(label, 2), np.tile(share, 2)
    weight, hold = PRIOR.copy(), np.where(np.arange(len(PRIOR)) < N_TEXT, 1e-3, 1e-2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (share * (p - label)) + hold * (weight - PRIOR)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        weight -= np.linalg.solve(bend, slope)
    return weight


def train(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the block classifier, from at most max_pages pages, those of the smallest id hash.

    Blocks in an article or main element are content, those in a landmark are not. Without one of the
    kinds the weights are the prior's: the text then says nothing.
    """
    sample = pages.filter(F.col("html").isNotNull()).select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    rows = sample.select("html").mapInArrow(_training_rows, "row array<double>").toArrow()["row"]
    table = np.array(sorted(rows.to_pylist())).reshape(-1, len(PRIOR) + 1)
    return fit(table[:, 0], table[:, 1:])


def _steps(nodes: list[Node], u: int, v: int) -> int:
    """Steps in the tree from one element to another. Over a page's blocks in order their sum is at most
    twice the number of elements."""
    n = 0
    while u != v:
        if nodes[u].depth >= nodes[v].depth:
            u = nodes[u].parent
        else:
            v = nodes[v].parent
        n += 1
    return n


def network(blocks: list[Block], nodes: list[Node], known: list[tuple[int, int]]) -> list[dict[int, float]]:
    """Smoothness edges between blocks: capacities by neighbourhood in the text and in the tree."""
    edges: list[dict[int, float]] = [{} for _ in blocks]

    def tie(u: int, v: int, capacity: float) -> None:
        capacity /= 1.0 if known[blocks[u].node][1] == known[blocks[v].node][1] else ACROSS
        edges[u][v] = edges[v][u] = edges[u].get(v, 0.0) + capacity

    last: dict[int, int] = {}
    for u, block in enumerate(blocks):
        if u:
            tie(u - 1, u, ADJACENT / STEP ** min(64, max(0, _steps(nodes, blocks[u - 1].node, block.node) - 2)))
        holder = nodes[block.node].parent
        if holder in last:
            tie(last[holder], u, SIBLING)
        last[holder] = u
    return edges


def label_blocks(page: str, weight: np.ndarray) -> tuple[list[Block], np.ndarray, list[int]]:
    """The blocks of a page, their log-odds of being content, and the labels of the minimum cut."""
    blocks, nodes = blocks_of(page)
    known = structure(nodes)
    odds = features(blocks, nodes, known) @ weight
    return blocks, odds, min_cut(odds.tolist(), network(blocks, nodes, known))


def main_text(page: str | None, weight: np.ndarray) -> str:
    """The content blocks of a page, joined by line ends."""
    blocks, _, labels = label_blocks(page or "", weight)
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def _extract(weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page, weight) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages(page_id, url, html).

    Null or empty html, or a page without content blocks: empty text. A null id or url is carried.
    Blocks with equal odds for both labels are content. Repeated rows are each extracted. Other
    columns are not read. Empty table: empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract(train(rows, max_pages)), "page_id long, url string, text string, n_chars long")
