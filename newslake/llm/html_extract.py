"""Main text of HTML pages by a minimum cut between content and boilerplate.

A page becomes a row of text blocks. A block's terminal capacities are the costs of its two labels, in nats: what its
elements say (article, navigation, class and id words, ...) and the log-odds of a logistic classifier over its length,
links, punctuation and kind. The classifier is trained on the blocks that elements do mark, without seeing those marks,
so it can judge blocks and pages that have none. Blocks that follow each other, the closer in the element tree the more,
and blocks of one parent element are tied by smoothness edges. The minimum cut labels the blocks; content blocks are
joined in page order. Being in or outside an article is evidence of the classifier's and the edges' own scale, so the cut
may overrule it (a list of links in an article goes); only a mark of boilerplate outweighs all others together.

The classifier is fitted on a bounded sample, about `Costs.sample` pages of least hash; of these only counts of blocks by
cell of features (a few hundred) leave a task. Without marked blocks of both labels its weights are 0.

Null and empty html gives an empty text. Pages are read whole. Unclosed comments, scripts and other raw elements are taken
to the page's end, as browsers do. What a head can hold has no text but its raw elements', and other text or elements end
it, so head tags need no rule. Buttons, selects, objects and drawings are left out; one without its end tag is left out up
to the next block's tag. Each row is extracted by itself, so repeated rows need no rule; equal costs are settled as content, so a page of which nothing is known is
content.
An empty table gives no rows. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import private

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("button object select svg".split())
#: A slash at a start tag's end that belongs to an unquoted value.
_VALUE = re.compile(r"=\s*[^\s\"'>]*/\Z")
_BAD_TAGS = frozenset("nav aside footer form menu dialog".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification"
    " alert nav navbar navigation menu breadcrumb breadcrumbs sidebar footer foot header masthead comment comments respond reply replies disqus share sharing"
    " social related recommended newsletter subscribe subscription signup login search pagination pager widget popup modal overlay paywall toolbar copyright legal"
    " contentinfo complementary disclaimer form".split()
)
_GOOD_WORDS = frozenset("article content post entry story main body text".split())


@dataclass(frozen=True)
class Costs:
    """All in nats. bad: of a mark of boilerplate; article, outside, good: of a block in an article, outside the page's
    articles, and with a good word on a page without one; most: bound of the classifier's log-odds; near, sibling: edges
    between blocks in a row and of one parent; sample: pages that the classifier learns from."""

    bad: float = 6.0
    article: float = 2.5
    outside: float = 3.0
    good: float = 1.5
    most: float = 3.0
    near: float = 1.0
    sibling: float = 0.5
    ridge: float = 1.0
    sample: int = 5_000


class _Element:
    __slots__ = ("name", "parent", "bad", "page_header", "article", "good", "n")

    def __init__(self, name: str, parent: _Element | None, attrs: str, n: int):
        words = {w.lower() for m in _ATTR.finditer(attrs) for w in _PARTS.split(m[2] or m[3] or m[4] or "")} if attrs else set()
        at = parent
        self.name, self.parent, self.n = name, parent, n
        inside = bool(at and at.article)
        own_article = name in ("article", "main")
        bad_words = words & _BAD_WORDS
        if own_article or name in ("body", "html"):
            bad_words = set()
        elif inside:  # of the article, not of the page
            bad_words -= {"header", "banner", "masthead"}
        self.bad = int(at.bad if at else 0) + (name in _BAD_TAGS) + bool(bad_words)
        self.page_header = bool(at and at.page_header) or (name == "header" and not inside)
        self.article = inside or own_article
        self.good = bool(at and at.good) or bool(words & _GOOD_WORDS)


def _ends(tags: list[re.Match]) -> dict[int, int]:
    """Of the start tags of elements that are left out: the place in tags of their end tags, -1 where there is none.

    An element without an end tag ends where a block around it does. A drawing's start tag that ends it is its end tag.
    """
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    for k, m in enumerate(tags):
        name = (m["name"] or "").lower()
        if name not in _LEFT_OUT and (name not in _BLOCK or name in _VOID):
            continue
        if m["close"]:
            while held.get(name):
                top, at = stack.pop()
                held[top] -= 1
                if top == name:
                    if name in _LEFT_OUT:
                        found[at] = k
                    break
        elif name == "svg" and m["attrs"].endswith("/") and not _VALUE.search(m["attrs"]):
            found[k] = k
        else:
            stack.append((name, k))
            held[name] = held.get(name, 0) + 1
            if name in _LEFT_OUT:
                found[k] = -1
    return found


def blocks_of(page: str) -> list[tuple[str, int, _Element]]:
    """(text, its characters inside links, innermost element) of each block with text."""
    top = at = _Element("", None, "", 0)
    out: list[tuple[str, int, _Element]] = []
    text: list[str] = []
    owner, linked, links, count, last = top, 0, 0, 0, 0
    tags = list(_TAG.finditer(page))
    ends, skipped, left_out = _ends(tags), -1, False

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((joined, min(linked, len(joined)), owner))
        text.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal owner, linked
        if piece and not left_out:
            if not text:
                owner = at
            text.append(piece)
            linked += len(piece) if links else 0

    for k, m in enumerate(tags):
        if k <= skipped:
            last = m.end()
            continue
        take(page[last : m.start()])
        last = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                take(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if name == "head":
            continue
        if k in ends:
            skipped, left_out = ends[k], left_out or ends[k] < 0
            continue
        block = name in _BLOCK
        if block:
            left_out = False
            flush()
        if m["close"]:
            if name == "a":
                links = max(0, links - 1)
            e = at
            while e is not top and e.name != name:
                e = e.parent
            if e is not top:
                at = e.parent
        elif name not in _VOID:
            count += 1
            if name == "a":
                links += 1
            elif block:
                # a block element ends an open paragraph, and an item an open item
                if at.name == "p" or (name in ("li", "dt", "dd", "tr", "td", "th") and at.name == name):
                    at = at.parent
                links = 0
            if name not in ("b", "i", "em", "strong", "span", "font", "u", "small", "code", "sub", "sup", "a"):
                at = _Element(name, at, m["attrs"], count)
            elif m["attrs"] and name != "a":
                at = _Element(name, at, m["attrs"], count)
    take(page[last:])
    flush()
    return out


#: Feature cells: upper ends of text lengths and of shares of linked characters.
_LENGTHS, _LINKED = (20, 60, 150, 400), (0.05, 0.5)
_CELL = (len(_LENGTHS) + 1, len(_LINKED) + 1, 2, 2, 2, 2)
_ENDS = tuple(".!?:;\"”»…。")


def cell_of(text: str, linked: int, e: _Element) -> int:
    """The number of the block's cell: length, link share, list item, heading, ends like a sentence, copyright sign."""
    share = linked / max(1, len(text))
    item = e.name in ("li", "dt", "dd", "option")
    heading = e.name[:1] == "h" and e.name[1:].isdigit()
    parts = (bisect.bisect_left(_LENGTHS, len(text)), bisect.bisect_left(_LINKED, share), item, heading, text.endswith(_ENDS), "\u00a9" in text)
    return int(np.ravel_multi_index([int(x) for x in parts], _CELL))


def _features() -> np.ndarray:
    """A row of indicators for each cell, intercept last."""
    parts = np.stack(np.unravel_index(np.arange(np.prod(_CELL)), _CELL), 1)
    return np.concatenate([parts[:, [k]] == np.arange(1, n) for k, n in enumerate(_CELL)] + [np.ones((len(parts), 1))], axis=1).astype(float)


def marks(blocks: list[tuple[str, int, _Element]]) -> list[int]:
    """1 for blocks that elements mark as content, -1 as boilerplate, 0 for the others."""
    article = any(e.article and not e.bad for _, _, e in blocks)
    return [-1 if e.bad or e.page_header else 1 if e.article else -1 if article else int(e.good) for _, _, e in blocks]


def evidence_of(blocks: list[tuple[str, int, _Element]], costs: Costs) -> list[float]:
    """What the marks say of each block, above 0 for content."""
    article = any(e.article and not e.bad for _, _, e in blocks)
    out = []
    for _, _, e in blocks:
        if e.bad or e.page_header:
            out.append(-costs.bad)
        elif e.article:
            out.append(costs.article)
        else:
            out.append(-costs.outside if article else costs.good * e.good)
    return out


def log_odds(counts: np.ndarray, ridge: float = Costs.ridge) -> np.ndarray:
    """Log-odds of content by cell: a ridge logistic regression on (cell, label) counts, both labels weighted alike."""
    x, total = _features(), counts.sum(axis=0)
    if not total.all():
        return np.zeros(len(x))
    weight = counts * (total.sum() / 2 / total)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = weight.sum(axis=1)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight[:, 1] - n * p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return x @ w


def min_cut(evidence: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True (content) or False by block: the labelling of least total cost; max-flow after sure blocks are contracted.

    A block whose evidence outweighs all its edges has that label in some minimum cut; fixing it moves its edges'
    capacity to the terminals of its neighbours. What is left is cut by augmenting paths.
    """
    n = len(evidence)
    net, ties = list(evidence), [dict() for _ in range(n)]
    for i, j, w in edges:
        ties[i][j] = ties[i].get(j, 0.0) + w
        ties[j][i] = ties[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(net[i]) >= sum(ties[i].values()):
            label[i] = net[i] >= 0
            for j, w in ties[i].items():
                net[j] += w if label[i] else -w
                del ties[j][i]
                queue.append(j)
            ties[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return label
    # source n, sink n + 1
    room: dict[int, dict[int, float]] = {i: dict(ties[i]) for i in left}
    room[n], room[n + 1] = {}, {}
    for i in left:
        a, b = (n, i) if net[i] >= 0 else (i, n + 1)
        room[a][b] = abs(net[i])
        room[b].setdefault(a, 0.0)
    while True:
        came, queue = {n: n}, deque([n])
        while queue and n + 1 not in came:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if n + 1 not in came:
            break
        path, j = [], n + 1
        while j != n:
            path.append((came[j], j))
            j = came[j]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow
    # of the least cuts that with the most content: what can't reach the sink
    back: dict[int, list[int]] = {}
    for i, to in room.items():
        for j, w in to.items():
            if w > 1e-9:
                back.setdefault(j, []).append(i)
    reaches, queue = {n + 1}, deque([n + 1])
    while queue:
        for i in back.get(queue.popleft(), ()):
            if i not in reaches:
                reaches.add(i)
                queue.append(i)
    for i in left:
        label[i] = i not in reaches
    return label


def labelled(blocks: list[tuple[str, int, _Element]], said: list[float], odds: np.ndarray, costs: Costs = Costs()) -> list[bool]:
    """True by block that the minimum cut calls content; said: the marks' evidence."""
    evidence, edges, last = [], [], {}
    for i, ((text, linked, e), mark) in enumerate(zip(blocks, said, strict=True)):
        evidence.append(mark + min(costs.most, max(-costs.most, float(odds[cell_of(text, linked, e)]))))
        parent = e.parent.n if e.parent else 0
        if i:
            before = blocks[i - 1][2]
            other = before.parent.n if before.parent else 0
            edges.append((i - 1, i, costs.near if parent == other else costs.near / 2 if before.n == parent or other == e.n else costs.near / 4))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, costs.sibling))
        last[parent] = i
    return min_cut(evidence, edges)


#: Of no training: every cell alike.
NO_ODDS = np.zeros(int(np.prod(_CELL)))


def main_text(page: str, odds: np.ndarray = NO_ODDS, costs: Costs = Costs()) -> str:
    blocks = blocks_of(page)
    return " ".join(b[0] for b, good in zip(blocks, labelled(blocks, evidence_of(blocks, costs), odds, costs), strict=True) if good)


def train(pages: DataFrame, html_col: str = "html", costs: Costs = Costs()) -> np.ndarray:
    """Log-odds of content by cell, from the marked blocks of a sample of pages."""
    cells = int(np.prod(_CELL))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((cells, 2), np.int64)
        for part in parts:
            for page in part.iloc[:, 0]:
                blocks = blocks_of(page) if isinstance(page, str) else []
                for (text, linked, e), mark in zip(blocks, marks(blocks), strict=True):
                    if mark:
                        seen[cell_of(text, linked, e), int(mark > 0)] += 1
        cell, label = np.nonzero(seen)
        yield pd.DataFrame({"cell": cell, "label": label, "n": seen[cell, label]})

    share = min(1.0, costs.sample / max(1, pages.count()))
    page = F.col(html_col)
    some = pages.select(page).where((F.xxhash64(page).bitwiseAND(F.lit((1 << 53) - 1))) <= int(share * (1 << 53)))
    counts = np.zeros((cells, 2))
    for r in some.mapInPandas(count, "cell long, label long, n long").groupBy("cell", "label").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"], r["label"]] = r["n"]
    return log_odds(counts, costs.ridge)


def extracted(page: Column, odds: np.ndarray, costs: Costs = Costs()) -> Column:
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, odds, costs) if isinstance(p, str) else "" for p in pages], dtype=object)

    return text.asNondeterministic()(page)


def extract(
    pages: DataFrame, odds: np.ndarray | None = None, costs: Costs = Costs(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. Without odds, they are trained on the pages."""
    odds, name = train(pages, html_col, costs) if odds is None else odds, private("text")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(F.col(html_col), odds, costs).alias(name))
    return rows.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
