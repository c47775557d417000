"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the blocks before
and behind it, and two facts of its place: whether an article or main element holds it, and how many of its ancestors name
themselves as something else (menu, header, footer, sidebar, notice, advert, form, comments). A small decision tree, trained
here on the labelled blocks below, says which blocks are main text. No block is shuffled: a page is one row of one task.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed sets of element names (HTML standard).
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title noscript template svg iframe object canvas audio video select option button textarea datalist annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noscript".split())  # closed by their own end tag only
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav header footer aside form dialog menu".split())
# Fixed words in class, id or role that name a part of a page which is not its article.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disqus disclaimer footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion rail recommended related replies search share sharing sidebar sidenav "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget alert".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
#: Before a name in a class token these say that the element has such a part, or lacks it, not that it is one.
_OTHER = re.compile(r"(?:^|[-_])(?:has|have|with|no|not|without|hide)[-_]")

FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "in_main", "aside")
#: The labelled table the tree is trained on: the features of a block, and whether it is main text.
LABELLED = (
    (120, .0, 80, .0, 95, .0, 1, 0, 1), (45, .02, 120, .0, 60, .0, 1, 0, 1), (1, .0, 60, .0, 40, .0, 1, 0, 1), (3, .0, 1, .0, 2, .0, 1, 0, 1),
    (8, .0, 8, .0, 70, .0, 1, 0, 1), (12, .0, 6, 1., 12, .0, 1, 0, 1), (30, .1, 12, .0, 3, 1., 1, 0, 1), (2, .0, 90, .0, 0, .0, 1, 0, 1),
    (600, .01, 12, .0, 300, .0, 1, 0, 1), (15, .4, 50, .0, 60, .0, 1, 0, 1), (4, 1., 70, .0, 80, .0, 1, 0, 1), (25, .0, 0, .0, 0, .0, 1, 0, 1),
    (9, .0, 0, .0, 40, .0, 1, 0, 1), (5, .0, 7, .0, 8, .0, 1, 0, 1), (1, .0, 6, 1., 1, .0, 1, 0, 1), (200, .0, 9, .0, 9, .0, 1, 0, 1),
    (4, 1., 20, .0, 30, .0, 1, 0, 1), (1, 1., 3, .0, 2, .0, 1, 0, 1), (3, 1., 2, 1., 3, 1., 1, 0, 1), (14, .9, 8, .0, 0, .0, 1, 0, 1),
    (90, .0, 60, .0, 70, .0, 0, 0, 1), (40, .05, 90, .0, 30, .0, 0, 0, 1), (25, .0, 40, .0, 55, .0, 0, 0, 1), (150, .02, 3, 1., 80, .0, 0, 0, 1),
    (9, .0, 2, 1., 120, .0, 0, 0, 1), (6, .0, 80, .0, 100, .0, 0, 0, 1), (12, .0, 60, .0, 90, .0, 0, 0, 1), (70, .0, 4, 1., 3, 1., 0, 0, 1),
    (35, .0, 30, .0, 5, 1., 0, 0, 1), (3, .0, 45, .0, 60, .0, 0, 0, 1), (22, .1, 60, .0, 20, .0, 0, 0, 1), (16, .0, 20, .0, 33, .0, 0, 0, 1),
    (1, 1., 1, 1., 1, 1., 0, 1, 0), (2, 1., 2, 1., 2, 1., 0, 2, 0), (8, .0, 1, 1., 9, .0, 0, 1, 0), (40, .0, 8, .0, 60, .0, 0, 1, 0),
    (60, .0, 80, .0, 30, .0, 0, 1, 0), (10, .0, 70, .0, 0, .0, 0, 1, 0), (12, .2, 2, .0, 0, .0, 0, 1, 0), (90, .0, 60, .0, 60, .0, 0, 2, 0),
    (35, .0, 100, .0, 45, .0, 1, 1, 0), (8, .0, 100, .0, 80, .0, 1, 1, 0), (3, 1., 60, .0, 3, 1., 1, 1, 0), (120, .0, 40, .0, 50, .0, 1, 1, 0),
    (20, .0, 90, .0, 10, .0, 1, 2, 0), (2, .0, 50, .0, 50, .0, 1, 1, 0), (300, .0, 90, .0, 10, .0, 0, 1, 0), (1, .0, 9, .0, 9, .0, 0, 1, 0),
    (3, 1., 2, 1., 4, 1., 0, 0, 0), (5, 1., 60, .0, 4, 1., 0, 0, 0), (2, 1., 3, 1., 30, .0, 0, 0, 0), (12, .9, 10, .8, 14, .9, 0, 0, 0),
    (30, .8, 20, .9, 25, .8, 0, 0, 0), (4, .0, 3, 1., 2, 1., 0, 0, 0), (3, .0, 2, 1., 4, .0, 0, 0, 0), (6, .0, 4, 1., 3, 1., 0, 0, 0),
    (2, .0, 0, .0, 3, 1., 0, 0, 0), (5, .0, 6, .0, 3, .0, 0, 0, 0), (7, .5, 4, .0, 0, .0, 0, 0, 0), (1, .0, 2, .0, 1, .0, 0, 0, 0),
)


@dataclass
class Tree:
    """A node: a leaf's answer, or the feature and bound that part the rows."""

    answer: bool
    feature: int = -1
    bound: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def says(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.bound else node.high
        return node.answer


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 1) -> Tree:
    """A binary tree by Gini impurity. Of equal splits the first feature and lowest bound win."""
    answer = bool(2 * labels.sum() > len(labels))
    if depth == 0 or labels.min() == labels.max():
        return Tree(answer)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for bound in (values[:-1] + values[1:]) / 2:
            left = rows[:, f] <= bound
            n, m = left.sum(), (~left).sum()
            if min(n, m) < least:
                continue
            p, q = labels[left].mean(), labels[~left].mean()
            impurity = n * p * (1 - p) + m * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(bound), left
    if best is None:
        return Tree(answer)
    _, f, bound, left = best
    return Tree(answer, f, bound, train(rows[left], labels[left], depth - 1, least), train(rows[~left], labels[~left], depth - 1, least))


def default_tree() -> Tree:
    table = np.array(LABELLED, dtype=float)
    return train(table[:, :-1], table[:, -1])


def _aside(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element is something other than the article: 2 by its tag or because it is hidden, 1 by a name or as a form, else 0."""
    if tag in ASIDE and tag != "form" and not (tag == "header" and in_main):
        return 2
    named = int(tag == "form")
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and any(not NAMES.isdisjoint(_WORD.findall(token)) and not _OTHER.search(token) for token in value.split()):
            named = 1
    return named


def blocks(page: str) -> list[tuple[str, tuple[float, ...]]]:
    """The text blocks of a page in order, each with its features.

    A name, or being a form, does not count for an element that holds an article or main element, or, where the page has no such element, most of
    its words outside links: that is a wrapper of the page.
    """
    stack: list[tuple[str, int, bool]] = []  # name, 2: aside by its tag or 1: by a name, silent
    found: list[tuple[str, int, int, int, int]] = []
    named: list[int] = []  # the open elements that are aside by a name
    under: list[tuple[int, ...]] = []  # those around each block
    wrappers: set[int] = set()
    number = 0
    has_main = False
    pieces: list[str] = []
    linked = asides = mains = silent = anchors = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            words = text.count(" ") + 1
            found.append((text, words, min(linked, words), int(mains > 0), asides))
            under.append(tuple(named))
        linked = 0

    def leave(depth: int) -> None:
        nonlocal asides, mains, silent, anchors
        while len(stack) > depth:
            name, aside, quiet = stack.pop()
            if name in BLOCK or aside:
                flush()
            asides -= aside == 2
            if aside == 1:
                named.pop()
            mains -= name in MAIN
            silent -= quiet
            anchors -= name == "a"

    def put(text: str) -> None:
        nonlocal linked
        if text and not silent:
            text = html.unescape(text)
            pieces.append(text)
            if anchors:
                linked += len(text.split())

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in VOID:
            if tag == "br":
                put(" ")
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, -1, -1):  # an open paragraph, item or cell ends where the next one begins
                name = stack[depth][0]
                if name == "p" or name == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                    leave(depth)
                    break
                if name in BLOCK:
                    break
            flush()
        if m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        aside, quiet = _aside(tag, m[3], mains > 0), tag in SILENT
        if aside and tag not in BLOCK:
            flush()
        stack.append((tag, aside, quiet))
        asides += aside == 2
        if tag in MAIN and not silent:
            has_main = True
            wrappers.update(named)
        if aside == 1:
            named.append(number)
            number += 1
        mains += tag in MAIN
        silent += quiet
        anchors += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
    leave(0)
    flush()
    if not has_main:
        own = [words - links for _, words, links, _, _ in found]
        held: dict[int, int] = {}
        for n, around in zip(own, under):
            for k in around:
                held[k] = held.get(k, 0) + n
        wrappers.update(k for k, n in held.items() if 2 * n > sum(own))
    out = []
    for i, (text, words, links, main, aside) in enumerate(found):
        aside += sum(k not in wrappers for k in under[i])
        before = found[i - 1] if i else (None, 0, 0)
        behind = found[i + 1] if i + 1 < len(found) else (None, 0, 0)
        density = [links / words, *(b[2] / b[1] if b[1] else 0.0 for b in (before, behind))]
        out.append((text, (words, density[0], before[1], density[1], behind[1], density[2], main, aside)))
    return out


def main_text(page: str, tree: Tree) -> str:
    return " ".join(text for text, row in blocks(page) if tree.says(row))


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null, empty or textless page gives an empty text. Cut-off tags are dropped, unknown references stay as they are. Ids and
    urls pass through, nulls included; repeated rows are read each on their own; other columns are ignored.
    """
    tree = tree or default_tree()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
