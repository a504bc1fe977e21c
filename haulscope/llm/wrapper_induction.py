"""Main text of web pages by wrapper induction.

Pages of a host are made from few templates. They are grouped by layout, which is the skeleton of a
page's upper levels, and each layout has an exemplar page; layouts with too few different pages to
tell a template join the host's most frequent one. Every page's tree is aligned with its exemplar's by simple tree matching, and for each exemplar node it is counted how
many pages have it and how many have it with the same text. Nodes whose text stays the same are
template; slots whose text varies hold content. A page is then aligned once more with the
exemplar: text in template nodes goes, as does text in parts that HTML itself marks as menus,
headers, footers, sidebars, notices, adverts, forms or comments.

Copies of one article would make its text look constant, so every distinct main text of a host has
one vote, which its copies share.

Counts are summed inside each task and again by host, so a host with a third of all pages is a few
rows. The exemplars are broadcast only when measured to be small.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from haulscope.llm import common
from haulscope.llm.html_text import BLOCK, Node, blocks, parse
from haulscope.operators.joins import join_measured

# A node is template when at least this many pages that differ from the exemplar have it, and this
# share of those has the same text in it.
MIN_PAGES = 3
SAME_SHARE = 0.8
# The levels below the body that make a layout, and the share of the smaller page's elements on
# these levels that an exemplar must match for the page to vote.
LEVELS = 2
WELL = 0.75
# One vote in whole units, so that sums don't depend on their order; copies share it evenly.
VOTE = 1 << 30
# Cells of one alignment table; longer lists of children are cut at equal subtrees first.
MAX_CELLS = 250_000
# Up to so many cells every pair of subtrees is matched for itself; beyond, each pair of kinds once.
FEW_CELLS = 256
# Parts of a divided table that are worked out in full.
SMALL_TABLE = 2_048
# An equal text counts for as many elements in an alignment, so that it outweighs the places of others.
TEXT = 1_000

# Parts that never hold main text, by element, role, and words of class or id.
NEVER = frozenset(
    "head script style noscript template nav aside footer form iframe svg button select textarea "
    "input object embed canvas audio video dialog menu title search datalist noframes".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar".split()
)
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|adslot|sponsor|sponsored|"
    r"promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|sidebar|side|rail|widget|widgets|menu|"
    r"nav|navbar|navigation|breadcrumb|breadcrumbs|pager|pagination|comment|comments|commentlist|"
    r"disqus|respond|reply|replies|discussion|share|sharing|social|related|recommended|"
    r"recommendations|footer|header|masthead|topbar|toolbar|login|legal|copyright|disclaimer|"
    r"skip|tags|meta|byline)(?=$|[\s_-]|\d)",
    re.I,
)


def marked(node: Node) -> bool:
    """Whether HTML itself says that an element holds no main text."""
    if node.tag in NEVER:
        return True
    if node.tag == "header":
        # A header with the article's own headline stays.
        return not any(c.tag in ("h1", "h2", "hgroup") for c in node.elements())
    if not node.raw or node.tag in ("html", "body", "main"):
        return False
    attributes = node.attributes
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes:
        return True
    if attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    found = MARKED.search(names)
    if not found:
        return False
    # "with-sidebar" and the like on an element around the article say what is next to it.
    around = ("h1", "main") if re.search("comment|repl|related|recommend", names, re.I) else _AROUND
    return not _holds(node, around)


_AROUND = ("h1", "main", "article")


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    todo = [node]
    while todo:
        for child in todo.pop().elements():
            if child.tag in tags:
                return True
            todo.append(child)
    return False


def own_text(node: Node) -> str:
    """The text directly in an element and its inline elements, white space as it stands."""
    found, todo = [], node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            found.append(child)
        elif child.tag not in BLOCK and child.tag not in NEVER:
            if child.children:
                todo.extend(reversed(child.children))
            else:
                found.append(" ")
    return "".join(found)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matching elements of two trees, by simple tree matching.

    Roots with equal names match; below them, the lists of children are aligned in order so that the
    matched subtrees have as many equal texts as possible, then as many elements. Elements with
    equal names and texts at both ends are matched at once. Trees may have any depth.
    """
    work = _Alignment()
    stack = [work.match(a, b)]
    while stack:
        need = next(stack[-1], None)
        if need is None:
            stack.pop()
        else:
            stack.append(work.match(*need))
    pairs: list[tuple[Node, Node]] = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo.extend(work.sizes.get((x.no, y.no), _NO_CHILDREN)[1])
    return pairs


_NO_CHILDREN: tuple[int, list] = (0, [])


class _Side:
    """What the alignment needs to know of one tree's elements, each found once."""

    def __init__(self):
        self._children: dict[int, list[Node]] = {}
        self._texts: dict[int, int] = {}

    def children(self, x: Node) -> list[Node]:
        found = self._children.get(x.no)
        if found is None:
            found = [c for c in x.children if not isinstance(c, str) and (c.tag in BLOCK or c.children)]
            self._children[x.no] = found
        return found

    def text(self, x: Node) -> int:
        """A hash of an element's own text, 0 for white space."""
        found = self._texts.get(x.no)
        if found is None:
            text = own_text(x)
            found = self._texts[x.no] = hash(text) if text.strip() else 0
        return found

    def below(self, nodes: list[Node]) -> list[Node]:
        """The nodes and all elements below them; an element comes before its children."""
        found = list(nodes)
        for x in found:
            found.extend(self.children(x))
        return found

    def kinds(self, nodes: list[Node], texts: set[int] | None = None) -> list[int]:
        """Hashes of whole subtrees: names and texts (all, or just those that are in ``texts``)."""
        kinds: dict[int, int] = {}
        for x in reversed(self.below(nodes)):
            text = self.text(x) if x.tag in BLOCK else 0
            if texts is not None and text not in texts:
                text = 0
            kinds[x.no] = hash((x.tag, text, tuple(kinds[c.no] for c in self.children(x))))
        return [kinds[x.no] for x in nodes]


class _Alignment:
    """Matches of two trees. Methods that yield ask for the match of the two elements first."""

    def __init__(self):
        self.a, self.b = _Side(), _Side()
        self.sizes: dict[tuple[int, int], tuple[int, list]] = {}

    def match(self, x: Node, y: Node) -> Iterator[tuple[Node, Node]]:
        p, q = self.a.children(x), self.b.children(y)
        if len(p) == 1 and len(q) == 1:
            chosen = [(p[0], q[0])] if p[0].tag == q[0].tag else []
        else:
            chosen = yield from self.lists(p, q)
        total = self.own(x, y)
        for u, v in chosen:
            total += (yield from self.size(u, v))
        self.sizes[x.no, y.no] = (total, chosen)

    def size(self, u: Node, v: Node) -> Iterator[tuple[Node, Node]]:
        if not self.a.children(u) or not self.b.children(v):
            return self.own(u, v)
        if (u.no, v.no) not in self.sizes:
            yield u, v
        return self.sizes[u.no, v.no][0]

    def own(self, u: Node, v: Node) -> int:
        """The weight of two elements of one name without their children."""
        if u.tag not in BLOCK:
            return 1
        text = self.a.text(u)
        return 1 + TEXT if text and text == self.b.text(v) else 1

    def alike(self, u: Node, v: Node) -> bool:
        """Equal names and equal texts of elements without blocks below."""
        return u.tag == v.tag and self.a.text(u) == self.b.text(v) and _leaf(u) and _leaf(v)

    def lists(self, p: list[Node], q: list[Node]) -> Iterator[tuple[Node, Node]]:
        """The pairs of two lists of children."""
        chosen: list[tuple[Node, Node]] = []
        lo, hi, hj = 0, len(p), len(q)
        while lo < hi and lo < hj and self.alike(p[lo], q[lo]):
            chosen.append((p[lo], q[lo]))
            lo += 1
        while hi > lo and hj > lo and self.alike(p[hi - 1], q[hj - 1]):
            hi, hj = hi - 1, hj - 1
            chosen.append((p[hi], q[hj]))
        p, q = p[lo:hi], q[lo:hj]
        if len(p) * len(q) <= MAX_CELLS:
            chosen += yield from self.rest(p, q)
            return chosen
        # Long lists: equal subtrees that each list has once, as many as are in order in both.
        at_p = at_q = 0
        for i, j in [*_in_order(self.a.kinds(p), self.b.kinds(q)), (len(p), len(q))]:
            chosen += yield from self.rest(p[at_p:i], q[at_q:j])
            if i < len(p):
                chosen.append((p[i], q[j]))
            at_p, at_q = i + 1, j + 1
        return chosen

    def rest(self, p: list[Node], q: list[Node]) -> Iterator[tuple[Node, Node]]:
        if not p or not q:
            return []
        if self.uniform(p, q):
            return list(zip(p, q, strict=False))
        plain = not any(map(self.a.children, p)) or not any(map(self.b.children, q))
        few = len(p) * len(q) <= (MAX_CELLS if plain else FEW_CELLS)
        return (yield from (self.table if few else self.halves)(p, q))

    def table(self, p: list[Node], q: list[Node]) -> Iterator[tuple[Node, Node]]:
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        others = [(v, v.tag, not self.b.children(v), self.b.text(v)) for v in q]
        for i, u in enumerate(p, 1):
            row, above = best[i], best[i - 1]
            name, plain, text = u.tag, not self.a.children(u), self.a.text(u)
            text = text if name in BLOCK else 0
            left = corner = 0
            for j, (v, tag, bare, same) in enumerate(others, 1):
                up = above[j]
                if up > left:
                    left = up
                if tag == name:
                    if plain or bare:
                        size = 1 + TEXT if text and text == same else 1
                    else:
                        size = yield from self.size(u, v)
                    if corner + size > left:
                        left = corner + size
                row[j] = left
                corner = up
        return [(p[i], q[j]) for i, j in _traced(best)]

    def uniform(self, p: list[Node], q: list[Node]) -> bool:
        """Whether all are elements of one name without children and no text is in both lists.

        Then all pairs have equal weight.
        """
        if len({x.tag for x in p} | {x.tag for x in q}) > 1:
            return False
        if any(map(self.a.children, p)) and any(map(self.b.children, q)):
            return False
        return not ({self.a.text(x) for x in p} & {self.b.text(x) for x in q}) - {0}

    def halves(self, p: list[Node], q: list[Node]) -> Iterator[tuple[Node, Node]]:
        """The table's result in linear memory: two rows, by divide and conquer.

        Subtrees of equal names whose texts are not in the other list weigh the same: each such kind
        is matched once.
        """
        texts = {self.a.text(x) for x in self.a.below(p) if x.tag in BLOCK}
        texts &= {self.b.text(x) for x in self.b.below(q) if x.tag in BLOCK}
        kinds_p, kinds_q = self.a.kinds(p, texts), self.b.kinds(q, texts)
        of_p, of_q = dict(zip(kinds_p, p, strict=True)), dict(zip(kinds_q, q, strict=True))
        # A pair of different names never pays.
        weights = np.full((len(of_p), len(of_q)), -(1 << 40), np.int64)
        for i, u in enumerate(of_p.values()):
            for j, v in enumerate(of_q.values()):
                if u.tag == v.tag:
                    weights[i, j] = yield from self.size(u, v)
        place_p = {kind: i for i, kind in enumerate(of_p)}
        place_q = {kind: j for j, kind in enumerate(of_q)}
        r = np.array([place_p[kind] for kind in kinds_p])
        c = np.array([place_q[kind] for kind in kinds_q])
        return [(p[i], q[j]) for i, j in _divided(r, c, weights)]


def _in_order(p: list[int], q: list[int]) -> list[tuple[int, int]]:
    """Places of values that both lists have just once: the most that are in order in both."""
    in_p, in_q = Counter(p), Counter(q)
    place = {kind: j for j, kind in enumerate(q)}
    found = [(i, place[k]) for i, k in enumerate(p) if in_p[k] == 1 and in_q[k] == 1]
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(found):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1] = [j]
        last[at : at + 1] = [n]
    pairs, n = [], last[-1] if last else -1
    while n >= 0:
        pairs.append(found[n])
        n = before[n]
    return pairs[::-1]


def _traced(best: list[list[int]]) -> list[tuple[int, int]]:
    """The pairs that a full table stands for."""
    pairs, i, j = [], len(best) - 1, len(best[0]) - 1
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs


def _weighed(rows: list[int], columns: list[int], weights: list[list[int]]) -> list[tuple[int, int]]:
    best = [[0] * (len(columns) + 1)]
    for kind in rows:
        above, weight = best[-1], weights[kind]
        row = [0]
        for j, other in enumerate(columns, 1):
            row.append(max(above[j], row[-1], above[j - 1] + weight[other]))
        best.append(row)
    return _traced(best)


def _divided(r: np.ndarray, c: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Places of the heaviest pairing in order of two lists of kinds."""
    pairs: list[tuple[int, int]] = []
    listed = weights.tolist()
    todo = [(0, len(r), 0, len(c))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        if i == i_end or j == j_end:
            continue
        rows, columns = r[i:i_end], c[j:j_end]
        if (rows == rows[0]).all() and (columns == columns[0]).all():
            if weights[rows[0], columns[0]] > 0:
                pairs += zip(range(i, i_end), range(j, j_end), strict=False)
        elif len(rows) * len(columns) <= SMALL_TABLE:
            found = _weighed(rows.tolist(), columns.tolist(), listed)
            pairs += [(i + x, j + y) for x, y in found]
        elif len(rows) == 1:
            at = int(weights[rows[0], columns].argmax())
            if weights[rows[0], columns[at]] > 0:
                pairs.append((i, j + at))
        else:
            half = len(rows) // 2
            ahead = _last_row(rows[:half], columns, weights)
            back = _last_row(rows[half:][::-1], columns[::-1], weights)[::-1]
            at = int((ahead + back).argmax())
            todo += [(i, i + half, j, j + at), (i + half, i_end, j + at, j_end)]
    return pairs


def _last_row(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    row = np.zeros(len(columns) + 1, np.int64)
    for kind in rows:
        row[1:] = np.maximum(row[1:], row[:-1] + weights[kind, columns])
        np.maximum.accumulate(row, out=row)
    return row


def _leaf(x: Node) -> bool:
    return not any(not isinstance(c, str) and c.tag in BLOCK for c in x.children)


def main_blocks(root: Node, template: set[int]) -> list[str]:
    """The texts of the blocks of the main part. ``template``: numbers of elements to leave out."""
    region, nested = _region(root, template)
    found = blocks(region, lambda node: marked(node) or (node.tag == "article" and nested))
    return [text for owner, text in found if owner.no not in template]


def _region(root: Node, template: set[int]) -> tuple[Node, bool]:
    """The element that holds the main text, and whether articles inside it are comments.

    The article with most text; else main; else the smallest element that holds nearly all text
    outside links. Text in template elements doesn't count.
    """
    holders, nested = _holders(root)
    if holders:
        weigh = lambda node: _size(blocks(node, marked), template)
        return max(holders, key=lambda x: (weigh(x), -x.no)), nested
    here, whole = root, _plain(root, template)
    while True:
        inside = [(_plain(c, template), c) for c in here.elements() if c.tag in BLOCK and not marked(c)]
        weight, heavy = max(inside, key=lambda x: x[0], default=(0, None))
        if heavy is None or heavy.tag not in _HOLDERS or weight < 0.8 * whole:
            return here, False
        here = heavy


def _holders(root: Node) -> tuple[list[Node], bool]:
    """The elements that HTML itself names as main text: articles (True), else mains, else none."""
    articles, mains, todo = [], [], [root]
    while todo:
        node = todo.pop()
        for child in node.elements():
            if child.tag == "article":
                if not marked(child):
                    articles.append(child)
            elif child.tag == "main" or 'role="main"' in child.raw:
                mains.append(child)
                todo.append(child)
            elif not marked(child):
                todo.append(child)
    return articles or mains, bool(articles)


_HOLDERS = frozenset("html body div section center table tbody tr td fieldset".split())


def _size(found: list[tuple[Node, str]], template: set[int]) -> int:
    return sum(len(text) for owner, text in found if owner.no not in template)


def _plain(node: Node, template: set[int]) -> int:
    """Characters of text outside links."""
    return _size(blocks(node, lambda c: c.tag == "a" or marked(c)), template)


def layout(root: Node) -> str:
    """The skeleton of a page's upper levels: names of block elements other than those of running text.

    Runs of equal subtrees count once; an only child below the body is no level of its own.
    """
    return _skeleton(_top(root), LEVELS)


_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 hgroup hr pre blockquote address figure figcaption".split())


def _skeleton(node: Node, levels: int) -> str:
    names: list[str] = []
    for child in node.elements():
        if child.tag in BLOCK and child.tag not in _RUNNING:
            name = f"{child.tag}({_skeleton(child, levels - 1)})" if levels > 1 else child.tag
            if not names or names[-1] != name:
                names.append(name)
    return " ".join(names)


def _top(root: Node) -> Node:
    """The body, or the innermost only child around everything in it."""
    top = _body(root)
    while True:
        inside = [c for c in top.elements() if c.tag in BLOCK]
        if len(inside) != 1 or inside[0].tag not in _HOLDERS:
            return top
        top = inside[0]


def _body(root: Node) -> Node:
    todo = [root]
    for node in todo:
        for child in node.elements():
            if child.tag == "body":
                return child
            if child.tag == "html":
                todo.append(child)
    return root


def aligns_well(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> bool:
    """Whether two pages have enough of their upper levels in common to be made from one template."""
    upper_a, upper_b = _upper(a), _upper(b)
    both = sum(x.no in upper_a and y.no in upper_b for x, y in pairs)
    return both >= WELL * min(len(upper_a), len(upper_b))


def _upper(root: Node) -> set[int]:
    found: set[int] = set()
    level = [_top(root)]
    for _ in range(LEVELS):
        level = [c for node in level for c in node.elements() if c.tag in BLOCK]
        found.update(c.no for c in level)
    return found


# --- on Spark ---------------------------------------------------------------------------------


def _mark(keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds each page's layout and a hash of the text in all parts that may be its main.

    ``html`` goes unless kept.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, mains = [], []
            for page in batch.column("html").to_pylist():
                tree = parse(page)
                layouts.append(_hash(layout(tree)))
                mains.append(_main_hash(tree))
            names = [n for n in batch.schema.names if keep or n != "html"]
            arrays = [*(batch.column(n) for n in names), pa.array(layouts, pa.int64())]
            names += ["_layout", "_main"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(mains, pa.int64())], names)

    return mark


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html").to_pylist()
        found = [_hash(layout(parse(page))) if page else None for page in pages]
        arrays = [*batch.columns, pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "_layout"])


def _main_hash(tree: Node) -> int:
    # All parts, as constant text can outweigh the main part until the template is known.
    parts = sorted(_holders(tree)[0] or [tree], key=lambda node: node.no)
    return _hash("\n\n".join(text for part in parts for _, text in blocks(part, marked)))


def _hash(text: str) -> int:
    found = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(found.digest(), "big", signed=True)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per exemplar node: votes of pages that have it, and of those with the same text in it."""
    counts: dict[tuple[str, int, int], list[int]] = {}
    trees: dict[str, Node] = {}
    for batch in batches:
        columns = (batch[name] for name in ("host", "_group", "html", "exemplar", "_copies"))
        for host, group, page, exemplar, copies in zip(*columns, strict=True):
            tree, other, vote = _kept_tree(trees, exemplar), parse(page), VOTE // copies
            pairs = align(tree, other)
            if not aligns_well(tree, other, pairs):
                continue
            for x, y in pairs:
                if x.tag in BLOCK:
                    seen = counts.setdefault((host, group, x.no), [0, 0])
                    seen[0] += vote
                    text = own_text(x)
                    if text.strip() and text == own_text(y):
                        seen[1] += vote
        if len(counts) > 200_000:
            yield _frame(counts)
            counts = {}
    yield _frame(counts)


def _frame(counts: dict) -> pd.DataFrame:
    rows = [(*key, *n) for key, n in counts.items()]
    return pd.DataFrame(rows, columns=["host", "_group", "node", "pages", "same"])


def _kept_tree(trees: dict[str, Node], page: str) -> Node:
    if page not in trees:
        if len(trees) >= 64:
            trees.clear()
        trees[page] = parse(page)
    return trees[page]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees: dict[str, Node] = {}
    for batch in batches:
        texts = []
        columns = (batch.column(name).to_pylist() for name in ("html", "exemplar", "constant"))
        for page, exemplar, constant in zip(*columns, strict=True):
            tree, template = parse(page or ""), set()
            if exemplar is not None and constant:
                known = set(constant)
                for x, y in align(_kept_tree(trees, exemplar), tree):
                    if x.no in known and own_text(x) == own_text(y):
                        template.add(y.no)
            texts.append("\n\n".join(main_blocks(tree, template)))
        names = [n for n in batch.schema.names if n not in ("html", "exemplar", "constant")]
        arrays = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], [*names, "text"])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.withColumn("host", F.lower(host))


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The group of each layout of a host, and per group its exemplar and its template.

    The template is the list of the numbers of the exemplar's template nodes. ``pages`` has ``host``
    and ``html``. Every distinct main text of a group votes once, but for the exemplar's.
    """
    full = pages.where(F.length("html") > 0).select("host", "html", F.xxhash64("html").alias("_page"))
    marks = full.mapInArrow(
        _mark(keep=False), "host string, _page bigint, _layout bigint, _main bigint"
    )
    marks = marks.groupBy("host", "_layout", "_main").agg(
        F.min("_page").alias("_page"), F.count("*").alias("_copies")
    )
    marks = common.written(marks, "marks")
    layouts = marks.groupBy("host", "_layout").agg(
        F.count("*").alias("_texts"),
        F.min("_page").alias("_page"),
        F.min_by("_main", "_page").alias("_first"),
    )
    layouts = common.written(layouts, "layouts")
    most = layouts.groupBy("host").agg(
        F.max_by("_layout", F.struct("_texts", "_layout")).alias("_most")
    )
    # A layout with too few texts to tell a template goes to the host's most frequent layout.
    own = F.col("_texts") > MIN_PAGES
    groups = layouts.join(most, "host").select(
        "host", "_layout", F.when(own, F.col("_layout")).otherwise(F.col("_most")).alias("_group"),
        "_page", "_first",
    )
    groups = common.written(groups, "groups")
    picks = groups.where("_layout = _group").select("host", "_group", "_page", "_first")
    groups = groups.select("host", "_layout", "_group")

    exemplars = join_measured(full, picks, ["host", "_page"], "inner")
    exemplars = exemplars.groupBy("host", "_group", "_first").agg(F.min("html").alias("exemplar"))
    exemplars = common.written(exemplars, "exemplars")
    voters = full.drop("_page").mapInArrow(
        _mark(keep=True), "host string, html string, _layout bigint, _main bigint"
    )
    voters = join_measured(voters, groups, ["host", "_layout"], "inner")
    pairs = join_measured(voters, exemplars, ["host", "_group"], "inner").where("_main != _first")
    copies = join_measured(marks, groups, ["host", "_layout"], "inner")
    copies = copies.groupBy("host", "_group", "_main").agg(F.sum("_copies").alias("_copies"))
    pairs = join_measured(pairs, copies.where("_copies > 1"), ["host", "_group", "_main"], "left")
    pairs = pairs.select(
        "host", "_group", "html", "exemplar", F.coalesce("_copies", F.lit(1)).alias("_copies")
    )
    votes = pairs.mapInPandas(
        _votes, "host string, _group bigint, node int, pages bigint, same bigint"
    )
    sums = votes.groupBy("host", "_group", "node").agg(
        F.sum("pages").alias("pages"), F.sum("same").alias("same")
    )
    # Shares of a vote are rounded down: a hundredth makes up for it.
    constant = sums.where(
        (F.col("pages") >= int((MIN_PAGES - 0.01) * VOTE))
        & (F.col("same") >= SAME_SHARE * F.col("pages"))
    )
    constant = constant.groupBy("host", "_group").agg(
        F.sort_array(F.collect_list("node")).alias("constant")
    )
    return groups, exemplars.drop("_first").join(constant, ["host", "_group"], "left")


def extract(pages: DataFrame) -> DataFrame:
    """All pages with ``text`` (the main text, empty if there is none) and ``n_chars``.

    ``html`` is left out of the result. A NULL or empty page has an empty text. Pages without a
    host in their URL count as one host. Blocks are joined by two line feeds. Pages that are
    equal in main text but for a counter or date count as different texts. The input's own
    columns with the names of results are replaced, all others pass through; repeated rows give
    repeated results.
    """
    pages = common.spare(pages, "text", "n_chars", "host", "exemplar", "constant", "_layout", "_group")
    keyed = with_host(pages)
    groups, known = templates(keyed)
    laid = StructType([*keyed.schema.fields, StructField("_layout", LongType())])
    joined = join_measured(keyed.mapInArrow(_layouts, laid), groups, ["host", "_layout"], "left")
    joined = join_measured(joined, known, ["host", "_group"], "left")
    kept = [field for field in pages.schema.fields if field.name != "html"]
    schema = StructType([*kept, StructField("text", StringType())])
    names = [field.name for field in kept]
    inputs = joined.select(*names, "html", "exemplar", "constant")
    found = inputs.mapInArrow(_extract, schema)
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = common.read(spark, folder, "pages")
    return extract(pages).select("page_id", "url", "text", "n_chars")
