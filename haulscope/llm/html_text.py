"""HTML as a tree of elements, and its blocks of text. Plain Python, for use inside tasks."""

from __future__ import annotations

import html
import re

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# A start tag of the key ends an open element of the values, up to the given boundary.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
SCOPE = frozenset("table td th caption button object template".split())


class Node:
    """An element: name, attributes (as written), children (elements and texts) and its place."""

    __slots__ = ("tag", "raw", "children", "no")

    def __init__(self, tag: str, raw: str = "", no: int = -1):
        self.tag, self.raw, self.children, self.no = tag, raw, [], no

    @property
    def attributes(self) -> dict[str, str]:
        found = ATTRIBUTE.findall(self.raw) if self.raw else ()
        return {k.lower(): a or b or c for k, a, b, c in found}

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


def parse(text: str) -> Node:
    """The tree of a page. Anything is accepted: open elements are closed, stray ends ignored.

    Elements are numbered in page order (``no``); character references stay for ``squeeze``.
    """
    root = Node("#root", "", 0)
    stack, count, at = [root], 1, 0
    while True:
        m = TAG.search(text, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            _end(stack, name)
            continue
        if name in BLOCK:
            _close(stack, ("p",), SCOPE)
        if name in ENDS:
            _close(stack, *ENDS[name])
        node = Node(name, m[3], count)
        count += 1
        stack[-1].children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(text, at)
            node.children.append(text[at : stop.start() if stop else len(text)])
            at = stop.end() if stop else len(text)
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _close(stack: list[Node], names: tuple[str, ...], boundary) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in names:
            del stack[i:]
            return
        if stack[i].tag in boundary:
            return


def _end(stack: list[Node], name: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        # An inline end tag doesn't end a block around it.
        if name not in BLOCK and stack[i].tag in BLOCK:
            return


def squeeze(text: str) -> str:
    """Character references decoded, runs of white space as one space, trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def blocks(node: Node, skip) -> list[tuple[Node, str]]:
    """The texts of the blocks below a node in page order, each with the element it is in.

    ``skip(element)`` tells which elements to leave out with all they hold.
    """
    found: list[tuple[Node, str]] = []
    pieces: list[str] = []

    def flush(owner: Node) -> None:
        if pieces:
            if text := squeeze("".join(pieces)):
                found.append((owner, text))
            pieces.clear()

    todo: list = [(node, iter(node.children), node)]
    while todo:
        here, rest, owner = todo[-1]
        for child in rest:
            if isinstance(child, str):
                pieces.append(child)
                continue
            if skip(child):
                if child.tag in BLOCK:
                    flush(owner)
                continue
            if child.tag in BLOCK:
                flush(owner)
                todo.append((child, iter(child.children), child))
            else:
                if child.tag in ("br", "img", "wbr"):
                    pieces.append("" if child.tag == "wbr" else " ")
                todo.append((child, iter(child.children), owner))
            break
        else:
            todo.pop()
            if here.tag in BLOCK or here is node:
                flush(owner)
    return found
