"""A small tolerant HTML tree: nodes, the text blocks of an article, and a skeleton for tree matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# What an opening tag closes first, up to the nearest of its bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements, roles and names that are not part of an article.
APART = frozenset("head nav footer aside form button select option dialog menu".split()) | RAW
NAMES = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"topbar|toolbar|share|sharing|social|related|recommended|comments?|respond|disqus|widget|login|signup|paywall|copyright|legal"
)
#: A name beside a listed one that leaves open what the element is; the alignment of the host's pages decides then.
CONTENT_NAMES = re.compile(r"(?:content|article|post|entry|story|main|body|text|page)(?:$|[_-].*)")
#: Elements that no name makes a part of the page's frame; their class tells the layout, their id the subject.
NEVER_BY_NAME = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


# A skeleton has brackets and stars of its own.
_BRACKETS = str.maketrans("()*", "___")
_NUMBER = re.compile(r"\d")


@dataclass(eq=False)
class Node:
    tag: str
    name: str = ""  # class and id, lower-cased
    classes: str = ""
    role: str = ""
    children: list = field(default_factory=list)
    holds: bool = False  # an article or main element lies inside

    @property
    def label(self) -> str:
        """The tag and its class words. An id, or a word with a number, names the page or the entry, not its place in the wrapper."""
        words = [w for w in self.classes.split() if not _NUMBER.search(w)]
        return ".".join([self.tag, *words]).translate(_BRACKETS)

    def apart(self, inside: bool) -> bool:
        """Is it no part of an article? A header inside one is."""
        return self.tag in APART or self.tag == "header" and not inside or self.role in ROLES or bool(self.name) and self._named_apart()

    def _named_apart(self) -> bool:
        """Is one of its classes or its id, as a whole, a listed name, and does nothing speak against it?"""
        if self.tag in NEVER_BY_NAME or self.role == "main" or self.holds:
            return False
        names = self.name.split()
        return any(map(NAMES.fullmatch, names)) and not any(map(CONTENT_NAMES.fullmatch, names))


def parse(html: str) -> Node:
    """The tree of a page. Never fails: stray end tags are ignored, open elements end with what holds them."""
    root = Node("#")
    stack, at = [root], 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # The end of an inline element does not reach outside of the block at hand.
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        node = Node(tag)
        if attributes and "=" in attributes or "hidden" in attributes:
            for key, *values in _NAMED.findall(attributes):
                value = "".join(values).strip().lower()
                if key.lower() == "role":
                    node.role = value
                elif key.lower() == "hidden":
                    node.role = node.role or "hidden"
                else:
                    node.name = f"{node.name} {value}".strip()
                    if key.lower() == "class":
                        node.classes = value
        if tag in BLOCKS:
            _close(stack, {"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        stack[-1].children.append(node)
        if tag in ("article", "main") or node.role == "main":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].holds:
                    break
                stack[k].holds = True
        if tag in VOID or attributes and attributes.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _close(stack: list[Node], tags: set[str], bounds) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in bounds:
            return


@dataclass
class Block:
    text: str
    node: int  # number of the skeleton node that holds it
    linked: float  # share of its characters inside links


class Page:
    """Skeleton and text blocks of the article part of a page.

    The skeleton is the tree of block elements, where siblings in a row with one label are one node. It is written as a string of labels
    and brackets, and its nodes are numbered in page order.
    """

    def __init__(self, html: str):
        root = parse(html)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.count = 0
        mains = list(_mains(root))
        self.marked = bool(mains)
        for main in mains or [root]:
            self._walk(main, bool(mains))
        self.skeleton = "".join(self.parts)

    def _walk(self, top: Node, inside: bool) -> None:
        """Depth first with a stack of its own, so that deep pages do no harm."""
        number = self._open(top.label)
        buffer: list[tuple[str, bool]] = []
        # An entry: node, its skeleton number, next child, label of the last block child, that child's number, in a link.
        stack: list[list] = [[top, number, 0, None, -1, False]]
        while stack:
            entry = stack[-1]
            node, number, k, last, last_number, linked = entry
            if k == len(node.children):
                stack.pop()
                if node.tag in BLOCKS or not stack:
                    self._flush(buffer, number)
                    self.parts.append(")")
                continue
            entry[2] += 1
            child = node.children[k]
            if isinstance(child, str):
                buffer.append((child, linked))
                continue
            if child.tag == "br":
                buffer.append((" ", linked))
                continue
            if child.apart(inside) or child.role == "hidden":
                continue
            if child.tag not in BLOCKS:
                stack.append([child, number, 0, last, last_number, linked or child.tag == "a"])
                continue
            self._flush(buffer, number)
            if child.label == last:  # one more of a run: it shares the run's node
                self.parts.append("*(")
                stack.append([child, last_number, 0, None, -1, linked])
            else:
                new = self._open(child.label)
                entry[3], entry[4] = child.label, new
                stack.append([child, new, 0, None, -1, linked])

    def _open(self, label: str) -> int:
        self.parts.append(f"{label}(")
        self.count += 1
        return self.count - 1

    def _flush(self, buffer: list[tuple[str, bool]], number: int) -> None:
        text = " ".join(unescape("".join(t for t, _ in buffer)).split())
        if text:
            links = sum(len(t.strip()) for t, linked in buffer if linked)
            self.blocks.append(Block(text, number, links / max(1, sum(len(t.strip()) for t, _ in buffer))))
        buffer.clear()


def _mains(root: Node) -> Iterator[Node]:
    """The outermost article elements, else the outermost main elements, that are not apart."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.apart(False):
                continue
            if wanted(node):
                found.append(node)
                continue
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if found:
            yield from found
            return


@dataclass
class Shape:
    label: str
    number: int
    children: list = field(default_factory=list)


def shapes(skeleton: str) -> Shape:
    """The skeleton's tree; a run is one node with the children of its first element."""
    root = Shape("#", -1)
    stack, number, skipped = [root], 0, 0
    for m in re.finditer(r"(\*|[^()*]+)\(|\)", skeleton):
        if m[0] == ")":
            if skipped:
                skipped -= 1
            elif len(stack) > 1:
                stack.pop()
        elif skipped or m[1] == "*":
            skipped += 1
            number += m[1] != "*"
        else:
            node = Shape(m[1], number)
            number += 1
            stack[-1].children.append(node)
            stack.append(node)
    return root


def ways(skeleton: str) -> list[tuple[int, str, int]]:
    """Of each node of a skeleton in order: its parent's number (-1 at the top), its label, and how many of that label the parent had before."""
    out: list[tuple[int, str, int]] = []
    stack, last, before = [-1], [-1], {}
    for m in re.finditer(r"(\*|[^()*]+)\(|\)", skeleton):
        if m[0] == ")":
            if len(stack) > 1:
                last.pop()
                last[-1] = stack.pop()
            continue
        if m[1] == "*":
            number = last[-1]
        else:
            number, name = len(out), (stack[-1], m[1])
            out.append((*name, before.get(name, 0)))
            before[name] = before.get(name, 0) + 1
        stack.append(number)
        last.append(-1)
    return out


def tree_match(a: Shape, b: Shape) -> tuple[float, list[tuple[int, int]]]:
    """Simple tree matching: weight of the heaviest match of two trees that keeps order and levels, and the matched node numbers.

    Nodes match if their tags are equal; a match weighs 1 with equal class words and 0.5 with others, so that words seen on one page only
    do not keep it from the wrapper. Like subtrees match as they are; of two lists of children the like heads and tails are
    set aside, and the rest is aligned row by row over the weights of their subtrees.
    """
    if _tag(a) != _tag(b):
        return 0, []
    return _Matcher().match(a, b)


def _tag(shape: Shape) -> str:
    return shape.label.partition(".")[0]


class _Matcher:
    """Weights and alignments of subtrees, each worked out once for two kinds of subtree."""

    def __init__(self) -> None:
        self.kinds: dict[tuple, int] = {}
        self.kind: dict[int, int] = {}  # of a node, by its id()
        self.size: list[int] = []
        self.known: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}

    def _name(self, root: Shape) -> None:
        """Number the kinds of all subtrees, the deepest first: label and kinds of the children."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        for node in reversed(order):
            below = tuple(self.kind[id(c)] for c in node.children)
            kind = self.kinds.setdefault((node.label, below), len(self.kinds))
            if kind == len(self.size):
                self.size.append(1 + sum(self.size[k] for k in below))
            self.kind[id(node)] = kind

    def match(self, a: Shape, b: Shape) -> tuple[float, list[tuple[int, int]]]:
        self._name(a)
        self._name(b)
        weight = self.weight(a, b)
        out, stack = [], [(a, b)]
        while stack:
            x, y = stack.pop()
            out.append((x.number, y.number))
            if self.kind[id(x)] == self.kind[id(y)]:
                stack.extend(zip(x.children, y.children))
            else:
                stack.extend((x.children[i], y.children[j]) for i, j in self.aligned(x, y)[1])
        return weight, out

    def weight(self, x: Shape, y: Shape) -> float:
        kind = self.kind[id(x)]
        if kind == self.kind[id(y)]:
            return self.size[kind]
        if _tag(x) != _tag(y):
            return 0
        return (1 if x.label == y.label else 0.5) + (self.aligned(x, y)[0] if x.children and y.children else 0)

    def aligned(self, x: Shape, y: Shape) -> tuple[float, list[tuple[int, int]]]:
        """Weight and places of the best alignment of the children of two nodes."""
        key = (self.kind[id(x)], self.kind[id(y)])
        if key not in self.known:
            self.known[key] = self._align(x.children, y.children)
        return self.known[key]

    def _align(self, xs: list[Shape], ys: list[Shape]) -> tuple[float, list[tuple[int, int]]]:
        first, second = [self.kind[id(c)] for c in xs], [self.kind[id(c)] for c in ys]
        head, tail, least = 0, 0, min(len(xs), len(ys))
        while head < least and first[head] == second[head]:
            head += 1
        while tail < least - head and first[-1 - tail] == second[-1 - tail]:
            tail += 1
        m, n = len(xs) - tail, len(ys) - tail
        total = sum(self.size[k] for k in first[:head]) + sum(self.size[k] for k in first[m:])
        pairs = [(k, k) for k in range(head)] + [(m + k, n + k) for k in range(tail)]
        if m == head or n == head:
            return total, pairs
        # The weights of one kind of child against all children of the other side, worked out once for each kind.
        kinds, columns = np.unique(second[head:n], return_inverse=True)
        sample = {k: c for k, c in zip(second[head:n], ys[head:n])}
        weights: dict[int, np.ndarray] = {}
        # Of each cell, whether its value is that of the cell above, and that of the cell before, as bits.
        above, before, last = [], [], np.zeros(n - head + 1)
        for kind, child in zip(first[head:m], xs[head:m]):
            if kind not in weights:
                weights[kind] = np.array([self.weight(child, sample[k]) for k in kinds.tolist()])
            row = np.zeros_like(last)
            row[1:] = np.maximum.accumulate(np.maximum(last[1:], last[:-1] + weights[kind][columns]))
            above.append(np.packbits(row[1:] == last[1:]))
            before.append(np.packbits(row[1:] == row[:-1]))
            last = row
        bit = lambda rows, i, j: rows[i][j >> 3] >> (7 - (j & 7)) & 1
        i, j = m - head, n - head
        while i and j:
            if bit(above, i - 1, j - 1):
                i -= 1
            elif bit(before, i - 1, j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((head + i, head + j))
        return total + float(last[-1]), pairs
