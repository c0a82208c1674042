"""Elements of HTML pages by CSS selectors: tags, ids, classes and attributes, descendants, children, and lists of these."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag closes, and the elements that this doesn't reach beyond.
CLOSES = {"li": ("li", ("ul", "ol")), "p": ("p", ("div", "td", "li", "section", "article")), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",))}
BLOCKS = frozenset("p div ul ol table section article h1 h2 h3 h4 h5 h6 header footer nav blockquote form pre".split())
SIMPLE = re.compile(r"([a-z][a-z0-9-]*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]|(\*)", re.I)


class Node:
    """An element: its tag, attributes, parent, and children, which are elements and texts in order."""

    __slots__ = ("tag", "attrs", "parent", "children", "classes")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = frozenset((attrs.get("class") or "").split())

    def below(self) -> Iterator[Node]:
        """Elements inside of this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        """Its texts, each one trimmed, without scripts and styles."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n.strip())
            elif n.tag not in ("script", "style", "template"):
                todo += reversed(n.children)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _up_to(self, tag: str, walls: tuple[str, ...] = ()) -> None:
        n = self.at
        while n.parent is not None and n.tag not in walls:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._up_to(*CLOSES[tag])
        elif tag in BLOCKS:
            self._up_to(*CLOSES["p"])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)  # of equal names the first counts
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID and tag in ("svg", "path", "use"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self._up_to(tag)

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    """The root of a page's elements; broken markup gives what can be read of it."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _compound(part: str):
    tests, at = [], 0
    while at < len(part):
        m = SIMPLE.match(part, at)
        if not m:
            raise ValueError(f"selector {part!r} can't be read at {at}")
        tag, ident, name, attr, value, _ = m.groups()
        if tag:
            tests.append(lambda n, x=tag.lower(): n.tag == x)
        elif ident:
            tests.append(lambda n, x=ident: n.attrs.get("id") == x)
        elif name:
            tests.append(lambda n, x=name: x in n.classes)
        elif attr:
            tests.append(lambda n, x=attr, v=value: x in n.attrs and (v is None or n.attrs[x] == v))
        at = m.end()
    return lambda n: all(t(n) for t in tests)


@lru_cache(maxsize=256)
def compiled(selector: str):
    """A test of an element: whether one of the selector's alternatives ends in it."""
    chains = []
    for one in selector.split(","):
        steps = [(bool(child), _compound(part)) for child, part in re.findall(r"(>\s*)?((?:\[[^\]]*\]|[^\s>\[])+)", one.strip())]
        if not steps:
            raise ValueError(f"selector {selector!r} has an empty part")
        chains.append(steps)

    def fits(n: Node | None, steps: list) -> bool:
        """Whether the steps end in n; of ancestors the nearest is tried first, then those above."""
        child, test = steps[-1]
        if n is None or n.parent is None or not test(n):
            return False
        if len(steps) == 1:
            return True
        above = n.parent
        while above is not None and above.parent is not None:
            if fits(above, steps[:-1]):
                return True
            if child:
                return False
            above = above.parent
        return False

    return lambda n: any(fits(n, s) for s in chains)


def select(node: Node, selector: str) -> list[Node]:
    """All elements inside of node that the selector takes, in document order."""
    test = compiled(selector)
    return [n for n in node.below() if test(n)]


def select_one(node: Node, selector: str) -> Node | None:
    """The first of them."""
    test = compiled(selector)
    return next((n for n in node.below() if test(n)), None)
