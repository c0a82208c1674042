"""Main text of web pages by wrappers: union-free regular expressions over the pages of one host.

A page is parsed into a tree of elements and text slots. Trees of one host are aligned step by step: what only some pages have becomes
optional, neighbours of one kind become a repeated group, and a text that differs between pages becomes a variable slot. The wrapper tells
where a host's pages hold their text: the part that is reached by going, from the page down, to the child whose slots hold all of the
characters that vary and aren't links. It also tells template containers: elements that nearly all pages of a host have, and in which every
text is the same on pages of different articles. Outside of article elements those go; inside them, and in the flow of paragraphs,
headings, quotations and lists anywhere, a shared text stays. Element names take menus, forms and footers out. Class words do so where a
class is made of them alone; the weaker ones only propose, and inside an article the wrapper or the share of links decides.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, free_name, join_skewed

#: Different articles whose pages must agree on a text before it counts as part of the template, and the share of a host's pages that must
#: have its container. Share of the varying characters that a child must hold for the search for the main part to go on there: all of
#: them, or MOST where names don't help.
SUPPORT, NEARLY_ALL, MOST = 3, 0.75, 0.7
#: Share of link characters from which on a proposed container is no main text.
LINKS = 0.5
#: An ordered list of children that has grown beyond LONGEST becomes a repeated group of any of these. Texts below DEEPEST levels stand in
#: the list of the element there, each under a digest of the names of the elements between.
LONGEST, DEEPEST = 48, 24
#: Wrappers of all hosts together up to this size are broadcast; beyond it they are joined.
BROADCAST_BYTES = 16 << 20
#: Groups that a host's partial wrappers are merged in before the last step.
SALT = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object audio video canvas select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that never hold main text.
SKIPPED = frozenset("head nav footer aside form button menu dialog fieldset".split()) | RAW
CONTENT = frozenset(["article", "main"])
#: Words of class, id or role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer form header "
    "masthead menu menubar nav navbar navigation newsletter notice notices pagination popup modal promo promotion related replies reply respond search share sharing "
    "sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo alert dialog".split()
)
#: Of these, words that only propose inside an article.
PROPOSED = frozenset("alert banner complementary contentinfo dialog disclaimer form header masthead notice notices search toolbar widget".split())
#: Words that say nothing about what an element holds: a class made of boilerplate words and these is boilerplate, one with others isn't.
PLAIN = frozenset(
    "a area article aside bar block body bottom box button buttons card center col column container content div entry fixed float global group head id in inline inner inside "
    "item items js left link links list local main middle module on outer page pane panel part post posts primary region right row secondary section signup site sticky "
    "tertiary the to top unit user ui view wrap wrapper zone popular recent latest".split()
)
#: Elements that stand in the flow of an article: their neighbours are part of it too.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure".split())
#: Of these, the ones that mark even an article element as no main text; and the ones that don't count inside an article.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement comment comments promo related reply replies respond sponsored".split())
HEADINGS = frozenset("header masthead".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_MARK = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+|(?<=[-_])[0-9a-f]{6,}")


class Node:
    """An element: its label (name and class), children (elements and texts in order), whether it can hold main text, whether it is inside
    an article, whether its class only proposes that it holds none, and whether the wrapper calls it the main part or a template."""

    __slots__ = ("name", "label", "children", "skip", "content", "proposed", "main", "template")

    def __init__(self, name: str, label: str, skip: bool, content: bool, proposed: bool = False):
        self.name, self.label, self.skip, self.content, self.proposed, self.main, self.template, self.children = name, label, skip, content, proposed, False, False, []


class Text:
    """A run of character data between two tags; whether its slot is fixed, and on nearly all pages of the host."""

    __slots__ = ("text", "link", "fixed", "common")
    label = "#"

    def __init__(self, text: str, link: bool):
        self.text, self.link, self.fixed, self.common = text, link, False, False


def boilerplate_words(values: Iterable[str]) -> frozenset[str]:
    """Boilerplate words of those classes, ids and roles that are made of such words, plain ones and numbers only."""
    out: set[str] = set()
    for token in " ".join(values).split():
        words = {w.lower() for w in _WORD.findall(token)}
        if words <= BOILERPLATE | PLAIN:
            out |= words & BOILERPLATE
    return frozenset(out)


def parse(page: str | None, names: bool = True) -> Node:
    """A tree of any text: unknown, misnested and unclosed tags are taken as they come; nothing raises. Without ``names`` neither elements'
    names nor class words tell what is main text, except for elements that never show text."""
    root = Node("", "", False, False)
    stack, page, at = [root], page or "", 0
    links = 0

    def close(k: int) -> None:
        nonlocal links
        links -= sum(x.name == "a" for x in stack[k:])
        del stack[k:]

    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            stack[-1].children.append(Text(html_lib.unescape(page[at:end]), links > 0))
        if not m:
            break
        at = m.end()
        if m[1]:
            name = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
            continue
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        marks = m[3] or m[5] or ""
        if name in RAW and not marks.endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page) if name in ("script", "style", "textarea", "title") else at
            continue
        parent = stack[-1]
        if name in VOID or marks.endswith("/") and name not in ("p", "div", "a", "article"):
            if name not in ("br", "wbr") or parent.children:
                parent.children.append(Node(name, name, True, False))
            continue
        if name not in INLINE:
            # a paragraph ends where a block begins; list items, cells and terms end where the next one begins
            ends = {"p"} | ({name} if name in ("li", "option", "tr", "dt", "dd", "td", "th") else set()) | ({"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th", "tr") else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends:
                    close(k)
                    break
                if stack[k].name not in INLINE:
                    break
            parent = stack[-1]
        found = {a.lower(): b or c or d for a, b, c, d in _MARK.findall(marks)} if marks else {}
        content = names and (parent.content or name in CONTENT or found.get("role", "").lower() == "main")
        told = NO_ARTICLE if name == "article" else BOILERPLATE - HEADINGS if parent.content else BOILERPLATE
        words = boilerplate_words(found.values()) & told if found and name not in ("body", "html", "main") else frozenset()
        proposed = names and parent.content and bool(words) and words <= PROPOSED
        told = name in SKIPPED or name == "header" and not parent.content or bool(words) and not proposed if names else name in RAW or name == "head"
        # numbers in class names tell pages apart, not kinds of elements
        node = Node(name, f"{name}.{_NUMBER.sub('0', found['class'])}" if found.get("class") else name, parent.skip or told, content, proposed)
        parent.children.append(node)
        stack.append(node)
        links += name == "a"
    return root


# A wrapper is [label, optional, repeated, pages, kids]; a text slot ["#..", optional, repeated, pages, digest or null, characters outside
# links, articles], where articles are up to SUPPORT different ones that agree on the digest. Kids are a list in order, or a dict by label
# for "any of these, repeated".


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def _fold(items: list) -> list:
    """Neighbours with one label become one repeated item."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            y = merge(out[-1], x, same_page=True)
            y[2] = 1
            out[-1] = y
        else:
            out.append(x)
    return out


def described(node: Node, depth: int) -> list[tuple[str, Node | Text]]:
    """Label and child of all that a wrapper describes below an element; beyond DEEPEST levels only the texts, under their elements' names."""
    if depth < DEEPEST:
        return [(x.label, x) for x in node.children if not isinstance(x, Text) or x.text.strip()]
    out, stack = [], [("#", iter(node.children))]
    while stack:
        path, rest = stack[-1]
        x = next(rest, None)
        if x is None:
            stack.pop()
        elif isinstance(x, Text):
            if x.text.strip():
                out.append((path, x))
        elif not x.skip:
            stack.append((f"#{xxhash.xxh32_hexdigest(f'{path}/{x.name}')}", iter(x.children)))
    return out


def article_of(root: Node) -> int:
    """Digest of the longest text outside links: what tells an article from another."""
    best, stack = "", [root]
    while stack:
        for x in stack.pop().children:
            if isinstance(x, Node):
                if not x.skip:
                    stack.append(x)
            elif not x.link and (len(x.text), x.text) > (len(best), best):
                best = x.text
    return _digest(best)


def infer(node: Node, depth: int = 0, article: int | None = None) -> list:
    """The wrapper of one page; what is never main text is not described any further."""
    article, kids = article_of(node) if article is None else article, []
    for label, x in [] if node.skip else described(node, depth):
        if isinstance(x, Text):
            t = _SPACE.sub(" ", x.text).strip()
            kids.append([label, 0, 0, 1, _digest(t), 0 if x.link else len(t), [article]])
        else:
            kids.append(infer(x, depth + 1, article))
    return [node.label, 0, 0, 1, _general(_fold(kids))]


def _general(kids: list | dict) -> list | dict:
    return kids if isinstance(kids, dict) or len(kids) <= LONGEST else _general_dict(kids)


def _wider(label: str, step: int) -> str:
    """A label without its class; and one that stands for all elements."""
    return "#" if label[:1] == "#" else label.split(".")[0] if step == 0 else "*"


def _by_label(kids: Iterable[list], label=lambda x: x) -> dict:
    out: dict = {}
    for x in kids:
        k = label(x[0])
        x = [k, *x[1:]]
        out[k] = merge(out[k], x, same_page=True) if k in out else x
    return out


def _bounded(kids: dict) -> dict:
    """At most LONGEST kinds of children: beyond that classes, and then names, are no longer told apart, so that pages with class words of
    their own don't make a wrapper grow."""
    for step in (0, 1):
        if len(kids) > LONGEST:
            kids = _by_label(kids.values(), lambda x: _wider(x, step))  # noqa: B023
    return kids


def _slot(kids: dict, label: str) -> list | None:
    """The slot that describes children of this label."""
    return next((kids[k] for k in (label, _wider(label, 0), _wider(label, 1)) if k in kids), None)


def common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, low = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = low[j + 1] + 1 if a[i] == b[j] else max(low[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The least general wrapper that describes what either describes. Labels are equal."""
    pages = max(a[3], b[3]) if same_page else a[3] + b[3]
    if a[0][:1] == "#":
        same = a[4] is not None and a[4] == b[4]
        return [a[0], a[1] | b[1], a[2] | b[2], pages, a[4] if same else None, a[5] + b[5], sorted({*a[6], *b[6]})[:SUPPORT] if same else []]
    x, y = a[4], b[4]
    if isinstance(x, dict) or isinstance(y, dict):
        x, y = (_general_dict(z) for z in (x, y))
        kids: list | dict = _bounded({k: merge(x[k], y[k], same_page) if k in x and k in y else x.get(k) or y[k] for k in [*x, *(k for k in y if k not in x)]})
    else:
        kids, i, j = [], 0, 0
        for p, q in [*common([k[0] for k in x], [k[0] for k in y]), (len(x), len(y))]:
            kids += [[k[0], 1, *k[2:]] for k in x[i:p]] + [[k[0], 1, *k[2:]] for k in y[j:q]]
            if p < len(x):
                kids.append(merge(x[p], y[q], same_page))
            i, j = p + 1, q + 1
        kids = _general(_fold(kids))
    return [a[0], a[1] | b[1], a[2] | b[2], pages, kids]


def _general_dict(kids: list | dict) -> dict:
    return kids if isinstance(kids, dict) else _bounded(_by_label(kids))


def is_fixed(slot: list) -> bool:
    """Is a text slot part of the template: filled alike by pages of SUPPORT different articles?"""
    return slot[4] is not None and not slot[2] and len(slot[6]) >= SUPPORT


def kids_of(wrapper: list) -> list:
    return [] if wrapper[0][:1] == "#" else list(wrapper[4].values() if isinstance(wrapper[4], dict) else wrapper[4])


def main_part(wrapper: list, most: float = 1.0) -> list | None:
    """The part of a wrapper that holds the pages' text, None if none varies: from the page down to the child that holds the share ``most``
    of it, as long as nothing that varies in the flow of an article is left behind."""
    weights: dict[int, int] = {}

    def weigh(w: list) -> int:
        weights[id(w)] = n = (0 if is_fixed(w) else w[5]) if w[0][:1] == "#" else sum(map(weigh, kids_of(w)))
        return n

    if not weigh(wrapper):
        return None
    while True:
        below = [k for k in kids_of(wrapper) if k[0][:1] != "#" and not k[2] and k[0].split(".")[0] not in INLINE and weights[id(k)] >= most * weights[id(wrapper)]]
        if not below or any(weights[id(k)] and k[0].split(".")[0] in FLOW for k in kids_of(wrapper) if k is not below[0]):
            return wrapper
        wrapper = below[0]


def mark(node: Node, wrapper: list, main: list | None = None) -> None:
    """Align a page with its host's wrapper; mark the texts that stand in slots of the template, template containers, and the main part."""
    open_root, open_, pages = node, [(node, wrapper, 0)], wrapper[3]
    while open_:
        node, w, depth = open_.pop()
        node.main = w is main
        if node.skip:
            continue
        runs = [(k, [x for _, x in g]) for k, g in groupby(described(node, depth), key=lambda x: x[0])]
        if isinstance(w[4], dict):
            pairs = [(g, slot) for k, g in runs if (slot := _slot(w[4], k))]
        else:
            pairs = [(runs[i][1], w[4][j]) for i, j in common([k for k, _ in runs], [k[0] for k in w[4]])]
        for group, slot in pairs:
            for x in group:
                if isinstance(x, Node):
                    open_.append((x, slot, depth + 1))
                else:
                    x.fixed = is_fixed(slot)
                    x.common = x.fixed and slot[3] >= NEARLY_ALL * pages
    mark_templates(open_root)


def mark_templates(root: Node) -> None:
    """Mark containers of template text: elements, no part of the flow of a text, in which every text is fixed and on nearly all pages."""
    order, stack = [], [root]
    while stack:
        order.append(stack.pop())
        stack += [x for x in order[-1].children if isinstance(x, Node)]
    held: dict[int, tuple[int, int]] = {}  # texts below an element, and those that are common
    for node in reversed(order):
        n = common_ = 0
        for x in node.children:
            a, b = held[id(x)] if isinstance(x, Node) else (1, int(x.common)) if x.text.strip() else (0, 0)
            n, common_ = n + a, common_ + b
        held[id(node)] = n, common_
        node.template = n > 0 and n == common_ and node.name not in FLOW | INLINE | CONTENT and node.name not in ("", "html", "body", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead")


def _path(root: Node, wanted) -> list[Node] | None:
    """Nodes from the root to the first one, in page order, that is ``wanted``."""
    stack = [(root, iter(root.children))]
    while stack:
        if wanted(stack[-1][0]):
            return [x for x, _ in stack]
        x = next((y for y in stack[-1][1] if isinstance(y, Node)), None)
        while stack and x is None:
            stack.pop()
            x = next((y for y in stack[-1][1] if isinstance(y, Node)), None) if stack else None
        if x is not None:
            stack.append((x, iter(x.children)))
    return None


def mostly_links(node: Node) -> bool:
    """Are LINKS of an element's characters in links?"""
    linked = whole = 0
    stack = [node]
    while stack:
        for x in stack.pop().children:
            if isinstance(x, Node):
                stack.append(x)
            else:
                n = len(x.text.strip())
                whole, linked = whole + n, linked + n * x.link
    return whole > 0 and linked >= LINKS * whole


def blocks(root: Node, names: bool = True) -> list[str]:
    """Texts of the blocks of main text, in page order.

    The main part that the wrapper tells decides; an article or main element around it or inside it makes its borders exact. Where the
    wrapper's part isn't on the page, any such element counts, and without one the whole page. Template containers outside of articles
    go, and inside them those that their class proposes; without ``names`` every text in a slot of the template goes.
    """
    path = _path(root, lambda x: x.main and not x.skip)
    around = next((x for x in path or [] if x.content), None)
    inside = _path(path[-1] if path else root, lambda x: x.content and not x.skip) if around is None else None
    has_content = around is not None or inside is not None
    inside_main = path is not None and not has_content and path[-1].name not in ("", "html", "body")
    roots = {id(path[-1])} if inside_main else {id(around)} if around is not None else set()
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    def counts(x: Text, node: Node, within: bool) -> bool:
        if node.skip or x.fixed and not names:
            return False
        return within or not roots and (node.content or not has_content)

    stack: list = [(root, iter(root.children), not roots and not has_content)]
    while stack:
        node, rest, within = stack[-1]
        x = next(rest, None)
        if x is None:
            stack.pop()
            if node.name not in INLINE:
                flush()
        elif isinstance(x, Text):
            if counts(x, node, within):
                now.append(x.text)
        elif x.name == "br":
            now.append(" ")
        elif not (x.skip and x.name in VOID and x.name != "hr"):
            if x.name not in INLINE:
                flush()
            gone = names and (x.template and (x.proposed or not x.content) or x.proposed and mostly_links(x))
            if not x.skip and not gone:
                stack.append((x, iter(x.children), within or id(x) in roots))
    flush()
    return out


def extract(page: str | None, wrapper: list | None, main: list | None = None, names: bool = True) -> str:
    """The main text of one page; blocks joined by an empty line. ``main`` is the wrapper's main part."""
    root = parse(page, names)
    if wrapper is not None:
        mark(root, wrapper, main)
    return "\n\n".join(blocks(root, names))


def host(url: str) -> Column:
    """Lower-cased host without port and leading www; empty for null and for what has none."""
    found = F.regexp_extract(F.lower(col(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def _merge_sorted(batches: Iterable[pa.RecordBatch], keep_salt: bool):
    """One wrapper for each key of rows (host, salt, wrapper) that are sorted by key; only one merged wrapper is held for a key."""
    key, held = None, None
    names = ["h", "salt", "w"]

    def row(k, w):
        return pa.RecordBatch.from_arrays([pa.array([k[0]]), pa.array([k[1]], pa.int32()), pa.array([json.dumps(w)])], names=names)

    for b in batches:
        for h, s, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
            k, w = (h, s if keep_salt else 0), json.loads(w)
            if k == key:
                held = merge(held, w)
            else:
                if key is not None:
                    yield row(key, held)
                key, held = k, w
    if key is not None:
        yield row(key, held)


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", names: bool = True) -> DataFrame:
    """(host, wrapper, pages): one JSON wrapper for each host of all pages with html.

    A task merges what it sees of a host before anything is sent; a host's partial wrappers are then merged in salted groups and at last
    into one, row by row, so that no host's pages come together anywhere.
    """

    def partial(batches):
        held: dict[str, list] = {}
        for b in batches:
            for h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = infer(parse(t, names))
                held[h] = merge(held[h], w) if h in held else w
            if len(held) > 2000:
                yield send(held)
                held = {}
        yield send(held)

    def send(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([xxhash.xxh32_intdigest(json.dumps(w)) % SALT for w in held.values()], pa.int32()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["h", "salt", "w"])

    shape = "h string, salt int, w string"
    rows = pages.select(host(url).alias("h"), col(html).alias("t")).where(F.col("t").isNotNull()).mapInArrow(partial, shape)
    rows = rows.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(lambda b: _merge_sorted(b, True), shape)
    rows = rows.repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _merge_sorted(b, False), shape)
    return rows.select(F.col("h").alias("host"), F.col("w").alias("wrapper"), F.get_json_object("w", "$[3]").cast("long").alias("pages"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", result: str | None = None, keep: Sequence[str] | None = None, names: bool = True) -> tuple[DataFrame, str]:
    """pages' columns ``keep`` (default: all) with the main text, and that column's name. One row for each row that goes in.

    Null and empty html give an empty text; pages without a host are aligned with each other. Nothing is cut off; a very long page is one
    row of one task. Repeated rows come out as often as they go in; equal pages count as one article, so copies are no template. ``names``:
    whether element names and class words help the wrapper.
    """
    keep = list(pages.columns if keep is None else keep)
    name = free_name(pages.columns, result or "main_text")
    wrappers = cut(infer_wrappers(pages, url, html, names))
    size, total = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    inner = [f"k{i}" for i in range(len(keep))]
    base = pages.select(*(col(c).alias(k) for c, k in zip(keep, inner, strict=True)), host(url).alias("host"), col(html).alias("html"))
    if size <= BROADCAST_BYTES:
        joined = base.join(F.broadcast(wrappers.select("host", "wrapper")), "host", "left")
    else:
        joined = join_skewed(base, wrappers.select("host", "wrapper"), "host", wrappers.select("host", F.col("pages").alias("n"), F.octet_length("wrapper").alias("size")), total, most_bytes=BROADCAST_BYTES)
    joined = joined.select(*inner, "html", "wrapper")
    kept = joined.select(*inner).schema
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "t string"])

    def run(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            at, texts = len(inner), []
            for page, w in zip(b.column(len(inner)).to_pylist(), b.column(len(inner) + 1).to_pylist(), strict=True):
                if w is not None and w not in known:
                    if len(known) > 200:
                        known.clear()
                    known[w] = (tree := json.loads(w), main_part(tree, 1.0 if names else MOST))
                texts.append(extract(page, *known.get(w, (None, None)), names))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string())], names=[*inner, "t"])

    return joined.mapInArrow(run, schema).toDF(*keep, name), name

