"""Main text of pages by wrapper induction.

A bounded number of different pages of each host is aligned by simple tree matching, which gives the shape of its wrapper.
Every page is then aligned with the shape, and texts are counted in their slots over all different pages: what most pages
with a slot have there is template; the slots where text varies most are where content stands. Each page is then
aligned with its host's wrapper: template text goes, the content's part stays. Elements that are never content (menus,
forms, scripts and the like, by tag or role) go in any case. Classes are only a prior: one that names adverts, comments and the
like makes a slot's text count less when the content is sought, and goes where the content is elsewhere; what such a class says of
things that are the same everywhere, like notices, gives way to text that varies. Headings that all pages have are the article's own
where what they head varies. Where a page has
nothing in the content's part, or its host no wrapper, the elements that the page itself marks as its main part are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mapped, save, shard_count
from .common import bound_batches, fresh_uri, map_batches, texts, written

#: Different pages of a host that the shape of its wrapper is made from, at most: those of least hash, one for each of SAMPLE_PARTS parts.
SAMPLE_PAGES = 8
SAMPLE_PARTS = 64
#: Pages, and their share of those with the slot, that must have a text in it for it to be template; all pages of a host of fewer.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.6
#: Share of a node's varying text that one child must hold for the content to be sought in it.
CONTENT_SHARE = 0.7
#: Characters of varying text a page, and their share of its text, below which a host has but copies of one article: nothing of it is template.
COPIES_CHARS, COPIES_SHARE = 40, 0.1
#: Elements below each other that are told apart; the text of what is deeper belongs to the last of them.
MOST_DEPTH = 150
#: What a character of varying text counts for in an element whose class names adverts, comments and the like.
DOUBTED_WORTH = 0.25
#: Cells of a table of two lists that are kept to read an alignment from; longer lists are halved, which needs two rows alone.
MOST_CELLS = 1 << 20
#: Hosts, bytes of sampled pages and counted slots for each file of shapes or wrappers, at most.
HOSTS_PER_SHARD, BYTES_PER_SHARD, SLOTS_PER_SHARD = 2_000, 32 << 20, 400_000
#: Share of the text of a slot that must vary for it to count as content although its class names notices and the like.
TRUSTED_SHARE = 0.5

# Elements and words of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LITERAL = frozenset(["xmp"])
_SKIPPED = frozenset("script style title textarea iframe noscript template svg noembed noframes".split())
_DROPPED = frozenset("head nav footer aside form button select option input label fieldset dialog menu canvas audio video map".split()) | _SKIPPED
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
_CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NOT_CONTENT = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup popup modal overlay share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond replies pagination pager widget toolbar copyright login skip skiplink".split()
)
#: Of these such as name what is the same on every page: where it varies, the name is wrong.
_SAME_EVERYWHERE = frozenset("banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup popup modal overlay share sharing social toolbar copyright login skip skiplink".split())
#: Words of class names that say nothing about what an element holds, and such as turn the word after them round.
_NEUTRAL = frozenset(
    "active area articles bar big block body box bottom button buttons center col column container content count cta desktop fixed floating footer form global google group header inline inner item items large left link links list main media mobile outer page panel post posts primary reader right row secondary section site slot small sticky stories text title top unit user wide wrap wrapper".split()
)
_TURNED = frozenset("has hide no not with without".split())
_MAIN = frozenset(["article", "main"])
#: Elements that the content can be sought in; that of an article isn't sought further down, as its heading would go.
_CONTAINERS = frozenset("html body center main section div table tbody article".split())
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_DIGITS = re.compile(r"\d+")
#: Mark at the end of a label.
DOUBT = "!"


#: What speaks against an element: nothing, a name of what is the same everywhere, or another.
NO_DOUBT, WEAK_DOUBT, STRONG_DOUBT = range(3)


def _doubt(name: str) -> int:
    """Whether one class or id names adverts, comments or the like: by its last word, or by all its words that aren't neutral."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or any(w in _TURNED for w in words):
        return NO_DOUBT
    telling = [w for w in words if w in _NOT_CONTENT or len(w) > 2 and w not in _NEUTRAL]
    if words[-1] not in _NOT_CONTENT and not (telling and all(w in _NOT_CONTENT for w in telling)):
        return NO_DOUBT
    return WEAK_DOUBT if all(w in _SAME_EVERYWHERE for w in words if w in _NOT_CONTENT) else STRONG_DOUBT


class Node:
    """dropped: never content. doubted: its class names what isn't content, and how surely. structural: a block, or with one in it."""

    __slots__ = ("tag", "attributes", "children", "dropped", "doubted", "structural", "label")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes and attributes != "/" else {}
        a = self.attributes
        classes, ids = (a.get(k, "").split() for k in ("class", "id"))
        self.dropped = tag in _DROPPED or (bool(a) and (a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))))
        self.doubted = NO_DOUBT if tag in ("html", "body", *_MAIN) else max(map(_doubt, [*classes, *ids]), default=NO_DOUBT)
        self.structural = tag in _BLOCKS
        name = next((c for c in classes if not _DIGITS.search(c)), classes[0] if classes else _DIGITS.sub("0", ids[0]) if ids else "")
        self.label = (f"{tag}.{name}" if name else tag) + DOUBT * bool(self.doubted)


def parse(page: str) -> Node:
    """The tree of a page, however broken: what isn't closed is closed by what can't be in it, or at the end."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in _BLOCKS and stack[k].tag in _BLOCKS:
                    break
            continue
        if tag in _BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCKS:
                    break
        if tag in _CLOSED_BY:
            closed, until = _CLOSED_BY[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in closed:
                    del stack[k:]
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if node.structural and not node.dropped:
            for above in reversed(stack):
                if above.structural:
                    break
                above.structural = True
        if tag in _SKIPPED or tag in _LITERAL:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in _LITERAL:
                node.children.append(entities.escape(page[at : end.start() if end else n]))
            at = end.end() if end else n
        elif tag not in _VOID and not m[3].endswith("/") and len(stack) < MOST_DEPTH:
            stack.append(node)
    return root


def _clean(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


class Run:
    """A node of the tree that is matched: an element with blocks in it, or neighbours of one label without. Equal keys mean equal trees."""

    __slots__ = ("label", "nodes", "children", "key", "size")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes, self.children = label, nodes, [r for n in nodes for r in runs_of(n)]
        self.key, self.size = _tree_key(self)


def _tree_key(tree: Run | Slot) -> tuple[int, int]:
    return hash((tree.label, *(c.key for c in tree.children))), 1 + sum(c.size for c in tree.children)


def runs_of(node: Node) -> list[Run]:
    """The matched tree's nodes right below an element, in page order."""
    grouped: list[tuple[str, list[Node]]] = []
    last = None
    for child in node.children:
        if isinstance(child, str) or child.dropped or not child.structural:
            continue
        leaf = not any(isinstance(x, Node) and x.structural and not x.dropped for x in child.children)
        if leaf and child.label == last:
            grouped[-1][1].append(child)
        else:
            grouped.append((child.label, [child]))
        last = child.label if leaf else None
    return [Run(label, own) for label, own in grouped]


def _ends(a: list, b: list) -> tuple[int, int]:
    """How many equal trees both lists begin with, and end with after those. Some largest match pairs all of them."""
    most, first = min(len(a), len(b)), 0
    while first < most and a[first].key == b[first].key:
        first += 1
    last = 0
    while last < most - first and a[-1 - last].key == b[-1 - last].key:
        last += 1
    return first, last


def _weights(a: list, b: list, memo: dict) -> tuple[np.ndarray, list[int], list[int]]:
    """Sizes of the largest matches of each different tree of a with each of b, and the number of every tree's kind."""
    of_a, of_b = {x.key: x for x in a}, {y.key: y for y in b}
    kinds = np.array([[_size(x, y, memo) for y in of_b.values()] for x in of_a.values()], np.int32)
    number_a, number_b = ({k: i for i, k in enumerate(of)} for of in (of_a, of_b))
    return kinds, [number_a[x.key] for x in a], [number_b[y.key] for y in b]


def _size(x: Run | Slot, y: Run | Slot, memo: dict) -> int:
    if x.label != y.label:
        return 0
    if x.key == y.key or not x.children or not y.children:
        return min(x.size, y.size)
    if (x.key, y.key) not in memo:
        memo[x.key, y.key] = 1 + _best(x.children, y.children, memo)
    return memo[x.key, y.key]


def _rows(kinds: np.ndarray, a: list[int], b: list[int]) -> Iterator[np.ndarray]:
    """The table of the largest matches of a's and b's beginnings, row by row."""
    row = np.zeros(len(b) + 1, np.int32)
    yield row
    for x in a:
        below = row.copy()
        np.maximum(row[1:], row[:-1] + kinds[x, b], out=below[1:])
        row = np.maximum.accumulate(below)
        yield row


def _last(rows: Iterator[np.ndarray]) -> np.ndarray:
    return deque(rows, 1)[0]


def _best(a: list, b: list, memo: dict) -> int:
    if len(a) == len(b) == 1:
        return _size(a[0], b[0], memo)
    first, last = _ends(a, b)
    same = sum(x.size for x in [*a[:first], *a[len(a) - last :]])
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    return same + (int(_last(_rows(*_weights(a, b, memo)))[-1]) if a and b else 0)


def _pairs(a: list, b: list, memo: dict) -> list[tuple]:
    first, last = _ends(a, b)
    paired = [*zip(a[:first], b[:first], strict=True), *zip(a[len(a) - last :], b[len(b) - last :], strict=True)]
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if a and b:
        kinds, x, y = _weights(a, b, memo)
        paired += [(a[i], b[j]) for i, j in _places(kinds, np.array(x), np.array(y))]
    return [p for pair in paired for p in (pair, *_pairs(pair[0].children, pair[1].children, memo))]


def _places(kinds: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a largest match of two lists of kinds."""
    if len(a) > 1 and (len(a) + 1) * (len(b) + 1) > MOST_CELLS:
        half = len(a) // 2
        cut = int(np.argmax(_last(_rows(kinds, a[:half], b)) + _last(_rows(kinds, a[half:][::-1], b[::-1]))[::-1]))
        return [*_places(kinds, a[:half], b[:cut]), *((half + i, cut + j) for i, j in _places(kinds, a[half:], b[cut:]))]
    table, found, i, j = list(_rows(kinds, a, b)), [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def match(a: list, b: list) -> tuple[int, list[tuple]]:
    """Simple tree matching of two lists of trees: the size of the largest match that keeps order, label and descent, and its pairs."""
    memo: dict[tuple[int, int], int] = {}
    return _best(a, b, memo) if a and b else 0, _pairs(a, b, memo)


def _own_text(node: Node) -> str:
    """Text of a node and of the inline nodes in it."""
    pieces: list[str] = []

    def walk(x: Node) -> None:
        for child in x.children:
            if isinstance(child, str):
                pieces.append(child)
            elif not child.dropped and not child.doubted and child.tag not in _BLOCKS:
                pieces.append(" " if child.tag in ("br", "img") else "")
                walk(child)

    walk(node)
    return _clean(pieces)


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


ROOT = 1
#: What a slot's tag lets it be: ARTICLE and what is below it are containers of content, too. DOUBTED is added where its class speaks against it.
OTHER, CONTAINER, MAIN, ARTICLE = range(4)
DOUBTED = 4


def _kind(label: str) -> int:
    tag = label.rstrip(DOUBT).split(".")[0]
    kind = ARTICLE if tag == "article" else MAIN if tag in _MAIN else CONTAINER if tag in _CONTAINERS or tag == "#root" or "-" in tag else OTHER
    return kind + DOUBTED * label.endswith(DOUBT)


class Slot:
    """A node of the shape of a wrapper. place is a key that its place gives; equal keys mean equal trees, as those of a Run."""

    __slots__ = ("label", "children", "place", "key", "size")

    def __init__(self, label: str, children: list[Slot]):
        self.label, self.children, self.place = label, children, 0
        self.key, self.size = _tree_key(self)

    def packed(self) -> list:
        return [self.label, [c.packed() for c in self.children]]

    def keyed(self, place: int = ROOT) -> Slot:
        self.place = place
        for i, child in enumerate(self.children):
            child.keyed(_key(f"{place}/{i}"))
        return self


def _unpacked_slot(value: list) -> Slot:
    return Slot(value[0], [_unpacked_slot(c) for c in value[1]])


class Wrapper:
    """A shape, the keys of texts that are template by key of their slot, and the keys of slots: of content, and such as hold more that varies than not."""

    __slots__ = ("shape", "constant", "content", "trusted")

    def __init__(self, shape: Slot, constant: dict[int, frozenset[int]], content: frozenset[int], trusted: frozenset[int] = frozenset()):
        self.shape, self.constant, self.content, self.trusted = shape, constant, content, trusted

    def packed(self) -> list:
        return [self.shape.packed(), [[k, sorted(v)] for k, v in sorted(self.constant.items())], sorted(self.content), sorted(self.trusted)]


def unpacked(value: list) -> Wrapper:
    return Wrapper(_unpacked_slot(value[0]).keyed(), {k: frozenset(v) for k, v in value[1]}, *map(frozenset, value[2:]))


def unpacked_shape(value: list) -> Slot:
    return _unpacked_slot(value).keyed()


def _slot(run: Run) -> Slot:
    return Slot(run.label, [_slot(c) for c in run.children])


def shape_of(pages: list[str]) -> Slot:
    """The tree that pages of one host have together."""
    trees = [Run("#root", [parse(p)]) for p in pages]
    root = _slot(trees[0])
    for tree in trees[1:]:
        root = _merged(root, tree, {id(run): slot for slot, run in match(root.children, tree.children)[1]})
    return root.keyed()


def _merged(slot: Slot, run: Run, known: dict[int, Slot]) -> Slot:
    """A slot with what its run has besides, each in the place after the one before it."""
    children, after = {id(c): c for c in slot.children}, defaultdict(list)
    before = None
    for child in run.children:
        if own := known.get(id(child)):
            children[id(own)] = _merged(own, child, known)
            before = id(own)
        else:
            after[before].append(_slot(child))
    return Slot(slot.label, [*after[None], *(x for k, c in children.items() for x in (c, *after[k]))])


def align(shape: Slot, tree: Run) -> list[tuple[Run, int, int]]:
    """Each run of a page with its key and its parent's, in page order. What the shape doesn't have is known by labels below what it has."""
    slots = {id(run): slot for slot, run in match(shape.children, tree.children)[1]}
    out: list[tuple[Run, int, int]] = []

    def walk(run: Run, key: int, parent: int) -> None:
        out.append((run, key, parent))
        seen: Counter[str] = Counter()
        for child in run.children:
            if slot := slots.get(id(child)):
                walk(child, slot.place, key)
            else:
                seen[child.label] += 1
                walk(child, _key(f"{key}+{seen[child.label]}{child.label}"), key)

    walk(tree, ROOT, 0)
    return out


def measured(shape: Slot, page: str) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """A key of all texts of a page in their slots, and rows (key, parent, kind, text, length).

    text is the key of a text in its slot and length its characters there, or text is 0 and length that of the whole slot.
    """
    rows, lengths = [], Counter()
    runs = align(shape, Run("#root", [parse(page)]))
    for run, key, parent in reversed(runs):
        own = Counter(_own_text(n) for n in run.nodes if n.tag in _BLOCKS)
        for text, n in own.items():
            if text:
                rows.append((key, parent, _kind(run.label), _key(text), n * len(text)))
                lengths[key] += n * len(text)
        lengths[parent] += lengths[key]
    return _key(str(rows)), rows + [(key, parent, _kind(run.label), 0, lengths[key]) for run, key, parent in runs]


def settle(shape: Slot, slots: dict[int, tuple[int, int, int, int]], found: dict[tuple[int, int], tuple[int, int]]) -> Wrapper:
    """The wrapper of a host of two different pages or more. slots: parent, kind, pages and characters by key; found: pages and characters by slot and text."""
    n_pages = slots[ROOT][2]
    kind = lambda k: slots[k][1] % DOUBTED
    constant: dict[int, set[int]] = defaultdict(set)
    varying = {key: total for key, (*_, total) in slots.items()}
    below: dict[int, list[int]] = defaultdict(list)
    for key, (parent, *_) in slots.items():
        below[parent].append(key)
    for (key, text), (n, length) in found.items():
        if key in slots and n >= max(min(TEMPLATE_PAGES, n_pages), TEMPLATE_SHARE * slots[key][2]):
            constant[key].add(text)
            while key:
                varying[key] -= length
                key = slots[key][0]
    if varying[ROOT] < min(COPIES_CHARS * n_pages, COPIES_SHARE * slots[ROOT][3]):
        return Wrapper(shape, {}, frozenset())

    worth: dict[int, float] = {}

    def weigh(at: int) -> float:
        inner = sum(map(weigh, below[at]))
        own = varying[at] - sum(varying[k] for k in below[at])
        worth[at] = (own + inner) * (DOUBTED_WORTH if slots[at][1] >= DOUBTED else 1)
        return worth[at]

    weigh(ROOT)

    def sought(at: int) -> list[int]:
        if kind(at) == ARTICLE or not varying[at]:
            return [at]
        pages, least = (lambda k: slots[k][2]), CONTENT_SHARE * (worth[at] / (DOUBTED_WORTH if slots[at][1] >= DOUBTED else 1))
        layouts = [k for k in below[at] if kind(k) != OTHER and worth[k] * pages(at) >= least * pages(k)]
        if len(layouts) > 1 and sum(map(pages, layouts)) <= pages(at) and sum(worth[k] for k in layouts) >= least:
            return [x for k in sorted(layouts) for x in sought(k)]
        best = max(below[at], key=lambda k: (worth[k], kind(k) == MAIN, k), default=None)
        return sought(best) if best and worth[best] >= least and kind(best) != OTHER else [at]

    trusted = frozenset(k for k, (_, _, n, total) in slots.items() if slots[k][1] >= DOUBTED and n >= min(TEMPLATE_PAGES, n_pages) and varying[k] > TRUSTED_SHARE * total)
    return Wrapper(shape, {k: frozenset(v) for k, v in constant.items()}, frozenset(sought(ROOT)) - {ROOT}, trusted)


def fit(pages: list[str]) -> Wrapper:
    """The wrapper of different pages of one host, as induce() has it for all of them."""
    shape = shape_of(pages)
    slots: dict[int, tuple[int, int, int, int]] = {}
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for rows in dict(measured(shape, p) for p in pages).values():
        for key, parent, kind, text, length in rows:
            if text:
                n, total = found.get((key, text), (0, 0))
                found[key, text] = (n + 1, total + length)
            else:
                *_, n, total = slots.get(key, (0, 0))
                slots[key] = (parent, kind, n + 1, total + length)
    return settle(shape, slots, found) if slots[ROOT][2] > 1 else Wrapper(shape, {}, frozenset())


def _main_nodes(root: Node) -> list[Node]:
    """Outermost elements that a page itself marks as its main part."""
    found: list[Node] = []

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str) or child.dropped or child.doubted:
                continue
            if child.tag in _MAIN or child.attributes.get("role") == "main":
                found.append(child)
            else:
                walk(child)

    walk(root)
    inner = [x for node in found if node.tag != "article" for x in _articles(node)]
    return inner or found


def _articles(node: Node) -> list[Node]:
    return [y for child in node.children if isinstance(child, Node) and not child.dropped and not child.doubted for y in ([child] if child.tag == "article" else _articles(child))]


class _Known:
    """What a wrapper knows of a page's nodes, by their identity."""

    def __init__(self, root: Node, wrapper: Wrapper | None):
        self.template: dict[int, frozenset[int]] = {}
        self.trusted: set[int] = set()
        self.content: list[Node] = []
        for run, key, _ in align(wrapper.shape, Run("#root", [root])) if wrapper else ():
            nodes = list(map(id, run.nodes))
            if key in wrapper.constant:
                self.template |= dict.fromkeys(nodes, wrapper.constant[key])
            if key in wrapper.trusted:
                self.trusted.update(nodes)
            if key in wrapper.content:
                self.content += run.nodes


class _Block(NamedTuple):
    text: str
    heading: bool
    template: bool


def _blocks(node: Node, known: _Known) -> list[_Block]:
    """Blocks below a node in page order, without what is never content."""
    out: list[_Block] = []
    pieces: list[str] = []

    def flush(owner: Node) -> None:
        if pieces:
            text = _clean(pieces)
            pieces.clear()
            if text:
                constant = known.template.get(id(owner))
                out.append(_Block(text, owner.tag in _HEADINGS, bool(constant) and _key(text) in constant))

    def walk(x: Node, owner: Node, in_header: bool) -> None:
        for child in x.children:
            if isinstance(child, str):
                if not in_header or owner.tag in _HEADINGS:
                    pieces.append(child)
            elif child.dropped or child.doubted and not (child.doubted == WEAK_DOUBT and id(child) in known.trusted):
                if child.tag in _BLOCKS:
                    flush(owner)
            elif child.tag in _BLOCKS:
                flush(owner)
                walk(child, child, in_header or child.tag == "header")
                flush(child)
            elif child.tag in ("br", "img"):
                pieces.append(" ")
            else:
                walk(child, owner, in_header)

    walk(node, node, node.tag == "header")
    flush(node)
    return out


def _own(blocks: list[_Block]) -> list[str]:
    """Texts of the article's own blocks: those that aren't template, and headings that are but have one of these before the next heading."""
    out, ahead = [], False
    for b in reversed(blocks):
        if not b.template or b.heading and ahead:
            out.append(b.text)
        ahead = not b.heading and (ahead or not b.template)
    return out[::-1]


def read(page: str, wrapper: Wrapper | None = None) -> tuple[str, str]:
    """Blocks of the article, joined by empty lines, and what decided on them: wrapper, marks (of the page itself) or page (it has none)."""
    root = parse(page)
    known = _Known(root, wrapper)
    if own := _own([b for node in known.content for b in _blocks(node, known)]):
        return "\n\n".join(own), "wrapper"
    marked = _main_nodes(root)
    return "\n\n".join(_own([b for node in marked or [root] for b in _blocks(node, known)])), "marks" if marked else "page"


def main_text(page: str, wrapper: Wrapper | None = None) -> str:
    """The article's text alone, as read() finds it."""
    return read(page, wrapper)[0]


def _host(url):
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def _hash(host: str) -> int:
    """As Spark's xxhash64 has it, unsigned."""
    return xxhash.xxh64_intdigest(host, 42)


def _shard(host_key: int, shards: int) -> int:
    """As pmod of the signed hash."""
    return (host_key - (1 << 64) * (host_key >> 63)) % shards


def _save(folder: str, kind: str, shard: int, packed: dict[int, list]) -> pa.Table:
    """Write values by unsigned hash of their host as one file, and return the number of them."""
    done = [(key, json.dumps(value).encode()) for key, value in sorted(packed.items())]
    ends = np.cumsum([0, *(len(b) for _, b in done)])
    save(folder, f"{kind}-{shard}", np.array([k for k, _ in done], np.uint64), ends, np.frombuffer(b"".join(b for _, b in done), np.uint8))
    return pa.table([pa.array([len(done)], pa.int64())], names=["n"])


COUNTED = "host_key long, page_key long, slot long, parent long, kind int, text long, length long"
_LONGS = ("host_key", "slot", "parent", "text")


def _sampled(rows: DataFrame) -> DataFrame:
    """At most SAMPLE_PAGES different pages of each host of rows (host, h, ...): one for each part, those of least hash."""
    part = F.pmod("h", F.lit(SAMPLE_PARTS))
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("host", part).orderBy("h"))).where("n = 1")
    return one.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("h"))).where(F.col("n") <= SAMPLE_PAGES)


def induce(pages: DataFrame, folder: str) -> int:
    """Write the wrappers of all hosts with two different pages or more below folder, in as many files as it returns.

    Pages with the same texts in the same slots are one. What crosses the network is the sampled pages, and keys and lengths of texts.
    """
    rows = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host <> '' AND html <> ''").withColumn("h", F.xxhash64("html"))
    # Files are sized by what a task holds to make them: first without the pages themselves, which cost most.
    hosts, n_bytes = _sampled(rows.select("host", "h", F.octet_length("html").alias("size"))).agg(F.approx_count_distinct("host"), F.sum("size")).first()
    shards = max(shard_count(hosts or 0, HOSTS_PER_SHARD), shard_count(n_bytes or 0, BYTES_PER_SHARD))
    few = _sampled(rows)

    def shaped(group: pa.Table) -> pa.Table:
        by_host: dict[str, list[str]] = {}
        for host, page in sorted(zip(group.column("host").to_pylist(), group.column("html").to_pylist(), strict=True)):
            by_host.setdefault(host, []).append(page)
        return _save(folder, "shapes", _shard(_hash(next(iter(by_host))), shards), {_hash(host): shape_of(own).packed() for host, own in by_host.items()})

    few.withColumn("shard", F.pmod(F.xxhash64("host"), F.lit(shards))).groupBy("shard").applyInArrow(shaped, "n long").agg(F.sum("n")).collect()

    def counted(batch: pa.RecordBatch, shapes: _Kept) -> pa.RecordBatch:
        out: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page_key, own = measured(shapes.of(host), page)
            out += [(_hash(host), page_key, *row) for row in own]
        columns = [np.array(c, np.uint64).view(np.int64) for c in zip(*out, strict=True)]
        columns[4] = columns[4].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in COUNTED.split(", ")])

    found = map_batches(rows.select("host", "html"), counted, COUNTED, lambda: _Kept(folder, "shapes", shards, unpacked_shape))
    same = [F.first("parent").alias("parent"), F.first("kind").alias("kind")]
    found = found.groupBy("host_key", "page_key", "slot", "text").agg(*same, F.first("length").alias("length"))
    found = written(found.groupBy("host_key", "slot", "text").agg(*same, F.count("*").alias("n"), F.sum("length").alias("total")).where("n > 1"), "slot-texts")
    slots = found.where("text = 0")
    often = found.where("text <> 0").join(slots.select("host_key", "slot", F.col("n").alias("of")), ["host_key", "slot"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("of"))

    def settled(group: pa.Table) -> pa.Table:
        columns = {k: group.column(k).to_numpy() for k in (*_LONGS, "kind", "n", "total")}
        columns |= {k: columns[k].view(np.uint64) for k in _LONGS}
        hosts: dict[int, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
        for host, slot, parent, text, kind, n, total in zip(*(c.tolist() for c in columns.values()), strict=True):
            if text:
                hosts[host][1][slot, text] = (n, total)
            else:
                hosts[host][0][slot] = (parent, kind, n, total)
        shapes = _Kept(folder, "shapes", shards, unpacked_shape)
        return _save(folder, "wrappers", int(group.column("shard")[0].as_py()), {host: settle(shapes.read(host), *own).packed() for host, own in hosts.items()})

    names = [*_LONGS, "kind", "n", "total"]
    wrapper_shards = max(shard_count(hosts or 0, HOSTS_PER_SHARD), shard_count(found.count(), SLOTS_PER_SHARD))
    kept = slots.select(*names).unionByName(often.select(*names)).withColumn("shard", F.pmod("host_key", F.lit(wrapper_shards)))
    kept.groupBy("shard").applyInArrow(settled, "n long").agg(F.sum("n")).collect()
    return wrapper_shards


class _Kept:
    """Shapes or wrappers of hosts, each read from its file when first asked for; as many as a task's hosts are kept, the last KEPT of them."""

    KEPT = 256

    def __init__(self, folder: str, kind: str, shards: int, unpack: Callable[[list], Slot | Wrapper]):
        self.folder, self.kind, self.shards, self.unpack, self.known = folder, kind, shards, unpack, {}

    def of(self, host: str) -> Slot | Wrapper | None:
        if host not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.pop(next(iter(self.known)))
            self.known[host] = self.read(_hash(host)) if host else None
        return self.known[host]

    def read(self, host_key: int) -> Slot | Wrapper | None:
        arrays = mapped(self.folder, f"{self.kind}-{_shard(host_key, self.shards)}")
        if not arrays or not len(arrays[0]):
            return None
        keys, ends, data = arrays
        key = np.uint64(host_key)
        at = min(int(np.searchsorted(keys, key)), len(keys) - 1)
        return self.unpack(json.loads(data[int(ends[at]) : int(ends[at + 1])].tobytes())) if keys[at] == key else None


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and decided_by (wrapper, marks or page; null without html) of each row of pages.

    A null or empty html, or one without content, has an empty text. A null or unreadable url has no host and a host with one
    different page no wrapper; their pages are read by tags, roles and classes alone. A very long page is read whole; only what stands
    more than MOST_DEPTH elements deep counts as text of the last of them. Copies of a page count once in its host's wrapper
    and are each answered. No page is shuffled: wrappers come from files in the shared folder.
    """
    folder = fresh_uri(pages.sparkSession, "wrappers")
    bound_batches(pages.sparkSession)
    shards = induce(pages, folder)

    def kernel(batch: pa.RecordBatch, wrappers: _Kept) -> pa.RecordBatch:
        out = [read(page, wrappers.of(host)) if page else ("", None) for page, host in zip(texts(batch.column("html")), batch.column("host").to_pylist(), strict=True)]
        text, by = ([x[k] for x in out] for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64()), pa.array(by, pa.string())], names=["page_id", "url", "text", "n_chars", "decided_by"]
        )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    return map_batches(rows, kernel, "page_id long, url string, text string, n_chars long, decided_by string", lambda: _Kept(folder, "wrappers", shards, unpacked))
