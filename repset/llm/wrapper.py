"""HTML extraction by wrapper induction: trees of pages of one host are aligned by simple tree matching;
nodes that are constant become template, varying slots become content.

Per host, and per layout that is frequent there, some reference pages are aligned one after another
into one wrapper tree; of it those nodes stay that at least two references have alike, and what
stands above them. Every page is then aligned with its wrapper, once, and tells which of its nodes
are the same as at the aligned place. A node is template if that is so on most of the host's
distinct pages, counted over all of them. Tags, roles and class names are a hint besides: what they
say counts for nodes that don't hold most of a page's text.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repset.llm.worker import bounded, tidy
from repset.session import drop, materialize

#: a node is template if it is at the same place on this share of the distinct pages of its host, or of
#: its layout if that has LAYOUT pages at least
SHARE, LAYOUT = 0.75, 10
#: pages, those with the smallest hashes, that a wrapper tree is induced from; template is what most of
#: all pages have, so that of the nodes of that tree nearly none is missed for want of references
REFERENCES = 8
#: on hosts of fewer distinct pages, and by layout, near copies look like template: a page of which
#: that would take more than half of the text keeps it
FEW = 4
#: a block outside of the elements that hold most of the text is left out if it has at most so many words
STRAY = 4
#: pairs of children that are looked at one by one; in wider lists, children that align alike are one kind
PAIRS = 200_000
#: bytes of wrappers, and template nodes of all hosts, up to which they are broadcast; beyond, joined by shuffle
BROADCAST_BYTES, BROADCAST_NODES = 32 << 20, 1_000_000
#: containers that tell the layout of a page: the first so many in page order, with class, without digits
OPENING = 6

# HTML element classes and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCKS - {"li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
FURNITURE = frozenset("script style noscript template nav footer aside form button select option optgroup datalist textarea input svg canvas iframe object applet audio video map head title menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsbygoogle adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments disqus reply replies respond pagination pager toolbar skip hidden".split())
#: words that go along with those in one class name and say nothing themselves
PLAIN = frozenset("a all and area articles bar block body bottom box bottombar btn button buttons col column container content desktop div fixed form global group head holder icon icons in inner item items left link links list main mobile outer page panel post posts primary reader right row secondary section site slot small sticky stories text the title to top unit user users widget wrap wrapper wrapping".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: blocks of running text: inside an article, class names say nothing about them
RUNNING = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption caption".split())
SCOPES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """``sig``: hash of the subtree, 0 without text; ``weight``: its nodes; ``chars``: its text; ``key``: the
    place in the wrapper, if it is the same there."""

    __slots__ = ("tag", "attrs", "kids", "sig", "weight", "chars", "key")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.sig, self.weight, self.chars, self.key = 0, 0, 0, None


def parse(page: str) -> Node:
    """A tree that forgives unclosed and misplaced tags; comments and raw text elements are left out."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    low = None
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                stack[-1].kids.append(m[0])
            elif m[0].startswith("<![CDATA["):
                stack[-1].kids.append(_html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS and tag not in ("td", "th"):
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS or stack[k].tag in ("td", "th", "button", "object"):
                    break
        if tag in SCOPES:
            same, scope = SCOPES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in same:
                    del stack[k:]
                    if tag != "tr":
                        break
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            if low is None:
                low = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else end
            if end >= 0:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
        elif tag not in VOID and not attrs.endswith("/") or tag in ("p", "div", "span", "a", "li") and attrs.endswith("/"):
            stack.append(node)
    return root


# -- alignment ---------------------------------------------------------------------------------


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def sign(node: Node) -> None:
    """Fill in signatures (tag, text and children, the same in every process), weights and text sizes."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if not isinstance(k, str)]
    for x in reversed(order):
        kids, weight, chars = [], 1, 0
        for k in x.kids:
            if isinstance(k, str):
                k = " ".join(k.split())
                if k:
                    kids.append(k)
                    chars += len(k)
            elif k.sig:
                kids.append(str(k.sig))
                weight += k.weight
                chars += k.chars
        x.sig, x.weight, x.chars = _hash(x.tag, *kids) if kids else 0, weight, chars


def _elements(node: Node) -> list[Node]:
    return [k for k in node.kids if not isinstance(k, str) and k.sig]


def heaviest(pairs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest choice of pairs (i, j, weight) in which both i and j ascend: (weight, pairs)."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    size = max((j for _, j, _ in pairs), default=-1) + 2
    best: list[tuple[int, int]] = [(0, -1)] * size  # a tree of prefix maxima over j
    before = []
    for n, (_, j, w) in enumerate(pairs):
        top, k = (0, -1), j
        while k > 0:
            top = max(top, best[k])
            k &= k - 1
        before.append(top[1])
        now, k = (top[0] + w, n), j + 1
        while k < size:
            if best[k] < now:
                best[k] = now
            k += k & -k
    top, k = (0, -1), size - 1
    while k > 0:
        top = max(top, best[k])
        k &= k - 1
    out, n = [], top[1]
    while n >= 0:
        out.append(pairs[n][:2])
        n = before[n]
    return top[0], out[::-1]


def _kinds(xs: list[Node], ys: list[Node]) -> list[tuple[list[int], list[Node], list[set[int]]]]:
    """Of either list the kind of each node, a node of each kind, and the signatures in it that both lists hold. Nodes
    of one kind align with all of the other list alike: they differ in what that doesn't hold only."""
    inside: list[list[Node]] = []
    for nodes in (xs, ys):
        order, todo = [], list(nodes)
        while todo:
            x = todo.pop()
            order.append(x)
            todo += _elements(x)
        inside.append(order)
    both = {x.sig for x in inside[0]} & {y.sig for y in inside[1]}
    out = []
    for nodes, order in zip((xs, ys), inside):
        names: dict[tuple, int] = {}
        name: dict[int, int] = {}
        held: list[set[int]] = []
        for x in reversed(order):
            known = x.sig if x.sig in both else 0
            key = known, x.tag, *(name[id(k)] for k in _elements(x))
            name[id(x)] = names.setdefault(key, len(names))
            if len(held) < len(names):
                held.append({known} - {0} if x.weight == 1 else ({known} - {0}).union(*(held[name[id(k)]] for k in _elements(x))))
        place: dict[int, int] = {}
        some, kinds = [], []
        for x in nodes:
            k = place.setdefault(name[id(x)], len(place))
            if k == len(some):
                some.append(x)
            kinds.append(k)
        out.append((kinds, some, [held[n] for n in place]))
    return out


def _wide(rows: list[int], columns: list[int], weight: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """``heaviest`` of all pairs (i, j) with ``weight`` by the kinds of both, row by row; of the rows only some are kept."""
    kinds, n, m = np.array(columns), len(rows), len(columns)

    def after(row: np.ndarray, i: int) -> np.ndarray:
        new = np.zeros(m + 1, np.int64)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight[rows[i]][kinds]), out=new[1:])
        return new

    step = int(n**0.5) + 1
    kept, row = [], np.zeros(m + 1, np.int64)
    for i in range(n):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    out, j, top = [], m, int(row[m])
    for k in range(len(kept) - 1, -1, -1):
        some = [kept[k]]
        for i in range(k * step, min(n, (k + 1) * step)):
            some.append(after(some[-1], i))
        i = len(some) - 1
        while i and j:
            if some[i][j] == some[i - 1][j]:
                i -= 1
            elif some[i][j] == some[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((k * step + i, j))
    return top, out[::-1]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching of two signed trees: pairs of nodes, parents before children, that keep tags,
    ancestors and order, and hold as many equal subtrees' nodes as can be. Children of a pair of
    equal nodes are not listed. Works without recursion, so depth doesn't matter."""
    done: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}
    kinds: dict[tuple[int, int], list] = {}
    wide: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) in done:
            todo.pop()
            continue
        xs, ys = _elements(x), _elements(y)
        low, high = 0, 0
        most = min(len(xs), len(ys))
        while low < most and xs[low].sig == ys[low].sig:
            low += 1
        while high < most - low and xs[-1 - high].sig == ys[-1 - high].sig:
            high += 1
        ends = [(xs[i], ys[i]) for i in range(low)] + [(xs[len(xs) - 1 - i], ys[len(ys) - 1 - i]) for i in range(high)]
        xs, ys = xs[low : len(xs) - high], ys[low : len(ys) - high]
        pairs, open_ = [], []
        if len(xs) * len(ys) > PAIRS:
            key = id(x), id(y)
            if key not in wide:
                (rows, of_x, in_x), (columns, of_y, in_y) = kinds[key] = kinds.get(key) or _kinds(xs, ys)
                weights = np.zeros((len(of_x), len(of_y)), np.int32)
                for i, c in enumerate(of_x):
                    for j, d in enumerate(of_y):
                        if c.sig == d.sig:
                            weights[i, j] = c.weight
                        elif c.tag == d.tag and c.weight > 1 and d.weight > 1 and not in_x[i].isdisjoint(in_y[j]):
                            got = done.get((id(c), id(d)))
                            if got is None:
                                open_.append((c, d))
                            elif got[0]:
                                weights[i, j] = got[0] + 1
                if open_:
                    todo += open_
                    continue
                wide[key] = _wide(rows, columns, weights)
                del kinds[key]
            open_ = [(xs[i], ys[j]) for i, j in wide[key][1] if xs[i].sig != ys[j].sig and (id(xs[i]), id(ys[j])) not in done]
            if open_:
                todo += open_
                continue
            todo.pop()
            weight, chosen = wide.pop(key)
            done[key] = weight + sum(c.weight for c, _ in ends), ends[:low] + [(xs[i], ys[j]) for i, j in chosen] + ends[low:][::-1]
            continue
        alike: dict[object, list[int]] = {}
        for j, d in enumerate(ys):
            alike.setdefault(d.sig, []).append(j)
            if d.weight > 1:
                alike.setdefault(d.tag, []).append(j)
        for i, c in enumerate(xs):
            for j in alike.get(c.sig, ()):
                pairs.append((i, j, c.weight))
            for j in alike.get(c.tag, ()) if c.weight > 1 else ():
                d = ys[j]
                if d.sig != c.sig:
                    got = done.get((id(c), id(d)))
                    if got is None:
                        open_.append((c, d))
                    elif got[0]:
                        pairs.append((i, j, got[0] + 1))
        if open_:
            todo += open_
            continue
        todo.pop()
        weight, chosen = heaviest(pairs)
        done[id(x), id(y)] = weight + sum(c.weight for c, _ in ends), ends[:low] + [(xs[i], ys[j]) for i, j in chosen] + ends[low:][::-1]
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.sig != y.sig:
            todo += reversed(done[id(x), id(y)][1])
    return out


def _place(path: int, tag: str) -> int:
    return zlib.crc32(tag.encode("utf-8", "surrogatepass"), path)


def _key(path: int, sig: int) -> int:
    key = (sig ^ path * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    return key - (1 << 64) if key >> 63 else key


def induce(trees: list[Node]) -> Node | None:
    """The wrapper of signed trees: nodes that at least two of them have alike, and their ancestors."""
    if len(trees) < 2:
        return None
    root, times = trees[0], {}
    for t in trees[1:]:
        pairs = align(root, t)
        mates = {id(y): x for x, y in pairs}
        for x, y in pairs:
            if x.sig == y.sig:
                todo = [x]
                while todo:
                    k = todo.pop()
                    times[id(k)] = times.get(id(k), 1) + 1
                    todo += _elements(k)
                continue
            at, where = 0, {id(k): n for n, k in enumerate(x.kids)}
            kids: dict[int, list[Node]] = {}
            for d in _elements(y):
                if id(d) in mates:
                    at = where[id(mates[id(d)])] + 1
                else:
                    kids.setdefault(at, []).append(d)
            if kids:
                x.kids = [k for n in range(len(x.kids) + 1) for k in [*kids.get(n, ()), *x.kids[n : n + 1]]]
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += _elements(x)
    kept: set[int] = set()
    for x in reversed(order):
        x.kids = [k for k in _elements(x) if id(k) in kept]
        if x.kids or times.get(id(x), 1) > 1:
            kept.add(id(x))
    return root if root.kids else None


def dump(root: Node) -> bytes:
    """A wrapper as bytes: [tag, sig, children] in page order."""
    flat, todo = [], [root]
    while todo:
        x = todo.pop()
        kids = _elements(x)
        flat.append([x.tag, x.sig, len(kids)])
        todo += reversed(kids)
    return json.dumps(flat, separators=(",", ":")).encode()


def load(raw: bytes) -> Node:
    flat = json.loads(raw)
    nodes = []
    for tag, sig, _ in flat:
        nodes.append(Node(tag))
        nodes[-1].sig = sig
    open_: list[tuple[Node, int]] = []
    for node, (_, _, n) in zip(nodes, flat, strict=True):
        if open_:
            parent, left = open_.pop()
            parent.kids.append(node)
            if left > 1:
                open_.append((parent, left - 1))
        if n:
            open_.append((node, n))
    for x in reversed(nodes):
        x.weight = 1 + sum(k.weight for k in x.kids)
    return nodes[0]


def mark(wrapper: Node, tree: Node) -> list[int]:
    """Set the keys of the nodes of ``tree`` that are the same as their mates in the wrapper; returns all.

    Inline elements beside loose text are parts of a sentence, and no template by themselves."""
    equal = {id(y) for x, y in align(wrapper, tree) if x.sig == y.sig}
    out, todo = set(), [(tree, 0, id(tree) in equal)]
    while todo:
        x, path, same = todo.pop()
        loose = any(isinstance(k, str) and k.strip() for k in x.kids)
        for k in x.kids:
            if not isinstance(k, str) and k.sig:
                at, alike = _place(path, k.tag), same or id(k) in equal
                if alike and (not loose or k.tag in BLOCKS or k.tag in ("td", "th")):
                    k.key = _key(at, k.sig)
                    out.add(k.key)
                todo.append((k, at, alike))
    return sorted(out)


# -- furniture by tags, roles and names --------------------------------------------------------


def _find(node: Node, tags: frozenset | set) -> list[Node]:
    """Topmost nodes with one of the tags, in page order."""
    out, todo = [], list(reversed([k for k in node.kids if not isinstance(k, str)]))
    while todo:
        k = todo.pop()
        if k.tag in tags:
            out.append(k)
        else:
            todo += reversed([x for x in k.kids if not isinstance(x, str)])
    return out


def _named(value: str) -> bool:
    """Whether one of the names in a class or id attribute is made of words for furniture, and of such that say nothing."""
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if any(w in NAMES for w in words) and all(w in NAMES or w in PLAIN or len(w) == 1 or w.isdigit() for w in words):
            return True
    return False


def _furniture(node: Node, inside: bool, loose: bool, most: bool) -> bool:
    """``inside`` an article; beside ``loose`` text; or holding ``most`` of the page's text."""
    if node.tag in FURNITURE:
        return not (node.tag == "button" and loose or most and node.tag in ("form", "dialog", "search"))
    if node.tag in ("html", "body", "main", "article", "#root") or not node.attrs:
        return False
    for name, a, b, c in _ATTR.findall(node.attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true":
            return True
        if most or loose and node.tag not in BLOCKS or inside and node.tag in RUNNING:
            continue
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and _named(value):
            return True
    return False


def prune(root: Node) -> None:
    """Take out furniture; of a header inside an article the headings stay."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        loose = node.tag not in ("body", "#root", "html") and any(isinstance(k, str) and k.strip() for k in node.kids)
        kids = []
        for k in node.kids:
            if isinstance(k, str):
                kids.append(k)
                continue
            most = 2 * k.chars > root.chars
            named = _furniture(k, inside, loose, most)
            if k.tag == "header" and not (most and not inside) or named and k.tag not in FURNITURE and re.search("header", k.attrs, re.I):
                if inside:
                    kids += _find(k, HEADINGS)
                continue
            if not named:
                kids.append(k)
                todo.append((k, inside or k.tag in ("article", "main")))
        node.kids = kids


def _text_size(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                n += len(k.strip())
            else:
                todo.append(k)
    return n


def _holds(node: Node, tags: frozenset | set) -> bool:
    todo = [node]
    while todo:
        for k in todo.pop().kids:
            if not isinstance(k, str):
                if k.tag in tags:
                    return True
                todo.append(k)
    return False


def tree_of(page: str) -> Node:
    """The signed tree of a page; the children of html and body elements stand in place of these."""
    root = parse(page)
    out, todo = [], list(reversed(root.kids))
    while todo:
        k = todo.pop()
        if not isinstance(k, str) and k.tag in ("html", "body"):
            todo += reversed(k.kids)
        else:
            out.append(k)
    root.kids = out
    sign(root)
    return root


def strip(root: Node) -> Node:
    """A tree without furniture, in page order.

    Article and main elements are a hint only: where they hold at least half of the text, a block
    outside of them that has STRAY words at most, no blocks inside and is no heading is left out.
    All else stays, so also several articles, and what stands beside or between them."""
    prune(root)
    found = _find(root, {"article", "main"})
    if found and 2 * sum(map(_text_size, found)) >= _text_size(root):
        todo = [root]
        while todo:
            node = todo.pop()
            kids = []
            for k in node.kids:
                if isinstance(k, str) or k.tag in ("article", "main") or k.tag in HEADINGS:
                    kids.append(k)
                elif k.tag not in BLOCKS or _holds(k, BLOCKS):
                    kids.append(k)
                    todo.append(k)
                elif len(text(segments(k)).split()) > STRAY:
                    kids.append(k)
            node.kids = kids
    return root


# -- text --------------------------------------------------------------------------------------


def segments(node: Node) -> list[tuple[bool, str, list[int]]]:
    """The text in page order: (a block begins, text, keys of the nodes it stands in)."""
    out: list[tuple[bool, list[str], tuple[int, ...]]] = []
    begin = True
    todo: list = [(node, ())]
    while todo:
        k, keys = todo.pop()
        if k is None:
            begin = True
        elif isinstance(k, str):
            if begin or not out or out[-1][2] != keys:
                if begin and not k.strip():
                    continue
                out.append((begin, [], keys))
                begin = False
            out[-1][1].append(k)
        else:
            if k.key is not None:
                keys = (*keys, k.key)
            if k.tag in BLOCKS:
                begin = True
                todo.append((None, keys))
            elif k.tag == "br" or k.tag in ("td", "th"):
                todo += [(x, keys) for x in reversed(k.kids)]
                todo.append((" ", keys))
                continue
            todo += [(x, keys) for x in reversed(k.kids)]
    return [(new, re.sub(r"[ \t\n\r\f]+", " ", "".join(parts)), list(keys)) for new, parts, keys in out]


def text(parts: list[tuple[bool, str, list[int]]], leave: frozenset | set = frozenset()) -> str:
    """Blocks in page order, one a line, without what stands in a node of ``leave``; white space inside a block is one space."""
    lines: list[list[str]] = []
    for new, t, keys in parts:
        if new or not lines:
            lines.append([])
        if not leave or not any(k in leave for k in keys):
            lines[-1].append(_html.unescape(t))
    joined = (" ".join("".join(x).split()) for x in lines)
    return "\n".join(x for x in joined if x)


def left(parts: list[tuple[bool, str, list[int]]], sure: frozenset, weak: frozenset) -> str:
    """The text without ``sure`` template, and without ``weak`` unless that too would take most of the text."""
    if not sure and not weak:
        return text(parts)
    least = text(parts, sure)
    if not weak:
        return least
    rest = text(parts, sure | weak)
    return least if len(rest) < len(least) and 2 * len(rest) < len(text(parts)) else rest


# -- the operator ------------------------------------------------------------------------------


def host(url):
    """Lower-cased host of a URL; null without one."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def layout(page):
    """Hash of the first OPENING containers of a page, with their class and without digits; never null."""
    tags = F.regexp_extract_all(F.lower(page), F.lit(r"<((?:article|main|section|div|table|ul|ol|dl)\b[^>]*)>"), F.lit(1))
    return F.xxhash64(F.regexp_replace(F.array_join(F.slice(tags, 1, OPENING), "|"), "[0-9]+", ""))


_WRAPPER = "host string, layout long, wrapper binary"


@tidy
def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (host, layout), REFERENCES pages at most of each."""

    def made(key: tuple, pages: list[str]) -> pa.RecordBatch:
        root = induce([tree_of(p) for p in pages])
        raw = dump(root) if root is not None else b""
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([raw], pa.binary())], names=["host", "layout", "wrapper"])

    now, held = None, []
    for b in batches:
        for h, g, page in zip(*(b.column(c).to_pylist() for c in ("host", "layout", "html")), strict=True):
            if (h, g) != now:
                if held:
                    yield made(now, held)
                now, held = (h, g), []
            held.append(page)
    if held:
        yield made(now, held)


_PARTS = pa.list_(pa.struct([("new", pa.bool_()), ("text", pa.string()), ("keys", pa.list_(pa.int64()))]))
_MARKED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("layout", pa.int64()), ("sig", pa.int64()), ("keys", pa.list_(pa.int64())), ("parts", _PARTS)])
_MARKED_DDL = "page_id long, url string, host string, layout long, sig long, keys array<long>, parts array<struct<new: boolean, text: string, keys: array<long>>>"


@tidy
def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page its text in parts, with the keys of the nodes that are the same as in the wrapper."""
    known: dict[bytes, Node] = {}
    for b in batches:
        out, size = [], 0
        for page_id, url, page, h, g, wrapper in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "layout", "wrapper")), strict=True):
            tree = tree_of(page or "")
            sig, keys = tree.sig, []
            if wrapper:
                if wrapper not in known:
                    if len(known) >= 200:
                        known.clear()
                    known[wrapper] = load(wrapper)
                keys = mark(known[wrapper], tree)
            parts = [{"new": new, "text": t, "keys": k} for new, t, k in segments(strip(tree))]
            out.append({"page_id": page_id, "url": url, "host": h, "layout": g, "sig": sig, "keys": keys, "parts": parts})
            size += len(page or "")
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=_MARKED)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_MARKED)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


@tidy
def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page_id, url, g, parts, sure, weak in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "layout", "parts", "sure", "weak")), strict=True):
            parts = [(p["new"], p["text"], p["keys"]) for p in parts]
            weak = frozenset(weak or ())
            if weak and g is not None:
                weak |= {k for _, _, keys in parts for k in keys if k ^ g in weak}
            got = left(parts, frozenset(sure or ()), weak)
            out.append({"page_id": page_id, "url": url, "text": got, "n_chars": len(got)})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, layout, wrapper``: of each host (layout null), and of each of its layouts of LAYOUT distinct
    pages at least.

    References are the distinct pages with the smallest hashes; only their hashes are ranked, and a
    host with a third of all pages sends no more than REFERENCES of each partition."""
    tasks = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct, at_distinct = materialize(pages.where("host IS NOT NULL AND html IS NOT NULL").select("host", "layout", F.xxhash64("html").alias("page")).distinct(), "distinct")
    frequent = distinct.groupBy("host", "layout").count().where(F.col("count") >= LAYOUT).select("host", "layout")
    both = distinct.join(frequent, ["host", "layout"], "left_semi").union(distinct.select("host", F.lit(None).cast("long"), "page").distinct())
    first = Window.partitionBy("host", "layout").orderBy("page")
    picked = both.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= REFERENCES).select("host", "layout", "page")
    picked, at_picked = materialize(picked, "picked")
    refs = picked.select(F.col("host").alias("h"), F.col("page").alias("p")).distinct()
    if picked.count() <= BROADCAST_NODES:
        refs = F.broadcast(refs)
    found = pages.join(refs, (F.col("host") == F.col("h")) & (F.xxhash64("html") == F.col("p"))).groupBy("h", "p").agg(F.first("html").alias("html"))
    full = picked.join(found, (F.col("host") == F.col("h")) & (F.col("page") == F.col("p"))).select("host", "layout", "html", "page")
    out = full.repartition(tasks, "host", "layout").sortWithinPartitions("host", "layout", "page").select("host", "layout", "html").mapInArrow(_induced, _WRAPPER)
    out, _ = materialize(out, "wrappers")
    drop(pages.sparkSession, at_distinct, at_picked)
    return out


def templates(marked: DataFrame) -> DataFrame:
    """``h, sure, weak``: keys of the template nodes of every host that has any.

    Counted are distinct contents, so that copies of a page weigh as one. A key of a layout is
    xor-ed with the layout."""
    distinct, at_distinct = materialize(marked.where("host IS NOT NULL").groupBy("host", "sig").agg(F.min(F.struct("layout", "keys")).alias("x")).select("host", "x.layout", "x.keys"), "listed")
    kinds = distinct.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("size"))
    hosts = kinds.groupBy("host").agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    counts, at_counts = materialize(distinct.select("host", "layout", F.explode("keys").alias("k")).groupBy("host", "layout", "k").agg(F.count(F.lit(1)).alias("n")), "counts")
    whole = counts.groupBy("host", "k").agg(F.sum("n").alias("n")).where("n > 1").join(hosts, "host").where(F.col("n") >= SHARE * F.col("all"))
    whole = whole.select("host", "k", (F.col("all") >= FEW).alias("is_sure"))
    part = counts.where("n > 1").join(kinds.where(F.col("size") >= LAYOUT), ["host", "layout"]).where(F.col("n") >= SHARE * F.col("size"))
    part = part.join(hosts.where("kinds > 1").select("host"), "host", "left_semi").select("host", F.col("k").bitwiseXOR(F.col("layout")).alias("k"), F.lit(False).alias("is_sure"))
    both = whole.union(part)
    out = both.groupBy(F.col("host").alias("h")).agg(F.collect_set(F.when(F.col("is_sure"), F.col("k"))).alias("sure"), F.collect_set(F.when(~F.col("is_sure"), F.col("k"))).alias("weak"))
    out, _ = materialize(out, "templates")
    drop(marked.sparkSession, at_distinct, at_counts)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    All pages of a host are aligned with its wrapper, or that of their layout. A node that is the
    same, at the aligned place, on SHARE of the host's distinct pages, or of those of one layout, is
    the host's template, however long or short; the varying slots are content. Pages alone on their
    host, or without one, keep all slots. Besides, elements, roles and class names that mark
    furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) go, unless they
    hold most of the page's text.

    Null or empty html gives an empty text. Broken markup is read as browsers do, nearly: unclosed
    paragraphs, items and cells end where the next begins. Repeated rows get a row each; an empty
    table gives an empty result; other columns are left out. Of references with equal hashes the
    first found is taken."""
    spark = pages.sparkSession
    bounded(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"), layout(F.coalesce("html", F.lit(""))).alias("layout"))
    w = wrappers(p)
    of_layout = w.where("layout IS NOT NULL").select(F.col("host").alias("h1"), F.col("layout").alias("l1"), F.col("wrapper").alias("w1"))
    of_host = w.where("layout IS NULL").select(F.col("host").alias("h2"), F.col("wrapper").alias("w2"))
    if (w.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        of_layout, of_host = F.broadcast(of_layout), F.broadcast(of_host)
    p = p.join(of_layout, (F.col("host") == F.col("h1")) & (F.col("layout") == F.col("l1")), "left").join(of_host, F.col("host") == F.col("h2"), "left")
    p = p.select("page_id", "url", "html", "host", "layout", F.coalesce("w1", "w2").alias("wrapper"))
    marked, _ = materialize(p.mapInArrow(_marked, _MARKED_DDL), "marked")
    found = templates(marked)
    if (found.agg(F.sum(F.size("sure") + F.size("weak"))).first()[0] or 0) <= BROADCAST_NODES:
        found = F.broadcast(found)
    full = marked.join(found, F.col("host") == F.col("h"), "left").select("page_id", "url", "layout", "parts", "sure", "weak")
    return full.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
