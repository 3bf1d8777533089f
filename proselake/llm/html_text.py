"""HTML extraction by wrapper induction over pages of one host.

Pages of a host with the same body count as one. A block is a candidate for the host's template if at least ``ENOUGH``
of its pages, and a share of ``SHARE`` of them all, show it. Two of those (of least and of largest hash) are parsed to
trees and aligned by simple tree matching: nodes pair under equal names while keeping parents and order, so that the pairs share
the most blocks. Candidates that they have at paired nodes are constant, the template; everything else varies, the slots. Only
pairs of nodes that share a block below them can add to a matching, so only those are visited, deepest first, and the children of
a pair are aligned as a heaviest increasing sequence: time and memory follow the blocks, not their product. Where blocks stand at so many
places that their pairs are too many to list, nodes of one tree meet all of the other at once, a row at a time, and an alignment is
found by halves: every partner is tried, time follows the product, memory one page. A block is the
path of elements to it and its text; what is never content is no candidate, it goes in any case.
Every page then loses what stands in parts that are never content by element or by name (menus, headers, footers, sidebars,
notices, adverts, forms, comments). Where it marks an article, the rest of that is the text, whatever other pages share with it; where
it marks none, its body's slots are: the blocks that are not its host's template, each where it stands. All pages are read, for templates as for texts.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, cut, maybe_broadcast
from .url_filter import url_host

#: Fewest different pages of a host that show a block of its template, and the least share of them as a fraction.
ENOUGH, SHARE = 3, (4, 5)
#: What a shared block counts in an alignment, against one for a pair of nodes.
SHARED = 1 << 32
#: Pairs of places of all blocks of two pages up to which they are listed; beyond, nodes meet row by row, with the same result.
MOST_PLACES = 1 << 17
#: Cells of an alignment of two lists of nodes that are held at once, and rows of weights that are kept.
MOST_CELLS, KEPT = 1 << 20, 8
#: Elements of a path, and depth of a tree's nodes: what is nested deeper stands where its outermost DEEPEST elements do.
DEEPEST = 512
#: Hosts up to which a table of them is broadcast.
BROADCAST_ROWS = 1 << 16

# Elements by what they do to text.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
    tr ul""".split()
)
CLOSES_P = BLOCK - {"body", "head", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend"}
OUTSIDE = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "head", "label", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar"}
NAMES = set(
    """ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form
    gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted
    related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget""".split()
)
#: Words that may stand beside those of NAMES in a name of what is never content (``main-nav``, but not ``share-price``).
BESIDE = set(
    """area aside bar block bottom box btn button buttons container content count entry global group icon icons inner item items left link links
    list main mobile module outer page panel post posts primary region right secondary section site slot tabs top unit wrap wrapper""".split()
)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element of a page's tree: its name, whether it is content, its children and the content blocks (path, text) it holds itself."""

    __slots__ = ("blocks", "children", "name", "outside")

    def __init__(self, name: str, outside: bool):
        self.name, self.outside, self.children, self.blocks = name, outside, [], []


def _never(value: str, in_article: bool) -> bool:
    """Whether one of several names says so: all its words are of NAMES or beside them, and one at least is of NAMES."""
    for name in value.split():
        words = {w for w in _WORD.findall(name) if w != "header" or not in_article}
        if not NAMES.isdisjoint(words) and words <= NAMES | BESIDE:
            return True
    return False


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is never content; of an article's names only whole ones count (``comment``, not ``comment-open``)."""
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    for m in _NAMED.finditer(attributes) if attributes else ():
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name == "article" and not NAMES.isdisjoint(w for w in value.split() if w != "header"):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _never(value, in_article):
            return True
    return False


def parse(page: str) -> tuple[Node, list[tuple[str, str, bool, bool]]]:
    """The tree of a page, and its blocks in order: (path, text, inside an article, never content)."""
    root = Node("", False)
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]  # name, node, in article, outside
    out: list[tuple[str, str, bool, bool]] = []
    held: list[str] = []
    opened: Counter[str] = Counter()

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            _, node, inside, outside = stack[-1]
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK or not stack[i][0])
            out.append(("/".join(s[0] for s in stack[1 : min(k, DEEPEST) + 1]), text, inside, outside))
            if not outside:
                stack[k][1].blocks.append(out[-1][:2])

    def pop_to(k: int) -> None:
        flush()
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]

    at, raw = 0, None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if raw is None and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing, attributes = bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if closing:
            if not opened[name]:
                if name == "p":
                    flush()
                continue
            k = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name)
            if name in BLOCK or stack[k][3] != stack[k - 1][3]:
                pop_to(k)
            elif all(s[0] not in BLOCK for s in stack[k:]):
                opened[name] -= 1
                del stack[k]
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                held.append(" ")
            continue
        if name in BLOCK:
            flush()
            ends = {"p"} if name in CLOSES_P else set()
            ends |= {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(name, set())
            stop = {"ul", "ol", "dl", "table", "article", "main", "div", "section", "body"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    opened.subtract(s[0] for s in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in stop:
                    break
        _, parent, inside, outside = stack[-1]
        own = outside or _outside(name, attributes, inside)
        if own != outside:
            flush()
        inside = inside or name in ("article", "main")
        node = Node(name, own) if len(stack) <= DEEPEST else stack[-1][1]
        if name in BLOCK and len(stack) <= DEEPEST:
            next(s[1] for s in reversed(stack) if s[0] in BLOCK or not s[0]).children.append(node)
        opened[name] += not attributes.rstrip().endswith("/") or name in BLOCK
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append((name, node, inside, own))
    if at < len(page):
        held.append(page[at:])
    flush()
    return root, out


class _Flat:
    """A tree's nodes in order: of each its parent's number, its place among siblings, its depth and itself; and the nodes of each block."""

    def __init__(self, root: Node):
        self.nodes, self.parent, self.place, self.depth = [root], [-1], [0], [0]
        self.holders: dict[tuple[str, str], list[int]] = {}
        at = 0
        while at < len(self.nodes):
            for i, child in enumerate(self.nodes[at].children):
                self.nodes.append(child)
                self.parent.append(at)
                self.place.append(i)
                self.depth.append(self.depth[at] + 1)
            for block in set(self.nodes[at].blocks):
                self.holders.setdefault(block, []).append(at)
            at += 1


def _heaviest(pairs: list[tuple[int, int, int]]) -> list[int]:
    """Which of some (place, place, weight) form the heaviest sequence that increases in both places."""
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0], -pairs[k][1]))
    rank = {j: r + 1 for r, j in enumerate(sorted({p[1] for p in pairs}))}
    tree = [(0, -1)] * (len(rank) + 1)  # a Fenwick tree of the best (weight, pair) up to a place
    before = [-1] * len(pairs)
    for k in order:
        r, best = rank[pairs[k][1]], (0, -1)
        i = r - 1
        while i:
            best = max(best, tree[i])
            i &= i - 1
        before[k] = best[1]
        got, i = (best[0] + pairs[k][2], k), r
        while i < len(tree):
            tree[i] = max(tree[i], got)
            i += i & -i
    k, out = max(tree)[1], []
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


class _Rows:
    """The trees' nodes that hold a block of both, or stand above one, in order; a node's children, and all nodes of a depth, are neighbours."""

    def __init__(self, x: _Flat, y: _Flat):
        both = x.holders.keys() & y.holders.keys()
        self.ids, self.kids, names = [], [], []
        for flat in (x, y):
            kept = {0}
            for block in both:
                for u in flat.holders[block]:
                    while u not in kept:
                        kept.add(u)
                        u = flat.parent[u]
            ids = sorted(kept)
            first = np.searchsorted([flat.parent[u] for u in ids], [*ids, len(flat.nodes)])
            self.ids.append(ids)
            self.kids.append(np.maximum(first, 1))  # children of i: from its number to the next one's
            names.append([flat.nodes[u].name for u in ids])
        number = {name: i for i, name in enumerate(dict.fromkeys(names[0] + names[1]))}
        self.names = [np.array([number[n] for n in own]) for own in names]
        self.blocks = [[b for b in set(x.nodes[u].blocks) if b in both] for u in self.ids[0]]
        self.holders = {b: np.searchsorted(self.ids[1], y.holders[b]) for b in both}
        self.shared = min(len(own) for own in self.ids) + 1  # what a shared block counts, more than all pairs of nodes
        self.most = self.shared * (sum(map(len, self.holders.values())) + 1)  # more than any weight
        self.kept: dict[tuple, np.ndarray] = {}  # weights of the last different nodes without children

    def weights(self, u: int, low: int, high: int) -> np.ndarray:
        """The weight of u's pairing with each of some neighbours of its depth; 0: none."""
        leaf = self.kids[0][u] == self.kids[0][u + 1]
        key = (self.names[0][u], low, high, *self.blocks[u])
        if leaf and key in self.kept:
            return self.kept[key]
        out = np.zeros(high - low, np.int64)
        for block in self.blocks[u]:
            at = self.holders[block]
            out[at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low] += self.shared
        kids = self.kids[1][low : high + 1]
        if not leaf and kids[0] < kids[-1]:
            some = np.flatnonzero(kids[:-1] < kids[1:])
            row = self.row(range(self.kids[0][u], self.kids[0][u + 1]), kids[0], kids[-1], kids[some] - kids[0])
            out[some] += row[kids[some + 1] - 1 - kids[0]]
        out += out >= self.shared
        out[(out < self.shared) | (self.names[1][low:high] != self.names[0][u])] = 0
        if leaf:
            if len(self.kept) >= KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = out
        return out

    def row(self, us: range, low: int, high: int, starts: np.ndarray, back: bool = False, rows: list | None = None) -> np.ndarray:
        """The best alignment of some nodes with the neighbours up to each one, those from ``starts`` on apart; ``back``: from the last one on."""
        fits = self.most * len(starts) < 1 << 62  # else parts are told apart one by one
        base = np.arange(len(starts)) * (self.most if fits else 0)
        best = np.repeat(base, np.diff([*starts, high - low]))  # parts one above the other
        for u in reversed(us) if back else us:
            w = self.weights(u, low, high)
            w = w[::-1] if back else w
            one_more = w.copy()
            one_more[1:] += best[:-1]
            one_more[starts] = w[starts] + base
            np.maximum(best, one_more, out=one_more)
            best = np.maximum.accumulate(one_more) if fits else np.concatenate([np.maximum.accumulate(own) for own in np.split(one_more, starts[1:])])
            if rows is not None:
                rows.append(best)
        return best - np.repeat(base, np.diff([*starts, high - low])) if len(starts) > 1 else best

    def aligned(self, u: int, v: int) -> list[tuple[int, int]]:
        """The pairs of children of a pair, in order."""
        out, start = [], np.zeros(1, np.int64)
        stack = [(self.kids[0][u], self.kids[0][u + 1], self.kids[1][v], self.kids[1][v + 1])]
        while stack:
            a, b, low, high = map(int, stack.pop())
            if a == b or low == high:
                continue
            if u and b - a == high - low == 1 and not self.own(u, v):  # what the pair shares is below these two
                out.append((a, low))
            elif b - a == 1 or (b - a) * (high - low) <= MOST_CELLS:
                rows = [np.zeros(high - low, np.int64)]
                self.row(range(a, b), low, high, start, rows=rows)
                i, j, found = b - a, high - low - 1, []
                while i and j >= 0 and rows[i][j]:
                    if rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    elif j and rows[i][j] == rows[i][j - 1]:
                        j -= 1
                    else:
                        found.append((a + i - 1, low + j))
                        i, j = i - 1, j - 1
                out += found[::-1]
            else:
                half = (a + b) // 2
                one = np.concatenate(([0], self.row(range(a, half), low, high, start)))
                other = np.concatenate(([0], self.row(range(half, b), low, high, start, back=True)))[::-1]
                k = low + int(np.argmax(one + other))
                stack += [(half, b, k, high), (a, half, low, k)]
        return out

    def own(self, u: int, v: int) -> bool:
        """Whether two nodes share a block themselves."""
        return any(v in self.holders[block] for block in self.blocks[u])


def _match_rows(x: _Flat, y: _Flat) -> list[tuple[int, int]]:
    """The pairs of nodes of the best matching of two trees of one name, by rows."""
    rows = _Rows(x, y)
    if not rows.holders:
        return [(0, 0)]
    out, stack = [], [(0, 0)]
    while stack:
        u, v = stack.pop()
        out.append((rows.ids[0][u], rows.ids[1][v]))
        stack += rows.aligned(u, v)[::-1]
    return out


def tree_match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching: how many nodes of two trees pair under equal names, parents and order, in the matching whose
    pairs share the most blocks (and of these in one of the most nodes); adds the pairs. Nodes below which two trees share nothing don't pair."""
    x, y = _Flat(a), _Flat(b)
    if a.name != b.name:
        return 0
    if sum(len(one) * len(y.holders.get(block, ())) for block, one in x.holders.items()) > MOST_PLACES:
        found = _match_rows(x, y)
        if pairs is not None:
            pairs += [(x.nodes[u], y.nodes[v]) for u, v in found]
        return len(found)
    children: dict[tuple[int, int], list[tuple[int, int]]] = {}
    known: dict[tuple[int, int], bool] = {}
    for block, one in x.holders.items():
        for pair in [(u, v) for u in one for v in y.holders.get(block, ())]:
            up = []
            while pair not in known and min(pair) > 0 and x.nodes[pair[0]].name == y.nodes[pair[1]].name and x.depth[pair[0]] == y.depth[pair[1]]:
                up.append(pair)
                pair = x.parent[pair[0]], y.parent[pair[1]]
            fits = known.get(pair, pair == (0, 0))
            for own in [pair, *up[::-1]]:  # a pair fits if all pairs above it do
                if own not in known:
                    known[own] = fits
                    if fits and own != (0, 0):
                        children.setdefault((x.parent[own[0]], y.parent[own[1]]), []).append(own)
    known[0, 0] = True
    weight: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for pair in sorted((p for p, fits in known.items() if fits), key=lambda p: -x.depth[p[0]]):
        below = children.get(pair, [])
        best = [below[k] for k in _heaviest([(x.place[u], y.place[v], weight[u, v]) for u, v in below])]
        chosen[pair] = best
        u, v = x.nodes[pair[0]], y.nodes[pair[1]]
        weight[pair] = 1 + SHARED * (len(set(u.blocks).intersection(v.blocks)) if u.blocks and v.blocks else 0) + sum(weight[p] for p in best)
    if pairs is not None:
        stack = [(0, 0)]
        while stack:
            u, v = stack.pop()
            pairs.append((x.nodes[u], y.nodes[v]))
            stack += chosen[u, v][::-1]
    return weight[0, 0] % SHARED


def block_key(path: str, text: str) -> int:
    """A block, its place and its text, by 64 bits."""
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode(), digest_size=8).digest(), "big", signed=True)


def keys(page: str) -> tuple[int, list[int]]:
    """The key of a page's body, and its different blocks by key, without what is never content."""
    blocks = [(path, t) for path, t, _, outside in parse(page)[1] if not outside]
    return block_key("", "\n".join(t for _, t in blocks)), sorted({block_key(*b) for b in blocks})


def paired(one: str, other: str) -> set[int]:
    """The blocks, by key, that two pages have at nodes that their alignment pairs."""
    pairs: list[tuple[Node, Node]] = []
    tree_match(parse(one)[0], parse(other)[0], pairs)
    return {block_key(*k) for a, b in pairs if a.blocks and b.blocks for k in set(a.blocks).intersection(b.blocks)}


def induce(pages: list[str]) -> set[str]:
    """The template of all pages of one host as texts; the rule of main_text, in memory."""
    bodies: dict[int, tuple[str, list[int]]] = {}
    for page in sorted(pages, reverse=True):
        body, own = keys(page)
        bodies[body] = page, own
    shown: dict[int, list[str]] = {}
    for page, own in sorted(bodies.values()):
        for key in own:
            shown.setdefault(key, []).append(page)
    often = {k: at for k, at in shown.items() if len(at) >= ENOUGH and len(at) * SHARE[1] >= len(bodies) * SHARE[0]}
    found = {k for k, at in often.items() if k in paired(at[0], at[-1])}
    return {t for page, _ in bodies.values() for path, t, _, _ in parse(page)[1] if block_key(path, t) in found}


def extract(page: str | None, template: set[int] | frozenset = frozenset()) -> str:
    """The main text of a page: all blocks of its article that are not outside; of its body, if it marks none, those that are no template either.

    An article or main whose blocks are all outside marks none; a block is template by its place and text.
    """
    if not page:
        return ""
    blocks = [b[:3] for b in parse(page)[1] if not b[3]]
    inside = any(own for _, _, own in blocks)
    return "\n".join(t for path, t, own in blocks if (own if inside else not (template and block_key(path, t) in template)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [keys(h.as_py()) for h in batch.column(2)]
        body, own = pa.array([k for k, _ in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body, own], names=["__host", "__own", "__body", "__keys"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column(1), batch.column(2), batch.column(3), strict=True)
        kept = [sorted(paired(a.as_py(), b.as_py()).intersection(k.as_py())) for k, a, b in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64()))], names=["__host", "__kept"])


def _templates(held: DataFrame) -> DataFrame:
    """``__host, __template`` of hosts that have one; every page of a host counts."""
    full = held.where(F.length("__html") > 0).select("__host", F.xxhash64("__html").alias("__own"), "__html")
    read = full.mapInArrow(_read, "__host string, __own long, __body long, __keys array<long>")
    bodies = read.groupBy("__host", "__body").agg(F.min(F.struct("__own", "__keys")).alias("p"))
    bodies = cut(bodies.select("__host", "p.__own", "p.__keys"))
    hosts = maybe_broadcast(cut(bodies.groupBy("__host").agg(F.count("*").alias("pages")).where(F.col("pages") >= ENOUGH)), BROADCAST_ROWS)
    shown = bodies.select("__host", "__own", F.explode("__keys").alias("key")).groupBy("__host", "key")
    shown = shown.agg(F.count("*").alias("n"), F.min("__own").alias("lo"), F.max("__own").alias("hi")).where(F.col("n") >= ENOUGH)
    often = shown.join(hosts, "__host").where(F.col("n") * SHARE[1] >= F.col("pages") * SHARE[0])
    often = cut(often.groupBy("__host", "lo", "hi").agg(F.collect_list("key").alias("keys")))
    wanted = cut(often.select("__host", F.explode(F.array("lo", "hi")).alias("__own")).distinct())
    chosen = cut(full.join(maybe_broadcast(wanted, BROADCAST_ROWS), ["__host", "__own"], "left_semi").dropDuplicates(["__host", "__own"]))
    side = lambda at, name: chosen.select("__host", F.col("__own").alias(at), F.col("__html").alias(name))
    both = often.join(side("lo", "one"), ["__host", "lo"]).join(side("hi", "other"), ["__host", "hi"])
    kept = both.select("__host", "keys", "one", "other").mapInArrow(_confirm, "__host string, __kept array<long>")
    return kept.groupBy("__host").agg(F.flatten(F.collect_list("__kept")).alias("__template")).where(F.size("__template") > 0)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null and empty pages have an empty text; a url without host belongs to the host of no name. Hosts with fewer than
    ``ENOUGH`` different pages have no template; a page that marks an article loses nothing of it to one. References are decoded, white space inside a block is one space,
    blocks are joined by a line feed. Long and deep pages are read whole. Repeated rows give repeated rows; null ids are carried; other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    held = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("__html"))
    held = held.withColumn("__host", url_host(F.col("url")))
    templates = cut(_templates(held))
    size = templates.agg(F.sum(F.size("__template") * 8 + F.length("__host") + 64)).first()[0] or 0
    joined = held.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "__host", "left").select("page_id", "url", "__html", "__template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2), batch.column(3), strict=True)
            texts = [extract(h.as_py(), frozenset(t.as_py() or ())) for h, t in rows]
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), size], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
