"""HTML extraction by wrapper induction: pages of a host aligned by simple tree matching.

1. Pages of a host with about the same class attributes share a layout, whose
   exemplar is its page of the least id.  Pages of a layout with the same texts
   in the same order are copies and count once.  Every different page is parsed
   and its tree is aligned with the exemplar's by simple tree matching; partial
   sums count, per exemplar node, the pages that have its very text there.
2. A node that most pages share with equal text is template; nodes whose text
   varies are slots.
3. A second pass aligns each page again, drops the template and what is
   boilerplate by its element or class (menus, adverts, forms ...), and joins
   the remaining blocks.

Only keys of pages are grouped, written and joined back (narrow tables, as are
exemplars and templates, one small row per layout): Spark broadcasts those
below its size threshold and joins them by a skew-aware sort-merge join beyond it.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import remove, written

TEMPLATE_SHARE = 0.5  # of a host's different pages with equal text at a node
TEMPLATE_PAGES = 3  # at the least
MATCH_CELLS = 1 << 20  # of the dynamic programme's table held at once
HELD_SHAPES = 1 << 20  # shapes and their children a task keeps before it starts anew

# fixed values: element names and class words
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input"
    " iframe svg canvas object embed audio video map dialog menu xmp noembed noframes".split()
)
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html"
    " li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select article section div body html main aside nav footer header td th".split())
FORMATTING = frozenset("a b i u em strong small big font span s code tt".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|topbar|cookies?"
    r"|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus"
    r"|replies|pagination|pager|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())

PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element or, with tag "#", a run of text."""

    __slots__ = ("tag", "label", "kids", "text", "dropped", "size", "id", "shape", "content", "key")

    def __init__(self, tag: str, label: str = "", text: str = "", dropped: bool = False):
        self.tag, self.label, self.text, self.dropped = tag, label or tag, text, dropped
        self.kids: list[Node] = []
        self.size, self.id, self.shape, self.content = 1, -1, -1, 0
        self.key: str | None = None


def _traits(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's label (name and class or id) and whether it is boilerplate by its name, class or role."""
    label, dropped = tag, tag in DROPPED
    if attributes and "=" in attributes:
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = f"{a.get('class', '')} {a.get('id', '')}".strip()
        if names:
            label = f"{tag}.{a.get('class', '') or a.get('id', '')}"
            dropped |= tag not in ("html", "body", "article", "main") and bool(BOILERPLATE.search(names))
        dropped |= a.get("role", "").lower() in ROLES or a.get("aria-hidden") == "true" or "hidden" in a
    elif attributes and "hidden" in attributes.split():
        dropped = True
    return label, dropped


_short_traits = lru_cache(maxsize=4096)(_traits)


def _element(tag: str, attributes: str) -> Node:
    label, dropped = (_short_traits if len(attributes) <= 200 else _traits)(tag, attributes)
    return Node(tag, label, dropped=dropped)


def parse(text: str) -> Node:
    """A tree of the markup: implied ends of p, li, table parts; unclosed elements end with their parent."""
    root = Node("#root")
    stack, pos, n = [root], 0, len(text)
    while pos < n:
        m = PIECE.search(text, pos)
        start = m.start() if m else n
        if start > pos:
            run = text[pos:start]
            if run.strip() or stack[-1].kids:
                stack[-1].kids.append(Node("#", text=html_lib.unescape(run)))
        if not m:
            break
        pos = m.end()
        name = m.group(2)
        if not name:
            if m.group().startswith("<![CDATA["):
                stack[-1].kids.append(Node("#", text=m.group()[9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m.group(1):
            _close(stack, tag)
            continue
        if tag in CLOSES_P:
            _imply(stack, {"p"})
        if tag in SAME_LEVEL:
            _imply(stack, SAME_LEVEL[tag])
        node = _element(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, pos)
            stop = end.start() if end else n
            if tag in ("title", "textarea"):
                node.kids.append(Node("#", text=html_lib.unescape(text[pos:stop])))
            pos = stop
        elif tag not in VOID and not m.group(3).rstrip().endswith("/") or tag in FORMATTING:
            if tag not in VOID:
                stack.append(node)
    return root


def _imply(stack: list[Node], tags: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in SCOPE:
            return


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag in FORMATTING and stack[i].tag in BLOCK:
            return  # a stray end of inline markup ends no block


def number(node: Node, at: int = 0) -> int:
    """Preorder ids and subtree sizes; returns the next free id."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        x.id = at
        at += 1
        order.append(x)
        stack.extend(reversed(x.kids))
    for x in reversed(order):
        x.size = 1 + sum(k.size for k in x.kids)
    return at


def skeleton(node: Node) -> list:
    """The tree as nested lists [label, text hash of the node's own text, kids], without content."""
    out: list = []
    stack = [(node, out)]
    while stack:
        x, into = stack.pop()
        into += [x.label, own_text(x), []]
        for k in x.kids:
            kid: list = []
            into[2].append(kid)
            stack.append((k, kid))
    return out


def from_skeleton(s: list) -> Node:
    root = Node("", s[0])
    stack = [(root, s)]
    while stack:
        x, (_, text, kids) = stack.pop()
        x.text = text
        for k in kids:
            kid = Node("", k[0])
            x.kids.append(kid)
            stack.append((kid, k))
    number(root)
    return root


def own_text(x: Node) -> str:
    """A short key of a text run (empty for elements; an exemplar's nodes hold it as their text)."""
    if x.key is None:
        if x.tag != "#":
            x.key = "" if x.tag else x.text
        else:
            t = " ".join(x.text.split())
            x.key = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if t else ""
    return x.key


class Shapes:
    """Interned tree shapes and the sizes of their largest matches.

    Equal subtrees (labels and order, not texts) are one shape, so a match is
    computed once for two shapes, however many nodes have them.
    """

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.traces: dict[tuple[int, int, int, int], list[tuple[int, int]]] = {}
        self.held = 0

    def add(self, root: Node) -> None:
        """Give every node its shape and a key of its subtree's shape and texts."""
        order, stack = [], [root]
        while stack:
            x = stack.pop()
            order.append(x)
            stack.extend(x.kids)
        for x in reversed(order):
            kids = tuple([k.shape for k in x.kids])
            i = self.ids.get((x.label, kids))
            if i is None:
                i = self.ids[x.label, kids] = len(self.label)
                self.label.append(x.label)
                self.kids.append(kids)
                self.size.append(1 + sum(self.size[k] for k in kids))
                self.held += 1 + len(kids)
            x.shape = i
            x.content = hash((i, own_text(x), *[k.content for k in x.kids]))

    def score(self, s: int, t: int) -> int:
        """The size of a largest match of two shapes whose roots are matched; 0 where the labels differ."""
        if s == t:
            return self.size[s]
        if self.label[s] != self.label[t]:
            return 0
        stack = [(s, t)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.scores:
                stack.pop()
                continue
            lo, i, j = _ends(self.kids[x], self.kids[y])
            p, q = self.kids[x][lo:i], self.kids[y][lo:j]
            todo = [(u, v) for u in set(p) for v in set(q) if u != v and self.label[u] == self.label[v] and (u, v) not in self.scores] if p and q else []
            if todo:
                stack.extend(todo)
                continue
            n = 1 + sum(self.size[k] for k in self.kids[x][:lo]) + sum(self.size[k] for k in self.kids[x][i:])
            if len(p) == 1 == len(q):
                n += self._known(p[0], q[0])
            elif p and q:
                n += int(_sweep(*self.weights(p, q))[-1])
            self.scores[x, y] = n
            stack.pop()
        return self.scores[s, t]

    def _known(self, u: int, v: int) -> int:
        return self.size[u] if u == v else self.scores[u, v] if self.label[u] == self.label[v] else 0

    def weights(self, p: Sequence[int], q: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both lists as indexes of their different shapes, and the scores between those."""
        u, v = list(dict.fromkeys(p)), list(dict.fromkeys(q))
        at_u, at_v = {x: i for i, x in enumerate(u)}, {x: i for i, x in enumerate(v)}
        w = np.array([[self._known(x, y) for y in v] for x in u], dtype=np.int64)
        return np.array([at_u[x] for x in p]), np.array([at_v[x] for x in q]), w

    def trace(self, s: int, t: int, first: int, last: int) -> list[tuple[int, int]]:
        """The places of children that a largest match pairs, between `first` and `last` of them paired already."""
        key = (s, t, first, last)
        out = self.traces.get(key)
        if out is None:
            p, q = self.kids[s], self.kids[t]
            top, bottom = len(p) - last, len(q) - last
            lo, i, j = _ends(p, q, first, top, bottom)
            out = [(k, k) for k in range(first, lo)] + list(zip(range(i, top), range(j, bottom), strict=True))
            p, q = p[lo:i], q[lo:j]
            if p and q:
                for u in set(p):
                    for v in set(q):
                        self.score(u, v)
                out += [(lo + u, lo + v) for u, v in _matched(*self.weights(p, q))]
            self.traces[key] = out
            self.held += 1 + len(out)
        return out


def _ends(p: Sequence[int], q: Sequence[int], lo: int = 0, i: int | None = None, j: int | None = None) -> tuple[int, int, int]:
    """Equal first and last items: p[:lo] = q[:lo], p[i:] = q[j:].

    A subtree that equals its counterpart scores its whole size, the most that either can
    have, so some largest match pairs the two.
    """
    i, j = len(p) if i is None else i, len(q) if j is None else j
    while lo < i and lo < j and p[lo] == q[lo]:
        lo += 1
    while i > lo and j > lo and p[i - 1] == q[j - 1]:
        i, j = i - 1, j - 1
    return lo, i, j


def _sweep(p: np.ndarray, q: np.ndarray, w: np.ndarray, rows: list[np.ndarray] | None = None) -> np.ndarray:
    """The best order-keeping matches of all of p with each beginning of q, row by row of the dynamic programme."""
    f = np.zeros(len(q) + 1, dtype=np.int64)
    for i in p:
        g = f.copy()
        np.maximum(f[1:], f[:-1] + w[i][q], out=g[1:])
        f = np.maximum.accumulate(g)
        if rows is not None:
            rows.append(f)
    return f


def _matched(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> list[tuple[int, int]]:
    """The places that a best match of two lists pairs; long lists are halved, so memory stays bounded."""
    m, n = len(p), len(q)
    if not m or not n:
        return []
    if m > 1 and m * n > MATCH_CELLS:
        half = m // 2
        k = int(np.argmax(_sweep(p[:half], q, w) + _sweep(p[half:][::-1], q[::-1], w)[::-1]))
        return _matched(p[:half], q[:k], w) + [(half + i, k + j) for i, j in _matched(p[half:], q[k:], w)]
    rows = [np.zeros(n + 1, dtype=np.int64)]
    _sweep(p, q, w, rows)
    out, i, j = [], m, n
    while i and j:
        here = rows[i][j]
        if here == rows[i - 1][j]:
            i -= 1
        elif here == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of a largest top-down, order-keeping match of two trees.

    Scores come from the children upwards; the pairs are then read off from the root down.
    Of equally large matches one that pairs equal texts at the ends of child lists is taken.
    """
    if shapes is None:
        shapes = Shapes()
        shapes.add(a), shapes.add(b)
    pairs, stack = [], [(a, b)] if a.label == b.label else []
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        p, q = x.kids, y.kids
        if x.shape == y.shape:
            stack.extend(zip(p, q, strict=True))
            continue
        lo, i, j = 0, len(p), len(q)
        if not i or not j:
            continue
        while lo < i and lo < j and p[lo].content == q[lo].content:
            lo += 1
        while i > lo and j > lo and p[i - 1].content == q[j - 1].content:
            i, j = i - 1, j - 1
        stack.extend(zip(p[:lo], q[:lo], strict=True))
        stack.extend(zip(p[i:], q[j:], strict=True))
        if lo < i and lo < j:
            stack.extend((p[u], q[v]) for u, v in shapes.trace(x.shape, y.shape, lo, len(p) - i))
    return pairs


def main_text(root: Node, template: set[int]) -> str:
    """Blocks in page order joined by two newlines.

    The root is the page's articles (or its main element) where it has any,
    else the whole page.  `template` holds the ids of nodes to leave out.
    """
    tops = [x for t in ("article", "main") for x in _topmost(root, t)]
    tops = sorted({id(x): x for x in tops}.values(), key=lambda x: x.id) if tops else [root]
    kept, inside = [], -1
    for x in tops:
        if x.id >= inside:
            kept.append(x)
            inside = x.id + x.size
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = " ".join("".join(run).split())
        if t:
            blocks.append(t)
        run.clear()

    stack: list = list(reversed(kept))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
            continue
        if x.dropped or x.id in template:
            continue
        if x.tag == "#":
            run.append(x.text)
            continue
        if x.tag == "br":
            run.append(" ")
            continue
        if x.tag in BLOCK or x.tag == "#root":
            flush()
            stack.append(None)
        stack.extend(reversed(x.kids))
    flush()
    return "\n\n".join(blocks)


def _topmost(root: Node, tag: str) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.dropped:
            continue
        if x.tag == tag:
            out.append(x)
        else:
            stack.extend(reversed(x.kids))
    return out


# --- the Spark side ---------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def layout_of(html: Column) -> Column:
    """A key of the page's layout: the two least hashes of its class attributes (0 without any).

    Two pages share it with about the squared Jaccard similarity of their classes, so pages
    that differ by an optional part mostly share one, pages of another kind mostly do not.
    """
    classes = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)\sclass\s*=\s*["']?([^"'>]*)"""), 1))
    least = F.slice(F.array_sort(F.transform(classes, lambda c: F.xxhash64(c))), 1, 2)
    return F.when(F.size(least) > 0, F.xxhash64(least)).otherwise(F.lit(0).cast("long"))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(skeleton(parse(t or "")), separators=(",", ":")) for t in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(trees, pa.string())], names=["host", "layout", "tree"])


class _Exemplars:
    """Exemplar trees of the layouts that a task has just met, and the shapes it has seen."""

    def __init__(self, most: int = 256):
        self.most, self.trees, self.shapes = most, {}, Shapes()

    def align(self, layout: tuple[str, int], tree: str, page: Node) -> list[tuple[Node, Node]]:
        if len(self.trees) >= self.most or self.shapes.held + len(self.shapes.scores) > HELD_SHAPES:
            self.trees.clear()
            self.shapes = Shapes()
        x = self.trees.get(layout)
        if x is None:
            x = self.trees[layout] = from_skeleton(json.loads(tree))
            self.shapes.add(x)
        self.shapes.add(page)
        return align(x, page, self.shapes)


def text_key(root: Node) -> bytes:
    """A key of the page's texts in order, which copies of a page share."""
    key, stack = hashlib.blake2b(digest_size=16), [root]
    while stack:
        x = stack.pop()
        if x.tag == "#" and (t := own_text(x)):
            key.update(t.encode())
        stack.extend(reversed(x.kids))
    return key.digest()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [text_key(parse(t or "")) for t in batch.column("html").to_pylist()]
        names = ["host", "layout", "page_id", "raw"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(keys, pa.binary())], names=[*names, "key"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, layout, times, node, n_equal: sums over each batch of pages."""
    exemplars = _Exemplars()
    for batch in batches:
        sums: dict[tuple[str, int, int, int], int] = {}
        names = ("host", "layout", "times", "tree", "html")
        for host, layout, times, tree, page in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            for x, y in exemplars.align((host, layout), tree, parse(page or "")):
                if y.tag == "#" and x.text and x.text == own_text(y):
                    sums[host, layout, times, x.id] = sums.get((host, layout, times, x.id), 0) + 1
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
        cols = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(sums.values()), pa.int64())], names=["host", "layout", "times", "node", "n_equal"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    exemplars = _Exemplars()
    names = ("host", "layout", "tree", "nodes", "html")
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, texts = batch.slice(lo, 256), []
            for host, layout, tree, nodes, page in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                root = parse(page or "")
                number(root)
                template: set[int] = set()
                if nodes:
                    fixed = set(nodes)
                    template = {y.id for x, y in exemplars.align((host, layout), tree, root) if x.id in fixed and x.text == own_text(y)}
                texts.append(main_text(root, template))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def layout_templates(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """host, layout, tree (the exemplar's skeleton as JSON), nodes (ids of its template text)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    row = ["host", "layout", "page_id", "raw"]  # tells the rows of a repeated id apart
    pages = pages.withColumn("raw", F.xxhash64("html"))
    keyed = pages.select(*row, "html").mapInArrow(_keyed, f"host string, layout long, page_id {kind}, raw long, key binary")
    rows = keyed.groupBy(*row, "key").agg(F.count("*").alias("times"))
    one = rows.groupBy("host", "layout", "key").agg(F.min(F.struct("page_id", "raw", "times")).alias("page"))
    different = written(one.select("host", "layout", "page.*"), "different-pages")
    first = different.groupBy("host", "layout").agg(F.min(F.struct("page_id", "raw")).alias("page"))
    first = written(first.select("host", "layout", "page.*"), "first-pages")
    exemplars = pages.join(first, row, "left_semi").select("host", "layout", "html")
    trees = exemplars.mapInArrow(_skeletons, "host string, layout long, tree string").dropDuplicates(["host", "layout"])
    trees = written(trees, "exemplars")
    joined = pages.join(different.hint("merge"), row).join(trees, ["host", "layout"])  # one plan at every size
    counted = joined.select("host", "layout", "times", "tree", "html").mapInArrow(_count, "host string, layout long, times long, node int, n_equal long")
    # equal rows of the page that stands for its copies each count, so sums are divided by their number
    sums = counted.groupBy("host", "layout", "times", "node").agg((F.sum("n_equal") / F.col("times")).cast("long").alias("n_equal"))
    sums = written(sums.groupBy("host", "layout", "node").agg(F.sum("n_equal").alias("n_equal")), "node-counts")
    totals = different.groupBy("host", "layout").agg(F.count("*").alias("n_pages"))
    fixed = sums.join(totals, ["host", "layout"]).filter((F.col("n_equal") >= least) & (F.col("n_equal") >= share * F.col("n_pages")))
    nodes = fixed.groupBy("host", "layout").agg(F.collect_list("node").alias("nodes"))
    out = written(trees.join(nodes, ["host", "layout"]), "templates")
    for table in (different, first, trees, sums):
        remove(pages.sparkSession, table)
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page row.

    A null or empty page has the empty text.  A null url, or one without a
    host, belongs to the host "".  Equal rows each give a row; further
    columns are ignored.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    p = p.select("*", host_of(F.col("url")).alias("host"), layout_of(F.col("html")).alias("layout"))
    templates = layout_templates(p.filter("page_id is not null"))
    kind = p.schema["page_id"].dataType.simpleString()
    joined = p.join(templates, ["host", "layout"], "left").select("page_id", "url", "host", "layout", "tree", "nodes", "html")
    out = joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
