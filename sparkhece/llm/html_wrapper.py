"""HTML extraction by wrapper induction.

Each page is parsed into a tree of block elements whose leaves are runs of inline text. Every
page of a host is aligned with a reference page of that host by simple tree matching: the
largest order-preserving mapping of nodes with equal labels that maps parents to parents, and
among mappings of equal shape one with more equal texts. A leaf slot of the reference whose
text is the same on most aligned pages is template; slots that vary, and leaves that align
with none, are content. Pages of a host with the same set of tags have a reference of their
own where there are ``LEAST_PAGES`` of them (the one of least html hash); the others are
aligned with that of the host's most frequent set.

Marked-up roles narrow down what slots decide on: leaves below navigation, footers, asides,
forms, adverts, notices, comments and the like are never content, and where a page marks its
article (``article``, ``main``) only the leaves in it may be. Roles alone decide the pages of
hosts with too few pages. Inside a marked article a slot is template only if it is the same
on ``MAIN_SHARE`` of at least ``MAIN_PAGES`` pages, and a page that shares half of its article
with the reference is a near copy, which says nothing about what is template.

Matching (``align``): texts that only one of the two pages has are interchangeable, so nodes
fall into few classes, and scores are kept by pair of classes. Equal classes at both ends of
two lists of children are matched at once, which loses nothing: no other mapping gives them
more. The rest is a dynamic programme, by rows in numpy where the lists are long, whose rows
are kept only in part and computed again for the way back. Nothing recurses. The work is at
most the product of the numbers of nodes, and exact at every size.

Scale: one reference page per host and set of tags is joined to the host's pages, by broadcast
within a byte limit, else shuffled by host and set (AQE may split a host with very many
pages); slot counts are sums with partial aggregation; nothing is gathered per host but the
slots of one reference page.

Defined results: null or empty html gives the empty text; null url is a host of its own;
``br`` ends a block; copies of the reference do not count as agreement, so a host of copies
has no template; repeated rows are copies. Tags are read in linear time: quotes protect ``>``
after ``=``; from the first tag on that then never ends they do not. An unclosed comment, or
a tag without any ``>``, takes the rest of the page. Pages may be nested to any depth and of
any length. Extra columns may have any name, but for the one named ``out``, which is replaced.
An empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhece.llm.common import discard, materialize, plain, restored, sized

SAME_SHARE, LEAST_PAGES, MAIN_SHARE, MAIN_PAGES = 0.8, 3, 0.9, 8
SMALL, KEPT_CELLS = 400, 1 << 22  # pairs of children up to which plain lists are used, and a whole table is kept
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style template noscript iframe object svg math canvas audio video textarea title noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("head nav footer aside form button select menu dialog search optgroup option legend fieldset".split())
_KEEPS_P = frozenset("br button td th li dd option".split())
_ROLES = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|menu|menubar|dialog|alert|alertdialog)\b")
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notices?|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|masthead|site-?header|comments?|replies|disqus|share|sharing|social|related|popup|modal|overlay|newsletter|subscribe|widget|skip|pagination|pager|login|search)(?:$|[\s_-])"
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|))*+)>""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_CLOSE = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in _RAW}


class Node:
    """A block element, or a leaf (``tag`` is ``#text``) with its text."""

    __slots__ = ("tag", "kids", "text", "chrome", "main", "slot", "kind")

    def __init__(self, tag: str, chrome: bool = False, main: bool = False):
        self.tag, self.kids, self.text = tag, [], ""
        self.chrome, self.main, self.slot, self.kind = chrome, main, -1, -1


def _is_chrome(tag: str, attrs: str, main: bool) -> bool:
    if tag in _CHROME or (tag == "header" and not main):
        return True
    if not attrs.strip():
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and _ROLES.search(value):
            return True
        if name in ("class", "id") and tag not in ("body", "html") and _NAMED.search(value):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text", chunk, "")``, ``("open", tag, attributes)`` and ``("close", tag, "")``, in linear time; raw elements are left out."""
    at, plain = 0, False
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        c = page[lt + 1 : lt + 2]
        closing = c == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name and c not in ("!", "?"):
            yield "text", page[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        end = page.find(">", lt)
        if end < 0:
            return
        if not name:
            at = end + 1
            continue
        tag, attrs, at = name[0].lower(), "", end + 1
        if closing:
            yield "close", tag, ""
            continue
        if not plain:
            rest = _REST.match(page, name.end())
            if rest:
                attrs, at = rest[1], rest.end()
            else:
                plain = True
        attrs = attrs or page[name.end() : at - 1]
        if tag in _RAW:
            if not attrs.endswith("/"):
                close = _CLOSE[tag].search(page, at)
                at = close.end() if close else len(page)
            continue
        yield "open", tag, attrs
    if at < len(page):
        yield "text", page[at:], ""


def parse(page: str | None) -> Node:
    """The block tree of a page; broken markup is closed where it must be."""
    root = Node("#root")
    stack, inline, run = [root], [], []
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            top = stack[-1]
            leaf = Node("#text", top.chrome, top.main)
            leaf.text = text
            top.kids.append(leaf)

    for what, tag, attrs in tokens(page or ""):
        if what == "text":
            if not inline:
                run.append(entities.unescape(tag) if "&" in tag else tag)
        elif what == "close":
            if tag in _BLOCK:
                if open_tags[tag]:
                    flush()
                    while True:
                        gone = stack.pop().tag
                        open_tags[gone] -= 1
                        if gone == tag:
                            break
                    while inline and inline[-1][1] > len(stack):
                        inline.pop()
            elif inline and inline[-1][0] == tag:
                inline.pop()
        elif tag in _BLOCK:
            flush()
            if stack[-1].tag == "p" and tag not in _KEEPS_P:
                open_tags[stack.pop().tag] -= 1
            if tag in _VOID:
                continue
            top = stack[-1]
            main = top.main or tag in ("article", "main") or 'role="main"' in attrs
            node = Node(tag, top.chrome or bool(inline) or _is_chrome(tag, attrs, main), main)
            top.kids.append(node)
            stack.append(node)
            open_tags[tag] += 1
        elif tag not in _VOID and attrs and not attrs.endswith("/") and _is_chrome(tag, attrs, True):
            inline.append((tag, len(stack)))  # an inline advert or the like: what it holds is left out
    flush()
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def number(root: Node) -> Node:
    """Give the leaves of a reference page their slot numbers, in page order."""
    for slot, leaf in enumerate(leaves(root)):
        leaf.slot = slot
    return root


def leaves(root: Node) -> list[Node]:
    return [x for x in nodes(root) if x.tag == "#text"]


class _Matching:
    """Scores of simple tree matching between two trees, by pair of node classes.

    A leaf counts 1, and 2 with equal text; an element counts 1. Classes are numbered for
    both trees together; ``most[c]`` is what a node of class ``c`` can get at best.
    """

    def __init__(self, a: Node, b: Node):
        one, two = nodes(a), nodes(b)
        shared = {x.text for x in one if x.tag == "#text"} & {x.text for x in two if x.tag == "#text"}
        self.names: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.tag: list[str] = []
        self.most: list[int] = []
        self.shape: list[int] = []  # the class of the same tree without its shared texts
        self.score: dict[tuple[int, int], int] = {}
        self.texts: dict[int, frozenset[int]] = {}
        for tree in reversed(one), reversed(two):
            for x in tree:  # kids come before their parents
                x.kind = self.named(x.tag, tuple(k.kind for k in x.kids), x.text if x.text in shared else "")

    def named(self, tag: str, kids: tuple[int, ...], text: str) -> int:
        kind = self.names.get((tag, kids, text))
        if kind is None:
            plain = tuple(self.shape[k] for k in kids)
            like = None if plain == kids and not text else self.named(tag, plain, "")
            kind = self.names[tag, kids, text] = len(self.kids)
            self.kids.append(kids)
            self.tag.append(tag)
            self.most.append((2 if text else 1) + sum(self.most[k] for k in kids))
            self.shape.append(kind if like is None else like)
        return kind

    def shared(self, kind: int) -> frozenset[int]:
        """The classes of the shared texts below a class."""
        if kind not in self.texts:
            found, todo, seen = set(), [kind], set()
            while todo:
                x = todo.pop()
                if x not in seen and self.shape[x] != x:
                    seen.add(x)
                    if self.kids[x]:
                        todo.extend(self.kids[x])
                    else:
                        found.add(x)
            self.texts[kind] = frozenset(found)
        return self.texts[kind]

    def ends(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int]:
        """How many children of equal class stand at the start and at the end of both lists."""
        n, head, tail = min(len(a), len(b)), 0, 0
        while head < n and a[head] == b[head]:
            head += 1
        while tail < n - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return head, tail

    def known(self, x: int, y: int) -> int | None:
        """The score of two classes, if it needs no more work."""
        if x == y:
            return self.most[x]
        if self.tag[x] != self.tag[y]:
            return 0
        if not self.kids[x] or not self.kids[y]:
            return 1
        return self.score.get((x, y))

    def solve(self, x: int, y: int) -> int:
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if self.known(x, y) is not None:
                todo.pop()
                continue
            a, b = self.kids[x], self.kids[y]
            head, tail = self.ends(a, b)
            sure = sum(self.most[k] for k in a[:head]) + sum(self.most[k] for k in a[len(a) - tail :])
            a, b = a[head : len(a) - tail], b[head : len(b) - tail]
            missing = [p for p in self.asked(a, b) if self.known(*p) is None]
            if missing:
                todo += missing
                continue
            self.score[x, y] = 1 + sure + (self.best(a, b)[-1][-1] if a and b else 0)
            todo.pop()
        return self.known(x, y) or 0

    def asked(self, a: tuple[int, ...], b: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        """The pairs of classes whose scores the lists need: classes that share no text score as their shapes do."""
        if len(a) * len(b) <= SMALL:
            yield from ((x, y) for x in set(a) for y in set(b))
            return
        yield from ((x, y) for x in {self.shape[x] for x in a} for y in {self.shape[y] for y in b})
        near = self.by_text(set(b))
        for x in set(a):
            yield from ((x, y) for y in set().union(*(near.get(t, ()) for t in self.shared(x))))

    def by_text(self, kinds: set[int]) -> dict[int, list[int]]:
        near: dict[int, list[int]] = {}
        for y in kinds:
            for t in self.shared(y):
                near.setdefault(t, []).append(y)
        return near

    def weight(self, x: int, y: int) -> int:
        w = self.known(x, y)
        return self.known(self.shape[x], self.shape[y]) if w is None else w

    def rows(self, a: tuple[int, ...], b: tuple[int, ...], first: np.ndarray) -> Iterator[np.ndarray]:
        """The rows of the table for ``a`` below the row ``first``."""
        places: dict[int, list[int]] = {}
        for j, y in enumerate(b):
            places.setdefault(y, []).append(j)
        shapes, at = np.unique(np.array([self.shape[y] for y in b]), return_inverse=True)
        shapes, near = shapes.tolist(), self.by_text(set(b))
        weights: dict[int, np.ndarray] = {}
        row = first
        for x in a:
            w = weights.get(x)
            if w is None:
                w = np.array([self.known(self.shape[x], y) for y in shapes], dtype=np.int32)[at]
                for y in set().union(*(near.get(t, ()) for t in self.shared(x))):
                    w[places[y]] = self.known(x, y)
                if len(weights) >= 64:
                    weights.clear()
                weights[x] = w
            new = row.copy()
            np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0), out=new[1:])
            row = np.maximum.accumulate(new)
            yield row

    def best(self, a: tuple[int, ...], b: tuple[int, ...]) -> list:
        """Row by row the scores of the first i children with the first j; only the last row of a large table."""
        if len(a) * len(b) <= SMALL:
            table = [[0] * (len(b) + 1)]
            for x in a:
                above, row = table[-1], [0]
                for j, y in enumerate(b, 1):
                    w = self.known(x, y)
                    row.append(max(above[j], row[-1], above[j - 1] + w if w else 0))
                table.append(row)
            return table
        first = np.zeros(len(b) + 1, dtype=np.int32)
        if len(a) * len(b) <= KEPT_CELLS:
            return [first, *self.rows(a, b, first)]
        for first in self.rows(a, b, first):  # noqa: B007
            pass
        return [first]

    def pairs(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        """Which children are matched, by position."""
        head, tail = self.ends(a, b)
        out = [(i, i) for i in range(head)] + [(len(a) - i, len(b) - i) for i in range(1, tail + 1)]
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if not a or not b:
            return out
        whole = len(a) * len(b) <= max(SMALL, KEPT_CELLS)
        step = len(a) if whole else int(len(a) ** 0.5)
        if not whole:  # keep every step-th row, and compute those between again
            first = np.zeros(len(b) + 1, dtype=np.int32)
            kept = [first] + [row for i, row in enumerate(self.rows(a, b, first), 1) if i % step == 0]
        i, j = len(a), len(b)
        while i and j:
            low = (i - 1) // step * step
            table = self.best(a, b) if whole else [kept[low // step], *self.rows(a[low:i], b, kept[low // step])]
            while i > low and j:
                row, above = table[i - low], table[i - low - 1]
                w = self.weight(a[i - 1], b[j - 1])
                if w and row[j] == above[j - 1] + w:
                    i, j = i - 1, j - 1
                    out.append((head + i, head + j))
                elif above[j] >= row[j - 1]:
                    i -= 1
                else:
                    j -= 1
        return out


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """The score of simple tree matching of two trees, and the pairs of leaves that it maps."""
    m = _Matching(a, b)
    score = m.solve(a.kind, b.kind)
    out, todo = [], [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        if x.tag == "#text":
            out.append((x, y))
        elif x.kind == y.kind:
            todo.extend(zip(x.kids, y.kids, strict=True))
        elif x.kids and y.kids:
            m.solve(x.kind, y.kind)  # a pair without shared texts was scored by its shapes
            todo.extend((x.kids[i], y.kids[j]) for i, j in m.pairs(m.kids[x.kind], m.kids[y.kind]))
    return score, out


@lru_cache(maxsize=64)
def _reference(page: str | None) -> Node:
    return number(parse(page))


def blocks(page: str | None, reference: str | None) -> list[tuple[int, bool | None, bool, str]]:
    """Content candidates of a page: (slot, same text as the reference, in a marked article, text).

    Copies of the reference, and articles that share half of their text with it, have slots,
    but say nothing about what stays the same (None).
    """
    root = parse(page)
    own = [x for x in leaves(root) if not x.chrome]
    inside = any(x.main for x in own)
    if inside:
        own = [x for x in own if x.main]
    found: dict[int, Node] = {}
    if reference is not None and own:
        found = {id(x): y for x, y in align(root, _reference(reference))[1]}
    same = [found[id(x)].text == x.text if id(x) in found else None for x in own]
    copy = page == reference or (inside and 2 * sum(len(x.text) for x, s in zip(own, same, strict=True) if s) >= sum(len(x.text) for x in own))
    return [(found[id(x)].slot if id(x) in found else -1, None if copy else s, x.main, x.text) for x, s in zip(own, same, strict=True)]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for pages, references in batches:
        yield pd.Series([[{"slot": s, "same": e, "main": m, "text": t} for s, e, m, t in blocks(p, r)] for p, r in zip(pages, references, strict=True)])


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "main_text") -> DataFrame:
    """Add the main text of every page."""
    named, names = plain(pages)
    address, body = F.col(names[url]), F.coalesce(F.col(names[page]), F.lit(""))
    host = F.lower(F.coalesce(F.regexp_extract(address, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1), F.lit("")))
    shape = F.hash(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))))
    named = named.withColumn("_host", host).withColumn("_shape", shape)
    at = F.struct(F.xxhash64(body).alias("h"), F.length(body).alias("n"))

    # the reference of each host and set of tags; sets of few pages use that of the most frequent set
    shapes = materialize(named.groupBy("_host", "_shape").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at")), "shapes")
    top = shapes.groupBy("_host").agg(F.max_by("at", F.struct("n", "_shape")).alias("top"))
    kinds = shapes.join(top, "_host").select(F.col("_host").alias("_h"), F.col("_shape").alias("_s"), F.when(F.col("n") >= LEAST_PAGES, F.col("at")).otherwise(F.col("top")).alias("_at"))
    kinds = materialize(kinds, "kinds")
    asked = materialize(kinds.select(F.col("_h").alias("_rh"), F.col("_at").alias("_ra")).distinct(), "asked")
    first = named.select("_host", at.alias("at"), body.alias("r")).join(sized(asked, asked.count(), 128), (F.col("_host") == F.col("_rh")) & (F.col("at") == F.col("_ra")))
    first = materialize(first.groupBy("_rh", "_ra").agg(F.min("r").alias("_ref")), "references")
    n_first, width = first.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.octet_length("_ref")), F.lit(0.0))).first()
    cut = named.join(sized(kinds, kinds.count(), 96), (F.col("_host") == F.col("_h")) & (F.col("_shape") == F.col("_s")))
    cut = cut.join(sized(first, n_first, 128 + int(width)), (F.col("_h") == F.col("_rh")) & (F.col("_at") == F.col("_ra")))
    kind = "array<struct<slot:int,same:boolean,main:boolean,text:string>>"
    cut = cut.withColumn("_blocks", F.pandas_udf(_candidates, kind)(body, F.col("_ref"))).select(*names.values(), "_h", "_at", "_blocks")
    cut = materialize(cut, "blocks")
    discard(shapes, kinds, asked, first)

    slots = cut.select("_h", "_at", F.explode("_blocks").alias("b")).where("b.slot >= 0 AND b.same IS NOT NULL")
    slots = slots.groupBy("_h", "_at", "b.slot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b.same").cast("int")).alias("same"))
    fixed = slots.where((F.col("n") >= LEAST_PAGES) & (F.col("same") >= SAME_SHARE * F.col("n")))
    strict = (F.col("n") >= MAIN_PAGES) & (F.col("same") >= MAIN_SHARE * F.col("n"))
    fixed = fixed.groupBy(F.col("_h").alias("_fh"), F.col("_at").alias("_fa")).agg(F.collect_set("slot").alias("_fixed"), F.collect_set(F.when(strict, F.col("slot"))).alias("_strict"))
    fixed = materialize(fixed, "template")
    done = cut.join(sized(fixed, fixed.count(), 256), (F.col("_h") == F.col("_fh")) & (F.col("_at") == F.col("_fa")), "left")
    kept = F.filter("_blocks", lambda b: F.when(F.col("_fixed").isNull(), True).when(b["main"], ~F.array_contains("_strict", b["slot"])).otherwise(~F.array_contains("_fixed", b["slot"])))
    return restored(done, names, **{out: F.array_join(F.transform(kept, lambda b: b["text"]), "\n")})
