"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Pages are read as trees of block elements. A wrapper starts as one page of a host and is aligned with one page after
another, level by level: equal labels are merged, texts that differ become slots, elements that some pages lack
become optional, neighbours of one label become repeated groups. Wrappers align with each other the same way, so
every task infers wrappers for the pages it holds and only those, not pages, are brought together by host.
"""

from __future__ import annotations

import html
import json
import math
import operator
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.llm.common import settle

# Elements by how they are read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|noscript|template|iframe|svg|math|object|select|button|canvas|audio|video"
DROPPED = frozenset("head nav footer aside form menu dialog title".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Block elements before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: Class, id or role words of parts that are not the article.
ASIDE = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay "
    "comment comments disqus reply replies sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead related "
    "recommended share sharing social newsletter subscribe subscription signup login toolbar pagination pager skip widget "
    "complementary contentinfo search".split()
)
MAIN_WORDS = frozenset("main article articlebody post-content entry-content article-body article-content".split())
#: Nesting from which elements melt into their parent: plain ones, and, deeper, all. Their texts stay, as blocks.
DEEP, DEEPEST = 120, 200

_tokens = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S | re.I,
).finditer
_marks = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I).findall


class Node:
    """An element (label: tag and its marks) with children in order, or a text (label #text). In a wrapper, `text` None is a
    slot, `optional` and `repeated` say how often the node stands, `pages` how many pages have it and `texts` how many
    pages have each text (by digest) there."""

    __slots__ = ("label", "text", "children", "optional", "repeated", "pages", "texts")

    def __init__(self, label, text=None, children=None, optional=False, repeated=False, pages=1, texts=None):
        self.label, self.text, self.children, self.optional, self.repeated = label, text, children or [], optional, repeated
        self.pages, self.texts = pages, texts or {}

    def plain(self):
        return [self.label, self.text, self.optional, self.repeated, [c.plain() for c in self.children], self.pages, list(self.texts.items())]

    @staticmethod
    def of(x):
        return Node(x[0], x[1], [Node.of(c) for c in x[4]], x[2], x[3], x[5], dict(x[6]))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def parse(page: str | None) -> Node:
    """The tree of a page's block elements; inline elements melt into their texts, scripts and comments vanish."""
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    levels: list[int] = []  # stack sizes at which the tree grew deeper
    words: list[str] = []

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                stack[-1][1].children.append(Node("#text", text))

    for m in _tokens(page or ""):
        name = m["name"]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                words.append(token)
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if name == "br":
            words.append(" ")
            continue
        flush()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    while levels and levels[-1] > len(stack):
                        levels.pop()
                    break
            continue
        if name in ("html", "body") and any(s[0] == name for s in stack[1:]):
            continue
        shut = CLOSES.get(name, ())
        while len(stack) > 1 and (stack[-1][0] in shut or (stack[-1][0] == "p" and name in ENDS_P)):
            stack.pop()
            while levels and levels[-1] > len(stack):
                levels.pop()
        if name in VOID:
            continue
        label = name
        if m["attrs"]:
            marks = sorted({w for _, a, b, c in _marks(m["attrs"]) for w in (a or b or c).lower().split()})
            label = ".".join([name, *marks])
        level = len(levels)
        if level > DEEPEST or (level > DEEP and not (is_main(label) or aside(label, True))):
            node, deeper = stack[-1][1], False
        else:
            node, deeper = Node(label), True
            stack[-1][1].children.append(node)
        if not (m["attrs"] or "").rstrip().endswith("/"):
            stack.append((name, node))
            if deeper:
                levels.append(len(stack))
    flush()
    return root


def folded(node: Node) -> Node:
    """The node as a wrapper: runs of neighbours with one label become one repeated node."""
    out: list[Node] = []
    for child in map(folded, node.children):
        if out and out[-1].label == child.label and child.label != "#text":
            out[-1] = align(out[-1], child, max)
            out[-1].repeated = True
        else:
            out.append(child)
    texts = {digest(node.text): 1} if node.text is not None else {}
    return Node(node.label, node.text, out, node.optional, node.repeated, node.pages, texts)


def align(a: Node, b: Node, both=operator.add) -> Node:
    """The wrapper of two nodes with one label. `both` joins their counts of pages: added for different pages; the greater one
    for neighbours, which stand on the same pages."""
    text = a.text if a.text == b.text else None
    few, texts = sorted((a.texts, b.texts), key=len)
    texts = dict(texts)
    for d, n in few.items():
        texts[d] = both(texts[d], n) if d in texts else n
    children = align_all(a.children, b.children, both)
    return Node(a.label, text, children, a.optional or b.optional, a.repeated or b.repeated, both(a.pages, b.pages), texts)


def align_all(x: list[Node], y: list[Node], both=operator.add) -> list[Node]:
    """Align two lists of children: the longest common run of labels is merged, what one side lacks becomes optional."""
    if [n.label for n in x] == [n.label for n in y]:
        return [align(a, b, both) for a, b in zip(x, y)]
    n, m = len(x), len(y)
    skip_left = lcs_choice([c.label for c in x], [c.label for c in y])
    out: list[Node] = []
    i = j = 0

    def alone(node: Node) -> None:
        if out and out[-1].label == node.label and node.label != "#text":  # a group that repeats
            out[-1] = align(out[-1], node, max)
            out[-1].repeated = True
        else:
            node.optional = True
            out.append(node)

    while i < n or j < m:
        if i < n and j < m and x[i].label == y[j].label:
            out.append(align(x[i], y[j], both))
            i, j = i + 1, j + 1
        elif j == m or (i < n and skip_left(i, j)):
            alone(x[i])
            i += 1
        else:
            alone(y[j])
            j += 1
    return out


def lcs_choice(x: list[str], y: list[str]):
    """A function (i, j), asked with rising i: whether the longest common subsequence of x[i + 1:] and y[j:] is at least as
    long as that of x[i:] and y[j + 1:].

    One bit per place of y marks where the length grows; a row of the table is one integer, made from the next one by a few
    operations on whole integers. Rows are kept at about sqrt(n) places and made anew from there, so long lists of elements
    need little time and memory."""
    n, m = len(x), len(y)
    mask = (1 << m) - 1
    where: dict[str, int] = {}
    for k, label in enumerate(reversed(y)):
        where[label] = where.get(label, 0) | 1 << k
    step = math.isqrt(n) + 1

    def before(v: int, label: str) -> int:
        u = v & where.get(label, 0)
        return ((v + u) | (v - u)) & mask

    marks, v = {n: mask}, mask
    for i in range(n - 1, -1, -1):
        v = before(v, x[i])
        if i % step == 0:
            marks[i] = v
    rows: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        if i not in rows:
            top = min((i // step + 1) * step, n) if i < n else n
            rows.clear()
            rows[top] = v = marks[top]
            for k in range(top - 1, max(i - 1, 0) - 1, -1):
                rows[k] = v = before(v, x[k])
        return (~rows[i] & ((1 << (m - j)) - 1)).bit_count()

    return lambda i, j: length(i + 1, j) >= length(i, j + 1)


def hint(label: str) -> int:
    """How surely class, id or role words name an element that is no part of the article: 2 by a whole word, 1 by a part of one."""
    marks = [w for w in label.split(".")[1:] if w not in MAIN_WORDS]
    if any(w in ASIDE for w in marks):
        return 2
    return int(any(p in ASIDE for w in marks for p in re.split(r"[-_]", w)))


def aside(label: str, inside: bool, trust: int = 0) -> bool:
    """Whether an element is no part of the article; a header is one only outside of it. Hints up to `trust` don't count."""
    name = label.split(".", 1)[0]
    if name in DROPPED or (name == "header" and not inside):
        return name != "form" or trust == 0
    return name not in ("html", "body") and hint(label) > trust


def is_main(label: str) -> bool:
    name, *marks = label.split(".")
    return name in ("article", "main") or any(w in MAIN_WORDS for w in marks)


def mains(node: Node, trust: int, out: set[int]) -> bool:
    """Whether the node is or holds a main element; `out` gets all (by id) that do. Hints up to `trust` don't count."""
    if node.label == "#text" or aside(node.label, True, trust):
        return False
    found = is_main(node.label)
    for child in node.children:
        found |= mains(child, trust, out)
    if found:
        out.add(id(node))
    return found


def sizes(node: Node, out: dict[int, int]) -> int:
    """Characters of text in every element (by id)."""
    out[id(node)] = n = len(node.text) if node.text is not None else sum(sizes(c, out) for c in node.children)
    return n


def clear(n: int, pages: int) -> bool:
    """Whether `n` of the host's pages are a clear majority: two of two, three of three or four, 55 of 100."""
    return n > 1 and 2 * n >= pages + math.sqrt(pages)


def blocks(page: Node, wrapper: Node | None, pages: int) -> list[str]:
    """The page's article blocks, read along the wrapper of the host's `pages` pages.

    Inside of main elements (where the page has some) as well as outside, a text that a clear majority of the host's pages have at
    its place is template text and left out, unless nothing would remain (a host of copies). In a main element its h1 is the
    title, and a repeated group (paragraphs, items) with any text of the page's own is content as a whole. Tags and class words
    are hints: one that would leave the page without its main element, or without any text, gives way."""
    size: dict[int, int] = {}
    sizes(page, size)
    main: set[int] = set()
    level = next((t for t in range(3) if mains(page, t, main)), 0)
    own: list[str] = []
    every: list[str] = []

    def template(text: str, known: list[Node]) -> bool:
        d = digest(text)
        return any(clear(w.texts.get(d, 0), pages) for w in known)

    def meet(node: Node, known: list[Node]) -> Iterator[tuple[Node, list[Node]]]:
        """Children, each with all the wrapper's children of its label."""
        labels: dict[str, list[Node]] = {}
        for w in known:
            for c in w.children:
                labels.setdefault(c.label, []).append(c)
        for child in node.children:
            yield child, labels.get(child.label, [])

    def constant(node: Node, known: list[Node]) -> bool:
        if node.label == "#text":
            return template(node.text, known)
        return all(constant(c, k) for c, k in meet(node, known))

    def walk(node: Node, known: list[Node], inside: bool, content: bool = False) -> None:
        if node.label == "#text":
            if inside or not main:
                every.append(node.text)
                if content or not template(node.text, known):
                    own.append(node.text)
            return
        large = 2 * size[id(node)] > size[id(page)]
        trust = level if large or (not inside and id(node) in main) else 0
        if aside(node.label, inside, max(trust, 1) if large and not inside else trust):
            return
        inside = inside or is_main(node.label)
        for _, run in groupby(meet(node, known), lambda c: c[0].label):
            run = list(run)
            label = run[0][0].label
            kept = inside and bool(main) and label.split(".", 1)[0] == "h1"
            if inside and main and label != "#text" and any(w.repeated for w in run[0][1]):
                kept = kept or not all(constant(c, k) for c, k in run)
            for child, k in run:
                walk(child, k, inside, content if child.label == "#text" else kept)

    while True:
        walk(page, [wrapper] if wrapper else [], False)
        if every or level == 2:
            return own or every
        level += 1


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _dump(node: Node) -> str:
    return json.dumps(node.plain(), ensure_ascii=False, separators=(",", ":"))


def pruned(node: Node, keep) -> Node:
    """The wrapper with slots for constants and with those texts only whose count `keep` holds for."""
    texts = {d: n for d, n in node.texts.items() if keep(n)}
    return Node(node.label, None, [pruned(c, keep) for c in node.children], node.optional, node.repeated, node.pages, texts)


#: Partial wrappers forget texts on less than this share of their pages, once when they are made and once a merge: what a text
#: loses is within so many times this share of the host's pages, and no count ever comes out too high. A text near the clear
#: majority of its host's pages may therefore stay in the article; none is left out for it.
FORGET = 1 / 64
#: Partial wrappers of one host that one task merges.
FAN = 64
#: Characters of wrappers that go to every task; beyond, pages and wrappers are joined by host.
SENT = 16_000_000
#: Pages of a host that go with one copy of its wrapper, where they are joined.
SHARE = 20_000
#: Parsed wrappers that a task keeps.
TREES = 500


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of each batch of (host, html)."""
    for batch in batches:
        have: dict[str, tuple[Node, int]] = {}
        for i in range(0, batch.num_rows, 64):
            for host, page in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                new = folded(parse(page))
                if not new.children:
                    continue  # nothing on it tells of the host's template
                old = have.get(host)
                have[host] = (align(old[0], new), old[1] + 1) if old else (new, 1)
        yield _wrapped(have)


def _wrapped(have: dict[str, tuple[Node, int]], whole: bool = False) -> pa.RecordBatch:
    """Rows of wrappers; the `whole` one of a host needs its template texts only."""
    slim = [pruned(node, (lambda n: clear(n, k)) if whole else (lambda n: n >= k * FORGET)) for node, k in have.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(have), pa.string()), pa.array(map(_dump, slim), pa.string()), pa.array([k for _, k in have.values()], pa.int64())],
        ["host", "wrapper", "pages"],
    )


def _merger(whole: bool):
    """One wrapper per host of partial ones that come host by host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, tuple[Node, int]] = {}
        for batch in batches:
            done: dict[str, tuple[Node, int]] = {}
            for host, wrapper, pages in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "pages"))):
                node = Node.of(json.loads(wrapper))
                if host in now:
                    now[host] = (align(now[host][0], node), now[host][1] + pages)
                else:
                    done |= now
                    now = {host: (node, pages)}
            if done:
                yield _wrapped(done, whole)
        if now:
            yield _wrapped(now, whole)

    return run


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) from all of `pages` (host, html): partial wrappers per task, merged FAN at a time in as many rounds
    as the host with the most of them needs, so no task merges more than about that many."""
    kind = "host string, wrapper string, pages long"
    part = settle(pages.select("host", "html").mapInArrow(_infer, kind))
    while True:
        many = part.groupBy("host").agg(F.count("*").alias("n"))
        most = many.agg(F.max("n")).first()[0] or 0
        salt = F.pmod(F.xxhash64("wrapper", "pages"), F.ceil(F.col("n") / FAN))
        part = part.join(many, "host").withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
        if most <= FAN:
            return part.select("host", "salt", "wrapper", "pages").mapInArrow(_merger(True), kind)
        part = settle(part.select("host", "salt", "wrapper", "pages").mapInArrow(_merger(False), kind))


class Wrappers:
    """Parsed wrappers by host, the last TREES of them."""

    def __init__(self, known: dict[str, tuple[str, int]] | None = None):
        self.known, self.trees = known, {}

    def get(self, host: str, wrapper: str | None, pages: int | None) -> tuple[Node | None, int]:
        if self.known is not None:
            wrapper, pages = self.known.get(host, (None, 0))
        if not wrapper:
            return None, 0
        tree = self.trees.get(host)
        if tree is None:
            if len(self.trees) >= TREES:
                self.trees.pop(next(iter(self.trees)))
            tree = self.trees[host] = Node.of(json.loads(wrapper))
        return tree, pages or 0


def _extract(known: dict[str, tuple[str, int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = Wrappers(known)
        for batch in batches:
            texts = []
            joined = known is None
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                hosts, pages = part.column("host").to_pylist(), part.column("html").to_pylist()
                more = [part.column(c).to_pylist() for c in ("wrapper", "pages")] if joined else [[None] * len(pages)] * 2
                for host, page, wrapper, many in zip(hosts, pages, *more):
                    texts.append(" ".join(blocks(parse(page), *wrappers.get(host, wrapper, many))))
            names = [n for n in batch.schema.names if n not in ("html", "wrapper", "pages")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return run


def _joined(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with their host's wrapper. A host of many pages is dealt to several groups, each with a copy of the wrapper."""
    found = found.withColumn("copies", F.ceil(F.col("pages") / SHARE).cast("int"))
    large = found.where("copies > 1").select(F.col("host").alias("l"), F.col("copies"))  # at most one host in SHARE pages
    salted = pages.join(large, F.col("host") == F.col("l"), "left").withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("copies", F.lit(1)))
    )
    dealt = found.select(F.col("host").alias("h"), "wrapper", "pages", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("s"))
    joined = salted.join(dealt, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")
    return joined.select("page_id", "url", "host", "html", "wrapper", "pages")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), host.

    Pages without a host (null or odd urls) share the wrapper of the empty host. Null or empty html gives an empty
    text; repeated rows stay repeated; elements nested very deeply melt into their parents (DEEP, DEEPEST), their texts stay; other
    columns are not read. Wrappers of less than SENT characters together go to the pages, which then stay where they are;
    otherwise both are joined by host, a host of very many pages in several groups.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = settle(infer(slim))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    if (found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= SENT:
        known = {r["host"]: (r["wrapper"], r["pages"]) for r in found.collect()}
        rows, run = slim.select("page_id", "url", "host", "html"), _extract(known)
    else:
        rows, run = _joined(slim, found), _extract(None)
    out = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url string, host string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")
