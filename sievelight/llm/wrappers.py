"""Main text of pages by wrapper induction: pages of a host are aligned as trees, what stays the same is template."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import slices
from sievelight.llm.urls import url_host
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small

#: Hosts whose reference pages fit a broadcast.
HOSTS = 20_000

#: Aligned pages that a host needs before its constant nodes count as template, and the share of them that must agree.
LEAST_PAGES = 5
AGREEMENT = 0.9

#: Depth below which elements are siblings of each other instead of nested.
DEEPEST = 200

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNWANTED = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object select svg template textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names that say what a box is for, as words of its class, id or role.
UNWANTED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|complementary|consent|contentinfo|cookie|"
    r"cookies|disqus|footer|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|replies|search|share|sharing|sidebar|social|"
    r"sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])"
)
#: An open element that a start tag of the same list ends.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|xmp|noembed)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)[^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    """An element: its alignment key, child nodes and texts in page order, and whether it is unwanted by name."""

    __slots__ = ("at", "children", "key", "out", "tag")

    def __init__(self, tag: str, key: str, out: bool):
        self.tag, self.key, self.out, self.children, self.at = tag, key, out, [], -1

    def nodes(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is Node]

    def text(self) -> str:
        return " ".join(" ".join(c for c in self.children if c.__class__ is str).split())


def parse(page: str) -> Node:
    """The tree of block elements. Inline elements are part of the text unless their name makes them unwanted."""
    root = Node("", "", False)
    stack, at = [root], 0

    def say(text: str) -> None:
        if text:
            children = stack[-1].children
            if children and children[-1].__class__ is str:
                children[-1] += text
            else:
                children.append(text)

    for m in _TOKEN.finditer(page):
        say(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if tag == "br" or tag == "img":
            say(" ")
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(m["rest"] or "")).lower() if m["rest"] else ""
        unwanted = tag in UNWANTED or bool(named and UNWANTED_NAMES.search(named)) and tag not in ("html", "body", "article", "main")
        if tag == "header" and not any(n.tag in ("article", "main") for n in stack):
            unwanted = True
        if tag not in BLOCKS and not unwanted:
            continue
        if tag in BLOCKS and stack[-1].tag == "p":
            stack.pop()
        elif tag in ENDED and stack[-1].tag in ENDED[tag]:
            stack.pop()
        if len(stack) > DEEPEST:
            stack.pop()
        node = Node(tag, f"{tag}.{named}" if named else tag, unwanted or stack[-1].out)
        stack[-1].children.append(node)
        if tag not in VOID and not (m["rest"] or "").endswith("/"):
            stack.append(node)
    say(html.unescape(page[at:]))
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered as slots."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.at = len(out)
        out.append(node)
        todo += reversed(node.nodes())
    return out


def match(a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
    """Simple tree matching: the greatest number of nodes that pair up in order with equal keys, and the pairs.

    Two leaves of equal text count a little more, so that constant texts meet each other among alike siblings.
    """
    if a.key != b.key:
        return 0.0, []
    xs, ys = a.nodes(), b.nodes()
    own = 1.0 + (0.5 if a.text() == b.text() else 0.0)
    if not xs or not ys:
        return own, [(a, b)]
    # Equal leaves at the start pair up at once, which keeps pages that hardly differ from costing a square.
    same = 0
    while same < min(len(xs), len(ys)) and _twins(xs[same], ys[same]):
        same += 1
    first, (xs, ys) = list(zip(xs[:same], ys[:same], strict=True)), (xs[same:], ys[same:])
    found = {(i, j): match(x, y) for i, x in enumerate(xs) for j, y in enumerate(ys) if x.key == y.key}
    rows = [[0.0] * (len(ys) + 1)]
    for i in range(len(xs)):
        last, row = rows[-1], [0.0]
        for j in range(len(ys)):
            best = max(last[j + 1], row[j])
            if (i, j) in found:
                best = max(best, last[j] + found[i, j][0])
            row.append(best)
        rows.append(row)
    i, j, pairs = len(xs), len(ys), [(a, b), *first]
    while i and j:
        if (i - 1, j - 1) in found and rows[i][j] == rows[i - 1][j - 1] + found[i - 1, j - 1][0]:
            i, j = i - 1, j - 1
            pairs += found[i, j][1]
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return own + 1.5 * same + rows[-1][-1], pairs


def _twins(x: Node, y: Node) -> bool:
    return x.key == y.key and not x.nodes() and not y.nodes() and x.text() == y.text()


def _find(node: Node, tag: str) -> list[Node]:
    """The outermost wanted elements of a name."""
    if node.out:
        return []
    return [node] if node.tag == tag else [x for c in node.nodes() for x in _find(c, tag)]


def _blocks(node: Node, template: set[int]) -> list[str]:
    if node.out:
        return []
    out = []
    for c in node.children:
        if c.__class__ is Node:
            out += _blocks(c, template)
        elif id(node) not in template and (text := " ".join(c.split())):
            out.append(text)
    return out


def main_text(page: str, reference: str | None = None, constant: frozenset[int] = frozenset(), content: int = -1) -> str:
    """The page's main text: blocks in page order, one line each.

    `reference` is the host's reference page, `constant` its slots that all pages of the host share and `content` the
    slot below which pages differ; nodes of the page that align with them are template and region. A page that says
    which element is its article is taken at its word for the region; then the induced one, main, or the whole body.
    """
    root = parse(page)
    regions, template = _find(root, "article"), set()
    if reference is not None and (constant or not regions):
        slots = number(parse(reference))
        paired = {y.at: x for x, y in match(root, slots[0])[1]}
        template = {id(paired[k]) for k in constant if k in paired}
        if not regions and content in paired:
            regions = [paired[content]]
    regions = regions or _find(root, "main") or [root]
    return "\n".join(b for r in regions for b in _blocks(r, template))


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "big", signed=True)


def _page(root: Node) -> tuple[int, list[int]]:
    """A hash of all that alignment sees of a page, which its copies share, and hashes of its distinct paths of elements."""
    told, paths, todo = [], {}, [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        if depth:
            path = f"{path}>{node.key}" if depth < 8 else path
            paths[path] = None
        told += [str(depth), node.key, node.text()]
        todo += [(c, path, depth + 1) for c in reversed(node.nodes())]
    return _hash("\0".join(told).encode("utf-8", "replace")), [_hash(p.encode("utf-8", "replace")) for p in paths]


def _unseen(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """Rows of (host, html, ...) in lists, without those whose host and html the task has just had."""
    seen: set = set()
    for batch in slices(batches, "html"):
        rows = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("host", "html", *columns)), strict=True):
            mark = (row[0], blake2b((row[1] or "").encode("utf-8", "replace"), digest_size=16).digest())
            if mark not in seen:
                seen.add(mark)
                rows.append(row)
        if len(seen) > 100_000:
            seen.clear()
        yield rows


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`host, page, size, name, paths` of pages (host, html, name), a copy within a task once as a rule."""
    for rows in _unseen(batches, "name"):
        made = [(host, *_page(parse(page or "")), len(page or ""), name) for host, page, name in rows]
        columns = [[m[k] for m in made] for k in (0, 1, 3, 4, 2)]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "page", "size", "name", "paths"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`host, page, slots`: the slots of the host's reference that a page has, twice their number, plus one with the same text."""
    trees: dict[str, list[Node]] = {}
    for rows in _unseen(batches, "reference"):
        out = []
        for host, page, reference in rows:
            if host not in trees:
                if len(trees) > 200:
                    trees.clear()
                trees[host] = number(parse(reference or ""))
            root = parse(page or "")
            out.append((host, _page(root)[0], [2 * y.at + (x.text() == y.text()) for x, y in match(root, trees[host][0])[1]]))
        types = [pa.string(), pa.int64(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["host", "page", "slots"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Constant slots and the content slot of each host, from the counts of its slots."""
    for batch in batches:
        constants, contents = [], []
        for reference, counts in zip(batch.column("reference").to_pylist(), batch.column("slots").to_pylist(), strict=True):
            slots = number(parse(reference or ""))
            told = {c["slot"]: c for c in counts or []}
            enough = {k for k, c in told.items() if c["matched"] >= LEAST_PAGES}
            constant = {k for k in enough if told[k]["same"] >= AGREEMENT * told[k]["matched"] and slots[k].text()}
            varying = {k for k in enough - constant if slots[k].text()}

            def weight(node: Node, varying: set[int] = varying) -> int:
                return 0 if node.out else (node.at in varying) + sum(weight(c) for c in node.nodes())

            # Down from the root, as long as one child holds all that varies.
            node, total = slots[0], weight(slots[0])
            while total and node.at not in varying and (heir := [c for c in node.nodes() if weight(c) == total]):
                node = heir[0]
            constants.append(sorted(constant))
            contents.append(node.at if total and node.nodes() else -1)
        columns = [batch.column("host"), batch.column("reference"), pa.array(constants, pa.list_(pa.int32())), pa.array(contents, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "reference", "constant", "content"])


def choose_references(pages: DataFrame) -> DataFrame:
    """`host, reference`: the shortest page of those that hold most of what more than half of a host's pages hold.

    What pages hold are paths of element names; copies of a page count once, and pages without elements don't count. A
    host whose pages all are without elements, or of which no two are alike, has its shortest page.
    """
    named = pages.withColumn("name", F.xxhash64("html"))
    shapes = named.mapInArrow(_shapes, "host string, page long, size long, name long, paths array<long>")
    shapes = stored(shapes.groupBy("host", "page").agg(F.min(F.struct("size", "name")).alias("least"), F.first("paths").alias("paths")))
    totals = shapes.filter(F.size("paths") > 0).groupBy("host").agg(F.count("*").alias("total"))
    counts = shapes.select("host", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.count("*").alias("n"))
    # Paths that more than half of the pages hold are at most twice as many as a page has on average.
    shared = counts.join(broadcast_if_small(totals, HOSTS), "host").filter("2 * n > total").groupBy("host").agg(F.collect_list("path").alias("shared"))
    met = shapes.join(broadcast_if_small(stored(shared), HOSTS), "host", "left")
    held = F.coalesce(F.size(F.array_intersect("paths", F.coalesce("shared", F.array().cast("array<long>")))), F.lit(0))
    best = met.groupBy("host").agg(F.min(F.struct((-held).alias("held"), F.col("least.size").alias("size"), F.col("least.name").alias("name"))).alias("r"))
    chosen = stored(best.select("host", "r.name"))
    return named.join(broadcast_if_small(chosen, HOSTS), ["host", "name"]).groupBy("host").agg(F.min("html").alias("reference"))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """`host, reference, constant, content` of every host of `pages` (host, html).

    Every page is aligned with the host's reference; copies of a page, which agree in all elements and texts, count
    once, so a page that is stored often is no template of its own. What is shuffled is a page's slot numbers. Constant
    slots hold the same text on nine of ten aligned pages, five at least; the content slot is the lowest one that holds
    all that varies.
    """
    references = stored(choose_references(pages))
    met = pages.join(broadcast_if_small(references, HOSTS), "host").select("host", "html", "reference")
    aligned = met.mapInArrow(_align, "host string, page long, slots array<int>").groupBy("host", "page").agg(F.first("slots").alias("slots"))
    counts = aligned.select("host", F.explode("slots").alias("s")).groupBy("host", F.shiftright("s", 1).alias("slot"))
    counts = counts.agg(F.count("*").alias("matched"), F.sum(F.col("s").bitwiseAND(1).cast("long")).alias("same"))
    # A reference has as many slots as its page has elements.
    slots = counts.groupBy("host").agg(F.collect_list(F.struct("slot", "matched", "same")).alias("slots"))
    schema = "host string, reference string, constant array<int>, content int"
    return references.join(slots, "host", "left").select("host", "reference", "slots").mapInArrow(_judge, schema)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """`page_id, url, text, n_chars` of every row, from the whole page.

    Character references are decoded, white space within a block is one space, blocks are lines in page order. Menus,
    headers, footers, boxes that are named for adverts, notices, comments and the like, and what is constant on the
    host's distinct pages are left out. A null page is empty; a null url, or one without a host, shares a wrapper with its like.
    """
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).withColumn("host", url_host(F.col("url")))
    wrappers = stored(induce_wrappers(own.filter("html IS NOT NULL").select("host", "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            columns = [batch.column(c).to_pylist() for c in ("html", "reference", "constant", "content")]
            texts = [main_text(h or "", r, frozenset(k or ()), -1 if c is None else c) for h, r, k, c in zip(*columns, strict=True)]
            out = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])

    met = own.join(broadcast_if_small(wrappers, HOSTS), "host", "left").select("page_id", "url", "html", "reference", "constant", "content")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
