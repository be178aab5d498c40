"""Main text of web pages by wrapper induction over the pages of a host.

1. One page of each host (least hash) is its reference. Every page's DOM tree is aligned with the reference by simple
   tree matching: equal roots match, and a dynamic programme over the children finds the largest matching that keeps
   their order. So each text block of a page gets a template slot, the matched node of the reference.
   Elements that the reference lacks have the slot of their path (tags and names) below the nearest matched element,
   so other layouts of the host have slots of their own.
2. Over the distinct pages of the host, a slot whose text is the same on nearly all pages that have the slot is
   template; other slots vary and are content. Where few pages tell, or only some pages have the slot, the pages must
   otherwise differ (in their longest block), so near copies of one page are not a template.
3. Varying slots are kept where content can be: inside the article or main elements if the page marks text by them, else
   everywhere; never inside navigation, headers, footers, asides or scripts.
4. Names (class, id) of adverts, notices, menus or reader comments, and forms, only vote: such an element is left out
   unless it holds an article or main element, or most of the page's varying text.

Pages meet their host's reference and template by joins, so a host with very many pages is dealt over all tasks.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize

# Classes of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br".split())
DROPPED = frozenset("head script style noscript template textarea title nav header footer aside button select input iframe svg math object canvas menu dialog audio video map noembed noframes xmp".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption", "summary", "figcaption", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Parts of names that speak for boilerplate, and parts that say nothing; a name with any other part does not vote.
BOILERPLATE = re.compile(
    r"ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommended|comments?|commentlist|replies|respond|disqus|pagination|pager|toolbar|widget|login|signup|search|skiplink|paywall|tracking",
    re.I,
)
NEUTRAL = re.compile(r"\d*|\d+x\d+|the|site|page|main|global|top|bottom|left|right|box|wrap|wrapper|container|area|section|block|bar|list|items?|links?|inner|outer|primary|secondary|slot|unit|group|row|col|panel|buttons?|icons?|form|title|heading|body|count|meta|posts?|entry|article|user|reader|mobile|desktop", re.I)
JOINED = re.compile(r"\b(side|skip)-(bar|link)\b", re.I)
PARTS = re.compile(r"[_-]")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z]|[^<]+|<", re.S)
IN_TAG = re.compile(r"[\"'>]")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
#: A slot is template where at least this share of the distinct pages that have it have the same text in it.
CONSTANT_SHARE = 0.9
#: Distinct pages from which a text on nearly all pages of the host is template whatever their longest blocks are.
CERTAIN_PAGES = 5
#: Template texts that are broadcast at most.
BROADCAST_TEXTS = 500_000
#: Hosts, and bytes of their reference pages, up to which these are broadcast.
BROADCAST_HOSTS, BROADCAST_BYTES = 5_000, 32 << 20
BLOCKS = "page_id long, url string, host string, blocks array<struct<slot:long, marked:boolean, mass:int, votes:array<int>, line:int, text:string>>"


class Node:
    __slots__ = ("tag", "skip", "children", "size", "slot", "shape", "main", "voted", "names")

    def __init__(self, tag: str, skip: bool = False, main: bool = False, voted: bool = False, names: str = ""):
        self.tag, self.skip, self.main, self.voted, self.names = tag, skip, main, voted, names
        self.children: list = []
        self.size, self.slot, self.shape = 1, -1, -1


def votes(named: str) -> bool:
    """Whether a class or id speaks for boilerplate; ``no-sidebar`` or ``social-science`` do not."""
    for name in JOINED.sub(r"\1\2", named).split():
        parts = PARTS.split(name)
        if any(BOILERPLATE.fullmatch(x) for x in parts) and all(BOILERPLATE.fullmatch(x) or NEUTRAL.fullmatch(x) for x in parts):
            return True
    return False


class Tags:
    """Where tags of a page end: at the first ``>`` outside quoted values.

    Linear in the page, however broken it is: a quote that never closes is an ordinary character, which its last place
    tells at once, and after one tag whose quotes hide every ``>`` quotes are ordinary on the rest of the page.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, {c: page.rfind(c) for c in "\"'>"}, True

    def end(self, at: int) -> int:
        """Place behind the tag that starts at ``at``, or -1 if no tag does."""
        if at > self.last[">"]:
            return -1
        k = at
        while self.quoted and (m := IN_TAG.search(self.page, k)):
            k = m.end()
            if m[0] == ">":
                return k
            if k <= self.last[m[0]]:
                k = self.page.index(m[0], k) + 1
        self.quoted = False
        return self.page.index(">", at) + 1


def parse(page: str | None) -> Node:
    """DOM tree of a page, with the end tags that HTML lets authors leave out."""
    root = Node("html")
    stack, at, page = [root], 0, page or ""
    tags, opened = Tags(page), Counter()

    def shut(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while m := TOKEN.match(page, at):
        token, start, at = m[0], at, m.end()
        if token[0] == "<" and len(token) > 1 and token[1] not in "!?":
            end = tags.end(start)
            token, at = (page[start:end], end) if end > 0 else ("<", start + 1)
        if token[0] != "<" or token == "<":
            stack[-1].children.append(token)
            continue
        if token[1] in "!?":
            continue
        tag = NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag in ("html", "body") or not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    shut(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if tag in ("html", "body") and (tag == "html" or opened["body"]):
            continue
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in SIBLINGS and any(opened[t] for t in SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    shut(k)
                    break
                if stack[k].tag in HOLDS[tag]:
                    break
        if tag == "body":
            shut(1)
        rest = token[len(tag) + 1 : -1]
        skip, main, voted, named = tag in DROPPED, tag in ("article", "main"), tag == "form", ""
        if rest.strip(" /"):
            attributes = {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(rest)}
            named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
            role = attributes.get("role", "").lower()
            main |= role in ("main", "article")
            voted |= tag not in ("html", "body") and votes(named)
            skip |= "hidden" in attributes or attributes.get("aria-hidden") == "true"
            skip |= role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu") or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
        node = Node(tag, skip, main, voted, named)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:  # HTML ignores a slash at the end
            stack.append(node)
            opened[tag] += 1
    return root


#: Children of one tag from which on they share slots: each meets the reference's first child of its shape, or of its tag.
REPEATED = 48
#: Cells of a table of the dynamic programme that is kept whole; larger ones are halved until they fit.
TABLE_CELLS = 1 << 20
Shapes = dict[tuple, int]


def elements(n: Node) -> list[Node]:
    return [c for c in n.children if isinstance(c, Node)]


def number(root: Node, shapes: Shapes, slots: bool = False) -> int:
    """Give every element its shape, a number that subtrees of equal tags share, and its subtree's size; with ``slots``
    also its place in document order as slot."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        if slots:
            n.slot = len(order)
        order.append(n)
        todo.extend(reversed(elements(n)))
    for n in reversed(order):
        own = elements(n)
        n.size = 1 + sum(c.size for c in own)
        n.shape = shapes.setdefault((n.tag, *[c.shape for c in own]), len(shapes))
    return len(order)


def split_repeated(x: list[Node], y: list[Node]) -> tuple[list[Node], list[Node], list[tuple[list[Node], list[Node]]]]:
    """(children of a and of b that are matched in order, the repeated children of both by tag)."""
    if max(len(x), len(y)) <= REPEATED:
        return x, y, []
    n, m = Counter(c.tag for c in x), Counter(c.tag for c in y)
    tags = [t for t in n.keys() | m.keys() if max(n[t], m[t]) > REPEATED]
    if not tags:
        return x, y, []
    many = [([c for c in x if c.tag == t], [c for c in y if c.tag == t]) for t in tags]
    return [c for c in x if c.tag not in tags], [c for c in y if c.tag not in tags], many


def trimmed(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """Equal shapes at the head and at the tail; some best matching has them all."""
    head, most = 0, min(len(x), len(y))
    while head < most and x[head].shape == y[head].shape:
        head += 1
    tail = 0
    while tail < most - head and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    return head, tail


class Matcher:
    """Largest matchings of subtrees. What two subtrees share depends on their shapes alone, so it is kept by shapes."""

    def __init__(self) -> None:
        self.shared: dict[tuple[int, int], int] = {}

    def weight(self, a: Node, b: Node) -> int | None:
        """Matched elements of two subtrees, if known."""
        if a.shape == b.shape:
            return a.size
        if a.tag != b.tag:
            return 0
        return self.shared.get((a.shape, b.shape))

    def weigh(self, a: Node, b: Node) -> int:
        todo = [(a, b)]
        while todo:
            p, q = todo[-1]
            if self.weight(p, q) is not None:
                todo.pop()
                continue
            x, y, many = split_repeated(elements(p), elements(q))
            head, tail = trimmed(x, y)
            inner_x, inner_y = x[head : len(x) - tail], y[head : len(y) - tail]
            wait = self.missing(inner_x, inner_y)
            if wait:
                todo.extend(wait)
                continue
            total = 1 + sum(c.size for c in x[:head] + x[len(x) - tail :]) + (int(self.last_row(inner_x, inner_y)[-1]) if inner_x and inner_y else 0)
            for own, other in many:
                n, m = Counter(c.shape for c in own), Counter(c.shape for c in other)
                size = {c.shape: c.size for c in own}
                equal = {k: min(n[k], m[k]) for k in n.keys() & m.keys()}
                total += sum(size[k] * v for k, v in equal.items()) + min(len(own), len(other)) - sum(equal.values())
            self.shared[p.shape, q.shape] = total
            todo.pop()
        return self.weight(a, b)

    def missing(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        """A pair of each two shapes of ``x`` and ``y`` whose weight is not known yet."""
        first_x, first_y = {c.shape: c for c in reversed(x)}, {c.shape: c for c in reversed(y)}
        by_tag: dict[str, list[Node]] = {}
        for c in first_y.values():
            by_tag.setdefault(c.tag, []).append(c)
        return [(c, d) for c in first_x.values() for d in by_tag.get(c.tag, ()) if self.weight(c, d) is None]

    def rows(self, x: list[Node], y: list[Node]) -> Iterator[np.ndarray]:
        """Rows of the dynamic programme: the best matching of the first children of ``x`` with the first j of ``y``."""
        kinds, place = np.unique([c.shape for c in y], return_inverse=True)
        one = {c.shape: c for c in y}
        sample = [one[k] for k in kinds.tolist()]
        known: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, np.int64)
        for c in x:
            w = known.get(c.shape)
            if w is None:
                w = known[c.shape] = np.array([self.weight(c, d) for d in sample], np.int64)[place]
            best = np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0))
            row = np.concatenate([[0], np.maximum.accumulate(best)])
            yield row

    def last_row(self, x: list[Node], y: list[Node]) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int64)
        for row in self.rows(x, y):  # noqa: B007
            pass
        return row

    def pairs(self, x: list[Node], y: list[Node]) -> Iterator[tuple[Node, Node]]:
        """Children that a largest matching in order pairs. Large tables are never held: ``x`` is halved where the best
        matchings of its halves meet."""
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            head, tail = trimmed(x, y)
            yield from zip(x[:head], y[:head], strict=True)
            yield from zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            if not x or not y:
                continue
            if len(x) > 1 and len(x) * len(y) > TABLE_CELLS:
                half = len(x) // 2
                cut = int((self.last_row(x[:half], y) + self.last_row(x[half:][::-1], y[::-1])[::-1]).argmax())
                todo += [(x[:half], y[:cut]), (x[half:], y[cut:])]
                continue
            table = np.stack([np.zeros(len(y) + 1, np.int64), *self.rows(x, y)])
            i, j = len(x), len(y)
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield x[i], y[j]


def align(ref: Node, page: Node, matcher: Matcher | None = None) -> None:
    """Simple tree matching of ``page`` with the numbered tree ``ref``; matched nodes of the page get the slots.

    Subtrees of equal shape are matched as they are. Where one tag has more than ``REPEATED`` children, as the rows of a
    table, these children share slots, and the work is in proportion to them. Other children are matched in order by the
    dynamic programme, after equal ones at either end.
    """
    matcher = matcher or Matcher()
    todo = [(ref, page)] if ref.tag == page.tag else []
    while todo:
        a, b = todo.pop()
        b.slot = a.slot
        x, y = elements(a), elements(b)
        if a.shape == b.shape and len(x) <= REPEATED:
            todo.extend(zip(x, y, strict=True))
            continue
        x, y, many = split_repeated(x, y)
        for own, other in many:
            by_shape = {c.shape: c for c in reversed(own)}
            if own:
                todo.extend((by_shape.get(c.shape, own[0]), c) for c in other)
        head, tail = trimmed(x, y)
        for c, d in matcher.missing(x[head : len(x) - tail], y[head : len(y) - tail]):
            matcher.weigh(c, d)
        todo.extend(matcher.pairs(x, y))


def settle(root: Node) -> None:
    """Take back the votes of elements that hold an article or main element, and of articles on their own; an article
    with such a name in another article, or in an element with such a name, is a comment."""
    order, todo = [], [(root, False)]
    while todo:
        n, inside = todo.pop()
        n.voted &= inside or not n.main
        order.append(n)
        if not n.skip:
            todo.extend((c, inside or n.main or n.voted) for c in n.children if isinstance(c, Node))
    holds: set[int] = set()  # elements with an article or main in them that no name votes against
    for n in reversed(order):
        if any(id(c) in holds for c in n.children):
            n.voted = False
            holds.add(id(n))
        elif n.main and not n.skip and not n.voted:
            holds.add(id(n))


def path(above: int, node: Node) -> int:
    """Slot, below -1, of an element without a match: its tag and names under the slot of its parent."""
    return -2 - zlib.crc32(f"{above}/{node.tag} {DIGITS.sub('', node.names)}".encode("utf-8", "surrogatepass"))


def blocks(root: Node) -> list[tuple[int, bool, int, list[int], int, str]]:
    """[(slot, marked, letters outside links, elements around it that names vote against, line, text)] of the blocks
    that may be content: those in article or main elements, or all blocks of a page without text in such elements."""
    settle(root)
    out: list[tuple[int, bool, int, list[int], int, str]] = []
    line: list[str] = []
    owner, against, mass, seen, at, marked = [root.slot], [()], [0], 0, 0, [False]

    def close() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append((owner[0], marked[0], mass[0], list(against[0]), at, text))
        mass[0] = 0

    todo: list[tuple] = [(root, root.slot, False, False, (), False)]
    while todo:
        item, slot, inside, link, voted, leaving = todo.pop()
        if isinstance(item, str):
            line.append(item)
            mass[0] += 0 if link else len(item.strip())
            continue
        if leaving:
            close()
            owner[0], against[0], marked[0], ended = item
            at += ended
            continue
        if item.skip:
            if item.tag in BLOCK or item.tag in ("nav", "header", "footer"):
                close()
                at += 1
            continue
        within = inside or item.main
        if item.tag == "br":
            line.append(" ")
            continue
        slot = item.slot if item.slot >= 0 else path(slot, item)
        around = voted
        if item.voted:
            seen += 1
            around = (*voted, seen)
        if item.tag in BLOCK or item.voted or within != inside:
            close()
            ends = item.tag in BLOCK
            at += ends
            todo.append(((owner[0], against[0], marked[0], ends), slot, within, link, voted, True))
            owner[0], against[0], marked[0] = slot, around, within
        todo.extend((c, slot, within, link or item.tag == "a", around, False) for c in reversed(item.children))
    close()
    return [b for b in out if b[1]] or out


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[Node, Matcher]] = {}
    shapes: Shapes = {}
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("marked", pa.bool_()), ("mass", pa.int32()), ("votes", pa.list_(pa.int32())), ("line", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            found = []
            for page, host, ref in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                root = parse(page)
                if len(held) > 500 or len(shapes) > 1_000_000:
                    held.clear()
                    shapes.clear()
                if host not in held:
                    held[host] = parse(ref), Matcher()
                    number(held[host][0], shapes, slots=True)
                number(root, shapes)
                align(held[host][0], root, held[host][1])
                found.append([{"slot": s, "marked": m, "mass": n, "votes": v, "line": k, "text": t} for s, m, n, v, k, t in blocks(root)])
            yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "host": part.column(3), "blocks": pa.array(found, kind)})


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text. Pages without url or host form one host. Rows that repeat a page_id are
    separate pages. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)).alias("host"),
    )
    pick = p.where("html <> ''").groupBy("host").agg(F.min_by("page_id", F.struct(F.xxhash64("page_id", "url"), "page_id")).alias("page_id"))
    pick = materialize(pick, "html-picks")
    few = pick.count() <= BROADCAST_HOSTS
    refs = p.join(F.broadcast(pick) if few else pick, ["host", "page_id"], "left_semi").groupBy("host").agg(F.min("html").alias("ref"))
    refs = materialize(refs, "html-references")
    small = few and (refs.agg(F.sum(F.octet_length("ref"))).first()[0] or 0) <= BROADCAST_BYTES
    # Beyond these bounds pages meet their reference by a join on the host, whose large keys Spark splits.
    aligned = p.join(F.broadcast(refs) if small else refs, "host", "left").select("page_id", "url", "html", "host", F.coalesce("ref", F.lit("")).alias("ref")).mapInArrow(_slots, BLOCKS)
    slots = materialize(aligned, "html-slots", compression="zstd")
    # Copies of a page count once. Its blocks as hashes, and the hash of its longest block.
    page = F.expr("array_distinct(transform(blocks, b -> struct(b.slot AS slot, xxhash64(b.text) AS hash)))")
    longest = F.expr("xxhash64(array_max(transform(blocks, b -> struct(length(b.text) AS n, b.text AS text))).text)")
    pages = slots.where("size(blocks) > 0").select("host", F.xxhash64("blocks.slot", "blocks.text").alias("copy"), longest.alias("body"), page.alias("page")).dropDuplicates(["host", "copy"])
    pages = materialize(pages, "html-pages", compression="zstd")
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    having = pages.select("host", F.explode(F.expr("array_distinct(page.slot)")).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("having"))
    same = pages.select("host", "body", F.explode("page").alias("b")).groupBy("host", "b.slot", "b.hash").agg(F.count("*").alias("same"), F.count_distinct("body").alias("bodies"))
    template = same.where("same >= 2").join(having, ["host", "slot"]).join(sizes, "host").where(f"same >= {CONSTANT_SHARE} * having AND (same >= {CERTAIN_PAGES} AND same >= {CONSTANT_SHARE} * pages OR bodies >= greatest(2, 0.5 * same))")
    template = materialize(template.select("host", "slot", "hash"), "html-template")
    constant = template.groupBy("host").agg(F.collect_list(F.struct("slot", "hash")).alias("template"))
    few = few and template.count() <= BROADCAST_TEXTS
    kept = "filter(blocks, b -> template IS NULL OR NOT array_contains(template, struct(b.slot AS slot, xxhash64(b.text) AS hash)))"
    varying = slots.join(F.broadcast(constant) if few else constant, "host", "left").select("page_id", "url", F.expr(kept).alias("kept"))
    # Names only vote: an element with most of the page's varying text stays.
    mass = "aggregate({}, 0L, (n, b) -> n + b.mass)"
    against = f"filter(array_distinct(flatten(kept.votes)), v -> 2 * {mass.format('filter(kept, b -> array_contains(b.votes, v))')} <= {mass.format('kept')})"
    held = "if(exists(kept, b -> size(b.votes) > 0), filter(kept, b -> NOT arrays_overlap(b.votes, against)), kept)"
    text = F.expr("array_join(transform(held, (b, i) -> concat(if(i = 0, '', if(b.line = held[i - 1].line, ' ', '\\n')), b.text)), '')")
    return varying.withColumn("against", F.expr(against)).withColumn("held", F.expr(held)).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
