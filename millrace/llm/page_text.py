"""HTML extraction: site template removal.

Every page is parsed once. Each block element gives three keys: its place (tags, classes and ids from the root down,
containers numbered among their like), its slot (the place and the shape of its subtree, without text) and its content
(tags and text of the subtree). Spark counts them on the different pages of each host and settles per host

* the container of the prose: the deepest place that holds half of the host's different text on half of its pages;
* contents that recur: outside the container on a fifth of the pages or on MANY pages, inside it on half of them (fewer
  won't do: passages that many articles share are prose);
* slots that recur outside the container as often, and inside it those that stand on half of the pages and are mostly
  links. Where what a slot holds differs on every page and is no links (a title or a price, but also an advert that
  never comes twice), counts can't tell: it stays, unless a name or label of its own calls it template.

Those subtrees are deleted from the page's blocks, which the first pass has written: a node knows the block element
above it, so marks go down a page in node order and markup may be nested to any depth. Elements that HTML itself calls no
prose (nav, footer, form and so on) and reader comments, which differ from page to page, go by name. On hosts with too
few pages to count, and where no container can be told, the words of class, id and role decide instead, and the main
element or the articles stay alone if they hold half of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, small_side, written
from .url_rules import url_parts

#: Element names and words of class, id and role attributes.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th option img input".split())
UNSEEN = frozenset("applet audio button canvas datalist embed head iframe map noembed noframes noscript object script select style svg template textarea title video xmp".split())
DROPPED = frozenset("aside dialog footer form menu nav".split())
OPEN = frozenset(("", "html", "body"))
HOLDERS = frozenset("article aside body center details dialog div dl fieldset footer form header html main menu nav ol section table tbody tr ul".split()) | {""}
COMMENTS = frozenset("comment commentlist comments disqus".split())
LABELS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()) | COMMENTS
OUTSIDE = frozenset("contentinfo footer form header login masthead search site".split())
PROSE = frozenset("article body content entry headline main post story text title".split())
CLOSES_P = BLOCKS - {"body", "html"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"tbody", "thead"}, "tfoot": {"tbody"}}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table ul".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</?[A-Za-z][^>]*>|<[!?][^>]*>|<[A-Za-z/!?][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TELLING = re.compile("class|id|role|hidden|style", re.I)
LEAST_PAGES, SHARE, SHARE_INSIDE, MANY = 5, 0.2, 0.5, 25
LINKED, DIFFERENT = 0.6, 0.95
ROOT = 1  # the place of the page itself
OUT, ANYWHERE, CONTAINER, SETTLED, OWN = 1, 2, 3, 4, 5  # what a key of a host tells

NAMED, LABELLED, COMMENT, ARTICLE, MAIN = 1, 2, 4, 8, 16  # what elements around a block are, by name

NODES = "array<struct<node: int, place: bigint, slot: bigint, content: bigint, depth: int, holder: int, chars: int, links: int, first: int, fresh: int>>"
PIECES = "overs array<int>, texts array<string>, homes array<int>, flags array<int>"  # of nodes: the node above; of blocks: text, node, what is around
FIELDS = f"page_id long, url string, host string, part int, row long, prose long, nodes {NODES}, {PIECES}"


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    __slots__ = ("article", "block", "chars", "comment", "depth", "labelled", "link", "links", "main", "name", "named", "number", "over", "parts", "place", "seen", "shapes", "tag", "unseen")

    def __init__(self, tag: str, number: int, over: Node | None, name: str, *, unseen: bool, named: bool, labelled: bool, comment: bool, article: bool, main: bool) -> None:
        self.tag, self.number, self.name, self.unseen, self.named, self.labelled, self.comment, self.article, self.main = tag, number, name, unseen, named, labelled, comment, article, main
        self.seen, self.chars, self.links = {}, 0, 0
        self.parts, self.shapes = (over.parts, over.shapes) if tag and tag not in BLOCKS else ([], [])  # inline ones write on
        self.block = self if over is None or tag in BLOCKS else over.block
        self.link = tag == "a" or (over is not None and over.link)
        self.over = over.block.number if over else -1
        if over is None:
            self.place, self.depth = ROOT, 0
        elif tag in BLOCKS:
            nth = over.seen[name] = over.seen.get(name, 0) + 1
            self.place, self.depth = hashed(f"{over.place}/{name}{nth if tag in HOLDERS else ''}"), over.depth + 1
        else:
            self.place, self.depth, self.seen = over.place, over.depth, over.seen


def labels(tag: str, attributes: str) -> tuple[set[str], bool, bool, str]:
    """(words of class, id and role; whether hidden; whether of the role main; name of the element in places)."""
    if not attributes or not TELLING.search(attributes):
        return set(), False, False, tag
    words, hidden, main, named = set(), False, False, []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            words.update(w for w in re.split(r"[^a-z0-9]+", value) if w)
            main |= name == "role" and value == "main"
            named.append(f"{name}={' '.join(sorted(re.sub('[0-9]+', '0', value).split()))}")
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
    return words, hidden, main, tag if tag in ("html", "body", "article", "main") else f"{tag}[{' '.join(sorted(named))}]"


class Page:
    """nodes: (number, place, slot, content, depth, holder, chars, links); overs: the node above each; blocks: (text,
    node, flags). Where the open elements of a name stand is kept beside the stack, so a tag costs the same at any depth."""

    def __init__(self, html: str) -> None:
        self.nodes, self.overs, self.blocks, self.run, self.linked, self.count = [], [], [], [], 0, 0
        self.where: dict[str, list[int]] = {}
        self.scopes, self.block_at = [0], [0]
        self.stack = [Node("", 0, None, "", unseen=False, named=False, labelled=False, comment=False, article=False, main=False)]
        self.read(html)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run.clear()
            top = self.stack[-1]
            if text and not top.unseen:
                top.parts.append(text)
                top.shapes.append("t")
                top.chars += len(text)
                top.links += min(len(text), self.linked)
                self.blocks.append((text, top.block.number, NAMED * top.named | LABELLED * top.labelled | COMMENT * top.comment | ARTICLE * top.article | MAIN * top.main))
        self.linked = 0

    def close(self) -> None:
        node = self.stack.pop()
        over = self.stack[-1] if self.stack else None
        if over:
            over.chars += node.chars
            over.links += node.links
            self.where[node.tag].pop()
            if node.tag in SCOPES:
                self.scopes.pop()
            if node.tag in BLOCKS:
                self.block_at.pop()
        if node.block is node and node.parts:
            content = hashed(f"{node.tag}({'|'.join(node.parts)})")
            shape = f"{node.name}({'|'.join(s for k, s in enumerate(node.shapes) if not k or s != node.shapes[k - 1])})"
            holder = 2 if node.tag in OPEN else int(node.tag in HOLDERS)
            self.nodes.append((node.number, node.place, hashed(f"{node.place} {shape}"), content, node.depth, holder, node.chars, node.links))
            self.overs.append(node.over)
            if over:
                over.parts.append(f"{node.tag}:{content:x}")
                over.shapes.append(shape if len(shape) < 40 else f"{hashed(shape):x}")

    def close_from(self, k: int) -> None:
        while len(self.stack) > k:
            self.close()

    def last(self, tag: str) -> int:
        """Where the innermost open element of that name stands; 0: nowhere."""
        return at[-1] if (at := self.where.get(tag)) else 0

    def close_to(self, tags) -> None:
        """Closes the innermost open element of these names, unless a scope stands between."""
        k = max(map(self.last, tags))
        if k > self.scopes[-1]:
            self.flush()
            self.close_from(k)

    def end(self, tag: str) -> None:
        k, block = self.last(tag), tag in BLOCKS
        if block:
            self.flush()
        if k and (block or k > self.block_at[-1]):
            if self.stack[k].unseen or self.stack[k].named:
                self.flush()
            self.close_from(k)

    def start(self, tag: str, attributes: str) -> None:
        if tag in SPACED:
            self.run.append(" ")
        if tag in CLOSES_P:
            self.flush()
            self.close_to({"p"})
        if tag in ENDS:
            self.close_to(ENDS[tag])
        if tag in VOID:
            return
        top = self.stack[-1]
        words, hidden, main, name = labels(tag, attributes)
        shielded = tag in ("html", "body", "main") or main
        unseen = top.unseen or tag in UNSEEN or hidden
        named = top.named or tag in DROPPED or (tag == "header" and not top.article)
        comment = top.comment or (not shielded and bool(words & COMMENTS))
        labelled = (top.labelled and tag not in ("article", "main")) or (not shielded and not words & PROSE and bool(words & LABELS or (not top.article and words & OUTSIDE)))
        if (unseen, named, labelled, comment) != (top.unseen, top.named, top.labelled, top.comment):
            self.flush()
        self.count += 1
        article = top.article or (tag == "article" and not (named or comment))
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        if tag in BLOCKS:
            self.block_at.append(len(self.stack))
        self.stack.append(Node(tag, self.count, top, name, unseen=unseen, named=named, labelled=labelled, comment=comment, article=article, main=top.main or main or tag == "main"))

    def read(self, html: str) -> None:
        at, stack = 0, self.stack
        while True:
            m = TOKEN.search(html, at)
            end = m.start() if m else len(html)
            if end > at and not (stack[-1].unseen and stack[-1].tag in RAW):
                text = unescape(html[at:end])
                self.run.append(text)
                if stack[-1].link:
                    self.linked += len(text)
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = found.start() if found else len(html)
        self.flush()
        self.close_from(0)

    def prose(self) -> int:
        """A hash of what neither names nor labels call template: pages that differ elsewhere only are copies."""
        return hashed("\n".join(text for text, _, flags in self.blocks if not flags & (NAMED | LABELLED | COMMENT)))


def parsed(pages: DataFrame) -> DataFrame:
    """FIELDS of every page, written to the shared folder; part and row are those of the writing task."""

    def arrays(lists: list[list[tuple]], kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
        offsets, flat = [0], []
        for rows in lists:
            flat += rows
            offsets.append(len(flat))
        columns = list(zip(*flat, strict=True)) if flat else [()] * len(kinds)
        made = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)

    node_kinds = [("node", pa.int32()), ("place", pa.int64()), ("slot", pa.int64()), ("content", pa.int64()), *((n, pa.int32()) for n in ("depth", "holder", "chars", "links", "first", "fresh"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                nodes, overs, blocks, prose = [], [], [], []
                for x in batch.column(3):
                    page, slots, contents, rows = Page(x.as_py() or ""), set(), set(), []
                    for n in page.nodes:
                        rows.append((*n, int(n[2] not in slots), int(n[3] not in contents)))
                        slots.add(n[2])
                        contents.add(n[3])
                    nodes.append(rows)
                    overs.append(page.overs)
                    blocks.append(tuple(zip(*page.blocks, strict=True)) or ((),) * 3)
                    prose.append(page.prose())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(prose, pa.int64()), arrays(nodes, node_kinds), pa.array(overs, pa.list_(pa.int32())), *[pa.array([b[k] for b in blocks], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]], names=["page_id", "url", "host", "part", "row", "prose", "nodes", "overs", "texts", "homes", "flags"])
                row += n

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_parts(F.col("url"))[0].alias("host"), "html")
    return written(given.mapInArrow(run, FIELDS), "page-trees")


def counted(trees: DataFrame) -> DataFrame:
    """host, place, slot, content and on how many different pages of the host; copies of a page's prose count once."""
    known = trees.select("host", "prose", "part", "row")
    twice = known.groupBy("host", "prose").agg(F.count("*").alias("n"), F.min(F.struct("part", "row")).alias("first")).filter("n > 1").checkpoint()
    again = hot_join(known, twice, ["host", "prose"], "n").filter(F.struct("part", "row") != F.col("first")).select("part", "row").checkpoint()
    each = trees.join(small_side(again, 500_000), ["part", "row"], "left_anti").select("host", F.inline("nodes"))
    sums = [F.count("*").alias("times"), F.sum("first").alias("firsts"), F.sum("fresh").alias("freshes")]
    return written(each.groupBy("host", "place", "slot", "content").agg(*sums, *[F.max(c).alias(c) for c in ("depth", "holder", "chars", "links")]), "page-subtrees")


def site_keys(counts: DataFrame, *, least_pages: int, share: float, share_inside: float, many: int) -> DataFrame:
    """host, key, tells (OUT, ANYWHERE, CONTAINER, SETTLED or OWN), n (pages) of every key that decides something."""
    totals = counts.filter(F.col("place") == ROOT).groupBy("host").agg(F.sum("times").alias("pages"), F.sum("chars").alias("text")).filter(F.col("pages") >= least_pages)
    totals = small_side(totals.checkpoint(), 500_000)
    places = counts.filter("holder > 0").groupBy("host", "place").agg(F.sum("times").alias("n"), F.sum("chars").alias("chars"), F.max("depth").alias("depth"), F.max("holder").alias("holder"))
    heavy = places.join(totals, "host").filter((F.col("n") >= 0.5 * F.col("pages")) & (F.col("chars") >= 0.5 * F.col("text"))).checkpoint()
    deepest = heavy.groupBy("host").agg(F.max(F.struct("depth", "chars", "place", "holder", "n")).alias("c")).filter("c.holder = 1").checkpoint()
    settled = small_side(deepest.select("host"), 500_000)
    light = counts.join(settled, "host").join(small_side(heavy.select("host", "place"), 500_000), ["host", "place"], "left_anti")
    often = lambda n, at_least, of: (F.col(n) >= least_pages) & ((F.col(n) >= of * F.col("pages")) | (F.col(n) >= at_least))
    tells = lambda outside, inside: F.when(inside, ANYWHERE).when(outside, OUT)
    contents = light.groupBy("host", "content").agg(F.sum("freshes").alias("n")).filter(F.col("n") >= least_pages).join(totals, "host")
    inside = F.col("n") >= share_inside * F.col("pages")
    same = contents.select("host", F.col("content").alias("key"), tells(often("n", many, share), inside).alias("tells"), "n")
    slots = light.groupBy("host", "slot").agg(F.sum("firsts").alias("n"), F.count("*").alias("contents"), F.sum("times").alias("times"), F.sum(F.col("times") * F.col("chars")).alias("chars"), F.sum(F.col("times") * F.col("links")).alias("links"), F.max("holder").alias("holder")).filter(F.col("n") >= least_pages).join(totals, "host")
    of_links = F.col("links") >= LINKED * F.col("chars")
    own = (F.col("contents") >= DIFFERENT * F.col("times")) & ~of_links
    shaped = slots.select("host", F.col("slot").alias("key"), tells(often("n", many, share) & ~own, (F.col("n") >= share_inside * F.col("pages")) & (F.col("holder") > 0) & of_links).when(often("n", many, share), OWN).alias("tells"), "n")
    marks = deepest.select("host", F.col("c.place").alias("key"), F.lit(CONTAINER).alias("tells"), F.col("c.n").alias("n")).unionByName(deepest.join(totals, "host").select("host", F.lit(ROOT).cast("long").alias("key"), F.lit(SETTLED).alias("tells"), F.col("pages").alias("n")))
    return same.unionByName(shaped).unionByName(marks).filter("tells IS NOT NULL").groupBy("host", "key").agg(F.max("tells").alias("tells"), F.max("n").alias("n")).checkpoint()


def extract_text(pages: DataFrame, *, least_pages: int = LEAST_PAGES, share: float = SHARE, share_inside: float = SHARE_INSIDE, many: int = MANY, names: bool = True) -> DataFrame:
    """A row a page: page_id, url, text, n_chars; blocks in page order, joined by a line feed.

    Null and empty html give empty text. Pages without a host form one site. Rows that repeat are extracted as often
    as they come. Malformed markup closes where a later tag implies it. On a host with fewer than ``least_pages``
    different pages, or without a container, labels decide. ``names`` off leaves all to the counts (and, on such
    hosts, to labels). Other columns are not looked at; an empty table gives no rows.
    """
    trees = parsed(pages)
    keys = site_keys(counted(trees), least_pages=least_pages, share=share, share_inside=share_inside, many=many)
    pair = lambda key: F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), n[key].alias("key")))
    root = F.array(F.struct(F.lit(0).alias("node"), F.lit(ROOT).cast("long").alias("key")))
    each = trees.select("part", "row", "host", F.inline(F.array_distinct(F.concat(root, pair("place"), pair("slot"), pair("content")))))
    told = hot_join(each, keys, ["host", "key"], "n")
    hits = told.groupBy("part", "row").agg(F.collect_set(F.col("node") * 8 + F.col("tells")).alias("hits")).checkpoint()
    known = trees.select("part", "row", "page_id", "url", F.col("nodes.node").alias("numbers"), "overs", "texts", "homes", "flags").join(small_side(hits, 200_000), ["part", "row"], "left").drop("part", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [page_left(*x, names=names) for x in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return known.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def page_left(numbers: list[int], overs: list[int], texts: list[str], homes: list[int], flags: list[int], hits: list[int] | None, *, names: bool) -> str:
    """The blocks of a page that stay, by the hits (node * 8 + what is told) on its nodes and those above them."""
    told: dict[int, int] = {}
    for hit in hits or ():
        told[hit >> 3] = told.get(hit >> 3, 0) | 1 << (hit & 7)
    gone = COMMENT | (NAMED if names else 0)
    if not told.get(0, 0) & 1 << SETTLED:
        left = [(t, f) for t, f in zip(texts, flags, strict=True) if not f & (gone | LABELLED)]
        size = sum(len(t) for t, _ in left)
        for flag in (MAIN, ARTICLE):
            only = [(t, f) for t, f in left if f & flag]
            if 2 * sum(len(t) for t, _ in only) >= size:
                left = only
                break
        return "\n".join(t for t, _ in left)
    for node, over in sorted(zip(numbers, overs, strict=True)):  # the node above has the smaller number
        if over >= 0 and (above := told.get(over)):
            told[node] = told.get(node, 0) | above
    drops = {n for n, t in told.items() if t & 1 << ANYWHERE or (t & 1 << OUT and not t & 1 << CONTAINER)}
    unsure = {n for n, t in told.items() if t & 1 << OWN and not t & 1 << CONTAINER}
    return "\n".join(t for t, home, f in zip(texts, homes, flags, strict=True) if not (f & gone or home in drops or (f & (NAMED | LABELLED) and home in unsure)))
