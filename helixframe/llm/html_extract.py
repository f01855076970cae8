"""HTML main-text extraction with a site style tree.

Each page is parsed into a tree of block elements; an element's node is its style path, the tags and classes (without
digits) from the root down, and the pages of a host are merged by node.  Elements nested deeper than DEPTH belong to
the node of that depth.

Importance.  A node's features are the words of its own text; over the pages of the host that hold the node, a
feature of entropy H (in units of the log of the pages: 1 if it is on every page, 0 if it is on one only) carries 1 - H.
The information of a node is the sum of what its features, and those of the nodes below it, carry on a page
that holds it; its share is its part of its parent's.  The presentation importance of a node is the entropy of its
sequences of children, in the same units.  A node's importance is share * (1 + presentation) / 2.  A block element with at least
DOMINANT of its parent's information is where the main text is; where there is one, its siblings whose importance is under
LOW are removed with all they hold, and the same is decided inside it.  A content node (a node with a certain text)
whose entropy is within LOW_CONTENT of 1, which nearly every page of the host repeats, is removed anywhere.
Pages with the same blocks are copies and count once.  Hosts of fewer than MIN_PAGES different pages have no tree.

Priors.  Elements that say what they are (navigation, footers, forms, adverts, comments, ... by tag, role, class or
id) are dropped whatever the tree says; if there is an ``article`` (else a ``main``) only its inside counts, and the tree
removes none of its plain prose; headings and paragraphs outside stay unless they are repeated.
``extract(pages, priors=False)`` is the tree alone.

Scale.  Pages are parsed once, into a written table.  Counts are made in each task and combine before
the shuffle; a node's words are dealt out by node and word, packed, so a hot host fills no task.  What the tree removes is
a few rows for each host; they are broadcast if they are at most BROADCAST rows, which is checked; otherwise pages get
their host's by a join that deals out hot hosts.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by two newlines; ``br`` is white space.  Null or empty html gives an empty text; null
urls share the host ''.  Repeated rows, also of one page_id, each give a row.  Broken markup never fails: what cannot be
a tag is text, and open elements end with the page.
"""

from __future__ import annotations

import html as H
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LOW, DOMINANT, LOW_CONTENT = 0.1, 0.5, 0.25
MIN_PAGES, BROADCAST, DEPTH = 12, 1_000_000, 64

# HTML's elements by how they are laid out, and words that name what is not the article.
UNSEEN = frozenset("script style noscript template link meta input param source track".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROP_TAGS = frozenset(
    "head nav footer aside form script style noscript iframe template svg math canvas button select option input textarea menu dialog object embed video audio map title".split()
)
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus submenu footer "
    "sidebar sidebars aside widget widgets breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login signin search searchbox share sharing social related recommended recommendations comment comments commentlist disqus "
    "respond reply replies discussion masthead toolbar topbar skip form".split()
)
HEADER_WORDS = frozenset("header heading-bar sitehead siteheader".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An element of the left ends an open one of the right before it begins.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")
}
SCOPE = frozenset("ul ol dl table article section main body html div td th nav aside footer header form".split())

#: Elements of plain text, which the tree does not remove for their small share where priors hold.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption table".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: Flags of an element: of plain text; an article, a main or around one.
PLAIN, AROUND = 1, 2
#: Flags of a block: dropped by a prior; inside a main, an article.
DROPPED, MAIN, ARTICLE = 1, 2, 4
_MASK = (1 << 64) - 1


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()



def _described(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element's style label, and whether it names something that is not the article."""
    label, drop = tag, tag in DROP_TAGS or tag == "header" and not inside
    if attributes and "=" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            name = name.lower()
            if name == "role":
                drop |= value in DROP_ROLES
                continue
            words = set(_WORDS.split(value))
            drop |= not words.isdisjoint(DROP_WORDS) or not inside and not words.isdisjoint(HEADER_WORDS)
            if name == "class":
                label += "." + ".".join(sorted(_DIGITS.sub("", value).split()))
    if drop and tag in ("html", "body", "article", "main"):
        drop = False
    return label, drop


class Page:
    """A parsed page: its elements in order (path, style, parent, flags; the first is the root) and blocks of text (element, text, flags)."""

    def __init__(self, page: str | None):
        self.path, self.style, self.parent, self.flags = [1], [0], [0], [AROUND]
        self.blocks: list[tuple[int, str, int]] = []
        self._last = [""]
        self._read(page or "")

    def _element(self, parent: int, tag: str, label: str, attributes: str) -> int:
        h = xxhash.xxh64_intdigest(label)
        if self._last[parent] != label:  # a run of like children counts once
            self.style[parent] = (self.style[parent] * 0x9E3779B97F4A7C15 + h) & _MASK
            self._last[parent] = label
        self.path.append((self.path[parent] * 0xD6E8FEB86659FD93 + h) & _MASK)
        self.style.append(0)
        self.parent.append(parent)
        self.flags.append(PLAIN if tag in PROSE and label == tag else 0)
        self._last.append("")
        return len(self.path) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int, bool, int]] = []  # tag, element, depth, dropped, inside
        open_: dict[str, int] = {}
        text: list[str] = []
        hidden: list[str] = []  # of dropped inline elements
        where = (0, False, 0)  # of the text that is being gathered
        element, depth, dropped, inside = 0, 0, False, 0

        def flush():
            for pieces, gone in ((text, where[1]), (hidden, True)):
                if pieces:
                    t = " ".join(H.unescape("".join(pieces)).split())
                    if t:
                        self.blocks.append((where[0], t, DROPPED * gone | (MAIN if where[2] == 1 else ARTICLE if where[2] else 0)))
                    pieces.clear()

        def pop(k: int):
            for tag, *_ in stack[k:]:
                open_[tag] -= 1
            del stack[k:]

        at, scan = 0, _TOKEN.match
        while at < len(page):
            m = scan(page, at)
            at = m.end()
            tag = m.group(2)
            if tag is None:
                piece = m.group(0)
                if piece[0] != "<" or len(piece) == 1:
                    if not text and not hidden:
                        where = (element, dropped, inside)
                    (hidden if dropped and not where[1] else text).append(piece)
                continue
            tag = tag.lower()
            if tag == "br" or tag == "wbr":
                if text and tag == "br":
                    text.append(" ")
                continue
            inline = tag in INLINE or tag in UNSEEN
            if m.group(1):  # an end tag
                if not inline:
                    flush()
                for k in range(len(stack) - 1, -1, -1) if open_.get(tag) else ():
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if inline and stack[k][0] not in INLINE:
                        break
                _, element, depth, dropped, inside = stack[-1] if stack else ("", 0, 0, False, 0)
                continue
            if not inline:
                flush()
            if tag in CLOSES_P and open_.get("p"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            for k in range(len(stack) - 1, -1, -1) if tag in ENDS else ():
                if stack[k][0] in ENDS[tag]:
                    pop(k)
                    break
                if stack[k][0] in SCOPE:
                    break
            _, element, depth, dropped, inside = stack[-1] if stack else ("", 0, 0, False, 0)
            if tag in VOID:
                continue
            label, drop = _described(tag, m.group(3), inside > 0)
            if tag in RAW:
                end = _end_of(tag).search(page, at)
                at = end.end() if end else len(page)
                continue
            dropped = dropped or drop
            if not inline:
                if depth < DEPTH:
                    element = self._element(element, tag, label, m.group(3))
                depth += 1
                if not dropped and tag in ("article", "main"):
                    inside = max(inside, 2 if tag == "article" else 1)
                    up = element
                    while not self.flags[up] & AROUND:
                        self.flags[up] |= AROUND
                        up = self.parent[up]
            stack.append((tag, element, depth, dropped, inside))
            open_[tag] = open_.get(tag, 0) + 1
        flush()

    def pack(self) -> bytes:
        n = len(self.path)
        return b"".join(
            (
                np.int64(n).tobytes(), np.array(self.path, np.uint64).tobytes(), np.array(self.style, np.uint64).tobytes(),
                np.array(self.parent, np.int32).tobytes(), np.array(self.flags, np.uint8).tobytes()
            )
        )


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(style path, text) of each block that the priors alone leave of a page, in order."""
    found = Page(page)
    inside = [0 if k & DROPPED else k & (MAIN | ARTICLE) for _, _, k in found.blocks]
    return [(found.path[e], t) for (e, t, k), i in zip(found.blocks, inside, strict=True) if not k & DROPPED and i >= max(inside)]


def _end_of(tag: str):
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    """path, style, parent, flags of a page's elements."""
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8
    for kind in (np.uint64, np.uint64, np.int32, np.uint8):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return tuple(out)


PARSED = "uid long, page_id long, url string, host long, same long, nodes binary, texts array<string>, places array<int>, kinds array<int>"


def _parse(batches):
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 36
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for whole in batches:
        for k in range(0, whole.num_rows, 200):  # pages that are held at once
            batch = whole.slice(k, 200)
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(html)
                places, texts, kinds = zip(*page.blocks, strict=True) if page.blocks else ((), (), ())
                rows.append(
                    (
                        uid, signed(xxhash.xxh64_intdigest(host_of(url))), signed(xxhash.xxh64_intdigest("\0".join(texts))), page.pack(), texts,
                        places, kinds
                    )
                )
                uid += 1
            uids, host, same, nodes, texts, places, kinds = zip(*rows, strict=True)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uids, pa.int64()), batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(host, pa.int64()), pa.array(same, pa.int64()), pa.array(
                        nodes, pa.binary()
                    ),
                    pa.array(texts, pa.list_(pa.string())), pa.array(places, ints), pa.array(kinds, ints),
                ],
                names=[c.split(" ")[0] for c in PARSED.split(", ")],
            )


def parsed(pages: DataFrame) -> DataFrame:
    """Each row of pages (page_id, url, html) with its elements and blocks: PARSED, written once."""
    return C.cut(pages.select("page_id", "url", "html").mapInArrow(_parse, PARSED), "parsed", "zstd")


def node_ids(host: np.ndarray, path: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix(host.astype(np.uint64) * C.U64(0x9FB21C651E98DF25) + path)


def text_ids(node: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A content node: a node with a certain text."""
    with np.errstate(over="ignore"):
        return C.mix(node * C.U64(0xA24BAED4963EE407) + text)


class Nodes:
    """The elements and blocks of a batch of parsed pages in flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        host = C.longs(batch.column("host"))
        parts = [unpack(x) for x in batch.column("nodes").to_pylist()]
        n = np.array([len(p[0]) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.page = np.repeat(np.arange(len(n)), n)
        path, self.style, parent, self.flags = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.host = host
        self.id = node_ids(host[self.page], path)
        self.parent = parent + self.first[:-1][self.page]
        texts = batch.column("texts")
        per = np.diff(np.asarray(texts.offsets))
        self.block_page = np.repeat(np.arange(len(n)), per)
        self.block_first = np.concatenate([[0], np.cumsum(per)])
        self.block_at = np.asarray(batch.column("places").flatten()).astype(np.int64) + self.first[:-1][self.block_page]
        self.block_kind = np.asarray(batch.column("kinds").flatten())
        self.texts = texts.flatten()
        self.buf, self.offs = C.flat(self.texts)
        self.block_text = C.range_hash(C.prefix_hash(C.BYTE[self.buf]), self.offs[:-1], self.offs[1:])


ELEMENT, STYLE, UNDER, CONTENT, HOST, WORDS = range(6)
TALLY = "kind int, a long, b long, c long, n long, flag int, names binary, words binary"
_COLUMNS = [c.split(" ")[0] for c in TALLY.split(", ")]
WORD_BITS = C.U64((1 << 40) - 1)  # of a word's hash, which only counts


def _summed(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows with equal keys as one, the last column added up."""
    *keys, n = map(np.concatenate, zip(*rows, strict=True))
    if not len(n):
        return *keys, n
    by = np.lexsort(keys[::-1])
    keys, n = [k[by] for k in keys], n[by]
    at = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    return *(k[at] for k in keys), np.add.reduceat(n, at)


def _once(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different rows, each counted once."""
    *keys, n = _summed([(*keys, np.ones(len(keys[0]), np.int64))])
    return *keys, np.ones_like(n)


def _page_counts(x: Nodes) -> dict[int, tuple[np.ndarray, ...]]:
    """For each kind of count its keys and a last column of pages or times, of a batch of pages."""
    real = np.flatnonzero(np.arange(len(x.id)) != x.parent)
    parent = x.id[x.parent]
    holds = np.zeros(len(x.id), np.uint64)  # has an element below it
    holds[x.parent[real]] = 1
    out = {}
    _, *element = _once(x.page.astype(np.uint64), x.id, parent, x.host[x.page].astype(np.uint64), holds)
    out[ELEMENT] = tuple(element)
    out[STYLE] = (x.id, x.style, np.ones(len(x.id), np.int64))
    leaf = x.id[x.block_at]
    pairs, at, live = [], x.block_at, np.arange(len(x.block_at))
    while len(live):
        pairs.append((leaf[live], x.id[at]))
        up = x.parent[at]
        live, at = live[up != at], up[up != at]
    out[UNDER] = _once(*map(np.concatenate, zip(*pairs, strict=True))) if pairs else (leaf, leaf, np.empty(0, np.int64))
    page = x.block_page.astype(np.uint64)
    _, *content = _once(page, text_ids(leaf, x.block_text), x.host[x.block_page].astype(np.uint64))
    out[CONTENT] = tuple(content)
    out[HOST] = (x.host.astype(np.uint64), np.ones(len(x.host), np.int64))
    starts, ends, at = C.words_of(x.buf, x.offs)
    word = C.range_hash(C.prefix_hash(C.BYTE[x.buf]), starts, ends) & WORD_BITS
    block = np.repeat(np.arange(len(leaf)), np.diff(at))
    names, number = np.unique(leaf, return_inverse=True)  # a page and a node as one number: the sort has two keys
    place = (page * C.U64(len(names) + 1) + number.astype(np.uint64))[block]
    place, word, one = _once(place, word)
    out[WORDS] = (names[(place % C.U64(len(names) + 1)).astype(np.int64)], word, one) if len(names) else (leaf, word, one)
    return out


def _tally(n: int):
    """Counts of a task's pages (TALLY); words in packs by bucket (in c)."""

    def flushed(held: dict[int, list]):
        for kind, parts in held.items():
            if kind == WORDS:
                continue
            keys = _summed(parts)
            size = len(keys[0])
            column = lambda k: keys[k].astype(np.int64) if k < len(keys) - 1 else np.zeros(size, np.int64)
            arrays = [np.full(size, kind, np.int32), column(0), column(1), column(2), keys[-1].astype(np.int64), column(3).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary())], names=_COLUMNS)
        node, word, count = _summed(held[WORDS])
        bucket = (C.mix(node ^ word) % C.U64(n)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(n + 1))
        full = np.flatnonzero(np.diff(ends))
        names_of, packs = [], []
        for i in full:
            own = by[ends[i] : ends[i + 1]]  # sorted by node and word, so steps from word to word are small
            names, at = np.unique(node[own], return_inverse=True)
            names_of.append(C.pack(node=names))
            packs.append(C.pack(at=at.astype(np.uint32), step=np.diff(word[own], prepend=C.U64(0)), count=count[own].astype(np.uint32)))
        size = len(full)
        zero = pa.array(np.zeros(size, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, WORDS, np.int32)), zero, zero, pa.array(full.astype(np.int64)), zero, pa.array(np.zeros(size, np.int32)),
                pa.array(names_of, pa.binary()), pa.array(packs, pa.binary())
            ], names=_COLUMNS
        )

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for k in range(0, batch.num_rows, 200):
                for kind, columns in _page_counts(Nodes(batch.slice(k, 200))).items():
                    held.setdefault(kind, []).append(columns)
                    size += len(columns[0])
            if size > 8_000_000:
                held = {kind: [_summed(parts)] for kind, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 4_000_000:
                    yield from flushed(held)
                    held, size = {}, 0
        if held:
            yield from flushed(held)

    return run


def _word_sums(batches):
    """For each node its words' pages and what their entropies take away, of one bucket of nodes and words."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, names, words in zip(batch.column("c").to_pylist(), batch.column("names").to_pylist(), batch.column("words").to_pylist(), strict=True):
            held.setdefault(bucket, []).append((names, words))
    for bucket in list(held):
        parts = []
        for names, words in held.pop(bucket):
            w = C.unpack(words, at="<u4", step="<u8", count="<u4")
            parts.append((C.unpack(names, node="<u8")["node"][w["at"]], np.cumsum(w["step"], dtype=np.uint64), w["count"].astype(np.int64)))
        node, _, pages = _summed(parts)
        at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(node[at].astype(np.int64)), pa.array(np.add.reduceat(pages, at)), pa.array(np.add.reduceat(pages * np.log(pages), at))
            ], names=["node", "found", "lost"]
        )


def style_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged tree of each host, from ``parsed`` rows: node, parent, host, pages, holds (an element below it), information of a page, presentation.

    Also all counts, and the hosts with their different pages (MIN_PAGES at least, as for the tree)."""
    n = C.partitions(rows.sparkSession)
    first = rows.groupBy("host", "same").agg(F.min("uid").alias("kept"), F.count("*").alias("m")).where("m > 1")
    copies = C.join_each(rows.select("host", "same", "uid"), first, ["host", "same"], rows.count(), "m").where("uid <> kept").select("uid")
    copies = C.cut(copies, "copies")
    if copies.limit(BROADCAST + 1).count() <= BROADCAST:  # else pages are shuffled for them
        copies = F.broadcast(copies)
    tally = C.cut(
        rows.join(copies, "uid", "left_anti").select(
            "host", "nodes", "texts", "places"
        ).withColumn("kinds", F.col("places")).mapInArrow(_tally(n), TALLY),
        "tally", "zstd"
    )
    hosts = tally.where(f"kind = {HOST}").groupBy(F.col("a").alias("host")).agg(F.sum("n").alias("m")).where(F.col("m") >= MIN_PAGES)
    elements = tally.where(f"kind = {ELEMENT}").groupBy(F.col("a").alias("node")).agg(
        F.min("b").alias("parent"), F.min("c").alias("host"), F.sum("n").alias("pages"), F.max("flag").alias("holds")
    )
    elements = elements.join(hosts.select("host"), "host", "left_semi")
    styles = tally.where(f"kind = {STYLE}").groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy(F.col("a").alias("node")).agg(
        F.sum("n").alias("times"), F.sum(F.col("n") * F.log("n")).alias("lost")
    )
    presentation = F.when(F.col("times") > 1, (F.log("times") - F.col("lost") / F.col("times")) / F.log("times")).otherwise(F.lit(1.0))
    words = tally.where(f"kind = {WORDS}").select("c", "names", "words").repartition(n, "c").mapInArrow(_word_sums, "node long, found long, lost double")
    words = words.groupBy("node").agg(F.sum("found").alias("found"), F.sum("lost").alias("lost")).join(elements.select("node", "pages"), "node")
    carried = words.select(
        F.col("node").alias("a"), (F.col("found") - F.when(F.col("pages") > 1, F.col("lost") / F.log("pages")).otherwise(F.lit(0.0))).alias("carried")
    )
    under = tally.where(f"kind = {UNDER}").select("a", "b").distinct()
    whole = under.join(carried, "a").groupBy(F.col("b").alias("node")).agg(F.sum("carried").alias("carried"))
    tree = elements.join(whole, "node", "left").join(styles.select("node", presentation.alias("presentation")), "node")
    tree = tree.select("node", "parent", "host", "pages", "holds", (F.coalesce("carried", F.lit(0.0)) / F.col("pages")).alias("information"), "presentation")
    return C.cut(tree, "tree"), tally, hosts


MAIN_NODE, LOW_NODE, LOW_TEXT = 1, 2, 3


def decisions(rows: DataFrame) -> DataFrame:
    """host, id, what: the nodes where the main text is, the nodes that go, and the content nodes that go."""
    tree, tally, hosts = style_tree(rows)
    above = tree.select(F.col("node").alias("parent"), F.col("information").alias("outer"))
    shared = tree.where("node <> parent").join(above, "parent").withColumn(
        "share", F.when(F.col("outer") > 0, F.col("information") / F.col("outer")).otherwise(F.lit(0.0))
    )
    main = shared.where((F.col("share") >= DOMINANT) & (F.col("holds") == 1))
    inside = main.select("parent").distinct()
    low = shared.join(inside, "parent", "left_semi").where(
        (F.col("share") * (1 + F.col("presentation")) / 2 < LOW) & ((F.col("share") < DOMINANT) | (F.col("holds") == 0))
    )
    texts = tally.where(f"kind = {CONTENT}").groupBy(F.col("a").alias("id"), F.col("b").alias("host")).agg(F.sum("n").alias("c")).where("c > 1")
    often = C.salted_join(texts, hosts, "host", texts.count(), "id", C.partitions(rows.sparkSession)).where(1 - F.log("c") / F.log("m") < LOW_CONTENT)
    what = lambda df, k: df.select("host", "id", F.lit(k).alias("what"))
    found = what(main.withColumnRenamed("node", "id"), MAIN_NODE).unionByName(
        what(low.withColumnRenamed("node", "id"), LOW_NODE)
    ).unionByName(what(often, LOW_TEXT))
    out = C.cut(found, "low-nodes")
    C.forget(tree)
    C.forget(tally)
    return out


def _kept(x: Nodes, ids: np.ndarray, what: np.ndarray, priors: bool) -> np.ndarray:
    """Which blocks of a batch of pages stay. ids: sorted, with what is decided for each."""

    def is_(names: np.ndarray, kind: int) -> np.ndarray:
        if not len(ids):
            return np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
        return (ids[at] == names) & (what[at] == kind)

    main, low = is_(x.id, MAIN_NODE), is_(x.id, LOW_NODE)
    if priors:
        low &= x.flags == 0
    gone, chain = np.zeros(len(x.id), bool), np.zeros(len(x.id), bool)
    chain[x.first[:-1]] = True
    if low.any():
        g, c = gone.tolist(), chain.tolist()
        for k, (up, is_main, is_low) in enumerate(zip(x.parent.tolist(), main.tolist(), low.tolist(), strict=True)):
            if up != k:
                g[k] = g[up] or (c[up] and is_low)
                c[k] = c[up] and is_main
        gone = np.array(g, bool)
    leaf, kind = x.block_at, x.block_kind
    stay = ~gone[leaf]
    repeated = is_(text_ids(x.id[leaf], x.block_text), LOW_TEXT)
    if not priors:
        return stay & ~repeated
    inside = kind & (MAIN | ARTICLE)
    best = np.zeros(len(x.first) - 1, np.int64)
    np.maximum.at(best, x.block_page, np.where(kind & DROPPED, 0, inside))
    plain = (inside > 0) & (x.flags[leaf] & PLAIN > 0)
    return (kind & DROPPED == 0) & (inside >= best[x.block_page]) & (plain | ~repeated) & ((inside > 0) | stay)


OUT = "page_id long, url string, text string, n_chars long"


def _texts(batch: pa.RecordBatch, ids: np.ndarray, what: np.ndarray, priors: bool) -> pa.RecordBatch:
    x = Nodes(batch)
    stay = _kept(x, ids, what, priors)
    blocks = x.texts.to_pylist()
    out = [
        "\n\n".join(t for t, s in zip(blocks[i:j], stay[i:j].tolist(), strict=True) if s) for i,
        j in zip(x.block_first[:-1].tolist(), x.block_first[1:].tolist(), strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
        names=["page_id", "url", "text", "n_chars"]
    )


def _sorted(ids: list[int], what: list[int]) -> tuple[np.ndarray, np.ndarray]:
    names = np.array(ids, np.int64).astype(np.uint64)
    by = np.argsort(names)
    return names[by], np.array(what, np.uint8)[by]


def extract(pages: DataFrame, priors: bool = True) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars. Without ``priors`` the tree alone decides."""
    spark = pages.sparkSession
    rows = parsed(pages)
    low = decisions(rows)
    columns = ["page_id", "url", "host", "nodes", "texts", "places", "kinds"]
    if low.limit(BROADCAST + 1).count() <= BROADCAST:
        got = low.select("id", "what").toArrow()
        shared = spark.sparkContext.broadcast(_sorted(got["id"].to_pylist(), got["what"].to_pylist()))

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 200):
                    yield _texts(batch.slice(k, 200), *shared.value, priors)

        return rows.select(*columns).mapInArrow(run, OUT)
    return by_join(rows.select("uid", *columns), low, priors)


def by_join(rows: DataFrame, low: DataFrame, priors: bool) -> DataFrame:
    """Beyond the broadcast's bound: each page gets its host's decisions through a join that deals out hot hosts."""
    by_host = low.groupBy("host").agg(F.collect_list("id").alias("ids"), F.collect_list("what").alias("whats"))
    every = rows.select("host").distinct().join(by_host, "host", "left")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield _texts(one, *_sorted(one.column("ids")[0].as_py() or [], one.column("whats")[0].as_py() or []), priors)

    met = C.salted_join(rows, every, "host", rows.count(), "uid", C.partitions(rows.sparkSession))
    return met.select("page_id", "url", "host", "nodes", "texts", "places", "kinds", "ids", "whats").mapInArrow(run, OUT)


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
