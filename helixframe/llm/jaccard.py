"""N-gram Jaccard join: all documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Method (Bayesian candidate pruning).  Texts with the same set of shingles are one class, so copies
never meet each other.  Each class has BANDS * ROWS MinHash values; BANDS groups of ROWS values bring
together classes that agree on a whole group (a pair of similarity 0.8 is missed with probability
(1 - 0.8**ROWS)**BANDS, under one in a million).  Pairs that meet are compared HASHES of the values, a few
at a time; a pair is dropped as soon as the posterior probability (uniform prior) that its similarity
reaches the threshold falls below TOLERANCE.  Classes that surviving pairs tie together are a cluster.  Inside
it every pair is pruned in the same way and what survives is verified exactly, as a product of shingle
incidence matrices; large buckets and clusters are dealt out as pairs of blocks, and no pair is ever a row.

Words are ``[^\\x20\\x09-\\x0D]+`` with ASCII letters as they are.  A text of one to four words has one
shingle, all its words.  Texts without words (null, empty, blank) are like nothing, not even each
other.  Rows with a null doc_id take no part: they have no class and no links.  Every row is judged by its own
text, so rows that share a doc_id and differ in text have links of their own; rows that repeat a doc_id and
its text count as copies of the document.  Very long texts are worked on whole, one at a time.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 4
#: MinHash values that pairs are compared by, and those compared at a time.
HASHES, STEP = 60, 12
TOLERANCE = 1e-6
#: Classes in a block of exact comparison (a 64th of a large cluster, up to the second number), and in a block of a band's bucket.
BLOCK, WIDEST, BUCKET = 256, 2048, 1024
#: Pairs of a bucket that are compared at once.
CHUNK = 1 << 18

_rng = np.random.default_rng(20260101)
_MUL = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * C.U64(2) + C.U64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def posterior(agree: int, of: int, threshold: float = THRESHOLD) -> float:
    """P(similarity >= threshold | agree of ``of`` MinHash values are equal), uniform prior: a Beta(agree+1, rest+1) tail."""
    n = of + 1
    return sum(comb(n, j) * threshold**j * (1 - threshold) ** (n - j) for j in range(agree + 1))


def least_agreement(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest that must be equal."""
    return {n: next(m for m in range(n + 2) if m > n or posterior(m, n, threshold) >= tolerance) for n in range(STEP, HASHES + 1, STEP)}


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (sorted by text, then hash) and the n + 1 offsets."""
    n = len(offs) - 1
    starts, ends, at = C.words_of(buf, offs)
    word = C.range_hash(C.prefix_hash(C.BYTE[buf]), starts, ends)
    count = np.diff(at)
    full = np.maximum(count - WORDS + 1, (count > 0).astype(np.int64))
    first = C.runs_to_rows(at[:-1], full)
    row = np.repeat(np.arange(n), full)
    h = np.full(len(first), C.U64(0x1234567))
    size = np.minimum(count, WORDS)[row]
    padded = np.append(word, np.zeros(WORDS, np.uint64))
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            inside = k < size
            h = np.where(inside, C.mix(h * C.U64(0x9E3779B97F4A7C15) + padded[first + k]), h)
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def signatures(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with shingles; for each two hashes of its whole set, and BANDS * ROWS MinHash values of 32 bits (permutations of either half of a shingle's hash)."""
    full = np.flatnonzero(np.diff(offs) > 0)
    if not len(full):
        return full, np.empty((0, 2), np.uint64), np.empty((0, BANDS * ROWS), np.uint32)
    begin = offs[full]
    out = np.empty((len(full), BANDS * ROWS), np.uint32)
    with np.errstate(over="ignore"):
        whole = np.stack([np.add.reduceat(C.mix(h), begin), np.bitwise_xor.reduceat(C.mix(h + C.U64(99)), begin)], 1)
        halves = (h & C.U64(0xFFFFFFFF)).astype(np.uint32), (h >> C.U64(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            out[:, k] = np.minimum.reduceat(halves[k % 2] * _MUL[k] + _ADD[k], begin)
    return full, whole, out


SKETCH = "doc_id long, th long, k1 long, k2 long, sig binary, bands binary"


def _sketch(batches):
    """Each row with its class key, signature and band keys; these are null for texts without words and rows without an id."""
    for batch in batches:
        buf, offs = C.flat(batch.column("text"))
        known = np.asarray(batch.column("doc_id").is_valid())
        for i, j in C.blocks(offs, 1 << 19):
            h, at = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            full, whole, sig = signatures(h, at)
            keys, short = band_keys(sig), sig[:, :HASHES].astype(np.uint16)
            row = np.full(j - i, -1)
            row[full] = np.arange(len(full))
            row[~known[i:j]] = -1
            none = row < 0
            packed = lambda x: pa.array([None if r < 0 else x[r].tobytes() for r in row], pa.binary())
            key = lambda c: pa.array(whole[row, c].astype(np.int64) if len(full) else np.zeros(len(row), np.int64), mask=none)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), key(0), key(1), packed(short), packed(keys)
                ], names=["doc_id", "th", "k1", "k2", "sig", "bands"]
            )


def _banded(batches):
    """One row for each class and band: the band's key and the class."""
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(C.longs(batch.column("c")), BANDS))], names=["key", "c"])


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(sig), C.U64(b + 1))
            for k in range(ROWS):
                h = C.mix(h * C.U64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + k])
            out[:, b] = h
    return out


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of signatures (rows a and b of sig) are never dropped. Only the values that are compared are fetched, of pairs that are left."""
    left, agree = np.arange(len(a)), np.zeros(len(a), np.int16)
    for n in range(STEP, HASHES + 1, STEP):
        part = np.ascontiguousarray(sig[:, n - STEP : n])
        agree = agree + (part[a[left]] == part[b[left]]).sum(1, dtype=np.int16)
        ok = agree >= least[n]
        left, agree = left[ok], agree[ok]
    return left


def bucket_edges(c: np.ndarray, sig: np.ndarray, least: dict[int, int], side: np.ndarray | None = None) -> np.ndarray:
    """Edges of a spanning forest of the pairs of one bucket (of one side and the other only) that survive the pruning.

    Grows from one class at a time: it is compared with all that are still alone, so a bucket of
    near copies of one text takes few comparisons for each class."""
    left = np.arange(len(c))
    side = np.zeros(len(c), bool) if side is None else side
    two = side.any() and not side.all()
    edges = []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            some = max(1, CHUNK // (len(left) * 4))
            take, reached = np.array(reached[:some]), reached[some:]
            a, b = np.repeat(take, len(left)), np.tile(np.arange(len(left)), len(take))
            if two:
                across = side[a] != side[left[b]]
                a, b = a[across], b[across]
            alive = survivors(sig, a, left[b], least)
            if len(alive):
                b, first = np.unique(b[alive], return_index=True)
                edges.append(np.stack([c[a[alive[first]]], c[left[b]]], 1))
                reached += left[b].tolist()
                left = np.delete(left, b)
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def _bucket_edges(batches):
    """Sorted by key and pair of blocks: rows of one follow each other; batches are joined at their seams."""
    least = least_agreement()
    held: tuple[np.ndarray, ...] | None = None

    def settle(key, x, y, block, c, sig):
        cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        ends = np.append(cuts[1:], len(key))
        out = [
            bucket_edges(c[a:b], sig[a:b], least, block[a:b] != x[a]) for a,
            b in zip(cuts, ends, strict=True) if b - a > 1 and (x[a] == y[a] or len(set(block[a:b].tolist())) == 2)
        ]
        edges = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        now = (
            *(C.longs(batch.column(k)) for k in ("key", "x", "y", "block", "c")),
            np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, HASHES)
        )
        if held is not None:
            now = tuple(np.concatenate(z) for z in zip(held, now, strict=True))
        key, x, y = now[:3]
        other = np.flatnonzero((key != key[-1]) | (x != x[-1]) | (y != y[-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield settle(*(z[:last] for z in now))
        held = tuple(z[last:] for z in now)
    if held is not None and len(held[0]):
        yield settle(*held)


def _verify(table):
    """Links between the classes of one block, or of two, of a cluster: class -> partners (as documents, as texts), and edges."""
    table = table.combine_chunks()
    c, block, n = (C.longs(table.column(k)) for k in ("c", "block", "n"))
    by = np.lexsort((c, block))
    c, block, n = c[by], block[by], n[by]
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(by), HASHES)[by]
    first = np.flatnonzero(block == block[0])
    two = len(first) < len(c)
    left, right = (first, np.setdiff1d(np.arange(len(c)), first)) if two else (first, first)
    alive, least = np.zeros((len(left), len(right)), bool), least_agreement()
    for i in range(0, len(left), max(1, CHUNK // (4 * len(right)))):
        some = left[i : i + max(1, CHUNK // (4 * len(right)))]
        a, b = np.repeat(some, len(right)), np.tile(right, len(some))
        alive[i : i + len(some)].reshape(-1)[survivors(sig, a, b, least)] = True
    if not two:
        np.fill_diagonal(alive, False)
    used = np.unique(np.concatenate([left[alive.any(1)], right[alive.any(0)]]))  # only these are verified
    buf, offs = C.flat(table.column("text").take(pa.array(by[used])))
    h, at = shingles(buf, offs)
    size = np.zeros(len(c))
    size[used] = np.diff(at)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), np.diff(at))
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    lpos, rpos = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    lrow, rrow = np.searchsorted(used, left[lpos]), np.searchsorted(used, right[rpos])
    inter, width = np.zeros((len(lpos), len(rpos))), (1 << 24) // max(len(used), 1 << 11)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(used), min(width, int(column[b - 1]) - lo + 1)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        inter += m[lrow] @ m[rrow].T
    # |A & B| / (|A| + |B| - |A & B|) >= 4/5, in whole numbers
    like = alive
    like[np.ix_(lpos, rpos)] &= 5 * inter >= 4 * (size[left[lpos]][:, None] + size[right[rpos]][None, :] - inter)
    docs, texts = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    docs[left] += like @ n[right]
    texts[left] += like.sum(1)
    if two:
        docs[right] += like.T @ n[left]
        texts[right] += like.sum(0)
    # a forest of the links, so that edges grow with the classes
    a, b = forest(like, left, right, len(c))
    k = np.flatnonzero(texts)
    zero = np.zeros(len(a), np.int64)
    return pa.table({
        "c": np.concatenate([c[k], c[a]]), "other": np.concatenate([c[k], c[b]]),
        "docs": np.concatenate([docs[k], zero]), "texts": np.concatenate([texts[k], zero]),
    })


def forest(like: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links, by breadth-first search."""
    full = np.zeros((n, n), bool)
    full[np.ix_(left, right)] = like
    full |= full.T
    alone = np.ones(n, bool)
    a, b = [], []
    for start in range(n):
        if not alone[start]:
            continue
        alone[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(full[x] & alone)
            alone[new] = False
            a += [x] * len(new)
            b += new.tolist()
            queue += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _block_pairs(rows: DataFrame, name: str, blocks) -> DataFrame:
    """Each row once for every pair (x, y) of ``blocks`` blocks that holds its own, which is chosen by hash of ``name``."""
    own = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(name), F.col("blocks")).cast("int"))
    met = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"x": F.least("block", "with"), "y": F.greatest("block", "with")}).drop("with", "blocks")


def _judged(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, th (a hash of its text) and the other columns of ``jaccard_join``."""
    n = C.partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    sketch = C.cut(slim.mapInArrow(_sketch, SKETCH), "sketch")
    grouped = sketch.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = C.cut(grouped.select("k1", "k2", "rep.doc_id", "rep.th", "n", "sig", "bands", F.monotonically_increasing_id().alias("c")), "classes")
    many, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    banded = classes.select("c", "bands").mapInArrow(_banded, "key long, c long")
    live = C.cut(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "bands")
    met = C.join_each(banded, live, "key", many * BANDS, "m").join(classes.select("c", "sig"), "c")
    dealt = _block_pairs(met, "c", F.ceil(F.col("m") / F.lit(BUCKET))).select("key", "x", "y", "block", "c", "sig")
    edges = dealt.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_bucket_edges, "a long, b long")
    edges = C.cut(edges, "edges")
    clusters = C.cut(components(edges).withColumnRenamed("node", "c"), "clusters")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m"))
    member = C.join_each(clusters, sizes, "root", many, "m").join(classes.select("c", "n", "doc_id", "th", "sig"), "c")
    # one text for each class: rows that repeat it are alike
    texts = slim.join(member.select("c", "doc_id", "th"), ["doc_id", "th"]).select("c", "text").dropDuplicates(["c"])
    held = _block_pairs(member.select("root", "c", "n", "m", "sig").join(texts, "c"), "c", F.ceil(F.col("m") / F.least(F.greatest(F.col("m") / 64, F.lit(BLOCK)), F.lit(WIDEST))))
    found = C.cut(
        held.select("root", "x", "y", "block", "c", "n", "sig", "text").groupBy("root", "x", "y").applyInArrow(
            _verify, "c long, other long, docs long, texts long"
        ),
        "links"
    )
    linked = found.groupBy("c").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    roots = C.cut(components(found.where("c <> other").select(F.col("c").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "c"), "roots")
    least = roots.join(classes.select("c", "doc_id"), "c").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("m"))
    named = C.join_each(roots, least, "root", many, "m").select("c", "class_id")
    about = classes.select("k1", "k2", "c", "n", F.col("doc_id").alias("text_id")).join(linked, "c", "left").join(named, "c", "left").select(
        "k1",
        "k2",
        "n",
        F.coalesce("class_id", "text_id").alias("class_id"),
        "text_id",
        (F.coalesce("docs", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
    )
    rows = sketch.select("doc_id", "th", "k1", "k2")
    worded = C.join_each(rows.where("k1 is not null"), about, ["k1", "k2"], total, "n").select("doc_id", "th", "class_id", "text_id", "n_links", "n_texts")
    zero = F.lit(0).cast("long")
    none = rows.where("k1 is null").select(
        "doc_id", "th", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"), zero.alias("n_links"), zero.alias("n_texts")
    )
    return worded.unionByName(none)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored):

    doc_id; class_id, the smallest doc_id that links lead to (its own if there are none); text_id, the
    smallest doc_id with the same set of shingles; n_links, other documents at or above the threshold
    (copies count); n_texts, those of them that count once for each different set of shingles."""
    return _judged(docs).drop("th")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of linked documents the one with the smallest doc_id.

    Rows without an id, and texts without words, stay; rows that repeat an id and its text stay or go together."""
    joined = _judged(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("__jaccard_id"), F.col("th").alias("__jaccard_th"))
    keyed = docs.withColumns({"__jaccard_id": F.col("doc_id").cast("long"), "__jaccard_th": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return C.without(keyed, joined, ["__jaccard_id", "__jaccard_th"]).select(*docs.columns)


OP8_SQL = f"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end)) as s from d
), named as (
  select doc_id, s, md5(array_to_string(s, chr(10))) as k from sets
), classes as (
  select k, min(doc_id) as c, count(*) as n, any_value(s) as s, len(any_value(s)) as size from named where len(s) > 0 group by k
), rows_ as (
  select c, size, unnest(s) as shingle from classes
), common as (
  select a.c as a, b.c as b, a.size as na, b.size as nb, count(*) as both_ from rows_ a join rows_ b on a.shingle = b.shingle and a.c <> b.c group
    by all
), links as (
  select a, b from common where 5 * both_ >= 4 * (na + nb - both_)
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), roots as (
  select a as c, least(a, min(b)) as class_id from reach group by a
), counted as (
  select l.a as c, sum(o.n)::bigint as docs, count(*) as texts from links l join classes o on o.c = l.b group by l.a
)
select n.doc_id, coalesce(r.class_id, c.c, n.doc_id) as class_id, coalesce(c.c, n.doc_id) as text_id,
  (coalesce(t.docs, 0) + coalesce(c.n - 1, 0))::bigint as n_links, coalesce(t.texts, 0)::bigint as n_texts
from named n left join classes c on c.k = n.k and len(n.s) > 0 left join roots r using (c) left join counted t using (c)
"""


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
