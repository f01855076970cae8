"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a context tree over the DEPTH bytes before it.
A node (context, bits of the byte so far) holds the counts of zeros and ones that followed it in the
training texts; its Krichevsky-Trofimov estimate is mixed with its children's by the weight that
context-tree weighting gives them, P_w = (KT + product of the children's P_w) / 2, from the deepest
contexts to the empty one.  The weights come from block probabilities of all the training data, and a
text is scored by the final tree: the probability of a decision is w * KT + (1 - w) * (that of the
next longer context), and the code length is the sum over decisions.

The text that is scored is the canonical one: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, each
followed by a space, and a final end byte (0), so it is a distribution over sequences of tokens.

Training counts are gathered from every training text: each task counts its distinct grams of
DEPTH + 1 bytes, which are then summed over tasks and dealt out by the two nearest context bytes, so
each part holds whole subtrees and mixes them with all their counts.  Every node is kept: the model is
the written table of grams and grows with the input.  Only the nodes of depth 0 and 1 (at most 65,535,
whatever the input) are collected and broadcast.  Texts are written once, in chunks of about CHUNK
bytes; a chunk's distinct grams go to the parts that hold their subtrees, and what they cost comes
back to the chunk.

The base score needs each word's training count.  Words are far too many to broadcast: each task
packs its words by bucket of their hash, each bucket sums the counts and returns each row's part of
the sum, and the parts meet by row.

Every row gets one row, repeated rows too; null or empty texts have one token, the end.  Rows with
a null doc_id have no remainder: they are scored, not learnt from, and held_out is true.  Without
training texts every decision costs one bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH = 5
BLOCK = 1 << 20  # bytes of text that are worked on at once
CHUNK = 8 << 20  # bytes of text whose distinct grams are asked for together
ASKED = 1_000_000  # grams that a part looks up at once
END = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def canonical(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as words with a space after each and an end byte; n + 1 offsets."""
    starts, ends, at = C.words_of(buf, offs)
    size = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(size)])
    n = len(offs) - 1
    new = total[at] + np.arange(n + 1)
    out = np.full(int(new[-1]), 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(at))
    first = total[:-1] + row
    out[C.runs_to_rows(first, size - 1)] = _LOWER[buf[C.runs_to_rows(starts, size - 1)]]
    out[new[1:] - 1] = END
    return out, new


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte: itself in the low byte, the bytes before it above it, nearest lowest; END before a text."""
    padded = np.zeros(len(data) + DEPTH, np.uint8)
    n = len(offs) - 1
    key = data.astype(np.uint64)
    since = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs)) if n else np.empty(0, np.int64)
    padded[DEPTH:] = data
    for d in range(1, DEPTH + 1):
        before = padded[DEPTH - d : len(padded) - d].astype(np.uint64)
        key |= np.where(since >= d, before, C.U64(END)) << C.U64(8 * d)
    return key


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(keys) else counts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series after shifting the argument above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - 2 * 0.5723649429247001


@dataclass
class Tree:
    """For each depth: sorted node keys (context and bit prefix), P(one) by KT, and the weight of stopping there.

    In double precision, so that 1 - P(one) is not lost beside counts of up to some 10**14."""

    keys: list[np.ndarray]
    one: list[np.ndarray]
    stop: list[np.ndarray]


def node_key(gram: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """The context's bytes above, and below them the byte's first ``bit`` bits with a leading one (1 .. 255)."""
    prefix = ((gram & C.U64(255)) | C.U64(256)) >> C.U64(8 - bit)
    context = (gram >> C.U64(8)) & C.U64((1 << (8 * depth)) - 1)
    return (context << C.U64(8)) | prefix


def parent_key(key: np.ndarray, depth: int) -> np.ndarray:
    """The node of ``depth`` above a node one deeper: without the byte that is farthest away."""
    return ((key >> C.U64(8)) & C.U64((1 << (8 * depth)) - 1)) << C.U64(8) | (key & C.U64(255))


def mixed(own: np.ndarray, kids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P_w of nodes with children, and the weight of stopping at them."""
    both = np.logaddexp(own, kids) - np.log(2)
    return both, np.exp(np.clip(own - np.log(2) - both, -745, 0))


def counted(gram: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth with their zeros and ones."""
    k = np.concatenate([node_key(gram, depth, b) for b in range(8)])
    bit = np.concatenate([(gram >> C.U64(7 - b)) & C.U64(1) for b in range(8)]).astype(np.int64)
    c = np.tile(count, 8)
    names, inverse = np.unique(k, return_inverse=True)
    ones = np.bincount(inverse, c * bit, len(names))
    return names, np.bincount(inverse, c, len(names)) - ones, ones


def subtrees(gram: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """From whole subtrees below depth 2: (key, zeros, ones, log P_w, stop) of each depth from DEPTH to 2, then for
    depths 1 and 0 (key, zeros, ones, sum of the children's log P_w), which other parts add to."""
    out = []
    below = None
    for depth in range(DEPTH, 0, -1):
        names, zeros, ones = counted(gram, count, depth)
        own = log_kt(zeros, ones)
        kids = np.zeros(len(names))
        if below is not None:
            kids = np.bincount(np.searchsorted(names, parent_key(below[0], depth)), below[1], len(names))
        if depth == 1:
            out.append((names, zeros, ones, kids))
            break
        log_w, stop = (own, np.ones(len(names))) if below is None else mixed(own, kids)
        out.append((names, zeros, ones, log_w, stop))
        below = (names, log_w)
    return out


def p_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def topmost(first: tuple[np.ndarray, ...]) -> Tree:
    """Depths 0 and 1 from the summed (key, zeros, ones, kids) of depth 1."""
    k, z, o, kids = first
    log_w, w = mixed(log_kt(z, o), kids)
    names, inverse = np.unique(k & C.U64(255), return_inverse=True)
    zeros, ones, below = (np.bincount(inverse, x, len(names)) if len(names) else np.empty(0) for x in (z, o, log_w))
    _, top = mixed(log_kt(zeros, ones), below)
    return Tree([names, k], [p_one(zeros, ones), p_one(z, o)], [top, w])


def completed(top: Tree, deep: list[tuple[np.ndarray, ...]]) -> Tree:
    """top with the nodes of depths DEPTH .. 2 as subtrees() gives them."""
    up = deep[::-1]
    return Tree(top.keys + [x[0] for x in up], top.one + [p_one(x[1], x[2]) for x in up], top.stop + [x[4] for x in up])


def grow(gram: np.ndarray, count: np.ndarray) -> Tree:
    """The tree of all training grams at once (for small inputs and tests)."""
    *deep, first = subtrees(gram, count)
    return completed(topmost(first), deep)


def log10_probability(tree: Tree, gram: np.ndarray) -> np.ndarray:
    """log10 P(byte | the bytes before it) of each gram."""
    out = np.zeros(len(gram))
    for b in range(8):
        bit = ((gram >> C.U64(7 - b)) & C.U64(1)) == 1
        last = np.full(len(gram), 0.5)
        sure, rest = np.zeros(len(gram)), np.ones(len(gram))  # of P(one): from nodes so far; weight that is left
        live = np.arange(len(gram))
        for depth in range(DEPTH + 1):
            names = tree.keys[depth]
            if not len(live) or not len(names):
                break
            k = node_key(gram[live], depth, b)
            at = np.minimum(np.searchsorted(names, k), len(names) - 1)
            hit = names[at] == k
            live, at = live[hit], at[hit]
            one, stop, left = tree.one[depth][at], tree.stop[depth][at], rest[live]
            last[live] = one
            sure[live] += left * stop * one
            rest[live] = left - left * stop
        p = sure + rest * last  # beyond the longest context its own estimate holds
        out += np.log10(np.where(bit, p, 1 - p))
    return out


@dataclass
class Model:
    """The training grams (gram, n, part; a written table) and the nodes of depths 0 and 1."""

    table: DataFrame
    top: Tree

    def tree(self) -> Tree:
        """All nodes on the driver (for small inputs and tests)."""
        got = self.table.select("gram", "n").orderBy("gram").toArrow()
        return grow(C.longs(got["gram"].combine_chunks()).astype(np.uint64), C.longs(got["n"].combine_chunks()))

    keys = property(lambda self: self.tree().keys)
    one = property(lambda self: self.tree().one)
    stop = property(lambda self: self.tree().stop)


def part_of(gram, n: int):
    """The part of a gram (a numpy array of int64, or a column) by its two nearest context bytes, so a part holds whole subtrees."""
    if isinstance(gram, np.ndarray):
        return (((gram >> 8) & 0xFFFF) * 2654435761 >> 12) % n
    return F.pmod(F.shiftright(F.shiftright(gram, 8).bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(2654435761), 12), F.lit(n)).cast("int")


def split(key: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Each value of key (0 .. n - 1) that occurs, and where, in ascending order."""
    by = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[by], np.arange(n + 1))
    return [(int(k), by[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts))]


def table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, (_, k) in enumerate(fields)], names=[f for f, _ in fields])


def _training(batches):
    """Distinct grams of each task's training texts, with their counts."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        buf, offs = C.flat(batch.column("text"))
        for i, j in C.blocks(offs, BLOCK):
            parts.append(tally(grams(*canonical(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))))
            held += len(parts[-1][0])
            if held > 2_000_000:
                parts = [tally(*map(np.concatenate, zip(*parts, strict=True)))]
                held = len(parts[0][0])
    if parts:
        g, c = tally(*map(np.concatenate, zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "n"])


def train(docs: DataFrame) -> Model:
    """The model of docs' texts. Only the nodes of depth 1 reach the driver, at most 256 * 255."""
    n = C.partitions(docs.sparkSession)
    gathered = docs.select("text").mapInArrow(_training, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    gathered = C.cut(gathered.withColumn("part", part_of(F.col("gram"), n)), "grams")

    def nodes(batches):
        got = [(C.longs(b.column("gram")).astype(np.uint64), C.longs(b.column("n"))) for b in batches if b.num_rows]
        if got:
            key, *rest = subtrees(*map(np.concatenate, zip(*got, strict=True)))[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.int64)), *(pa.array(x.astype(float)) for x in rest)], names=["key", "zeros", "ones", "kids"]
            )

    first = gathered.repartition(n, "part").select("gram", "n").mapInArrow(nodes, "key long, zeros double, ones double, kids double")
    got = first.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "kids"))).orderBy("key").toArrow()
    key, *rest = (got[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "zeros", "ones", "kids"))
    return Model(gathered, topmost((key.astype(np.uint64), *rest)))


def held_out():
    """Remainder 1 of crc32(doc_id as text) modulo 5; true for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(True))


END_TOKEN = C.U64(0x5851F42D4C957F2D)  # stands for the end among the words' hashes
META = {"uid": "<i8", "id": "<i8", "null": "<u1", "out": "<u1", "tokens": "<i8", "score": "<f8"}
PART = {"uid": "<i8", "log": "<f8", "known": "<i8"}
TEXTS = {"id": "<i8", "null": "<u1", "out": "<u1", "size": "<i8"}


def chunks(docs: DataFrame) -> DataFrame:
    """docs' canonical texts, written once: for each chunk its first row's number, its rows and their bytes."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("out"))
    schema = "chunk long, meta binary, text binary"

    def texts(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        size = 0

        def whole():
            m = C.joined([m for _, m in held])
            return table(schema, [(uid, C.pack(**m), C.pack(text=np.concatenate([d for d, _ in held])))]), len(m["id"])

        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            ids = batch.column("doc_id")
            null, ids = np.asarray(ids.is_null()), C.longs(ids.fill_null(0))
            out = np.asarray(batch.column("out").to_numpy(zero_copy_only=False)).astype(bool)
            for i, j in C.blocks(offs, BLOCK):
                data, o = canonical(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                held.append((data, {"id": ids[i:j], "null": null[i:j].astype(np.uint8), "out": out[i:j].astype(np.uint8), "size": np.diff(o)}))
                size += len(data)
                if size >= CHUNK:
                    done, many = whole()
                    yield done
                    uid, held, size = uid + many, [], 0
        if held:
            yield whole()[0]

    return C.cut(slim.mapInArrow(texts, schema), "texts")


def blocks_of(chunk: int, meta: bytes, text: bytes):
    """A chunk's rows, a block at a time: their numbers, META's other columns, canonical text and offsets."""
    m, data = C.unpack(meta, **TEXTS), C.unpack(text, text="<u1")["text"]
    offs = np.concatenate([[0], np.cumsum(m["size"])])
    for i, j in C.blocks(offs, BLOCK):
        yield chunk + np.arange(i, j), {c: m[c][i:j] for c in ("id", "null", "out")}, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def rows_of(batches, *columns: str):
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in columns)


def costs(texts: DataFrame, model: Model) -> DataFrame:
    """For each chunk and part (chunk, pack): the chunk's distinct grams of that part and log10 of what they are given."""
    n = C.partitions(texts.sparkSession)
    top = texts.sparkSession.sparkContext.broadcast(model.top)
    schema = "part int, turn int, chunk long, pack binary"

    def learnt(batches):
        for batch in batches:
            g, c = C.longs(batch.column("gram")), C.longs(batch.column("n"))
            yield table(schema, [(k, 0, 0, C.pack(gram=g[at], n=c[at])) for k, at in split(part_of(g, n), n)])

    def asked(batches):
        for chunk, meta, text in rows_of(batches, "chunk", "meta", "text"):
            g = np.unique(np.concatenate([np.unique(grams(data, o)) for _, _, data, o in blocks_of(chunk, meta, text)])).astype(np.int64)
            yield table(schema, [(k, 1, chunk, C.pack(gram=g[at])) for k, at in split(part_of(g, n), n)])

    def answered(held, tree):
        names, inverse = np.unique(np.concatenate([g for _, g in held]), return_inverse=True)
        cost = log10_probability(tree, names)[inverse]
        at = 0
        for chunk, g in held:
            yield table("chunk long, pack binary", [(chunk, C.pack(gram=g, cost=cost[at : at + len(g)]))])
            at += len(g)

    def run(batches):
        part, tree, known, held, size = -1, None, [], [], 0
        for k, turn, chunk, pack in rows_of(batches, "part", "turn", "chunk", "pack"):
            if k != part:
                if held:
                    yield from answered(held, tree)
                part, tree, known, held, size = k, None, [], [], 0
            if turn == 0:
                known.append(C.unpack(pack, gram="<u8", n="<i8"))
                continue
            if tree is None:
                got = C.joined(known) or {"gram": np.empty(0, np.uint64), "n": np.empty(0, np.int64)}
                tree, known = completed(top.value, subtrees(got["gram"], got["n"])[:-1]), []
            held.append((chunk, C.unpack(pack, gram="<u8")["gram"]))
            size += len(held[-1][1])
            if size >= ASKED:
                yield from answered(held, tree)
                held, size = [], 0
        if held:
            yield from answered(held, tree)

    both = model.table.select("gram", "n").mapInArrow(learnt, schema).unionByName(texts.mapInArrow(asked, schema))
    return both.repartition(n, "part").sortWithinPartitions("part", "turn").mapInArrow(run, "chunk long, pack binary")


def scored(texts: DataFrame, model: Model, home) -> DataFrame:
    """Packs of META dealt out by home(uid): the texts with the sums of their grams' costs."""
    n = C.partitions(texts.sparkSession)
    schema = "part int, kind string, a binary"

    def run(batches):
        chunk, held = -1, []
        for c, turn, a, b in rows_of(batches, "chunk", "turn", "a", "b"):
            if c != chunk:
                chunk, held = c, []
            if turn == 0:
                held.append(C.unpack(a, gram="<u8", cost="<f8"))
                continue
            names, cost = (C.joined(held)[x] for x in ("gram", "cost"))
            held = []
            by = np.argsort(names)
            names, cost = names[by], cost[by]
            for uid, m, data, o in blocks_of(c, a, b):
                key = grams(data, o)
                order = np.argsort(key)
                each = np.empty(len(key))
                each[order] = cost[np.searchsorted(names, key[order])]
                starts, _, at = C.words_of(data, o)
                m |= {"uid": uid, "tokens": np.diff(at), "score": np.add.reduceat(each, o[:-1])}  # no text is empty: each has its end
                yield table(schema, [(k, "meta", C.pack(**{x: m[x][rows] for x in META})) for k, rows in split(home(uid), n)])

    asked = costs(texts, model).select("chunk", F.lit(0).alias("turn"), F.col("pack").alias("a"), F.lit(None).cast("binary").alias("b"))
    both = asked.unionByName(texts.select("chunk", F.lit(1).alias("turn"), F.col("meta").alias("a"), F.col("text").alias("b")))
    return both.repartition(n, "chunk").sortWithinPartitions("chunk", "turn").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (doc_id, text): the columns of ROW."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    texts = chunks(docs)

    def pieces(batches):
        for chunk in rows_of(batches, "chunk", "meta", "text"):
            for own, m, data, o in blocks_of(*chunk):
                starts, ends, at = C.words_of(data, o)
                last = at[1:] - 1  # each text's end
                word = C.range_hash(C.prefix_hash(C.BYTE[data]), starts, ends)
                word[last] = END_TOKEN
                row = np.repeat(np.arange(len(own)), np.diff(at))
                rows = []
                for k, part in split((word % C.U64(n)).astype(np.int64), n):
                    names, inverse = np.unique(word[part], return_inverse=True)
                    learnt = np.bincount(inverse, m["out"][row[part]] == 0, len(names)).astype(np.int64)
                    pair, times = np.unique(row[part] * len(names) + inverse, return_counts=True)
                    rows.append(
                        (
                            k, C.pack(name=names, n=learnt),
                            C.pack(uid=own[pair // len(names)], name=(pair % len(names)).astype(np.uint32), times=times.astype(np.uint32))
                        )
                    )
                yield table("bucket int, a binary, b binary", rows)

    def sums(batches):
        """For each bucket of words: training counts over all tasks, then each row's part of the base score."""
        held: dict[int, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                held.setdefault(x["bucket"], []).append((C.unpack(x["a"], name="<u8", n="<i8"), x["b"]))
        for k in list(held):
            got = held.pop(k)
            names, inverse = np.unique(np.concatenate([a["name"] for a, _ in got]), return_inverse=True)
            learnt = np.bincount(inverse, np.concatenate([a["n"] for a, _ in got]), len(names))
            at = 0
            done = []
            for a, b in got:
                mine = learnt[inverse[at : at + len(a["name"])]]
                at += len(a["name"])
                p = C.unpack(b, uid="<i8", name="<u4", times="<u4")
                c = mine[p["name"]]
                uids, place = np.unique(p["uid"], return_inverse=True)
                log = np.bincount(place, np.log10(c + 0.5) * p["times"], len(uids))
                known = np.bincount(place, (c > 0) * p["times"].astype(np.int64), len(uids)).astype(np.int64)
                done.append({"uid": uids, "log": log, "known": known})
            whole = C.joined(done)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1], pa.int32()), pa.array(["size"]), pa.array([None], pa.binary()), pa.array([int(learnt.sum())], pa.int64()),
                    pa.array([int((learnt > 0).sum())], pa.int64())
                ],
                names=["part", "kind", "a", "tokens", "names"]
            )
            part = home(whole["uid"])
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(n + 1))
            full = np.flatnonzero(np.diff(cuts))
            packs = [C.pack(**{c: whole[c][by[cuts[i] : cuts[i + 1]]] for c in PART}) for i in full]
            zero = pa.array(np.zeros(len(full), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(["part"] * len(full)), pa.array(packs, pa.binary()), zero, zero],
                names=["part", "kind", "a", "tokens", "names"]
            )

    def home(uid):
        """Rows of one block may go to several parts: by their own number."""
        return (C.mix(uid.astype(np.uint64)) % C.U64(n)).astype(np.int64)

    schema = "part int, kind string, a binary, tokens long, names long"
    summed = texts.mapInArrow(pieces, "bucket int, a binary, b binary").repartition(n, "bucket").mapInArrow(sums, schema)
    summed = C.cut(summed, "base")
    tokens, names = summed.where("kind = 'size'").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("names"), F.lit(0))).first()
    scale = float(np.log10(tokens + 0.5 * (names + 1)))

    def rows(batches):
        held: dict[int, dict[str, list]] = {}
        for batch in batches:
            for part, kind, a in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("a").to_pylist(), strict=True):
                held.setdefault(part, {"meta": [], "part": []})[kind].append(C.unpack(a, **(META if kind == "meta" else PART)))
        for part in list(held):
            got = held.pop(part)
            m, p = C.joined(got["meta"]), C.joined(got["part"])
            by = np.argsort(m["uid"])
            m = {c: v[by] for c, v in m.items()}
            at = np.searchsorted(m["uid"], p["uid"])
            log = np.bincount(at, p["log"], len(by))
            known = np.bincount(at, p["known"], len(by)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(m["id"], pa.int64(), mask=m["null"].astype(bool)), pa.array(m["out"].astype(bool)), pa.array(m["tokens"]), pa.array(known),
                    pa.array(np.full(len(by), tokens, np.int64)), pa.array(log - m["tokens"] * scale), pa.array(m["score"]),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    both = summed.where("kind <> 'size'").select("part", "kind", "a").unionByName(scored(texts, model, home))
    return both.repartition(n, "part").mapInArrow(rows, ROW)


def op4_ctw(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs.where(~held_out())))
