"""Reads against a reference of any size: blocks of reads and pieces of contigs meet in buckets, and what travels is packed.

A block of reads asks the buckets of its codes how many places each has; with the answers its reads choose probes as ``local`` does.  The
probes' places are asked for in the same way and become candidates, whose windows are cut where their contigs are.  A task holds one
block, bucket or group of pieces at a time, so memory does not grow with the reads or the reference, and no seed, hit or window is a row."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Policy
from ..functions import kmers, packs
from . import index, local

#: Bases of a bucket of codes and of a group of contigs' pieces; bits of the filter of wanted codes.
BUCKET, GROUP, BITS = 4_000_000, 4_000_000, 1 << 29
_STRICT = np.full(256, 4, np.uint8)
_STRICT[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_FOUR = np.frombuffer(b"ACGT", np.uint8)[(np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3]
_READS, _PIECES = {"read_ord": "<i8", "size": "<i8"}, {"contig_id": "<i8", "start": "<i8", "size": "<i8"}
_PLACES = {"contig_id": "<i8", "ref_pos": "<i8", "is_rc": "<u1"}
_WINDOWS = {"read": "<i4", "slot": "<i4", "contig_id": "<i8", "start": "<i8", "end": "<i8"}
_CUT = {"read": "<i4", "slot": "<i4", "start": "<i8", "size": "<i8"}


def packed_text(raw: bytes) -> bytes:
    """A, C, G and T in two bits each; any other text deflated."""
    c, size = _STRICT[np.frombuffer(raw, np.uint8)], len(raw).to_bytes(8, "little")
    if c.max(initial=0) > 3:
        return b"\1" + size + pa.compress(raw, codec="zstd", asbytes=True)
    c = np.append(c, np.zeros(-len(c) % 4, np.uint8)).reshape(-1, 4)
    return b"\0" + size + (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def text_of(blob: bytes) -> bytes:
    size = int.from_bytes(blob[1:9], "little")
    if blob[:1] == b"\1":
        return pa.decompress(blob[9:], decompressed_size=size, codec="zstd", asbytes=True)
    return _FOUR[np.frombuffer(blob, np.uint8, offset=9)].reshape(-1)[:size].tobytes()


def _held(x) -> bytes:
    raw = pickle.dumps(x, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _back(blob: bytes):
    return pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _rows(batches, *names: str):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _texts(sizes: np.ndarray, raw: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]


def _group_of(contig: np.ndarray, piece: np.ndarray, groups: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = kmers.splitmix(contig.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64))
    return (mixed % np.uint64(groups)).astype(np.int64)


def stored_pieces(contigs: DataFrame, k: int, groups: int, n: int) -> DataFrame:
    """group, about, text: pieces of contigs (kmers.PIECE bases and k - 1 more), packed; contigs are read once and kept on disk."""
    size, bases = kmers.PIECE, F.length("sequence")
    at = F.when(bases > size, F.sequence(F.lit(0).cast("long"), (bases - 1).cast("long"), F.lit(size).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    cut = contigs.where(bases > 0).select("contig_id", "sequence", F.explode(at).alias("start"))
    part = F.substring("sequence", (F.col("start") + 1).cast("int"), F.lit(size + k - 1))
    rows = cut.select("contig_id", "start", F.when(bases > size, part).otherwise(F.col("sequence")).alias("sequence"))
    fields = ("group", pa.int64()), ("about", pa.binary()), ("text", pa.binary())

    def packed(some: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        contig, start, length = (np.array(x, np.int64) for x in ([s[0] for s in some], [s[1] for s in some], [len(s[2]) for s in some]))
        out = []
        for g, own in packs.dealt(_group_of(contig, start // size, groups), groups):
            about = packs.pack(contig_id=contig[own], start=start[own], size=length[own])
            out.append((g, about, packed_text(b"".join(some[i][2] for i in own.tolist()))))
        return _batch(out, *fields)

    def deal(batches):
        some, held = [], 0
        for contig, start, text in _rows(batches, "contig_id", "start", "sequence"):
            some.append((contig, start, text.encode()))
            held += len(text)
            if held > 8 * size:
                yield packed(some)
                some, held = [], 0
        if some:
            yield packed(some)

    def merge(batches):
        for g, columns in index._groups(batches, "group"):
            about = [packs.unpack(v, **_PIECES) for v in columns["about"]]
            whole = packs.pack(**{c: np.concatenate([a[c] for a in about]) for c in _PIECES})
            yield _batch([(g, whole, packed_text(b"".join(text_of(v) for v in columns["text"])))], *fields)

    schema = "group long, about binary, text binary"
    return index._dealt(rows.mapInArrow(deal, schema), n, "group").mapInArrow(merge, schema).persist(StorageLevel.DISK_ONLY)


def stored_reads(reads: DataFrame, bases: int) -> DataFrame:
    """block, about, text: reads in blocks of about so many bases, packed and kept on disk, as every step comes back to them."""

    def run(batches):
        from pyspark import TaskContext

        turn, some, held = TaskContext.get().partitionId() << 32, [], 0

        def row():
            about = packs.pack(read_ord=np.array([k for k, _ in some], np.int64), size=np.array([len(s) for _, s in some], np.int64))
            return _batch([(turn, about, packed_text(b"".join(s for _, s in some)))], ("block", pa.int64()), ("about", pa.binary()), ("text", pa.binary()))

        for k, sequence in _rows(batches, "read_ord", "sequence"):
            some.append((k, (sequence or "").encode().upper()))
            held += len(some[-1][1])
            if held > bases or len(some) == 10_000:
                yield row()
                turn, some, held = turn + 1, [], 0
        if some:
            yield row()

    return reads.select("read_ord", "sequence").mapInArrow(run, "block long, about binary, text binary").persist(StorageLevel.DISK_ONLY)


def _kmers_of(batches, k: int, among):
    """Mixed codes of pieces that a filter lets pass (None: all), and their places."""
    for about, text in _rows(batches, "about", "text"):
        a, raw = packs.unpack(about, **_PIECES), text_of(text)
        offsets = np.concatenate([[0], np.cumsum(a["size"])]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(a["size"]), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        for i, row, at, code, rc in kmers.of_rows(column, k):
            x = index._mixed(code, k)
            if among is not None:
                own = np.flatnonzero(among(x))
                x, row, at, rc = x[own], row[own], at[own], rc[own]
            if len(x):
                yield x, {"contig_id": a["contig_id"][i:][row], "ref_pos": at + a["start"][i:][row], "is_rc": rc.astype(np.uint8)}


class _Bits:
    """Whether mixed codes may be in a set: by their high bits."""

    def __init__(self, bits: np.ndarray, k: int):
        self.bits, self.shift = bits, np.uint64(max(0, 2 * k - (8 * len(bits)).bit_length() + 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = x >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _wanted(asked: DataFrame, k: int):
    """A broadcast that makes a filter of the asked codes (block, codes): exact for few, else bits of a bounded number; made by tasks."""
    spark = asked.sparkSession
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= index.WANTED:
        parts = [np.cumsum(packs.unpack(v, gap=index._gap(k))["gap"], dtype=np.uint64) for v in asked.select("codes").toArrow()["codes"].to_pylist()]
        return "codes", spark.sparkContext.broadcast(np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))), total
    width = min(2 * k, BITS.bit_length() - 1, (16 * total).bit_length())
    slices = 64
    shift = np.uint64(2 * k - width)

    def split(batches):
        for (codes,) in _rows(batches, "codes"):
            x = np.unique(np.cumsum(packs.unpack(codes, gap=index._gap(k))["gap"], dtype=np.uint64) >> shift)
            ends = np.searchsorted(x, np.arange(slices + 1, dtype=np.uint64) << np.uint64(width - 6))
            rows = [(s, packs.pack(gap=index._gaps_of(x[i:j], k))) for s, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]
            yield _batch(rows, ("part", pa.int64()), ("codes", pa.binary()))

    def joined(batches):
        for s, columns in index._groups(batches, "part"):
            bits = np.zeros(1 << (width - 6), bool)
            for v in columns["codes"]:
                bits[np.cumsum(packs.unpack(v, gap=index._gap(k))["gap"], dtype=np.uint64) - np.uint64(s << (width - 6))] = True
            yield _batch([(s, pa.compress(np.packbits(bits, bitorder="little").tobytes(), codec="zstd", asbytes=True))], ("part", pa.int64()), ("bits", pa.binary()))

    made = index._dealt(asked.mapInArrow(split, "part long, codes binary"), slices, "part").mapInArrow(joined, "part long, bits binary").toArrow()
    out = np.zeros(1 << (width - 3), np.uint8)
    one = 1 << (width - 9)
    for s, v in zip(made["part"].to_pylist(), made["bits"].to_pylist(), strict=True):
        out[s * one : (s + 1) * one] = np.frombuffer(pa.decompress(v, decompressed_size=one, codec="zstd", asbytes=True), np.uint8)
    return "bits", spark.sparkContext.broadcast(out), total


def _filter(kind: str, held, k: int):
    return index._Among(held.value, k) if kind == "codes" else _Bits(held.value, k)


def _split(block: int, x: np.ndarray, k: int, m: int) -> list[tuple]:
    """Sorted codes of a block by bucket: (bucket, block, codes)."""
    buckets, ends = index._edges(x, k, m)
    return [(int(b), block, packs.pack(gap=index._gaps_of(x[i:j], k))) for b, i, j in zip(buckets, ends[:-1], ends[1:], strict=True)]


_ASKED = ("bucket", pa.int64()), ("block", pa.int64()), ("codes", pa.binary())


def _codes_of(blob: bytes, k: int) -> np.ndarray:
    return np.cumsum(packs.unpack(blob, gap=index._gap(k))["gap"], dtype=np.uint64)


def _seeds(about: bytes, text: bytes, p: Policy):
    """A block's reads: their numbers and bases, seeds (place, code, is_rc) of each, and all distinct mixed codes."""
    a = packs.unpack(about, **_READS)
    texts = _texts(a["size"], text_of(text))
    seeds = [kmers.minimizers(s, p.k, p.window) for s in texts]
    x = [index._mixed(s[1], p.k) for s in seeds]
    return a["read_ord"], texts, seeds, x, np.unique(np.concatenate([np.empty(0, np.uint64), *x]))


def _by_block(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.repartition(n, "block").sortWithinPartitions("block", *order)


@dataclass
class _Found:
    """What ``local.hits_of`` needs of a read's probes: where their codes are in the block's table."""

    at: np.ndarray


def searches(reads: DataFrame, contigs: DataFrame, p: Policy, bases: int, budget):
    """The packed steps up to the windows: a frame (block, ...) and a function that makes of a task's rows, for one block after the other, lists
    of (read_ord, bases, exact place or None, its window, candidates). ``budget(loci)`` says how many candidates a read searches: only those get windows.

    ``bases``: of the contigs."""
    k, most, piece_size = p.k, p.max_stored_hits, kmers.PIECE
    n = max(index._tasks(contigs), bases // 16_000_000)
    m, groups = max(1, -(-bases // BUCKET)), max(1, -(-bases // GROUP))
    pieces = stored_pieces(contigs, k, groups, n)
    blocks = stored_reads(reads, min(4_000_000, max(500_000, bases // 500)))

    # the number of places of every seed
    def every(batches):
        for block, about, text in _rows(batches, "block", "about", "text"):
            x = _seeds(about, text, p)[4]
            yield _batch([(block, len(x), packs.pack(gap=index._gaps_of(x, k)))], ("block", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()))

    asked = blocks.mapInArrow(every, "block long, n long, codes binary").persist(StorageLevel.DISK_ONLY)
    few = None
    if asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= index.WANTED:
        few = _wanted(asked, k)

    def counted(batches):
        parts, held = [], 0

        def rows():
            x = np.sort(np.concatenate(parts))
            head, many = index._heads(x)
            return _batch([(b, None, v) for b, v in index._counts(x[head], many, k, m)], *_ASKED)

        for x, _ in _kmers_of(batches, k, None if few is None else _filter(*few[:2], k)):
            parts.append(x)
            held += len(x)
            if held > index.BLOCK:
                yield rows()
                parts, held = [], 0
        if parts:
            yield rows()

    def dealt(batches):
        for block, codes in _rows(batches, "block", "codes"):
            yield _batch(_split(block, _codes_of(codes, k), k, m), *_ASKED)

    schema = "bucket long, block long, codes binary"

    def totals(batches):
        for bucket, columns in index._groups(batches, "bucket"):
            parts = [packs.unpack(v, gap=index._gap(k), n="<u4") for b, v in zip(columns["block"], columns["codes"], strict=True) if b is None]
            x = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(q.pop("gap"), dtype=np.uint64) for q in parts)])
            by = index._order(x, k)
            x = x[by]
            head = index._heads(x)[0]
            total = np.add.reduceat(np.concatenate([q["n"] for q in parts])[by].astype(np.int64), head) if len(head) else head
            x, out = np.append(x[head], np.uint64(2**64 - 1)), []
            total = np.append(np.minimum(total, 2**32 - 1), 0)
            for block, codes in zip(columns["block"], columns["codes"], strict=True):
                if block is not None:
                    own = _codes_of(codes, k)
                    at = np.searchsorted(x, own)
                    out.append((block, bucket, packs.pack(total=np.where(x[at] == own, total[at], 0).astype(np.uint32))))
            yield _batch(out, ("block", pa.int64()), ("part", pa.int64()), ("answer", pa.binary()))

    both = pieces.mapInArrow(counted, schema).unionByName(asked.mapInArrow(dealt, schema))
    known = index._dealt(both, n, "bucket").mapInArrow(totals, "block long, part long, answer binary")

    # probes, and the first seeds that have one place
    def probed(batches):
        for block, columns in index._groups(batches, "block"):
            i = next(i for i, v in enumerate(columns["text"]) if v is not None)
            order, texts, seeds, mixed, x = _seeds(columns["about"][i], columns["text"][i], p)
            total = np.concatenate([np.empty(0, np.uint32), *(packs.unpack(v, total="<u4")["total"] for v in columns["answer"] if v is not None)]).astype(np.int64)
            if len(total) != len(x):
                raise RuntimeError(f"block {block} asked for {len(x)} codes and got {len(total)} answers")
            out, codes = [], []
            for s, (place, code, rc), own in zip(texts, seeds, mixed, strict=True):
                t = total[np.searchsorted(x, own)]
                found = local.Seeds(place, code.astype(np.int64), rc, own, t, (t > 0) & (t <= most))
                rows = local.probes_of(len(s), found, p)
                one = np.flatnonzero(found.complete & (t == 1))[:3]
                out.append((rows[:, :5], own[rows[:, 5]], np.stack([place[one], rc[one]], 1).astype(np.int64), own[one]))
                codes += [own[rows[:, 5]], own[one]]
            x = np.unique(np.concatenate([np.empty(0, np.uint64), *codes]))
            yield _batch(
                [(block, columns["about"][i], len(x), packs.pack(gap=index._gaps_of(x, k)), _held(out))],
                ("block", pa.int64()), ("about", pa.binary()), ("n", pa.int64()), ("codes", pa.binary()), ("state", pa.binary())
            )

    probes = _by_block(blocks.unionByName(known, allowMissingColumns=True), n, "part").mapInArrow(
        probed, "block long, about binary, n long, codes binary, state binary"
    ).persist(StorageLevel.DISK_ONLY)
    wanted = _wanted(probes.select("block", "n", "codes"), k)

    # their places
    def placed(batches):
        parts, held = [], 0

        def rows():
            x, r, _, _ = index._limited(np.concatenate([q[0] for q in parts]), {c: np.concatenate([q[1][c] for q in parts]) for c in _PLACES}, k, most, False)
            buckets, ends = index._edges(x, k, m)
            return _batch(
                [(int(b), None, packs.pack(gap=index._gaps_of(x[i:j], k), **{c: v[i:j] for c, v in r.items()})) for b, i, j in zip(buckets, ends[:-1], ends[1:], strict=True)],
                *_ASKED
            )

        for part in _kmers_of(batches, k, _filter(*wanted[:2], k)):
            parts.append(part)
            held += len(part[0])
            if held > index.BLOCK:
                yield rows()
                parts, held = [], 0
        if parts:
            yield rows()

    def places(batches):
        for bucket, columns in index._groups(batches, "bucket"):
            parts = [packs.unpack(v, gap=index._gap(k), **_PLACES) for b, v in zip(columns["block"], columns["codes"], strict=True) if b is None]
            x = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(q.pop("gap"), dtype=np.uint64) for q in parts)])
            r = {c: np.concatenate([np.empty(0, t), *(q[c] for q in parts)]) for c, t in _PLACES.items()}
            parts.clear()
            x, r, codes, many = index._limited(x, r, k, most, True)
            stored = np.append(np.minimum(many, most), 0)
            codes, first = np.append(codes, np.uint64(2**64 - 1)), np.cumsum(stored) - stored
            for block, asked_for in zip(columns["block"], columns["codes"], strict=True):
                if block is not None:
                    own = _codes_of(asked_for, k)
                    at = np.searchsorted(codes, own)
                    count = np.where(codes[at] == own, stored[at], 0)
                    hit = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    yield _batch(
                        [(block, bucket, packs.pack(count=count.astype(np.uint32)), packs.pack(**{c: v[hit] for c, v in r.items()}))],
                        ("block", pa.int64()), ("part", pa.int64()), ("answer", pa.binary()), ("hits", pa.binary())
                    )

    both = pieces.mapInArrow(placed, schema).unionByName(probes.select("block", "codes").mapInArrow(dealt, schema))
    met = index._dealt(both, n, "bucket").mapInArrow(places, "block long, part long, answer binary, hits binary")

    # candidates, and the windows that they ask for
    def found(batches):
        for block, columns in index._groups(batches, "block"):
            i = next(i for i, v in enumerate(columns["state"]) if v is not None)
            size, x = packs.unpack(columns["about"][i], **_READS)["size"].tolist(), _codes_of(columns["codes"][i], k)
            count = np.concatenate([np.empty(0, np.uint32), *(packs.unpack(v, count="<u4")["count"] for v in columns["answer"] if v is not None)]).astype(np.int64)
            if len(count) != len(x):
                raise RuntimeError(f"block {block} asked for {len(x)} codes and got {len(count)} answers")
            hits = [packs.unpack(v, **_PLACES) for v in columns["hits"] if v is not None]
            contig, place, rc = (np.concatenate([np.empty(0, t), *(h[c] for h in hits)]) for c, t in _PLACES.items())
            table = local.SeedTable({}, x, count, np.cumsum(count) - count, contig, place, rc.astype(bool))
            out, asks = [], []
            for j, (rows, codes, one, single) in enumerate(_back(columns["state"][i])):
                at = np.searchsorted(x, codes)
                if (count[at] != rows[:, 4]).any():
                    raise RuntimeError(f"block {block} did not get all places of its probes")
                rows = np.concatenate([rows, np.arange(len(rows))[:, None]], 1)
                loci = local.candidates_of(size[j], local.hits_of(rows, table, _Found(at), p), p)
                loci = [c | local.window_of(c, size[j], b"", p) for c in loci]
                asked_of = loci[: budget(loci)]
                for slot, c in enumerate(asked_of):
                    asks.append((j, slot, c["contig_id"], c["offset"], _end_of(c, size[j], p)))
                exact = []
                for slot, ((at_read, turned), a) in enumerate(zip(one.tolist(), np.searchsorted(x, single).tolist(), strict=True)):
                    h = table.first[a]
                    is_rc = bool(turned) != bool(table.rc[h])
                    start = int(table.place[h] - (size[j] - at_read - k if is_rc else at_read))
                    if start < 0:
                        break
                    name = int(table.contig[h])
                    if any(e[:3] == (name, is_rc, start) for e in exact):
                        continue
                    inside = next((s for s, c in enumerate(asked_of) if c["contig_id"] == name and c["offset"] <= start and start + size[j] <= _end_of(c, size[j], p)), None)
                    exact.append((name, is_rc, start, -1 - slot if inside is None else inside))
                    if inside is None:
                        asks.append((j, -1 - slot, name, start, start + size[j]))
                out.append((exact, loci))
            read, slot, name, start, end = (np.array([a[c] for a in asks], np.int64) for c in range(5))
            yield _batch(
                [(block, _held(out), packs.pack(read=read.astype(np.int32), slot=slot.astype(np.int32), contig_id=name, start=start, end=end))],
                ("block", pa.int64()), ("state", pa.binary()), ("asks", pa.binary())
            )

    candidates = _by_block(probes.unionByName(met, allowMissingColumns=True), n, "part").mapInArrow(
        found, "block long, state binary, asks binary"
    ).persist(StorageLevel.DISK_ONLY)

    def asked_windows(batches):
        for block, asks in _rows(batches, "block", "asks"):
            a = packs.unpack(asks, **_WINDOWS)
            low, high = a["start"] // piece_size, (np.maximum(a["end"], a["start"] + 1) - 1) // piece_size
            row = np.repeat(np.arange(len(low)), high - low + 1)
            piece = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
            a = {c: v[row] for c, v in a.items()}
            a["start"], a["end"] = np.maximum(a["start"], piece * piece_size), np.minimum(a["end"], (piece + 1) * piece_size)
            out = [(g, block, packs.pack(**{c: v[own] for c, v in a.items()})) for g, own in packs.dealt(_group_of(a["contig_id"], piece, groups), groups)]
            yield _batch(out, ("group", pa.int64()), ("block", pa.int64()), ("asks", pa.binary()))

    def cut(batches):
        for g, columns in index._groups(batches, "group"):
            if all(b is None for b in columns["block"]):
                continue
            where, texts = {}, []
            for about, text in zip(columns["about"], columns["text"], strict=True):
                if text is not None:
                    a = packs.unpack(about, **_PIECES)
                    where |= {(c, s): len(texts) + i for i, (c, s) in enumerate(zip(a["contig_id"].tolist(), a["start"].tolist(), strict=True))}
                    texts += _texts(a["size"], text_of(text))
            for block, asks in zip(columns["block"], columns["asks"], strict=True):
                if block is not None:
                    a, some = packs.unpack(asks, **_WINDOWS), []
                    for c, start, end in zip(a["contig_id"].tolist(), a["start"].tolist(), a["end"].tolist(), strict=True):
                        begin = start // piece_size * piece_size
                        at = where.get((c, begin))
                        some.append(b"" if at is None else texts[at][start - begin : end - begin])
                    about = packs.pack(read=a["read"], slot=a["slot"], start=a["start"], size=np.array([len(s) for s in some], np.int64))
                    yield _batch([(block, g, about, packed_text(b"".join(some)))], ("block", pa.int64()), ("part", pa.int64()), ("answer", pa.binary()), ("window", pa.binary()))

    asks = candidates.select("block", "asks").mapInArrow(asked_windows, "group long, block long, asks binary")
    windows = index._dealt(pieces.unionByName(asks, allowMissingColumns=True), n, "group").mapInArrow(
        cut, "block long, part long, answer binary, window binary"
    )
    everything = blocks.unionByName(candidates.select("block", "state"), allowMissingColumns=True).unionByName(windows, allowMissingColumns=True)

    def together(batches):
        for _, columns in index._groups(batches, "block"):
            i, s = (next(i for i, v in enumerate(columns[c]) if v is not None) for c in ("text", "state"))
            a = packs.unpack(columns["about"][i], **_READS)
            parts: dict[tuple[int, int], list] = {}
            for answer, window in zip(columns["answer"], columns["window"], strict=True):
                if window is not None:
                    w = packs.unpack(answer, **_CUT)
                    for j, slot, start, text in zip(w["read"].tolist(), w["slot"].tolist(), w["start"].tolist(), _texts(w["size"], text_of(window)), strict=True):
                        parts.setdefault((j, slot), []).append((start, text))
            cuts = {key: b"".join(t for _, t in sorted(v)) for key, v in parts.items()}
            parts.clear()
            out = []
            for j, (order, read, (exact, loci)) in enumerate(zip(a["read_ord"].tolist(), _texts(a["size"], text_of(columns["text"][i])), _back(columns["state"][s]), strict=True)):
                for slot, c in enumerate(loci[: budget(loci)]):
                    c["window"] = cuts[j, slot]
                own = []
                for name, is_rc, start, slot in exact:
                    window = cuts[j, slot] if slot < 0 else cuts[j, slot][start - loci[slot]["offset"] :][: len(read)]
                    own.append({"contig_id": name, "is_rc": is_rc, "ref_start": start, "window": window})
                out.append((order, read, own, loci))
            cuts.clear()
            yield out

    return _by_block(everything, n, "part"), together


def _end_of(c: dict, n: int, p: Policy) -> int:
    """Where the window of ``local.window_of`` ends."""
    return max(c["offset"], c["ref_end"] + (c["q_start"] if c["is_rc"] else n - c["q_end"]) + min(p.flank, n))
