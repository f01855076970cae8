"""Vectorized k-mer and minimizer enumeration, and the table functions built on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


def codes(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical 2-bit code of every k-mer, whether it is the reverse complement's, and whether all its bases are A, C, G, T."""
    code, rc, ok = _canonical(_CODE[np.frombuffer(seq, np.uint8)], k)
    return code.astype(U), rc, ok


def _canonical(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``codes`` of bases as _CODE has them, in 32 bits where they fit."""
    n, kind = len(c) - k + 1, np.uint32 if k <= 16 else U
    if n <= 0:
        return np.empty(0, kind), np.empty(0, bool), np.empty(0, bool)
    x = (c & 3).astype(kind)
    forward, backward = _doubled(x, k, False), _doubled(kind(3) - x, k, True)
    if c.max() <= 3:
        ok = np.ones(n, bool)
    else:
        bad = np.concatenate([np.zeros(1, np.int32), np.cumsum(c > 3, dtype=np.int32)])
        ok = bad[k:] == bad[:-k]
    return np.minimum(forward, backward), backward < forward, ok


def of_rows(sequences: pa.Array, k: int, most: int = 1 << 20):
    """(first row, row of each, place in it, code, is_rc) of the unambiguous k-mers of a column, for some rows at a time: rows of up to ``most`` bytes
    together are one numpy step, so many short rows cost no more than a long one. Null is empty."""
    sequences = sequences.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(sequences.buffers()[1], np.int64)[sequences.offset : sequences.offset + len(sequences) + 1]
    raw = np.frombuffer(sequences.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(sequences):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        own = offsets[i : j + 1] - offsets[i]
        code, rc, ok = _canonical(_CODE[raw[offsets[i] : offsets[j]]], k)
        row = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(own))[: len(code)]
        at = np.flatnonzero(ok & (np.arange(len(code)) + k <= own[1:][row])) if len(code) else np.empty(0, np.int64)
        row = row[at]
        yield i, row, at - own[:-1][row], code[at], rc[at]
        i = j


def forward(seq: bytes, k: int) -> np.ndarray:
    """Code of every k-mer as it stands, -1 where a base is ambiguous."""
    c = _CODE[np.frombuffer(seq, np.uint8)]
    if len(c) < k:
        return np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(c > 3)])
    return np.where(bad[k:] == bad[:-k], _doubled((c & 3).astype(U), k, False).astype(np.int64), -1)


def _doubled(x: np.ndarray, k: int, turned: bool) -> np.ndarray:
    """Codes of k neighbours from codes of 1, 2, 4, ... neighbours; ``turned``: the first neighbour is the lowest."""
    parts, size = {1: x}, 1

    def joined(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> np.ndarray:
        return a | (b << a.dtype.type(2 * na)) if turned else (a << a.dtype.type(2 * nb)) | b

    while size * 2 <= k:
        parts[size * 2] = joined(parts[size][:-size], size, parts[size][size:], size)
        size *= 2
    n, out, done = len(x) - k + 1, None, 0
    for size in sorted(parts, reverse=True):
        if k & size:
            part = parts[size][done : done + n]
            out = part if out is None else joined(out, done, part, size)
            done += size
    return out


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finalizer that orders minimizers of the in-memory index."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def xxh64(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each number's 8 little-endian bytes."""
    p1, p2, p3, p4, p5 = (U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    roll = lambda v, r: (v << U(r)) | (v >> U(64 - r))
    with np.errstate(over="ignore"):
        h = U((seed + 2870177450012600261 + 8) % 2**64) ^ (roll(x * p2, 31) * p1)
        h = roll(h, 27) * p1 + p4
        h = (h ^ (h >> U(33))) * p2
        h = (h ^ (h >> U(29))) * p3
    return h ^ (h >> U(32)) if p5 else h


def minimizers(seq: bytes, k: int, w: int, hashed=splitmix, restart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, code, is_rc) of the minimizers.

    restart False: windows run over all k-mer places, ambiguous ones are skipped inside a window.
    restart True: windows run inside stretches of unambiguous k-mers; a stretch shorter than w has one."""
    code, rc, ok = codes(seq, k)
    n = len(code)
    if n == 0:
        return np.empty(0, np.int64), code, rc
    with np.errstate(over="ignore"):
        h = hashed(code)
    picked = []
    if restart:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
        stretches = zip(edge[0::2], edge[1::2], strict=True)
    else:
        stretches = [(0, n)]
    top = U(2**64 - 1)
    for a, b in stretches:
        own = np.where(ok[a:b], h[a:b], top)
        view = np.lib.stride_tricks.sliding_window_view(own, min(w, b - a))
        at = view.argmin(1) + np.arange(len(view))
        at = at[ok[a:b][at]]
        picked.append(a + at[np.append(True, at[1:] != at[:-1])] if len(at) else at)
    at = np.concatenate(picked) if picked else np.empty(0, np.int64)
    return at, code[at], rc[at]


#: Bases in a piece of a contig that is worked on at once.
PIECE = 1 << 20


def pieces(contigs: DataFrame, overlap: int, size: int = PIECE) -> DataFrame:
    """contig_id, start, sequence: contigs of more than ``size`` bases in pieces that share ``overlap``, dealt out over all tasks.

    A chromosome is many rows then; short contigs, which files already deal out, stay where they are."""
    own = contigs.select("contig_id", "sequence")
    n = F.length("sequence")
    short = own.where(n <= size).select("contig_id", F.lit(0).cast("long").alias("start"), "sequence")
    at = F.explode(F.sequence(F.lit(0).cast("long"), (n - 1 - overlap).cast("long"), F.lit(size).cast("long")))
    long = own.where(n > size).select("contig_id", at.alias("start"), "sequence")
    long = long.select("contig_id", "start", F.substring("sequence", (F.col("start") + 1).cast("int"), F.lit(size + overlap)).alias("sequence"))
    return short.unionByName(long.repartition("contig_id", "start"))


def _table(df: DataFrame, key: str, of, schema: str) -> DataFrame:
    """Rows that ``of`` makes of each sequence; places count from ``start`` where the frame has it."""

    def run(batches):
        for batch in batches:
            starts = batch.column("start").to_pylist() if "start" in batch.schema.names else [0] * batch.num_rows
            ids, pos, code, rc = [], [], [], []
            for i, start, s in zip(batch.column(key).to_pylist(), starts, batch.column("sequence").to_pylist(), strict=True):
                p, c, r = of((s or "").encode())
                ids.append(np.full(len(p), i, np.int64))
                pos.append(p + start)
                code.append(c.astype(np.int64))
                rc.append(r)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (ids, pos, code)] + [pa.array(np.concatenate(rc).astype(bool))],
                    names=[x.split(" ")[0] for x in schema.split(", ")]
                )

    return df.mapInArrow(run, schema)


def dense_kmers(contigs: DataFrame, k: int) -> DataFrame:
    """contig_id, ref_pos, code, is_rc of every unambiguous k-mer: made in Arrow batches, a row for each place."""

    def of(seq):
        code, rc, ok = codes(seq, k)
        at = np.flatnonzero(ok)
        return at, code[at], rc[at]

    return _table(pieces(contigs, k - 1), "contig_id", of, "contig_id long, ref_pos long, code long, is_rc boolean")


def query_minimizers(reads: DataFrame, k: int, w: int, persisted: bool = False) -> DataFrame:
    """read_ord, query_pos, code, is_rc of each read's minimizers, for the in-memory or the persisted index."""
    hashed = xxh64 if persisted else splitmix
    return _table(
        reads.select("read_ord", "sequence"), "read_ord", lambda s: minimizers(s, k, w, hashed, persisted),
        "read_ord long, query_pos long, code long, is_rc boolean"
    )


def repeat_periods(contigs: DataFrame, size: int = 24, periods: int = 8) -> DataFrame:
    """contig_id, start, period: of each window of ``size`` bases, end to end over the whole contig (the last one is shorter), the least
    period up to ``periods`` at which three quarters of its places repeat; null if there is none, or under six bases."""
    schema = "contig_id long, start long, period int"

    def run(batches):
        for batch in batches:
            ids, starts, found = [], [], []
            for i, s in zip(batch.column("contig_id").to_pylist(), batch.column("sequence").to_pylist(), strict=True):
                x = np.frombuffer((s or "").encode(), np.uint8)
                at = np.arange(0, len(x), size)
                end = np.minimum(at + size, len(x))
                least = np.zeros(len(at), np.int32)
                for p in range(periods, 0, -1):
                    same = np.concatenate([[0], np.cumsum(x[p:] == x[:-p])]) if len(x) > p else np.zeros(1, np.int64)
                    places = end - at - p
                    hits = same[np.clip(end - p, 0, len(same) - 1)] - same[np.clip(at, 0, len(same) - 1)]
                    least[(end - at >= 6) & (places > 0) & (4 * hits >= 3 * places)] = p
                ids.append(np.full(len(at), i, np.int64))
                starts.append(at)
                found.append(least)
            if ids:
                period = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(period, mask=period == 0)],
                    names=["contig_id", "start", "period"]
                )

    return contigs.select("contig_id", "sequence").mapInArrow(run, schema)
