"""Suffix-array dedup: remove every byte that a repeated 100-byte string covers.

Method.  A sparse suffix array: only suffixes at content-chosen anchors are kept (``spans``), which
stand for all windows.  Splitters sampled from the suffixes' leading 24 bytes (three 8-byte tokens)
range-partition them; each bucket sorts its suffixes by multikey quicksort, token by token, and
compares neighbours.  Suffixes whose leading tokens and whose covered text are equal are decided
there.  Where the leading tokens are equal but the covered texts differ, only some of the windows
can be equal: the covered bytes are fetched, range-partitioned by the same splitters, and all their
suffixes are sorted by multikey quicksort on their 100 bytes.

Boundaries.  A splitter is a whole leading-token prefix, so equal prefixes share a bucket, unless a
prefix is hot (a fixed share of the sampled suffixes): its windows are then dealt out one by one by
the hash of their 100 bytes, so a boundary never separates equal windows and no prefix fills one
task.  Before the shuffle each task keeps only the first of its own equal suffixes.

The order of strings is that of (doc_id, start); null ids come last; different texts under one id
are told apart by their CRC and do not remove each other's bytes, as neither has the smaller id.  A row that repeats a
whole row (id and text) is the same document: it gets the same result.  Texts of fewer than 100 bytes and null texts lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import spans as S

WINDOW = 100
GRAM = 24
#: Texts are cut into pieces of at most so many windows, and worked on in blocks of so many bytes.
PIECE, BLOCK = 1 << 24, 1 << 18
#: Share of sampled suffixes that makes a prefix hot.
HOT = 1 / 256
RECORD = {"t1": "<u8", "t2": "<u8", "t3": "<u8", "span": "<u8", "did": "<i8", "crc": "<u4", "first": "<u4", "count": "<u1", "back": "<u1"}
REMOVE, COMPARE = 1, 2
PARTS = "did long, crc long, kind int, first long, count int, back int"


def leading(buf: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The three leading 8-byte tokens of the suffixes, as big-endian numbers: they sort as the bytes do."""
    view = np.lib.stride_tricks.sliding_window_view(buf, GRAM)[at] if len(at) else np.empty((0, GRAM), np.uint8)
    t = np.ascontiguousarray(view).view(">u8").astype(np.uint64)
    return [t[:, 0].copy(), t[:, 1].copy(), t[:, 2].copy()]


def records(did: np.ndarray, crc: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> Iterator[
    tuple[dict[str, np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray]]
]:
    """Records of each block of texts, with the block's bytes, the windows' places in them and the texts' rows."""
    for i, j in C.blocks(offs, BLOCK):
        long = j == i + 1 and offs[j] - offs[i] > PIECE
        for at in range(int(offs[i]), int(offs[j]), PIECE) if long else (int(offs[i]),):
            end = min(int(offs[j]), at + PIECE + WINDOW - 1) if long else int(offs[j])
            b = buf[at:end]
            o = np.array([0, end - at]) if long else offs[i : j + 1] - at
            r = S.find(C.BYTE[b], o[:-1], o[1:], WINDOW, GRAM)
            if r is None:
                continue
            t1, t2, t3 = leading(b, r.anchor)
            own = i + r.row
            begin = offs[own] - at
            yield {
                "t1": t1, "t2": t2, "t3": t3, "span": r.span, "did": did[own], "crc": crc[own].astype(np.uint32),
                "first": (r.first - begin).astype(np.uint32), "count": r.count.astype(np.uint8), "back": (r.anchor - r.first).astype(np.uint8),
            }, b, (r.first, own)


def earlier_first(r: dict[str, np.ndarray]) -> np.ndarray:
    """Order by (did, crc, first)."""
    ascending = (r["did"][1:] > r["did"][:-1]) | (
        (r["did"][1:] == r["did"][:-1]) & ((r["crc"][1:] > r["crc"][:-1]) | ((r["crc"][1:] == r["crc"][:-1]) & (r["first"][1:] >= r["first"][:-1])))
    )
    return np.arange(len(r["did"])) if ascending.all() else np.lexsort((r["first"], r["crc"], r["did"]))


def decide(r: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """The first of each set of equal suffixes; the others, which are removed; and where leading tokens are equal but spans are not.

    Of texts that share the least id, each keeps its first: none of them has a smaller id."""
    by = earlier_first(r)
    order, group = C.multikey([r["t1"], r["t2"], r["t3"], r["span"]], by)
    head, later = firsts(r["did"][order], r["crc"][order], r["first"][order], np.append(True, group[1:] != group[:-1]))
    heads = {k: v[order[head]] for k, v in r.items()}
    gone = {k: v[order[later]] for k, v in r.items()}
    same = np.ones(max(0, len(heads["t1"]) - 1), bool)
    for k in ("t1", "t2", "t3"):
        same &= heads[k][1:] == heads[k][:-1]
    open_ = np.append(False, same) | np.append(same, False)
    return heads, gone, open_ if len(heads["t1"]) else np.empty(0, bool)


def firsts(did: np.ndarray, crc: np.ndarray, first: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of sets of equals (each begins where ``new``; sorted by did, crc, first) are the first of their text under the
    set's least id, and which have an equal that starts earlier."""
    if not len(did):
        return np.empty(0, bool), np.empty(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = did == did[lead]
    text = new | np.append(True, (crc[1:] != crc[:-1]) | (did[1:] != did[:-1]))
    begin = first[np.flatnonzero(text)[np.cumsum(text) - 1]]
    return own & text, ~own | (first > begin)


def merged(did: np.ndarray, crc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of the spans of each document, in order."""
    if len(did) == 0:
        return did, crc, start, end
    by = np.lexsort((start, crc, did))
    did, crc, start, end = did[by], crc[by], start[by].astype(np.int64), end[by].astype(np.int64)
    doc = np.append(False, (did[1:] != did[:-1]) | (crc[1:] != crc[:-1]))
    shift = np.cumsum(doc) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(did)) - 1
    return did[head], crc[head], start[head], reach[last] - shift[last]


def part_rows(did, crc, kind, first, count, back) -> pa.RecordBatch:
    n = len(did)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(did, pa.int64()), pa.array(np.asarray(crc, np.int64)), pa.array(np.full(n, kind, np.int32)),
            pa.array(np.asarray(first, np.int64)), pa.array(np.asarray(count, np.int32)), pa.array(np.asarray(back, np.int32))
        ],
        names=["did", "crc", "kind", "first", "count", "back"],
    )


def removal_rows(gone: dict[str, np.ndarray]) -> pa.RecordBatch:
    did, crc, start, end = merged(gone["did"], gone["crc"], gone["first"], gone["first"].astype(np.int64) + gone["count"] - 1 + WINDOW)
    return part_rows(did, crc, REMOVE, start, end - start, np.zeros(len(did)))


class Splitters:
    """Sampled leading-token prefixes that cut the order of suffixes into buckets, and the hot prefixes."""

    def __init__(self, sample: np.ndarray, buckets: int):
        """sample: rows of three tokens."""
        self.buckets = buckets
        sample = sample[np.lexsort((sample[:, 2], sample[:, 1], sample[:, 0]))]
        whole = sample.view("u8,u8,u8").reshape(-1)
        hot, times = np.unique(whole, return_counts=True) if len(whole) else (whole, np.empty(0, int))
        self.hot = set(map(tuple, hot[(times >= 16) & (times > HOT * len(whole))].tolist()))  # at most 1 / HOT of them
        at = (np.arange(1, buckets) * len(sample)) // buckets
        self.keys = sample[at] if len(sample) else np.empty((0, 3), np.uint64)

    def bucket(self, t: list[np.ndarray]) -> np.ndarray:
        """How many splitters are not above each prefix."""
        keys = self.keys
        low, high = np.searchsorted(keys[:, 0], t[0], "left"), np.searchsorted(keys[:, 0], t[0], "right")
        out = high.copy()
        for i in np.unique(low[high > low + 1]) if len(keys) else ():  # several splitters share the first token
            own = np.flatnonzero((low == i) & (high > low + 1))
            j = high[own[0]]
            rest = keys[i:j, 1:].copy().view("u8,u8").reshape(-1)
            mine = np.stack([t[1][own], t[2][own]], 1).view("u8,u8").reshape(-1)
            out[own] = i + np.searchsorted(rest, mine, "right")
        return out

    def is_hot(self, t: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(t[0]), bool)
        for a, b, c in self.hot:
            out |= (t[0] == a) & (t[1] == b) & (t[2] == c)
        return out


def one_by_one(r: dict[str, np.ndarray], hot: np.ndarray, b: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Records of single windows for those of hot suffixes: their leading tokens are hashes of the 100 bytes."""
    own = np.flatnonzero(hot)
    count = r["count"][own].astype(np.int64)
    at = C.runs_to_rows(first[own], count)
    row = np.repeat(own, count)
    h = C.range_hash(C.prefix_hash(C.BYTE[b]), at, at + WINDOW)
    other = C.range_hash(C.prefix_hash(C.mix(C.BYTE)[b]), at, at + WINDOW)
    return {
        "t1": h, "t2": other, "t3": np.full(len(h), C.U64(2**64 - 1)), "span": h, "did": r["did"][row], "crc": r["crc"][row],
        "first": (r["first"][row] + (at - first[row])).astype(np.uint32), "count": np.ones(len(h), np.uint8), "back": np.zeros(len(h), np.uint8),
    }


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = C.flat(batch.column("text"))
    return C.longs(batch.column("did")), C.longs(batch.column("crc")), buf, offs


def splitters(keys: DataFrame, buckets: int) -> Splitters:
    """From a sample of a fixed number of suffixes (``common.some_texts``)."""

    def sample(batches):
        rng = np.random.default_rng(7)
        for batch in batches:
            for r, _, (_, row) in records(*_columns(batch)):
                own = C.some_of_each(row, rng)
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([r[k][own] for k in ("t1", "t2", "t3")], 1).tobytes()], pa.binary())], names=["t"])

    rows = C.some_texts(keys).mapInArrow(sample, "t binary").toArrow()["t"].to_pylist()
    return Splitters(np.frombuffer(b"".join(rows), np.uint64).reshape(-1, 3), buckets)


def removed_parts(docs: DataFrame) -> DataFrame:
    """Spans to remove: did, crc, first (byte), count (bytes); spans of one document may overlap."""
    spark = docs.sparkSession
    keys = C.keyed(docs)
    n = C.partitions(spark)
    cuts = splitters(keys, n)

    def suffixes(batches):
        parts = []
        for batch in batches:
            for r, b, (first, _) in records(*_columns(batch)):
                hot = cuts.is_hot([r["t1"], r["t2"], r["t3"]]) if cuts.hot else np.zeros(0, bool)
                if hot.any():
                    parts.append(one_by_one(r, hot, b, first))
                    r = {k: v[~hot] for k, v in r.items()}
                parts.append(r)
        if not parts:
            return
        heads, gone, _ = decide(C.joined(parts))
        del parts
        rows = removal_rows(gone)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows.num_rows, dtype=np.int32) % n), pa.nulls(rows.num_rows, pa.binary()), *rows.columns],
            names=["bucket", "blob", *rows.schema.names]
        )
        t = [heads["t1"], heads["t2"], heads["t3"]]
        bucket = np.where(heads["t3"] == C.U64(2**64 - 1), (heads["t2"] % C.U64(n)).astype(np.int64), cuts.bucket(t))
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(n + 1))
        full = np.flatnonzero(np.diff(ends))
        blobs = [C.pack(**{k: v[by[ends[i] : ends[i + 1]]] for k, v in heads.items()}) for i in full]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()),
                *(pa.nulls(len(full), x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))
            ],
            names=["bucket", "blob", "did", "crc", "kind", "first", "count", "back"],
        )

    def settle(batches):
        held: dict[int, list] = {}
        for batch in batches:
            whole = batch.filter(batch.column("blob").is_null())
            if whole.num_rows:
                yield whole.select(["did", "crc", "kind", "first", "count", "back"])
            batch = batch.filter(batch.column("blob").is_valid())
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                held.setdefault(k, []).append(blob.as_py())
        for k in list(held):
            heads, gone, open_ = decide(C.joined([C.unpack(x, **RECORD) for x in held.pop(k)]))
            yield removal_rows(gone)
            yield part_rows(*(heads[c][open_] for c in ("did", "crc")), COMPARE, *(heads[c][open_] for c in ("first", "count", "back")))

    out = f"bucket int, blob binary, {PARTS}"
    parts = C.cut(keys.mapInArrow(suffixes, out).repartition(n, "bucket").mapInArrow(settle, PARTS), "suffix-parts")
    wanted = parts.where(f"kind = {COMPARE}").groupBy("did", "crc").agg(F.collect_list(F.struct("first", "count", "back")).alias("spans"))
    compared = compare(keys.join(wanted, ["did", "crc"]), cuts, n)
    return parts.where(f"kind = {REMOVE}").select("did", "crc", "first", "count").unionByName(compared)


def compare(texts: DataFrame, cuts: Splitters, n: int) -> DataFrame:
    """Sort all suffixes of the asked spans by their 100 bytes; return those with an earlier equal."""

    def fetch(batches):
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            spans = batch.column("spans")
            per = np.diff(np.asarray(spans.offsets)) if spans.null_count == 0 else np.asarray(pa.compute.list_value_length(spans))
            f, c, k = (np.asarray(spans.flatten().field(i)).astype(np.int64) for i in range(3))
            row = np.repeat(np.arange(len(per)), per)
            if len(row) == 0:
                continue
            start = offs[row] + f
            t = leading(buf, start + k)
            bucket = cuts.bucket(t)
            did, crc = C.longs(batch.column("did"))[row], C.longs(batch.column("crc"))[row]
            by = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[by], np.arange(n + 1))
            for i in np.flatnonzero(np.diff(ends)):
                own = by[ends[i] : ends[i + 1]]
                size = c[own] - 1 + WINDOW
                data = buf[C.runs_to_rows(start[own], size)].tobytes()
                head = C.pack(
                    did=did[own], crc=crc[own].astype(np.uint32), first=f[own].astype(np.uint32), count=c[own].astype(np.uint8),
                    back=k[own].astype(np.uint8)
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([head], pa.binary()), pa.array([data], pa.binary())], names=["bucket", "head", "data"]
                )

    def sort(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                held.setdefault(x["bucket"], []).append((x["head"], x["data"]))
        for k in list(held):
            got = held.pop(k)
            r = C.joined([C.unpack(h, did="<i8", crc="<u4", first="<u4", count="<u1", back="<u1") for h, _ in got])
            data = np.frombuffer(b"".join(d for _, d in got), np.uint8)
            size = r["count"].astype(np.int64) - 1 + WINDOW
            base = np.cumsum(size) - size
            t = leading(data, base + r["back"])
            order, group = C.multikey(t)
            _, members = np.unique(group, return_counts=True)
            ends = np.cumsum(members)
            work = np.cumsum(r["count"][order].astype(np.int64))[ends - 1]
            i = 0
            while i < len(ends):  # whole groups of equal prefixes, about a million windows at once
                j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + 1_000_000)))
                own = order[(ends[i - 1] if i else 0) : ends[j - 1]]
                yield removal(r, data, base, own, group[(ends[i - 1] if i else 0) : ends[j - 1]])
                i = j

    def removal(r, data, base, own, prefix):
        count = r["count"][own].astype(np.int64)
        at = C.runs_to_rows(base[own], count)
        row = np.repeat(own, count)
        step = at - base[row]
        back = (r["back"][row].astype(np.int64) - step).astype(np.int64)  # how far the anchor is from the window's start
        first = r["first"][row] + step
        did, crc = r["did"][row], r["crc"][row]
        by = np.lexsort((first, crc, did))
        slot = np.repeat(prefix, count) * 256 + back
        view = np.lib.stride_tricks.sliding_window_view(data, 8)
        places = [*range(0, WINDOW - 8, 8), WINDOW - 8]

        class Token:
            """The 8-byte token of the windows at one place, read only for those that are still open."""

            def __init__(self, place):
                self.place = place

            def __getitem__(self, index):
                return np.ascontiguousarray(view[at[index] + self.place]).view(">u8").reshape(-1).astype(np.uint64)

        order, group = C.multikey([slot, *(Token(p) for p in places)], by)
        _, later = firsts(did[order], crc[order], first[order], np.append(True, group[1:] != group[:-1]))
        gone = order[later]
        return removal_rows({"did": did[gone], "crc": crc[gone], "first": first[gone], "count": np.ones(len(gone), np.int64)})

    rows = texts.mapInArrow(fetch, "bucket int, head binary, data binary").repartition(n, "bucket")
    return rows.mapInArrow(sort, PARTS).select("did", "crc", "first", "count")


REMOVED, _DID, _CRC = "__removed_spans", "__own_did", "__own_crc"


def with_removed(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """docs with REMOVED: an array of (first, count) byte spans, null if nothing goes."""
    own = parts.groupBy("did", "crc").agg(F.collect_list(F.struct("first", "count")).alias(REMOVED))
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.withColumns({_DID: F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)), _CRC: F.crc32(text.cast("binary"))})
    return left.join(own.withColumnsRenamed({"did": _DID, "crc": _CRC}), [_DID, _CRC], "left").drop(_DID, _CRC)


def spans_of(column: pa.Array) -> list[np.ndarray]:
    """For each row its merged (start, end) pairs."""
    out = []
    for x in column:
        if not x.is_valid:
            out.append(np.empty((0, 2), np.int64))
            continue
        v = x.values
        first, count = np.asarray(v.field(0)).astype(np.int64), np.asarray(v.field(1)).astype(np.int64)
        zero = np.zeros(len(first), np.int64)
        _, _, s, e = merged(zero, zero, first, first + count)
        out.append(np.stack([s, e], 1))
    return out


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return data
    edges = [0, *spans.reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (columns doc_id, text; others are ignored):
    doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; a character may have lost some of its bytes)."""

    def finish(batches):
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            spans = spans_of(batch.column(REMOVED))
            data = [buf[offs[i] : offs[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(offs)), pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()), pa.array([kept_bytes(d, s) for d, s in zip(data, spans, strict=True)], pa.binary())
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_removed(slim, removed_parts(slim)).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows of docs with their own columns: text without its repeated bytes (bytes of cut characters go too), n_chars to match.

    Null texts stay null; a text of which nothing is left is empty."""
    columns = docs.columns

    def finish(batches):
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            spans = spans_of(batch.column(REMOVED))
            null = np.asarray(batch.column("text").is_null())
            texts = [None if null[i] else kept_bytes(buf[offs[i] : offs[i + 1]].tobytes(), s).decode(errors="ignore") for i, s in enumerate(spans)]
            arrays = [batch.column(c) for c in columns]
            arrays[columns.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                kind = batch.schema.field("n_chars").type
                sizes = [len(t) if t is not None else None for t in texts]
                changed = pa.array([len(s) > 0 for s in spans])
                arrays[columns.index("n_chars")] = pa.compute.if_else(changed, pa.array(sizes, pa.int64()).cast(kind), batch.column("n_chars"))
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return with_removed(docs, removed_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))).mapInArrow(finish, docs.schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = f"""
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, ''))::bigint as n from documents
), windows as (
  select doc_id, p, md5(substr(x, 2 * p + 1, {2 * WINDOW})) as m from (select doc_id, x, unnest(range(0, greatest(n - {WINDOW - 1}, 0))) as p from d)
), first as (
  select m, min(row(doc_id, p)) as f from windows group by m having count(*) > 1
), starts as (
  select doc_id, p, p - lag(p) over (partition by doc_id order by p) as step from windows join first using (m) where row(doc_id, p) > f
), runs as (
  select doc_id, p, sum(case when step is null or step > {WINDOW} then 1 else 0 end) over (partition by doc_id order by p rows unbounded preceding)
    as run from starts
), spans as (
  select doc_id, run, min(p) as s, max(p) + {WINDOW} as e from runs group by doc_id, run
), pieces as (
  select doc_id, s, e, x, substr(x, 2 * coalesce(lag(e) over (partition by doc_id order by s), 0) + 1, 2 * (s - coalesce(lag(e) over (partition by
    doc_id order by s), 0))) as piece
  from spans join d using (doc_id)
), kept as (
  select doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans, string_agg(piece, '' order by s) || substr(any_value(x), 2 * max(e) + 1) as
    rest from pieces group by doc_id
)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, x)))
  as kept_sha256 from d left join kept using (doc_id)
"""


def brute_force(rows: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all windows (small inputs, distinct ids)."""
    seen: set[bytes] = set()
    out = {}
    for did, data in sorted(rows):
        gone = bytearray(len(data))
        for p in range(len(data) - WINDOW + 1):
            w = data[p : p + WINDOW]
            if w in seen:
                gone[p : p + WINDOW] = b"\1" * WINDOW
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[did] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
