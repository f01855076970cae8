"""Seed index: build, cap policies and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kmers, packs

HIT = "struct<contig_id:bigint,ref_pos:bigint,is_rc:boolean>"


#: K-mers of a task that are sorted at once, and of a bucket; codes that an index may be restricted to by a broadcast, a bounded number.
BLOCK, BUCKET, WANTED = 2_000_000, 2_000_000, 500_000
ROW = f"code long, total long, capped boolean, hits array<{HIT}>"
_HITS = {"contig_id": "<i8", "ref_pos": "<i8", "is_rc": "<u1"}


def build(contigs: DataFrame, k: int = 15, max_stored_hits: int = 256, wanted: DataFrame | None = None) -> DataFrame:
    """code, total, capped, hits: every canonical k-mer with its true number of places and the first of them.

    Contigs are read once, after their bases were counted.  A task sorts its k-mers in blocks and keeps of each the first
    ``max_stored_hits`` by (contig, place) and the number of the others, so a frequent k-mer stays small; records go packed to the bucket
    of their code.  There is a bucket for every BUCKET bases, and a task holds one at a time, so memory does not grow with the contigs.
    ``wanted`` (code) restricts the index to the k-mers that queries ask for, for an index that is used once: up to WANTED codes are
    broadcast; more are joined with the finished index."""
    if max_stored_hits < 1:
        raise ValueError("max_stored_hits must be positive")
    asked = None
    if wanted is not None:
        codes = wanted.select("code").distinct()
        asked = asked_codes(codes, k)
    n = _tasks(contigs)
    m = n if asked is not None else _parts(contigs, BUCKET)
    packed = kmers.pieces(contigs, k - 1).mapInArrow(_packed(k, max_stored_hits, m, asked), "bucket int, hits binary, others binary")
    built = _dealt(packed, n, "bucket").mapInArrow(_bucket(k, max_stored_hits), ROW)
    return built if wanted is None or asked is not None else built.join(codes, "code", "left_semi")


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _parts(contigs: DataFrame, size: int) -> int:
    """Parts of about ``size`` bases, one at least for every task of a shuffle."""
    bases = contigs.agg(F.coalesce(F.sum(F.length("sequence").cast("long")), F.lit(0))).first()[0]
    return max(_tasks(contigs), -(-bases // size))


def _dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows of a key in one task, one key after the other."""
    return rows.repartition(n, key).sortWithinPartitions(key)


def _groups(batches, key: str):
    """(key, columns as lists) of neighbouring rows of one key."""
    last, held = None, None
    for batch in batches:
        columns = batch.to_pydict()
        keys = columns.pop(key)
        i = 0
        while i < len(keys):
            j = i + 1
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if held is not None and keys[i] != last:
                yield last, held
                held = None
            if held is None:
                last, held = keys[i], {c: [] for c in columns}
            for c, v in columns.items():
                held[c] += v[i:j]
            i = j
    if held is not None:
        yield last, held


#: Codes times an odd number, without what is over 4 ** k: every code has its own product, and the high bits of products are even.
_ODD = 0x9E3779B97F4A7C15


def _mixed(code: np.ndarray, k: int) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(_ODD)) & np.uint64(4**k - 1)


def _unmixed(x: np.ndarray, k: int) -> np.ndarray:
    return ((x * np.uint64(pow(_ODD, -1, 4**k))) & np.uint64(4**k - 1)).astype(np.int64)


def _edges(x: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted mixed codes: the buckets (0 .. m - 1) that have some, and where they begin and the last one ends."""
    bucket = _bucket_of(x, k, m)
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(x) else np.empty(0, np.int64)
    return bucket[head], np.append(head, len(x))


def _bucket_of(x: np.ndarray, k: int, m: int) -> np.ndarray:
    top = x >> np.uint64(2 * k - 32) if k > 16 else x << np.uint64(32 - 2 * k)
    return ((top * np.uint64(m)) >> np.uint64(32)).astype(np.int64)


def _order(x: np.ndarray, k: int) -> np.ndarray:
    """Stable order of mixed codes."""
    if k > 16 or len(x) >= 1 << 32:
        return np.argsort(x, kind="stable")
    return (np.sort((x << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)) & np.uint64(2**32 - 1)).astype(np.int64)


def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a sorted array begins, and how often it is there."""
    head = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return head, np.diff(np.append(head, len(x)))


def asked_codes(codes: DataFrame, k: int):
    """Distinct codes as a broadcast of sorted mixed ones; None if there are more than WANTED."""
    some = codes.limit(WANTED + 1).toArrow()["code"]
    if len(some) > WANTED:
        return None
    own = np.array(some.to_numpy(), np.int64)
    return codes.sparkSession.sparkContext.broadcast(np.sort(_mixed(own[(own >= 0) & (own < 4**k)], k)))


class _Among:
    """Whether mixed codes are in a sorted set: a table of high bits passes few others to the search."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.shift = names, np.uint64(max(0, 2 * k - 22))
        self.table = np.zeros(1 << min(22, 2 * k), bool)
        self.table[names >> self.shift] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.table[x >> self.shift]
        at = np.flatnonzero(out)
        if len(at):
            own = x[at]
            out[at] = self.names[np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)] == own
        return out


def _by_place(r: dict[str, np.ndarray]) -> np.ndarray:
    contig, pos = r["contig_id"], r["ref_pos"]
    if len(pos) and contig.min() >= 0 and contig.max() < 1 << 32 and pos.max() < 1 << 31:
        return np.argsort((contig << 31) | pos, kind="stable")
    return np.lexsort((pos, contig))


def _limited(x: np.ndarray, r: dict[str, np.ndarray], k: int, most: int, whole: bool) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Records by mixed code, the first ``most`` by (contig, place) of each; heads of the codes' records before that, and their numbers. ``whole``: records of
    rarer codes are by place too."""
    if whole:
        by = _by_place(r)
        by = by[_order(x[by], k)]
    else:
        by = _order(x, k)
    x, r = x[by], {c: v[by] for c, v in r.items()}
    head, many = _heads(x)
    codes = x[head]
    if len(many) and many.max() > most:
        size = np.repeat(many, many)
        if not whole:
            over = np.flatnonzero(size > most)
            by = over[np.lexsort((r["ref_pos"][over], r["contig_id"][over], x[over]))]
            for v in r.values():
                v[over] = v[by]
        keep = np.arange(len(x)) - np.repeat(head, many) < most
        x, r = x[keep], {c: v[keep] for c, v in r.items()}
    return x, r, codes, many


def _gap(k: int) -> str:
    return "<u4" if k <= 16 else "<u8"


def _gaps_of(x: np.ndarray, k: int) -> np.ndarray:
    """Differences of sorted codes, the first from zero: most planes of a pack are empty then."""
    return np.diff(x, prepend=np.zeros(1, x.dtype)).astype(_gap(k))


def _packed(k: int, most: int, m: int, asked):
    def rows(parts: list[tuple[np.ndarray, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        x = np.concatenate([p[0] for p in parts])
        x, r, codes, many = _limited(x, {c: np.concatenate([p[1][c] for p in parts]) for c in _HITS}, k, most, False)
        over = many > most
        codes, others = codes[over], many[over] - most
        buckets, ends = _edges(x, k, m)
        more = np.searchsorted(_bucket_of(codes, k, m), np.append(buckets, m))
        hits = [packs.pack(gap=_gaps_of(x[i:j], k), **{c: v[i:j] for c, v in r.items()}) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        rest = [packs.pack(gap=_gaps_of(codes[i:j], k), others=others[i:j]) for i, j in zip(more[:-1], more[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), pa.array(hits, pa.binary()), pa.array(rest, pa.binary())], names=["bucket", "hits", "others"]
        )

    def run(batches):
        parts, held = [], 0
        among = None if asked is None else _Among(asked.value, k)
        for batch in batches:
            ids, starts = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("contig_id", "start"))
            for i, row, at, code, rc in kmers.of_rows(batch.column("sequence"), k):
                x = _mixed(code, k)
                if among is not None:
                    own = np.flatnonzero(among(x))
                    x, row, at, rc = x[own], row[own], at[own], rc[own]
                if len(x):
                    parts.append((x, {"contig_id": ids[i:][row], "ref_pos": at + starts[i:][row], "is_rc": rc.astype(np.uint8)}))
                    held += len(x)
                if held > BLOCK:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)

    return run


def places_of(contigs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """contig_id, ref_pos, code, is_rc of the places of wanted k-mers (code): tasks drop the others, up to WANTED codes; more are joined."""
    codes = wanted.select("code").distinct()
    asked = asked_codes(codes, k)
    if asked is None:
        return kmers.dense_kmers(contigs, k).join(codes, "code")

    def run(batches):
        among = _Among(asked.value, k)
        for batch in batches:
            ids, starts = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("contig_id", "start"))
            for i, row, at, code, rc in kmers.of_rows(batch.column("sequence"), k):
                own = np.flatnonzero(among(_mixed(code, k)))
                row, at = row[own], at[own]
                columns = [ids[i:][row], at + starts[i:][row], code[own].astype(np.int64), rc[own]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["contig_id", "ref_pos", "code", "is_rc"])

    return kmers.pieces(contigs, k - 1).mapInArrow(run, "contig_id long, ref_pos long, code long, is_rc boolean")


def _bucket(k: int, most: int):
    def run(batches):
        for _, columns in _groups(batches, "bucket"):
            hits = [packs.unpack(v, gap=_gap(k), **_HITS) for v in columns["hits"]]
            x = np.concatenate([np.cumsum(h.pop("gap"), dtype=np.uint64) for h in hits])
            x, r, codes, many = _limited(x, {c: np.concatenate([h[c] for h in hits]) for c in _HITS}, k, most, True)
            hits.clear()
            stored = np.minimum(many, most)
            for v in columns["others"]:
                o = packs.unpack(v, gap=_gap(k), others="<i8")
                np.add.at(many, np.searchsorted(codes, np.cumsum(o["gap"], dtype=np.uint64)), o["others"])
            codes = _unmixed(codes, k)
            ends = np.concatenate([[0], np.cumsum(stored)])
            for i in range(0, len(codes), 20_000):
                j = min(i + 20_000, len(codes))
                own = slice(ends[i], ends[j])
                fields = pa.StructArray.from_arrays(
                    [pa.array(r["contig_id"][own]), pa.array(r["ref_pos"][own]), pa.array(r["is_rc"][own].astype(bool))],
                    ["contig_id", "ref_pos", "is_rc"]
                )
                lists = pa.ListArray.from_arrays(pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[i:j]), pa.array(many[i:j]), pa.array(many[i:j] > most), lists], names=["code", "total", "capped", "hits"]
                )

    return run


def _counts(x: np.ndarray, n: np.ndarray, k: int, m: int) -> list[tuple[int, bytes]]:
    """Sorted mixed codes and their numbers, packed by bucket."""
    buckets, ends = _edges(x, k, m)
    return [(int(b), packs.pack(gap=_gaps_of(x[i:j], k), n=n[i:j].astype(np.uint32))) for b, i, j in zip(buckets, ends[:-1], ends[1:], strict=True)]


def _summed(packed: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all packs of a bucket in order, each's group, and the groups' totals."""
    parts = [packs.unpack(v, gap=_gap(k), n="<u4") for v in packed]
    x = np.concatenate([np.cumsum(p["gap"], dtype=np.uint64) for p in parts])
    by = _order(x, k)
    head, many = _heads(x[by])
    group = np.empty(len(x), np.int64)
    group[by] = np.repeat(np.arange(len(head)), many)
    return x, group, np.add.reduceat(np.concatenate([p["n"] for p in parts])[by].astype(np.int64), head) if len(head) else np.empty(0, np.int64)


def multiplicity(contigs: DataFrame, k: int = 15) -> DataFrame:
    """total, seeds: how many canonical k-mers have how many places. No place is kept: tasks count the codes of a block, and buckets add the counts."""
    n, m = _tasks(contigs), _parts(contigs, BUCKET)

    def counted(batches):
        parts, held = [], 0

        def rows():
            x = np.sort(np.concatenate(parts))
            head, many = _heads(x)
            out = _counts(x[head], many, k, m)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["bucket", "codes"])

        for batch in batches:
            for _, _, _, code, _ in kmers.of_rows(batch.column("sequence"), k):
                if len(code):
                    parts.append(_mixed(code, k))
                    held += len(code)
                if held > BLOCK:
                    yield rows()
                    parts, held = [], 0
        if parts:
            yield rows()

    def added(batches):
        for _, columns in _groups(batches, "bucket"):
            total, seeds = np.unique(_summed(columns["codes"], k)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(seeds)], names=["total", "seeds"])

    packed = kmers.pieces(contigs, k - 1).mapInArrow(counted, "bucket int, codes binary")
    each = _dealt(packed, n, "bucket").mapInArrow(added, "total long, seeds long")
    return each.groupBy("total").agg(F.sum("seeds").alias("seeds"))


def ranked(contigs: DataFrame, k: int = 15) -> DataFrame:
    """Every place of every k-mer with its offset in the k-mer's group and the group's size."""
    dense = kmers.dense_kmers(contigs, k)
    totals = dense.groupBy("code").agg(F.count("*").alias("total"))
    order = Window.partitionBy("code").orderBy("contig_id", "ref_pos")
    return dense.withColumn("offset", F.row_number().over(order) - 1).join(totals, "code")


def keeps(policy: str, offset, total, cap: int, medium: int | None = None, high: int | None = None):
    """Whether a cap policy stores the hit at ``offset`` of a group of ``total``."""
    # i-th spaced offset is floor(i * total / cap); i can only be one of three numbers
    i = F.floor(offset * F.lit(cap) / total)
    step = total / F.lit(float(cap))
    spaced = F.lit(False)
    for d in (0, 1, 2):
        j = i + d
        spaced = spaced | ((j < cap) & (F.floor(j * step) == offset))
    over = {
        "first": offset < cap,
        "drop": F.lit(False),
        "sample-spaced": spaced,
        "adaptive": F.when(total <= (medium or cap), F.lit(True)).when(total <= (high if high is not None else 2**62), spaced).otherwise(F.lit(False)),
    }
    over["sample"] = over["sample-spaced"]
    if policy not in over:
        raise ValueError(f"unknown cap policy {policy!r}; expected first, drop, sample, sample-spaced, isolated or adaptive")
    return F.when(total <= cap, F.lit(True)).otherwise(over[policy])


def build_capped(contigs: DataFrame, k: int, policy: str, cap: int, medium: int | None = None, high: int | None = None) -> DataFrame:
    """An index (columns of ``build``) that stores what a cap policy keeps: a dropped seed stays, with its total and no hits."""
    kept = ranked(contigs, k).withColumn("keep", keeps(policy, F.col("offset"), F.col("total"), cap, medium, high))
    hit = F.when(F.col("keep"), F.struct("contig_id", "ref_pos", "is_rc"))
    grouped = kept.groupBy("code").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(hit)).alias("hits"))
    return grouped.select("code", "total", (F.size("hits") < F.col("total")).alias("capped"), "hits")


def kept_by_policy(held: DataFrame, policies: list[str], cap: int, medium: int | None = None, high: int | None = None) -> DataFrame:
    """policy, hits, seeds, offsets: what cap policies store of k-mers of the given multiplicities (columns of ``multiplicity``).

    What is kept of a k-mer depends on its number of places only: of each number the offsets that any policy can keep are judged once."""
    few = F.sequence(F.lit(0).cast("long"), F.least(F.col("total"), F.lit(max(cap, medium or cap))) - 1)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.floor(i * F.col("total") / cap).cast("long"))
    each = held.select("total", "seeds", F.explode(F.array_distinct(F.concat(few, spaced))).alias("offset")).where("offset < total")
    kept = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), keeps(p, F.col("offset"), F.col("total"), cap, medium, high).alias("keep")) for p in policies)))
    by = each.select("total", "seeds", "offset", kept.alias("k")).where("k.keep").groupBy("k.policy", "total", "seeds")
    some = by.agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))
    return some.groupBy("policy").agg(
        F.sum(F.col("n") * F.col("seeds")).alias("hits"), F.sum("seeds").alias("seeds"), F.sum(F.col("offsets") * F.col("seeds")).alias("offsets")
    )


def _marked(contigs: DataFrame, k: int, most: int, halo: int, use, schema: str) -> DataFrame:
    """Rows that ``use`` makes of the places of a block of contigs, each marked if its k-mer has more than ``most`` places in all.

    Only codes travel: a block sends its distinct codes with their counts to buckets, which answer with those of them that are frequent; the
    answers meet the block's contigs. Contigs of more than a megabase are pieces, with ``halo`` more places on both sides.

    use(pieces, piece, place, own, frequent): pieces are (contig_id, first place, whether there are others of the contig), rows of equal
    ones together; ``own`` are the places that are not in a halo."""
    n, m = _tasks(contigs), _parts(contigs, BUCKET)
    size = kmers.pieces.__defaults__[0]
    long = F.length("sequence") - (k - 1) > size
    at = F.when(long, F.sequence(F.lit(0).cast("long"), (F.length("sequence") - k).cast("long"), F.lit(size).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    cut = contigs.where(F.length("sequence") >= k).select("contig_id", "sequence", long.alias("split"), F.explode(at).alias("low"))
    start = F.greatest(F.col("low") - halo, F.lit(0))
    text = F.substring("sequence", (start + 1).cast("int"), (F.col("low") + (size + halo + k - 1) - start).cast("int"))
    pieces = cut.select(
        F.pmod(F.xxhash64("contig_id", "low"), F.lit(m)).cast("int").alias("block"), "contig_id", "low", "split", start.alias("start"),
        F.when(F.col("split"), text).otherwise(F.col("sequence")).alias("sequence"), F.lit(None).cast("binary").alias("codes")
    )

    def places(columns):
        low, split, starts = (np.array([0 if v is None else v for v in columns[c]], np.int64) for c in ("low", "split", "start"))
        for i, row, at, code, _ in kmers.of_rows(pa.array(columns["sequence"], pa.large_string()), k):
            row = row + i
            place = at + starts[row]
            yield row, place, (split[row] == 0) | ((place >= low[row]) & (place < low[row] + size)), _mixed(code, k)

    def counted(batches):
        for block, columns in _groups(batches, "block"):
            some = [(x[own], x[~own]) for _, _, own, x in places(columns)]
            x = np.sort(np.concatenate([a for a, _ in some]))
            head, many = _heads(x)
            x = x[head]
            if any(len(b) for _, b in some):
                around = np.setdiff1d(np.concatenate([b for _, b in some]), x)
                x, many = np.append(x, around), np.append(many, np.zeros(len(around), np.int64))
                by = np.argsort(x)
                x, many = x[by], many[by]
            out = _counts(x, many, k, m)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([v for _, v in out], pa.binary())],
                names=["bucket", "block", "codes"]
            )

    def answered(batches):
        for _, columns in _groups(batches, "bucket"):
            x, group, total = _summed(columns["codes"], k)
            over = np.flatnonzero((total > most)[group])
            sizes = [int.from_bytes(v[:8], "little") for v in columns["codes"]]
            ends = np.searchsorted(over, np.cumsum([0, *sizes]))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([columns["block"][b] for b in some], pa.int32()),
                    pa.array([packs.pack(gap=_gaps_of(x[over[ends[b] : ends[b + 1]]], k)) for b in some], pa.binary())
                ], names=["block", "codes"]
            )

    def judged(batches):
        for _, columns in _groups(batches, "block"):
            answers = [np.cumsum(packs.unpack(v, gap=_gap(k))["gap"], dtype=np.uint64) for v in columns["codes"] if v is not None]
            among = _Among(np.sort(np.concatenate([np.empty(0, np.uint64), *answers])), k)
            names, number = {}, []
            for c, low, split in zip(columns["contig_id"], columns["low"], columns["split"], strict=True):
                number.append(names.setdefault((c, low), len(names)))
            several = [False] * len(names)
            for i, split in zip(number, columns["split"], strict=True):
                several[i] = several[i] or bool(split)
            number = np.array(number, np.int64)
            some = [(number[row], place, own, among(x)) for row, place, own, x in places(columns)]
            yield use([(*key, s) for key, s in zip(names, several, strict=True)], *(np.concatenate(v) for v in zip(*some, strict=True)))

    sent = _dealt(pieces, n, "block").mapInArrow(counted, "bucket int, block int, codes binary")
    answers = _dealt(sent, n, "bucket").mapInArrow(answered, "block int, codes binary")
    both = pieces.unionByName(answers, allowMissingColumns=True)
    return _dealt(both, n, "block").mapInArrow(judged, schema)


def isolated(contigs: DataFrame, k: int, cap: int, within: int = 512) -> DataFrame:
    """contig_id, hits: places of k-mers over the cap that stay under the isolated policy, which have no place of a k-mer under the cap
    within ``within`` bases."""

    def use(pieces, piece, place, own, frequent):
        key = (piece << 40) + place
        near = np.sort(key[~frequent])
        over = np.flatnonzero(frequent & own)
        at = np.searchsorted(near, key[over] - within)
        alone = (at == len(near)) | (np.append(near, 2**62)[at] > key[over] + within)
        hits = np.bincount(piece[over[alone]], minlength=len(pieces))
        some = np.flatnonzero(hits)
        return pa.RecordBatch.from_arrays([pa.array([pieces[i][0] for i in some], pa.int64()), pa.array(hits[some], pa.int64())], names=["contig_id", "n"])

    return _marked(contigs, k, cap, within, use, "contig_id long, n long").groupBy("contig_id").agg(F.sum("n").alias("hits"))


def _multiplicities(index: DataFrame) -> DataFrame:
    """total, seeds, and the stored places and capped seeds among them, if it is not an index's ``multiplicity`` already."""
    if "seeds" in index.columns:
        return index
    return index.groupBy("total").agg(F.count("*").alias("seeds"), F.sum(F.size("hits")).alias("stored"), F.sum(F.col("capped").cast("long")).alias("capped"))


def cap_distribution(index: DataFrame, cap: int) -> DataFrame:
    """Seeds over the cap by multiplicity: seeds, occurrences, and the mean share that a spaced sample keeps. Of an index or of its ``multiplicity``."""
    edges = [32, 64, 128, 256, 1024, 4096, 65536]
    high = F.lit(2**32 - 1)
    for e in reversed(edges):
        high = F.when(F.col("total") <= e, F.lit(e)).otherwise(high)
    seeds = F.sum("seeds")
    return (
        _multiplicities(index).where(F.col("total") > cap)
        .groupBy(high.cast("long").alias("up_to"))
        .agg(
            seeds.alias("seeds"), F.sum(F.col("total") * F.col("seeds")).alias("occurrences"),
            F.round(F.sum(F.col("seeds") * F.lit(float(cap)) / F.col("total")) / seeds, 6).alias("kept_share")
        )
    )


_GAPS = [16, 32, 64, 128, 512, 2048, 16384]


def position_gaps(contigs: DataFrame, k: int, max_frequency: int) -> DataFrame:
    """Histogram of distances between neighbouring places of a contig, of k-mers with at most max_frequency places.

    Distances are counted in the pieces of contigs; the last place of a long contig's piece and the first one of the next that has some
    are a row each."""
    edges = np.array([*_GAPS, 2**63 - 1])
    names = ["up_to", "n", "contig_id", "low", "first", "last"]

    def use(pieces, piece, place, own, frequent):
        key = np.unique((piece << 40)[own & ~frequent] + place[own & ~frequent])
        piece, place = key >> 40, key & (2**40 - 1)
        gap = np.diff(place)[piece[1:] == piece[:-1]]
        n = np.bincount(np.searchsorted(edges, gap), minlength=len(edges))
        head, many = _heads(piece)
        rows = [(int(edges[i]), int(n[i]), None, None, None, None) for i in np.flatnonzero(n)]
        rows += [(None, None, *pieces[piece[i]][:2], int(place[i]), int(place[i + j - 1])) for i, j in zip(head, many, strict=True) if pieces[piece[i]][2]]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    found = _marked(contigs, k, max_frequency, 0, use, ", ".join(f"{c} long" for c in names))
    gap = F.col("first") - F.lag("last").over(Window.partitionBy("contig_id").orderBy("low"))
    edge = F.lit(2**63 - 1)
    for e in reversed(_GAPS):
        edge = F.when(gap <= e, F.lit(e)).otherwise(edge)
    between = F.when(gap.isNotNull(), edge)
    each = found.select(F.coalesce("up_to", between).cast("long").alias("up_to"), F.coalesce("n", F.lit(1)).alias("n"))
    return each.where("up_to is not null").groupBy("up_to").agg(F.sum("n").alias("gaps"))


def summary(contigs: DataFrame, index: DataFrame, k: int, cap: int) -> DataFrame:
    """One row: contigs, bases, seeds, places, stored places, seeds over the cap. ``index``: an index or its ``multiplicity``."""
    a = contigs.agg(F.count("*").alias("contigs"), F.sum(F.length("sequence")).alias("bases"))
    seeds, total = F.col("seeds"), F.col("total")
    held = _multiplicities(index)
    if "stored" not in held.columns:
        held = held.withColumns({"stored": F.least(total, F.lit(cap)) * seeds, "capped": F.when(total > cap, seeds).otherwise(0)})
    b = held.agg(
        F.coalesce(F.sum("seeds"), F.lit(0)).alias("seeds"), F.sum(total * seeds).alias("places"), F.sum("stored").alias("stored"),
        F.sum("capped").alias("capped_seeds"), F.max("total").alias("max_total")
    )
    return a.crossJoin(b).withColumns({"k": F.lit(k), "max_stored_hits": F.lit(cap)})  # one row each
