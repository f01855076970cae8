"""Substring dedup: remove the words of 13-word windows that earlier documents hold.

Method (log-structured fingerprint index).  Historical windows are kept as immutable runs: Parquet
tables bucketed by a hash of the fingerprint, in which each bucket is a sorted sequence of packs of records.  Documents come
in batches, ascending by id.  A batch's records are dealt out to the same buckets and sorted; a bucket's packs of each
run then stream past them in order and are merge-joined by binary search, so history is neither shuffled nor sorted again, and
only the batch's own bucket and one pack are in memory.  What is new becomes the next run; when there are more than
FANOUT runs, the two smallest are merged into one (compaction: a streaming merge of sorted packs) and deleted.
``FingerprintIndex`` holds the runs; a manifest beside them names the runs, their weights, the number of buckets and the
hot grams, so an index can be reopened by its path in another session for the next batch.

A record stands for a run of neighbouring windows that share an anchor (``spans``): its fingerprint is
the hash of the anchor's GRAM words, and the windows are verified by a second, independent hash of all covered
words.  Where the anchors agree and the covered words do not, only some windows can be equal: the
words themselves are fetched and each window is compared word by word.

A gram that a fixed share of the records have (hot, from a bounded sample of the first batch) is not
used: its windows are records of their own, dealt out by the hash of all their words, so no gram
fills one task.  Before the shuffle each task keeps only its own first documents of a fingerprint.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if it lies in a window whose words also start
in a document with a smaller doc_id; windows are judged on the input.  Null texts have no words; null
ids come last; rows with one id do not remove each other's words, whether they repeat a text or not (their texts are
told apart by CRC).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import spans as S
from .suffix_dedup import COMPARE, PARTS, REMOVE, merged, part_rows

WINDOW, GRAM = 13, 4
FANOUT = 2
BLOCK, PIECE = 1 << 20, 1 << 22
#: Records in a pack, and the share of the sampled records that makes a gram hot.
PACK, HOT = 1 << 16, 1 / 512
#: Shares of the documents after which a new batch begins.
CUTS = (0.5, 0.75)
RECORD = {"gram": "<u8", "span": "<u8", "did": "<i8", "tag": "<u4", "first": "<u4", "count": "<u1", "back": "<u1"}
_48 = C.U64((1 << 48) - 1)


def records(did, crc, buf, offs, hot: np.ndarray | None = None):
    """Records of each block of texts; long texts in pieces of words that overlap by a window.

    The windows of hot grams are records of their own, with hashes of their 13 words as gram and span."""
    for i, j in C.blocks(offs, BLOCK):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, at = C.words_of(b, o)
        word = C.range_hash(C.prefix_hash(C.BYTE[b]), starts, ends)
        s, e, base = at[:-1], at[1:], np.arange(j - i)
        if len(word) > PIECE:  # one very long text
            s = np.arange(0, len(word), PIECE - WINDOW + 1)
            e, base = np.minimum(s + PIECE, len(word)), np.zeros(len(s), np.int64)
            for a, z in zip(s, e, strict=True):
                yield from _records(word[a:z], np.array([0]), np.array([z - a]), np.array([i]), np.array([a]), did, crc, hot)
            continue
        yield from _records(word, s, e, i + base, np.zeros(j - i, np.int64), did, crc, hot)


def _records(word, s, e, row, shift, did, crc, hot):
    r = S.find(word, s, e, WINDOW, GRAM)
    if r is None:
        return
    gram, span, piece, first, count, back = r.gram & _48, r.span & _48, r.row, r.first, r.count, r.anchor - r.first
    if hot is not None and len(hot) and (often := np.isin(gram, hot)).any():
        at = C.runs_to_rows(first[often], count[often])
        one = np.repeat(piece[often], count[often])
        own, other = (C.range_hash(C.prefix_hash(w), at, at + WINDOW) & _48 for w in (word, C.mix(word)))
        gram, span, piece, first = (np.concatenate([x[~often], y]) for x, y in ((gram, own), (span, other), (piece, one), (first, at)))
        count, back = np.append(count[~often], np.ones(len(at), np.int64)), np.append(back[~often], np.zeros(len(at), np.int64))
    own = row[piece]
    yield {
        "gram": gram, "span": span, "did": did[own], "tag": crc[own].astype(np.uint32), "first": (first - s[piece] + shift[piece]).astype(np.uint32),
        "count": count.astype(np.uint8), "back": back.astype(np.uint8),
    }


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Grams that a fixed share (HOT) of sampled records have: at most 1 / HOT of them. The sample is of a fixed size (``common.some_texts``)."""

    def sample(batches):
        rng = np.random.default_rng(7)
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            for r in records(np.arange(batch.num_rows), C.longs(batch.column("crc")), buf, offs):
                own = C.some_of_each(r["did"], rng)
                yield pa.RecordBatch.from_arrays([pa.array([r["gram"][own].tobytes()], pa.binary())], names=["g"])

    rows = C.some_texts(C.keyed(docs)).mapInArrow(sample, "g binary").toArrow()["g"].to_pylist()
    grams, times = np.unique(np.frombuffer(b"".join(rows), np.uint64), return_counts=True)
    return grams[(times >= 16) & (times > HOT * times.sum())]


def sort(r: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """By (gram, span, did); with marks where an equal fingerprint (gram and span) begins, and where a gram does."""
    by = np.lexsort((r["first"], r["did"]))
    order, group = C.multikey([r["gram"], r["span"]], by)
    r = {k: v[order] for k, v in r.items()}
    same = np.append(True, group[1:] != group[:-1]) if len(order) else np.empty(0, bool)
    gram = np.append(True, r["gram"][1:] != r["gram"][:-1]) if len(order) else same
    return r, same, gram


def within(r, same):
    """Which rows have an equal in a document with a smaller id among the rows."""
    lead = r["did"][np.flatnonzero(same)][np.cumsum(same) - 1] if len(same) else r["did"]
    return r["did"] > lead


def take(r, mask):
    return {k: v[mask] for k, v in r.items()}


def removal_rows(r) -> pa.RecordBatch:
    did, crc, start, end = merged(r["did"], r["tag"].astype(np.int64), r["first"], r["first"].astype(np.int64) + r["count"] - 1 + WINDOW)
    return part_rows(did, crc, REMOVE, start, end - start, np.zeros(len(did)))


def with_pack(rows: pa.RecordBatch, bucket=None) -> pa.RecordBatch:
    """Rows of results carry no pack; they pass through a bucket of their own number, or stay in one."""
    n = rows.num_rows
    own = np.arange(n, dtype=np.int32) if bucket is None else np.full(n, bucket, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(own), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary()), *rows.columns],
        names=["bucket", "turn", "low", "pack", *rows.schema.names]
    )


def pack_rows(bucket, low, packs) -> pa.RecordBatch:
    n = len(packs)
    zero = np.zeros(n)
    rows = part_rows(zero, zero, 0, zero, zero, zero)
    columns = [pa.array(np.asarray(bucket, np.int32)), pa.array(np.full(n, NEW, np.int32)), pa.array(np.asarray(low, np.int64)), pa.array(packs, pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *rows.columns], names=["bucket", "turn", "low", "pack", *rows.schema.names])


def sorted_packs(bucket: int, r: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Sorted records of a bucket in packs, each with its first gram."""
    at = range(0, len(r["gram"]), PACK)
    return pack_rows([bucket] * len(at), [int(r["gram"][k]) for k in at], [C.pack(**take(r, slice(k, k + PACK))) for k in at])


STEP = f"bucket int, turn int, low long, pack binary, {PARTS}"
_STEP = [c.split(" ")[0] for c in STEP.split(", ")]
RUN = "bucket int, turn int, low long, pack binary"
#: Turns of the rows of a bucket: results that pass through, the batch's packs, then the runs.
NEW, OLD = 1, 2


class FingerprintIndex:
    """Immutable sorted runs under a folder of the shared file system; an index that is there is reopened."""

    def __init__(self, spark, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{C.shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or C.partitions(spark)
        self.runs: list[tuple[str, int]] = []  # name of its table and folder, documents in it
        self.hot: np.ndarray | None = None  # found in the first batch; the same for all runs
        self._load()

    def _manifest(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> None:
        if not C.exists(self.spark, f"{self.path}/manifest.json"):
            return
        [row] = self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).collect()
        got = json.loads(row.value)
        if got["pack"] != list(RECORD.items()) and got["pack"] != [list(x) for x in RECORD.items()]:
            raise ValueError(f"{self.path} holds another kind of index")
        self.buckets, self.hot = got["buckets"], np.array(got["hot"], np.uint64)
        self.runs = [(name, weight) for name, weight in got["runs"]]
        for name, _ in self.runs:
            if not self.spark.catalog.tableExists(name):
                columns = RUN + ", " + PARTS + ", is_run boolean"
                self.spark.sql(
                    f"create table {name} ({columns}) using parquet partitioned by (is_run) clustered by (bucket) into {self.buckets} buckets location '{self.path}/{name}'"
                )
                self.spark.sql(f"msck repair table {name}")

    def _save(self) -> None:
        """A new manifest takes the old one's place by renaming."""
        path, fs = self._manifest()
        new = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{uuid.uuid4().hex}")
        text = json.dumps({"buckets": self.buckets, "hot": [int(x) for x in self.hot], "runs": self.runs, "pack": list(RECORD.items())})
        out = fs.create(new)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)

    def _table(self, df: DataFrame) -> str:
        """Write rows (bucket, ..., is_run) as a bucketed table of the index."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.path}/{name}").partitionBy("is_run").bucketBy(self.buckets, "bucket").saveAsTable(name)
        return name

    def _rows(self, name: str, turn: int) -> DataFrame:
        return self.spark.table(name).where("is_run").select(
            "bucket", F.lit(turn).alias("turn"), "low", "pack", *(F.lit(0).cast(t).alias(c) for c, t in (x.split(" ") for x in PARTS.split(", ")))
        )

    def add(self, docs: DataFrame, weight: int = 1) -> DataFrame:
        """Merge-join a batch with the runs, write its run, compact; returns decided and open parts (PARTS).

        The caller passes batches in ascending order of doc_id: all that is in the index counts as earlier."""
        n = self.buckets
        if self.hot is None:
            self.hot = hot_grams(docs)
        with C.short_batches(self.spark):
            moved = C.keyed(docs).mapInArrow(_batch(n, self.hot), STEP).repartition(n, "bucket")
            for k, (name, _) in enumerate(self.runs):  # bucketed as the batch is: the union needs no exchange
                moved = moved.unionByName(self._rows(name, OLD + k))
            joined = moved.sortWithinPartitions("bucket", "turn", "low").groupBy("bucket").applyInArrow(_merge_join, STEP)
            name = self._table(joined.withColumn("is_run", F.col("pack").isNotNull()))
        self.runs.append((name, weight))
        if len(self.runs) > FANOUT:
            self.compact()
        self._save()
        return self.spark.read.schema(STEP + ", is_run boolean").parquet(f"{self.path}/{name}").where("not is_run").select(
            *(x.split(" ")[0] for x in PARTS.split(", "))
        )

    def compact(self) -> None:
        """Merge the two smallest runs, bucket by bucket, without a shuffle. Results that were given out stay readable."""
        self.runs.sort(key=lambda x: -x[1])
        (a, wa), (b, wb) = self.runs[-2:]
        both = self._rows(a, OLD).unionByName(self._rows(b, OLD)).sortWithinPartitions("bucket", "low")
        merged_run = both.groupBy("bucket").applyInArrow(_merge, STEP)
        self.runs[-2:] = [(self._table(merged_run.withColumn("is_run", F.lit(True))), wa + wb)]
        for old in (a, b):
            self.spark.sql(f"drop table if exists {old}")
            C.remove(self.spark, f"{self.path}/{old}/is_run=true")


def _batch(n: int, hot: np.ndarray):
    def run(batches):
        parts = []
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            parts += records(C.longs(batch.column("did")), C.longs(batch.column("crc")), buf, offs, hot)
        if not parts:
            return
        r, same, _ = sort(C.joined(parts))
        del parts
        later = within(r, same)  # decided here: an earlier document of this task has the same
        yield with_pack(removal_rows(take(r, later)))
        r = take(r, ~later)
        bucket = (C.mix(r["gram"]) % C.U64(n)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(n + 1))
        full = np.flatnonzero(np.diff(ends))
        yield pack_rows(full, np.zeros(len(full)), [C.pack(**take(r, by[ends[i] : ends[i + 1]])) for i in full])

    return run


def _of_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    yield from zip(batch.column("turn").to_pylist(), (x.as_py() for x in batch.column("pack")), strict=True)


def _merge_join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: results that pass through, the batch's packs, then the runs' packs, sorted."""
    bucket, new, r = key[0].as_py(), [], None
    for batch in batches:
        done = batch.filter(batch.column("pack").is_null())
        if done.num_rows:
            yield done.select(_STEP)
        for turn, pack in _of_batch(batch.filter(batch.column("pack").is_valid())):
            if turn == NEW:
                new.append(C.unpack(pack, **RECORD))
                continue
            if not new and r is None:
                continue  # the batch has nothing in this bucket
            if r is None:
                r, new = _Batch(C.joined(new)), []
            asked = r.meet(C.unpack(pack, **RECORD))
            if len(asked["gram"]):
                yield with_pack(part_rows(asked["did"], asked["tag"], COMPARE, asked["first"], asked["count"], asked["back"]), bucket)
    if r is None and new:
        r = _Batch(C.joined(new))
    if r is not None:
        for x in r.settled():
            yield with_pack(x, bucket)
        yield sorted_packs(bucket, take(r.r, r.fresh))


class _Batch:
    """A bucket's records of the batch, sorted, and what is known of each."""

    def __init__(self, records: dict[str, np.ndarray]):
        self.r, self.same, gram = sort(records)
        self.later = within(self.r, self.same)
        many = np.bincount(np.cumsum(gram) - 1, self.same)
        self.open = many[np.cumsum(gram) - 1] > 1  # the gram occurs with other words in this batch
        self.fresh = self.same.copy()

    def meet(self, h: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Merge with a sorted pack of a run: both are sorted by gram, so each finds its partners by binary search. Returns the run's records to compare."""
        own = self.r["gram"]
        low, high = np.searchsorted(own, h["gram"], "left"), np.searchsorted(own, h["gram"], "right")
        h = take(h, high > low)
        if not len(h["gram"]):
            return h
        first, last = np.searchsorted(h["gram"], own, "left"), np.searchsorted(h["gram"], own, "right")
        at = np.flatnonzero(last > first)  # the batch's records with a partner
        n = len(h["gram"])
        order, group = C.multikey([np.concatenate([h["gram"], own[at]]), np.concatenate([h["span"], self.r["span"][at]])])
        head = np.append(True, group[1:] != group[:-1])
        of = np.cumsum(head) - 1
        old = np.bincount(of, order < n) > 0
        every = np.concatenate([h["gram"], own[at]])[order]
        begin = np.append(True, every[1:] != every[:-1])
        several = np.bincount(np.cumsum(begin) - 1, head) > 1
        known, differs = np.empty(len(order), bool), np.empty(len(order), bool)
        known[order], differs[order] = old[of], several[np.cumsum(begin) - 1]
        self.later[at] |= known[n:]
        self.fresh[at] &= ~known[n:]
        self.open[at] |= differs[n:]
        return take(h, differs[:n])

    def settled(self) -> Iterator[pa.RecordBatch]:
        yield removal_rows(take(self.r, self.later))
        # an open record needs the comparison for the first document that has it, and for others that are not decided
        for own in (self.open & self.same, self.open & ~self.same & ~self.later):
            x = take(self.r, own)
            yield part_rows(x["did"], x["tag"], COMPARE, x["first"], x["count"], x["back"])


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's packs of two runs, in the order of their first grams: what lies before the next pack's is final."""
    bucket, held = key[0].as_py(), None
    for batch in batches:
        for low, (_, pack) in zip(batch.column("low").to_pylist(), _of_batch(batch), strict=True):
            if held is not None:
                done = int(np.searchsorted(held["gram"], np.uint64(low), "left"))
                if done >= PACK:
                    yield sorted_packs(bucket, take(held, slice(0, done)))
                    held = take(held, slice(done, None))
            now = C.unpack(pack, **RECORD)
            if held is None:
                held = now
                continue
            r, same, _ = sort(C.joined([held, now]))
            held = take(r, same)
    if held is not None:
        yield sorted_packs(bucket, held)


def based(docs: DataFrame) -> DataFrame:
    """doc_id, did, crc and text: both joins below shuffle this same frame, so its exchange is made once."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)).alias("did"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def resolve(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Word spans to remove (did, crc, first, count): the decided ones, and of the open ones what the words themselves say."""
    n = C.partitions(docs.sparkSession)
    wanted = parts.where(f"kind = {COMPARE}").groupBy("did", "crc").agg(F.collect_set(F.struct("first", "count", "back")).alias("spans"))
    texts = based(docs).join(wanted, ["did", "crc"]).select("doc_id", "did", "crc", "text", "spans")

    def fetch(batches):
        for batch in batches:
            whole, offs = C.flat(batch.column("text"))
            spans = batch.column("spans")
            per = np.asarray(pa.compute.list_value_length(spans))
            last = np.concatenate([[0], np.cumsum(per)])
            fields = [np.asarray(spans.flatten().field(i)).astype(np.int64) for i in range(3)]
            did, crc = C.longs(batch.column("did")), C.longs(batch.column("crc"))
            for i, j in C.blocks(offs, BLOCK):
                row = np.repeat(np.arange(j - i), per[i:j])
                if len(row):
                    own = slice(last[i], last[j])
                    yield from cut_out(whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i], row, did[i:j], crc[i:j], *(f[own] for f in fields))

    def cut_out(buf, offs, row, did, crc, f, c, k):
        """The words of the asked spans, one space after each, packed by bucket of their anchor's gram."""
        starts, ends, at = C.words_of(buf, offs)
        first, size = at[row] + f, c - 1 + WINDOW
        fits = first + size <= at[row + 1]
        row, f, c, k, first, size = (x[fits] for x in (row, f, c, k, first, size))
        if not len(row):
            return
        gram = S.gram_hashes(C.range_hash(C.prefix_hash(C.BYTE[buf]), starts, ends), GRAM)[first + k]
        bucket = (gram % C.U64(n)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(n + 1))
        length = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        for i in np.flatnonzero(np.diff(cuts)):
            own = by[cuts[i] : cuts[i + 1]]
            w = C.runs_to_rows(first[own], size[own])
            long = ends[w] - starts[w] + 1
            text = np.full(int(long.sum()), 32, np.uint8)
            text[C.runs_to_rows(np.cumsum(long) - long, long - 1)] = buf[C.runs_to_rows(starts[w], long - 1)]
            n_bytes = length[first[own] + size[own]] - length[first[own]]
            head = C.pack(
                did=did[row[own]], crc=crc[row[own]].astype(np.uint32), first=f[own].astype(np.uint32), count=c[own].astype(np.uint8), gram=gram[own],
                size=n_bytes.astype(np.uint32)
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([head], pa.binary()), pa.array([text.tobytes()], pa.binary())], names=["bucket", "head", "data"]
            )

    def compare(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                held.setdefault(x["bucket"], []).append((x["head"], x["data"]))
        for bucket in list(held):
            got = held.pop(bucket)
            r = C.joined([C.unpack(h, did="<i8", crc="<u4", first="<u4", count="<u1", gram="<u8", size="<u4") for h, _ in got])
            data = np.frombuffer(b"".join(d for _, d in got), np.uint8)
            del got
            size = r["size"].astype(np.int64)
            begin = np.cumsum(size) - size
            order = np.argsort(r["gram"], kind="stable")
            work = np.cumsum(size[order])
            at = 0
            while at < len(order):  # whole groups of equal grams, about BLOCK bytes at once
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + BLOCK)))
                while to < len(order) and r["gram"][order[to]] == r["gram"][order[to - 1]]:
                    to += 1
                own = order[at:to]
                at = to
                yield removal_rows(repeated({c: v[own] for c, v in r.items()}, data[C.runs_to_rows(begin[own], size[own])]))

    def repeated(r, data):
        """Windows whose words start in a document with a smaller id; equal hashes are verified byte by byte."""
        starts, ends, _ = C.words_of(data, np.array([0, len(data)]))
        count = r["count"].astype(np.int64)
        words = count - 1 + WINDOW
        base = np.cumsum(words) - words
        w = C.runs_to_rows(base, count)
        row = np.repeat(np.arange(len(count)), count)
        first = r["first"][row] + (w - base[row])
        a, z = starts[w], ends[w + WINDOW - 1]
        key = C.range_hash(C.prefix_hash(C.BYTE[data]), a, z)
        by = np.lexsort((first, r["did"][row], key))
        key, row, first, a, z = key[by], row[by], first[by], a[by], z[by]
        same = np.append(True, key[1:] != key[:-1])
        lead = np.flatnonzero(same)[np.cumsum(same) - 1]
        gone = np.flatnonzero(r["did"][row] > r["did"][row[lead]])
        gone = gone[z[gone] - a[gone] == z[lead[gone]] - a[lead[gone]]]
        good = []
        for part in np.array_split(gone, max(1, len(gone) // 20_000)):
            size = z[part] - a[part]
            if len(part):
                wrong = data[C.runs_to_rows(a[part], size)] != data[C.runs_to_rows(a[lead[part]], size)]
                good.append(part[np.add.reduceat(wrong, np.cumsum(size) - size) == 0])
        gone = np.concatenate(good) if good else gone
        return {"did": r["did"][row[gone]], "tag": r["crc"][row[gone]].astype(np.uint32), "first": first[gone], "count": np.ones(len(gone), np.int64)}

    rows = texts.mapInArrow(fetch, "bucket int, head binary, data binary").repartition(n, "bucket").mapInArrow(compare, PARTS)
    return parts.where(f"kind = {REMOVE}").select("did", "crc", "first", "count").unionByName(rows.select("did", "crc", "first", "count"))


def batches_of(docs: DataFrame) -> list[tuple[DataFrame, int]]:
    """Batches ascending by doc_id (null ids last): the first half is the history of what follows."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID))
    cuts = docs.agg(F.percentile_approx(did, list(CUTS)).alias("q")).first().q or []
    edges = sorted(set(cuts))
    out, shares = [], [CUTS[0], *(b - a for a, b in zip(CUTS, CUTS[1:], strict=False)), 1 - CUTS[-1]]
    for k in range(len(edges) + 1):
        own = docs
        own = own.where(did > edges[k - 1]) if k else own
        own = own.where(did <= edges[k]) if k < len(edges) else own
        out.append((own, int(100 * shares[min(k, len(shares) - 1)])))
    return out


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    index = FingerprintIndex(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = None
    for own, weight in batches_of(slim):
        found = index.add(own, weight)
        parts = found if parts is None else parts.unionByName(found)
    removed = resolve(slim, parts).groupBy("did", "crc").agg(F.collect_list(F.struct("first", "count")).alias("removed"))
    whole = based(slim).join(removed, ["did", "crc"], "left").select("doc_id", "did", "crc", "text", "removed")

    def finish(batches):
        for batch in batches:
            all_bytes, all_offs = C.flat(batch.column("text"))
            for i, j in C.blocks(all_offs, BLOCK):
                yield kept_rows(all_bytes[all_offs[i] : all_offs[j]], all_offs[i : j + 1] - all_offs[i], batch.slice(i, j - i))

    def kept_rows(buf, offs, batch):
        starts, ends, at = C.words_of(buf, offs)
        gone = np.zeros(len(starts) + 1, np.int64)
        column = batch.column("removed")
        per = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
        f, c = (np.asarray(column.flatten().field(i)).astype(np.int64) for i in range(2))
        row = np.repeat(np.arange(len(per)), per)
        np.add.at(gone, at[row] + f, 1)
        np.add.at(gone, np.minimum(at[row] + f + c, at[row + 1]), -1)
        stay = np.cumsum(gone[:-1]) == 0
        kept = []
        for i in range(batch.num_rows):
            own = at[i] + np.flatnonzero(stay[at[i] : at[i + 1]])
            length = ends[own] - starts[own] + 1
            text = np.full(int(length.sum()), 32, np.uint8)
            text[C.runs_to_rows(np.cumsum(length) - length, length - 1)] = buf[C.runs_to_rows(starts[own], length - 1)]
            kept.append(text[:-1].tobytes().decode())
        n = np.diff(at)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(np.concatenate([[0], np.cumsum(stay)])[at])), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    return whole.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
  select doc_id, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 0) + 1)) as p,
    unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) as words from d
), first as (
  select words, min(doc_id) as least from windows group by words
), gone as (
  select distinct doc_id, unnest(range(p, p + {WINDOW})) as i from windows join first using (words) where doc_id > least
), every as (
  select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d
), kept as (
  select doc_id, count(*) as n_words, count(gone.i) as n_removed, string_agg(word, ' ' order by i) filter (gone.i is null) as rest
  from every left join gone using (doc_id, i) group by doc_id
)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256 from
  d left join kept using (doc_id)
"""


def brute_force(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of all windows (small inputs, distinct ids)."""
    import hashlib
    import re

    least: dict[tuple[str, ...], int] = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - WINDOW + 1):
            k = tuple(w[p : p + WINDOW])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - WINDOW + 1):
            if least[tuple(w[p : p + WINDOW])] < i:
                gone[p : p + WINDOW] = [True] * WINDOW
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out
