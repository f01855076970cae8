"""What the operators of this subpackage share: flat text buffers, hashing, packed records, lineage cuts.

Texts travel through Arrow and are worked on as one flat byte buffer with offsets, so the inner
loops are numpy calls over millions of bytes.  Records that must be shuffled are packed into binary
columns (one row for each task and bucket), which keeps row overhead out of the shuffle.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: A document without an id is ordered after every other document.
NO_ID = (1 << 63) - 1
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_own_dir: list[str] = []
_to_delete: list[str] = []
_places: dict[int, str] = {}


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session; packed shuffles deal out to as many buckets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs that run inside take at most ``rows`` rows in an Arrow batch, so that a batch of long texts stays a few megabytes on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share (``spark.checkpoint.dir``), deleted when the driver ends.

    Where the setting is unset, a folder of our own is used in local mode only: on a cluster it would be another one on each machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="helixframe-"))
        found = "file://" + _own_dir[0]
    path = f"{found.rstrip('/')}/helixframe-{context.applicationId}"
    if path not in _to_delete:
        _to_delete.append(path)
        atexit.register(_delete_at_end, spark, path)
    return path


def _delete_at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        remove(spark, path)


def cut(df: DataFrame, what: str = "cut", codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with short_batches(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for this very frame; nothing may read it, or what was made from it, any more."""
    path = _places.pop(id(df), None)
    if path is not None:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system through Hadoop's own client."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Keys that may be broadcast because they are hot: a fixed number, whatever the input.
HOT_KEYS = 50_000


def hot_limit(total: int) -> int:
    """Rows above which a key is hot. Of ``total`` rows at most HOT_KEYS keys can have more."""
    return max(256, -(-total // HOT_KEYS))


def join_each(rows: DataFrame, about: DataFrame, key: str | list[str], total: int, size: str) -> DataFrame:
    """rows joined with about (one row for each key; ``size``: how many of the ``total`` rows have it).

    The few hot keys are broadcast, so none of them brings its rows into one task; the others are joined as Spark sees fit."""
    limit, keys = hot_limit(total), [key] if isinstance(key, str) else key
    if total <= limit:
        return rows.join(about, keys)
    hot = about.where(F.col(size) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(about.where(F.col(size) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


#: Rows of two numbers that may be broadcast, which is checked.
FEW = 1_000_000


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not among those of gone, which is written first: up to FEW keys are broadcast, so the rows are not shuffled for them."""
    gone = cut(gone.select(*keys).distinct(), "gone")
    if gone.limit(FEW + 1).count() <= FEW:
        gone = F.broadcast(gone)
    return rows.join(gone, keys, "left_anti")


def salted_join(rows: DataFrame, table: DataFrame, key: str, total: int, by: str, salts: int) -> DataFrame:
    """Inner join of ``total`` rows with a table that may have several rows for a key.

    A hot key's rows are dealt over ``salts`` parts by hash of ``by``, and the table's rows of that key are in each part; the
    hot keys themselves (a bounded number) are broadcast, nothing else is."""
    limit = hot_limit(total)
    if total <= limit:
        return rows.join(table, key)
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > limit).select(key, F.lit(True).alias("__hot")))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.sequence(F.lit(0), F.when(F.col("__hot"), F.lit(salts - 1)).otherwise(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("__salt", part).drop("__hot")
    right = table.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")


def keyed(docs: DataFrame) -> DataFrame:
    """``did`` (doc_id, or NO_ID), ``crc`` (tells apart different texts under one id) and ``text`` (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
        F.crc32(text.cast("binary")).alias("crc"),
        text.alias("text"),
    )


#: Texts in a sample, the share of a text's places that is taken, and the most: a fixed number in all, whatever the input and its tasks.
SAMPLE_TEXTS, SAMPLE_RATE, SAMPLE_EACH = 20_000, 1 / 8, 256


def some_texts(keys: DataFrame) -> DataFrame:
    """About SAMPLE_TEXTS rows of ``keyed`` documents (all, if there are fewer), by hash of id and CRC."""
    share = max(1, keys.count() // SAMPLE_TEXTS)
    return keys.where(F.pmod(F.xxhash64("did", "crc"), F.lit(share)) == 0)


def some_of_each(row: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Random places: a share of those of each value of row (ascending), one at least and SAMPLE_EACH at most."""
    by = np.lexsort((rng.random(len(row)), row))
    head = np.flatnonzero(np.append(True, row[by][1:] != row[by][:-1])) if len(row) else np.empty(0, np.int64)
    many = np.diff(np.append(head, len(row)))
    rank = np.arange(len(row)) - np.repeat(head, many)
    return by[rank < np.repeat(np.clip((many * SAMPLE_RATE).astype(np.int64), 1, SAMPLE_EACH), many)]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def longs(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False))


def blocks(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts together stay near ``most`` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer; changes a copy."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= _MIX1
        x ^= x >> U64(27)
        x *= _MIX2
        x ^= x >> U64(31)
    return x


#: A fixed random word for each byte value.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_POWER = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_POWER, pow(_POWER, -1, 1 << 64)):
            p = np.full(size, U64(base))
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n + 1 running sums of values[i] * base**i modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]: the same for the same values wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * U64(0xA24BAED4963EE407))


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in ``buf``) of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, its first word's index."""
    if len(buf) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.empty(len(buf) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    cuts = np.unique(offs[1:-1])  # empty texts repeat an offset
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    both = cuts[word[cuts] & word[cuts - 1]]  # a word ends and another begins where two texts meet
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def multikey(columns: list[np.ndarray], order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort by columns of tokens: partition by one token, go on with the next only inside equal parts.

    Returns the order and, for each place in it, the id of its group of equal rows (ascending)."""
    n = len(columns[0])
    order = np.arange(n) if order is None else order
    group = np.zeros(n, np.int64)
    todo = np.arange(n)  # places whose order is still open
    for col in columns:
        if len(todo) == 0:
            break
        tokens, inside = col[order[todo]], group[todo]
        by = np.argsort(tokens, kind="stable") if inside[0] == inside[-1] else np.lexsort((tokens, inside))
        order[todo] = order[todo][by]
        tokens, inside = tokens[by], inside[by]  # parts stay in their places, as todo is ascending by part
        new = np.empty(len(todo), bool)
        new[0] = True
        np.logical_or(tokens[1:] != tokens[:-1], inside[1:] != inside[:-1], out=new[1:])
        first = todo[np.flatnonzero(new)]
        group[todo] = first[np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
    return order, group


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, deflated: planes of high bytes are mostly zeros and go away."""
    names = list(arrays)
    n = len(arrays[names[0]])
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T).tobytes() if n else b"" for a in arrays.values())
    return np.int64(n).tobytes() + pa.compress(planes, codec="zstd", asbytes=True) if n else np.int64(0).tobytes()


def unpack(blob: bytes, **dtypes: str) -> dict[str, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    widths = [np.dtype(d).itemsize for d in dtypes.values()]
    raw = pa.decompress(blob[8:], decompressed_size=n * sum(widths), codec="zstd", asbytes=True) if n else b""
    out, at = {}, 0
    for (name, d), w in zip(dtypes.items(), widths, strict=True):
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).reshape(-1).view(d) if n else np.empty(0, d)
        at += n * w
    return out


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def runs_to_rows(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then first[1], ..."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)
