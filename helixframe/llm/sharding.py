"""Sharding by extendible hashing: a directory of hash prefixes, of which only oversized buckets split.

A row's hash is 60 bits of its id and text; the directory starts with one bucket of depth 0.  A bucket whose
texts weigh more than the limit is split on its next bit; others stay.  The weights of the prefixes
come from one aggregate over the hashes (rows combine before the shuffle); each round looks at STEP
further bits of the rows in oversized buckets only, until every bucket fits.  Rows are then assigned
by joining their prefixes with the directory, one equi-join for each STEP of depth that occurs.

A shard fits the limit unless it is a single row (one text over the limit: a shard of its own,
``oversized``) or holds rows with one hash, that is, repeated rows: those are cut into numbered
volumes by the number of copies that fit (copies are counted in parallel parts, so some volumes are not full).  Null and empty texts weigh
  ROW_BYTES, as every row does
beside its text; null ids hash as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

LIMIT = 8 << 20
ROW_BYTES = 16
STEP, BITS = 8, 60


#: Columns that the operator adds to rows while it works on them.
_HASH, _BYTES = "__shard_hash", "__shard_bytes"


def _sized(docs: DataFrame) -> DataFrame:
    """docs with the hash of their id and text, and their weight."""
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + ROW_BYTES).cast("long")
    both = F.concat_ws(":", F.col("doc_id").cast("long").cast("string"), F.col("text"))
    hashed = F.conv(F.substring(F.md5(both.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    return docs.withColumns({_BYTES: size, _HASH: hashed})


def _directory(weights: DataFrame, limit: int) -> DataFrame:
    """The leaves (prefix, level, depth): rows whose hash begins with the prefix of ``level`` bits are in the bucket of its first ``depth`` bits."""
    leaves = None
    open_ = C.cut(weights.withColumn("depth", F.lit(0)), "open")  # hashes that are not in a fitting bucket yet
    depth = 0
    while depth < BITS:
        step = min(STEP, BITS - depth)
        # each hash's prefixes of the next depths, with the bucket's weight at each: split until it fits
        at = open_
        for d in range(depth, depth + step + 1):
            prefix = F.shiftrightunsigned("hash", BITS - d)
            at = at.withColumn(f"p{d}", prefix)
        sums = at.groupBy(f"p{depth + step}").agg(
            *(F.first(f"p{d}").alias(f"p{d}") for d in range(depth, depth + step)), F.sum("w").alias("w"), F.count("*").alias("k")
        )
        # weights of shorter prefixes are sums of those of longer ones: at most 2**STEP rows for each open bucket
        for d in range(depth, depth + step):
            own = Window.partitionBy(f"p{d}")
            sums = sums.withColumn(f"w{d}", F.sum("w").over(own)).withColumn(f"k{d}", F.sum("k").over(own))
        fit = F.when((F.col("w") <= limit) | (F.col("k") == 1), F.lit(depth + step))
        for d in reversed(range(depth, depth + step)):
            fit = F.when((F.col(f"w{d}") <= limit) | (F.col(f"k{d}") == 1), F.lit(d)).otherwise(fit)
        level = sums.select(F.col(f"p{depth + step}").alias("prefix"), fit.alias("depth"))
        closed = C.cut(level.where("depth is not null").select("prefix", F.lit(depth + step).alias("level"), "depth"), "directory")
        leaves = closed if leaves is None else leaves.unionByName(closed)
        still = level.where("depth is null").select("prefix")
        depth += step
        rest = C.cut(
            open_.withColumn(
                "prefix", F.shiftrightunsigned("hash", BITS - depth)
            ).join(still, "prefix", "left_semi").select("hash", "w", "n", "depth"),
            "open"
        )
        C.forget(open_)
        open_ = rest
        if open_.limit(1).count() == 0:
            break
    C.forget(open_)
    return leaves


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows (of ``_sized``) with shard, depth, volume and oversized; no row is added or lost."""
    # one weight for each hash: repeated rows meet here, in the aggregate before the shuffle
    weights = C.cut(rows.groupBy(F.col(_HASH).alias("hash")).agg(F.sum(_BYTES).alias("w"), F.count("*").alias("n")), "weights")
    leaves = _directory(weights, limit)
    levels = sorted(r.level for r in leaves.select("level").distinct().collect())  # at most BITS / STEP
    placed = None
    for level in levels:
        own = leaves.where(F.col("level") == level).select(F.col("prefix").alias("__shard_prefix"), F.col("depth").alias("__shard_depth"))
        own = rows.withColumn("__shard_prefix", F.shiftrightunsigned(_HASH, BITS - level)).join(own, "__shard_prefix").drop("__shard_prefix")
        placed = own if placed is None else placed.unionByName(own)
    if placed is None:  # no rows at all
        placed = rows.withColumn("__shard_depth", F.lit(0))
    shard = F.substring(F.lpad(F.bin(_HASH), BITS, "0"), F.lit(1), F.col("__shard_depth"))
    # copies are numbered inside salted parts, so that even a third of all rows spreads over the tasks
    parts = C.partitions(rows.sparkSession)
    copies = Window.partitionBy(_HASH, "__shard_salt").orderBy(_BYTES)
    fits = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(_BYTES)))
    one_hash = weights.where("n > 1").where(F.col("w") > limit).select(F.col("hash").alias(_HASH))
    heavy = placed.join(one_hash, _HASH, "left_semi").withColumn("__shard_salt", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    number = F.floor((F.row_number().over(copies) - 1) / fits) * parts + F.col("__shard_salt")
    heavy = heavy.withColumn("__shard_volume", number.cast("long")).drop("__shard_salt")
    light = placed.join(one_hash, _HASH, "left_anti").withColumn("__shard_volume", F.lit(0).cast("long"))
    return light.unionByName(heavy).withColumns({"__shard": shard, "__shard_oversized": F.col(_BYTES) > limit})


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, shard (bits of the prefix, '' at depth 0), depth, volume, oversized."""
    rows = C.cut(_sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "rows")
    return _placed(rows, limit).select(
        "doc_id", F.col(_BYTES).alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__shard_depth").alias("depth"), F.col("__shard_volume").alias("volume"), F.col(
            "__shard_oversized"
        ).alias("oversized")
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write docs as Parquet, one folder for each shard and volume: every row once, with its own columns (none of which may be
    called shard or volume).

    The rows themselves pass through the assignment, so repeated ids, texts or whole rows are neither lost nor multiplied."""
    taken = {"shard", "volume"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} name the folders")
    placed = _placed(_sized(docs), limit).withColumns({"shard": F.col("__shard"), "volume": F.col("__shard_volume")})
    placed.select(*docs.columns, "shard", "volume").repartition("shard", "volume").write.partitionBy("shard", "volume").parquet(path)


#: Where no shard is cut into volumes, as one hash never weighs more than a shard.
OP9_SQL = f"""
with r as (
  select row_number() over () as k, doc_id, (strlen(coalesce(text, '')) + {ROW_BYTES})::bigint as n_bytes,
    ('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 15))::bigint as h from documents
), b as (
  select d, h >> ({BITS} - d) as prefix, sum(n_bytes) as w, count(distinct h) as n from r, range(0, 33) as t(d) group by all
), f as (
  select k, doc_id, n_bytes, h, min(b.d) as depth from r, range(0, 33) as t(x) join b on b.d = x and b.prefix = h >> ({BITS} - x) where w <=
    {LIMIT} or n = 1 group by all
)
select doc_id, n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, depth::int) as shard, depth::int as depth, 0::bigint as volume, n_bytes > {LIMIT} as
  oversized from f
"""


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
