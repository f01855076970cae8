"""The driver's tables as contigs and reads: letters of texts become bases, the same way in Spark and in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTCATGGTACCGTATGCACTGATC"


def bases(text: Column) -> Column:
    return F.translate(F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS.upper(), LETTERS), LETTERS, BASES)


_TABLE = bytes.maketrans((LETTERS + LETTERS.upper()).encode(), (BASES * 2).encode())
_DROPPED = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def _as_bases(batches):
    """bases() of texts, byte by byte: what is not an ASCII letter goes, whole characters of several bytes too."""
    for batch in batches:
        texts = [None if t is None else t.encode().translate(_TABLE, _DROPPED).decode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("contig_id"), batch.column("name"), pa.array(texts, pa.string())], names=["contig_id", "name", "sequence"])


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contigs: contig_id is the doc_id. Texts are turned in tasks, where column functions take ten times as long."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select(F.col("doc_id").alias("contig_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("name"), "text")
    return named.mapInArrow(_as_bases, "contig_id long, name string, sequence string")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as reads; those with an odd item_id are reverse complements."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    seq = bases(F.col("text"))
    oriented = F.when(F.col("item_id") % 2 == 1, dna.reverse_complement(seq)).otherwise(seq)
    return rows.select(
        F.col("item_id").alias("read_ord"), F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("read_name"), oriented.alias("sequence"),
        F.lit(None).cast("string").alias("qualities"), F.concat(
            F.lit("RG:Z:g"), (F.col("item_id") % 3).cast("string"), F.lit(" XI:i:"), F.col("item_id").cast("string"), F.lit(" bad-token NM:i:9")
        ).alias("tags"),
    )


def windows(spark: SparkSession, sf_dir: str, length: int = 3000, overlap: int = 200) -> DataFrame:
    """Every contig over its whole length (contig_id, read_ord, start, s): windows of ``length`` bases that overlap by
    ``overlap`` or more, the last one up to the end; a shorter contig is one window."""
    c = contigs(spark, sf_dir).where(F.length("sequence") > 0)
    rest = F.greatest(F.length("sequence") - length, F.lit(0))
    at = F.posexplode(
        F.transform(F.sequence(F.lit(0), F.ceil(rest / (length - overlap)).cast("int")), lambda i: F.least(i * (length - overlap), rest))
    ).alias("turn", "start")
    c = c.select("contig_id", "sequence", at)
    # a contig has fewer than 2 ** 20 windows, as a text has fewer than 2 ** 31 bytes
    return c.select(
        "contig_id", (F.col("contig_id") * (1 << 20) + F.col("turn")).alias("read_ord"), "start",
        F.substring("sequence", F.col("start") + 1, F.lit(length)).alias("s")
    )


def long_reads(spark: SparkSession, sf_dir: str, length: int = 3000) -> DataFrame:
    """windows() with every 211th base changed, and one deletion and one insertion of a few bases."""
    c = windows(spark, sf_dir, length)
    s = F.col("s")
    at = F.floor(F.length(s) / 3).cast("int")
    cut = F.concat(F.substring(s, F.lit(1), at), F.substring(s, at + 8, F.lit(length)))
    c = c.withColumn("grown", F.concat(F.substring(cut, F.lit(1), 2 * at), F.lit("ACGTTGCA"), F.substring(cut, 2 * at + 1, F.lit(length))))
    grown = F.col("grown")
    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(grown) - 1) / 211)), lambda i: F.concat(
        F.translate(F.substring(grown, (i * 211 + 1).cast("int"), F.lit(1)), "ACGT", "CGTA"), F.substring(grown, (i * 211 + 2).cast("int"), F.lit(210)))), "")
    name = F.concat(F.lit("l"), F.col("contig_id").cast("string"), F.lit("_"), F.col("start").cast("string"))
    return c.select(
        "read_ord", name.alias("read_name"), changed.alias("sequence"), F.lit(None).cast("string").alias("qualities"),
        F.lit(None).cast("string").alias("tags")
    )
