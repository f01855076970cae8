"""Readers and writers of sequencing formats; ``register(spark)`` makes the Python data sources known by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bam, fastx
from .bam import BamSource
from .fastx import FastxSource


def register(spark) -> None:
    spark.dataSource.register(FastxSource)
    spark.dataSource.register(BamSource)


def _head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes of a file, or of a folder's first file, from any store."""
    row = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, size).alias("head")).orderBy("path").limit(1).collect()
    if not row:
        raise FileNotFoundError(path)
    return bytes(row[0]["head"])


def reads(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Reads of FASTA, FASTQ or BAM files, told apart by content; columns of ``fastx.as_reads``."""
    if not bam.is_bam(_head(spark, path)):
        return fastx.as_reads(fastx.read(spark, path), limit)
    register(spark)
    rows = spark.read.format("bam").load(path).withColumn("tags", F.lit(None).cast("string")).drop("aux")
    return fastx.as_reads(rows, limit)


def reference(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """("index", its rows) for a stored seed index, ("contigs", rows) for a FASTA file; a path that is tried as an index first.

    Names of the native index formats are refused: their files are not read."""
    if path.lower().endswith((".fmi", ".hfi", ".idx")):
        raise ValueError(f"{path}: only indexes that were stored as Parquet are read")
    try:
        stored = spark.read.parquet(path)
    except Exception:  # no Parquet there: a sequence file
        stored = None
    if stored is not None:
        if not {"code", "total", "capped", "hits"} <= set(stored.columns):
            raise ValueError(f"{path} is not a seed index")
        return "index", stored
    return "contigs", fastx.as_contigs(fastx.read(spark, path))
