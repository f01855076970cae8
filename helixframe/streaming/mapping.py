"""Mapping a stream of reads: each micro-batch is joined with the stored index and written in the order of its reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Policy
from ..operators import mapper, sam


def map_stream(stream: DataFrame, contigs: DataFrame, seed_index: DataFrame, out: str, checkpoint: str, p: Policy, once: bool = True):
    """Start mapping a fastx stream (file, ordinal, name, sequence, qualities, tags) to SAM lines under ``out``.

    Mapping keeps no state between reads, so a micro-batch is an ordinary batch: batches are folders
    ``batch=N``, and one that is repeated after a failure is written over, so each read is written once."""

    def write(batch: DataFrame, number: int) -> None:
        reads = batch.select(
            F.xxhash64("file", "ordinal").alias("read_ord"), "file", "ordinal", F.col("name").alias("read_name"), "sequence", "qualities", "tags"
        )
        found = mapper.map_reads(reads, contigs, p, seed_index)
        lines = sam.records(reads.drop("file", "ordinal"), found, contigs).join(reads.select("read_ord", "file", "ordinal"), "read_ord")
        lines.orderBy("file", "ordinal", "turn").select("line").write.mode("overwrite").text(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def user_sessions(spark: SparkSession, path: str, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """Sessions of the events table as a stream: events and value by user and session, late rows bounded by a watermark."""
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
    )
