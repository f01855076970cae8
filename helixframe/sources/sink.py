"""Where SAM lines go: by the name of the output."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sam
from . import bam


def write(records: DataFrame, contigs: DataFrame, path: str, carried: list[str] | None = None, sort: bool = False, level: int = 6) -> None:
    """``-``: the standard output; ``*.bam``: one BAM file; anything else: a folder of SAM text.

    Lines come in the order of the reads; a folder's part 0 begins with the header.  ``sort`` is for BAM only."""
    header = sam.header(contigs, carried)
    if path.endswith(".bam"):
        bam.write(records, header, contigs, path, sort, level)
        return
    if sort:
        raise ValueError("only BAM is sorted by place")
    spark = records.sparkSession
    top = spark.createDataFrame([(k, line) for k, line in enumerate(header)], "k long, line string")
    whole = top.select(F.lit(-1).cast("long").alias("read_ord"), F.col("k").alias("turn"), "line").unionByName(
        records.select("read_ord", F.col("turn").cast("long").alias("turn"), "line")
    )
    lines = whole.orderBy("read_ord", "turn").select("line")
    if path == "-":
        for r in lines.toLocalIterator():
            sys.stdout.write(r.line + "\n")
    else:
        lines.write.text(path)
