"""Generated genomes and reads with known places: for the benchmark, and for fitting and judging confidences."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS = "read_ord long, read_name string, sequence string, qualities string, tags string"
CONTIGS = "contig_id long, name string, sequence string"
TRUTH = "read string, contig string, start long, end long, strand string"


def _turned(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def review(spark: SparkSession, reads: int = 1000, length: int = 10_000, size: int = 400_000, seed: int = 906) -> tuple[DataFrame, DataFrame]:
    """Reads of a random genome with a short repeat every 2,500 bases: 20 bases of each are drawn anew, odd reads are turned."""
    rnd = random.Random(seed)
    genome = rnd.choices("ACGT", k=size)
    for at in range(0, size, 2500):
        genome[at : at + 120] = "ACGTAC" * 20
    rows = []
    for k in range(reads):
        at = rnd.randrange(0, size - length)
        own = genome[at : at + length]
        for _ in range(20):
            own[rnd.randrange(length)] = rnd.choice("ACGT")
        s = "".join(own)
        rows.append((k, f"r{k}", _turned(s) if k % 2 else s, None, None))
    return spark.createDataFrame(rows, READS), spark.createDataFrame([(0, "chr0", "".join(genome))], CONTIGS)


def confidence(spark: SparkSession, held_out: bool, reads: int = 600, length: int = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads, contigs and truth: exact reads of two equal contigs and a unique one, in turn. The two splits share nothing."""
    rnd = random.Random(991 if held_out else 719)
    twice, once = ("".join(rnd.choices("ACGT", k=25_000)) for _ in range(2))
    contigs = [(0, "a", twice), (1, "b", twice), (2, "unique", once)]
    rows, truth = [], []
    for k in range(reads):
        _, name, s = contigs[k % 3]
        at = rnd.randrange(100, 19_000)
        rows.append((k, f"r{k}", s[at : at + length], None, None))
        truth.append((f"r{k}", name, at, at + length, "+"))
    return spark.createDataFrame(rows, READS), spark.createDataFrame(contigs, CONTIGS), spark.createDataFrame(truth, TRUTH)


def digest(records: DataFrame) -> str:
    """One hash of all lines of ``sam.records``, whatever the partitions: the same records give the same digest."""
    each = records.select(F.sha2("line", 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(8)]
    row = each.agg(F.count("*").alias("n"), *sums).first()
    return "-".join(f"{int(x or 0):x}" for x in row)
