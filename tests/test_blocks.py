"""Mapping against a large reference: packed blocks, buckets and pieces of any size give what a search inside a task gives."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.config import policy
from helixframe.functions import kmers
from helixframe.operators import blocks, index, mapper

from .dna_helpers import pseudo_dna, rc

READ, CONTIG = "read_ord long, read_name string, sequence string, qualities string, tags string", "contig_id long, name string, sequence string"


def _tables(spark):
    a, b = pseudo_dna(30_000, 193), pseudo_dna(5_000, 194)
    rnd = random.Random(195)
    rows = []
    for k in range(24):
        src = a if k % 4 else b
        at = rnd.randrange(0, len(src) - 3000)
        s = list(src[at : at + rnd.randint(300, 3000)])
        for _ in range(len(s) // 150 if k % 3 else 0):
            s[rnd.randrange(len(s))] = rnd.choice("ACGT")
        s = "".join(s)
        rows.append((k, f"r{k}", rc(s) if k % 2 else s, None, None))
    rows += [(50, "split", a[1000:3000] + rc(b[2000:4000]), None, None), (51, "none", pseudo_dna(500, 196), None, None)]
    rows += [(52, "empty", "", None, None), (53, "null", None, None, None), (54, "n", a[8000:8400] + "N" * 9 + a[8409:9000], None, None)]
    reads = spark.createDataFrame(rows, READ)
    contigs = spark.createDataFrame([(0, "a", a), (1, "b", b), (2, "copy", a[:6000]), (3, "empty", ""), (4, "n", "NNNN" + b[:900].lower())], CONTIG)
    return reads, contigs


@pytest.mark.parametrize("wanted", [500_000, 0])
def test_blocks_give_what_a_small_reference_gives(spark, monkeypatch, wanted):
    """With contigs in several pieces and codes in several buckets, and with a filter of bits instead of codes."""
    reads, contigs = _tables(spark)
    p = policy(max_secondary=2)
    small = sorted(map(str, mapper.map_reads(reads, contigs, p).collect()))
    monkeypatch.setattr(mapper, "SMALL", 0)
    monkeypatch.setattr(blocks, "BUCKET", 9_000)
    monkeypatch.setattr(blocks, "GROUP", 9_000)
    monkeypatch.setattr(kmers, "PIECE", 7_000)
    monkeypatch.setattr(index, "WANTED", wanted)
    assert sorted(map(str, mapper.map_reads(reads, contigs, p).collect())) == small and len(small) > 24


def test_contigs_are_read_twice_in_all(spark, monkeypatch):
    """Once for their number of bases and once to be packed: every later step works on the packed pieces."""
    reads, contigs = _tables(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(mapper, "SMALL", 0)
    mapper.map_reads(reads, contigs.mapInArrow(count, CONTIG), policy()).agg(F.sum("ref_start")).collect()
    assert seen.value == 2 * contigs.count()


def test_packed_text():
    for s in (b"", b"A", b"ACGTT", b"acgt", b"ACGNT", bytes(range(256))):
        assert blocks.text_of(blocks.packed_text(s)) == s
