"""Queries that ask for an index several times make it once; batches of files are worked on in parts."""

import pyarrow as pa
import pytest

from helixframe.operators import index
from helixframe.plans import queries
from helixframe.sources import fastx


@pytest.mark.parametrize("name", ["j5_hits_in_windows", "j8_two_ended_loci"])
def test_one_index_for_a_query(spark, monkeypatch, name):
    made, real = [], index.build
    monkeypatch.setattr(index, "build", lambda *a: made.append(a) or real(*a))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_batches_of_records_are_small():
    n = 2 * fastx.SOME + 7
    values = [f"c{i} x\nac\nGT" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n), pa.array(values)], names=["file", "block", "value"])
    parts = list(fastx._parts(">")([batch]))
    assert [p.num_rows for p in parts] == [fastx.SOME, fastx.SOME, 7]
    out = list(fastx._records_of(">")([pa.Table.from_batches(parts).combine_chunks().to_batches()[0]]))
    assert [b.num_rows for b in out] == [fastx.SOME, fastx.SOME, 7]
    assert [x for b in out for x in b.column("name").to_pylist()] == [f"c{i}" for i in range(n)]


def test_contigs_are_not_read_again_for_a_header_that_names_them(spark, tmp_path):
    import gzip

    from helixframe import sources
    from helixframe.operators import sam
    from helixframe.sources import bam

    contigs = spark.createDataFrame([(7, "b", "ACGTA"), (2, "a", "ACG"), (9, "c", "")], "contig_id long, name string, sequence string")
    lines = sam.header(contigs)
    assert lines == ["@HD\tVN:1.6\tSO:unknown", "@SQ\tSN:a\tLN:3", "@SQ\tSN:b\tLN:5", "@SQ\tSN:c\tLN:0"]
    sources.register(spark)
    rows = [(1, 0, "q\t0\tb\t2\t60\t3M\t*\t0\t0\tCGT\t*", 7, 1)]
    found = spark.createDataFrame(rows, "read_ord long, turn int, line string, contig_id long, ref_start long").coalesce(1)
    bam.write(found, lines, None, str(tmp_path / "x.bam"), sort=True)
    assert bam.header(gzip.decompress((tmp_path / "x.bam").read_bytes()))[1] == [("a", 3), ("b", 5), ("c", 0)]
