"""Kernels against fixtures and naive versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.config import policy
from helixframe.functions import kmers
from helixframe.operators import chain, dp, local, mapper, mapq
from helixframe.operators import cigar as cg

from .dna_helpers import lcg32, pseudo_dna, rc

P, DUAL = policy(), policy(dual_affine=True)


def naive_score(q: str, r: str, p) -> int:
    """Full-matrix score with arbitrary gap costs."""
    low = -(10**9)
    h = np.full((len(q) + 1, len(r) + 1), low)
    h[0, 0] = 0
    for i in range(len(q) + 1):
        for j in range(len(r) + 1):
            if i and j:
                s = p.match if q[i - 1] == r[j - 1] else -p.mismatch
                h[i, j] = max(h[i, j], h[i - 1, j - 1] + s)
            for n in range(1, i + 1):
                h[i, j] = max(h[i, j], h[i - n, j] - cg.gap_cost(n, p))
            for n in range(1, j + 1):
                h[i, j] = max(h[i, j], h[i, j - n] - cg.gap_cost(n, p))
    return int(h[-1, -1])


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=18), st.text("ACGT", min_size=1, max_size=18), st.booleans())
def test_full_alignment_has_the_best_score(q, r, dual):
    p = DUAL if dual else P
    got = dp.align_full(q.encode(), r.encode(), 32, p)
    assert not isinstance(got, str)
    assert cg.query_length(got.cigar) == len(q) and cg.ref_length(got.cigar) == len(r)
    assert got.score == naive_score(q, r, p)


def test_alignment_fixtures():
    for p in (P, DUAL):
        got = dp.align_full(b"ACGTACGTTTACGTACGT", b"ACGTACGTACGTACGT", 32, p)
        assert ("I", 2) in got.cigar and got.edits == 2
    got = dp.align_full(b"AAA", b"AATAA", 32, P)
    assert (got.query_end, got.ref_end, got.edits) == (3, 5, 2)
    assert dp.align_full(b"", b"A", 8, P) == dp.EMPTY
    assert dp.align_full(b"A" * 8193, b"A", 8, P) == dp.BUDGET
    assert dp.align_full(b"A" * 8, b"A", 2, P) == dp.BAND
    assert dp.align_full(b"A" * 200, b"C" * 200, 64, P) == dp.ZDROP
    s = lcg32(1000, 5)
    assert dp.align_banded((s[:300] + s[700:]).encode(), s.encode(), 64, P) == dp.BAND
    assert dp.align_banded((s[:300] + s[700:]).encode(), s.encode(), 450, DUAL).score == 2 * 600 - 424
    local = dp.align_local(s[:200].encode() + b"A" * 3, s[:200].encode(), 32, P)
    assert local.query_end == 200 and local.score == 400


def anchors(*rows):
    return np.array([[r0, r1, q0, q1, q1 - q0] for q0, q1, r0, r1 in rows], np.int64)


def test_chain_fixtures():
    [c] = chain.chains(anchors((0, 100, 1000, 1100), (200, 300, 1200, 1300), (400, 500, 1400, 1500)), 1000, P)
    assert (len(c.anchors), c.covered, c.max_query_gap, c.max_ref_gap) == (3, 300, 100, 100) and P.max_dist == 40000
    two = chain.chains(anchors((0, 100, 100, 200), (120, 220, 300, 400)), 1000, policy(diagonal_tolerance=2))
    assert [len(c.anchors) for c in two] == [1, 1]
    many = [(0, 50, 0, 50), *[(200, 240, 200 + 7 * k, 240 + 7 * k) for k in range(80)], (400, 500, 400, 500)]
    best = chain.chains(anchors(*many), 1000, P)[0]
    assert (best.q_start, best.q_end) == (0, 500) and len(best.anchors) >= 3
    left, right = (chain.built(anchors(*x), 5000) for x in ([(0, 300, 1000, 1300), (300, 600, 1300, 1600)], [(3565, 3865, 1600, 1900), (3865, 4165, 1900, 2200)]))
    whole = chain.bridge(left, right, 5000, P)
    assert whole.max_query_gap == 2965 and (whole.ref_start, whole.ref_end) == (1000, 2200)
    small = [chain.built(anchors(x), 5000) for x in ((0, 100, 1000, 1100), (3065, 3165, 1100, 1200))]
    assert chain.bridge(*small, 5000, P) is None


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(40, 400))
def test_anchors_are_the_maximal_exact_matches(seed, n):
    ref = lcg32(n, seed)
    read = ref[: n // 2] + "A" + ref[n // 2 :]
    got = chain.find_anchors(read.encode(), ref.encode(), 0, P)
    for a in got:
        assert read[a[chain.QUERY] : a[chain.QUERY_END]] == ref[a[chain.REF] : a[chain.REF_END]]
    if n // 2 >= 30:
        assert any(a[chain.QUERY] == 0 and a[chain.REF] == 0 for a in got)


def test_cigar_passes():
    ref, query = b"NNNNNGGGCANNNNN", b"NNNNNGGCAGNNNNN"
    for ops in ("5M1D4M1I5M",):
        assert cg.text(cg.balanced_as_matches(cg.parse(ops), query, ref, P)) == "15M"
    assert cg.text(cg.clean_edges(cg.parse("2D3I5M4D"), 10)[0]) == "3S5M" and cg.clean_edges(cg.parse("2D3I5M"), 10)[1] == 12
    assert cg.text(cg.left_aligned(cg.parse("6M2D6M"), b"ACACACGTGTGT"[:12], b"ACACACACGTGTGT")) == "2D12M"
    left = cg.left_aligned(cg.parse("8M2D6M"), b"GGACACACGTGTGT", b"GGACACACACGTGTGT")
    assert cg.text(left) == "2M2D12M" and cg.metrics(left, b"GGACACACGTGTGT", b"GGACACACACGTGTGT", P)[1] == 2
    assert cg.normalized([("M", 2), ("M", 3), ("I", 0)]) == [("M", 5)]
    with pytest.raises(ValueError):
        cg.parse("3H")
    assert cg.metrics([("M", 4)], b"ACNT", b"ACNA", P) == (0, 1)


def test_confidence_fixtures(spark):
    cases = [((10000, None, 0.95, 20, 500, 0), 60), ((10000, None, 1, 20, 500, 10), 50), ((15000, 13500, 1, 50, 1000, 1), 60), ((15000, 14980, 1, 50, 1000, 1), None), ((15000, 14500, 1, 50, 1000, 1), 23), ((100, 80, 1, 10, 100, 1), 56), ((100, 95, 1, 10, 100, 1), 15), ((100, 100, 1, 10, 100, 1), 0), ((15000, 14999, 1, 50, 1000, 1), 1)]
    cases = [(*args[:2], float(args[2]), *args[3:], want) for args, want in cases if want is not None]
    rows = spark.createDataFrame(cases, "best int, second int, span double, anchors int, covered int, near int, want int")
    got = rows.select(mapq.minimap2(*(F.col(c) for c in ("best", "second", "span", "anchors", "covered", "near"))).alias("q"), "want").collect()
    assert [r.q for r in got] == [r.want for r in got]
    old = spark.createDataFrame([(100, None, 1.0, 60), (100, None, 0.8, 60), (100, None, 0.4, 30), (100, 99, 1.0, 1)], "best int, second int, share double, want int")
    assert all(r.q == r.want for r in old.select(mapq.legacy(F.col("best"), F.col("second"), F.col("share")).alias("q"), "want").collect())


def locus(ref: str, is_rc=False):
    return {"contig_id": 0, "is_rc": is_rc, "offset": 0, "window": ref.encode(), "bonus": 250}


@pytest.mark.parametrize("turn", [False, True])
@pytest.mark.parametrize("change", ["deletion", "insertion"])
def test_indels_in_reads(turn, change):
    ref = lcg32(5000, 717)
    read = ref[100:1500] + ref[1540:2700] if change == "deletion" else ref[100:1500] + lcg32(25, 3) + ref[1500:2700]
    n = 40 if change == "deletion" else 25
    [got] = mapper.align_read((rc(read) if turn else read).encode(), [locus(ref, turn)], DUAL)
    assert got["ref_start"] == 100 and got["edit_distance"] == n
    assert {"op": change[0].upper(), "len": n} in got["cigar"]
    matches = sum(o["len"] for o in got["cigar"] if o["op"] == "M")
    assert got["score"] == 2 * matches - min(6 + 2 * n, 24 + n)


def test_long_insertion_and_split_reads():
    a = pseudo_dna(8000, 101)
    read = a[:4000] + pseudo_dna(2965, 303) + a[4000:]
    got = mapper.align_read(read.encode(), [locus(a)], P)
    assert [g["record_type"] for g in got] == ["primary"]
    assert sum(o["len"] for o in got[0]["cigar"] if o["op"] == "I") >= 2900
    b = pseudo_dna(8000, 505)
    got = mapper.align_read((a[:4000] + b[:4000]).encode(), [locus(a), locus(b) | {"contig_id": 1}], P)
    assert [g["record_type"] for g in got] == ["primary", "supplementary"] and {g["contig_id"] for g in got} == {0, 1}
    assert all(max(o["len"] for o in g["cigar"] if o["op"] == "S") >= 3900 for g in got)


def test_minimizers():
    s = lcg32(600, 3)
    wide = {p for p in kmers.minimizers(s.encode(), 15, 16, kmers.xxh64, True)[0].tolist()}
    narrow = {p for p in kmers.minimizers(s.encode(), 15, 8, kmers.xxh64, True)[0].tolist()}
    assert wide <= narrow
    assert len(kmers.minimizers(b"ACGTACGTACGTACG", 15, 8)[0]) == 1
    broken = s[:100] + "N" + s[101:]
    assert all(not (p <= 100 < p + 15) for p in kmers.minimizers(broken.encode(), 15, 8, kmers.xxh64, True)[0])
    codes = np.array([449396736, 943947776], np.uint64)
    assert set((kmers.xxh64(codes) & np.uint64(2**32 - 1)).tolist()) == {636675604}


@pytest.mark.parametrize("turn", [False, True])
def test_whole_read_in_a_band(spark, turn):
    ref = lcg32(6000, 345)
    read = list(ref[200:3200])
    for k in range(50, 2950, 300):
        read[k] = "ACGT"[("ACGT".index(read[k]) + 1) % 4]
    read = "".join(read[:1500] + read[1510:])
    locus_ = {"contig_id": 3, "is_rc": turn, "offset": 200, "window": ref[200:3200].encode(), "drift": 10, "frequency": 1}
    got = mapper.whole_read((rc(read) if turn else read).encode(), locus_, P)
    assert got["ref_start"] == 200 and got["ref_end"] == 3200 and got["edit_distance"] == 20
    raw = mapper._raw([(0, got)])
    [row] = mapper.judged(spark.range(1).mapInArrow(lambda batches: (raw for _ in batches), mapper.RAW), P).limit(1).collect()
    assert row.mapq == 59
    assert mapper.whole_read(lcg32(3000, 8).encode(), locus_, P) is None
    assert mapper.whole_read(read.encode(), locus_ | {"drift": 300}, P) is None


def test_anchors_over_mismatches():
    ref = lcg32(900, 12)
    read = ref[:300] + "ACGT"["ACGT".index(ref[300]) - 1] + ref[301:600]
    got = chain.over_mismatches(chain.find_anchors(read.encode(), ref.encode(), 0, P), read.encode(), ref.encode(), 0)
    assert any((a[chain.QUERY], a[chain.QUERY_END], a[chain.SCORE]) == (0, 600, 599) for a in got)
    gap = ref[:300] + ref[301:600]
    got = chain.over_mismatches(chain.find_anchors(gap.encode(), ref.encode(), 0, P), gap.encode(), ref.encode(), 0)
    assert all(a[chain.QUERY_END] - a[chain.QUERY] < 330 for a in got)
    [x] = mapper.align_read(read.encode(), [locus(ref)], policy(snp_anchors=True))
    assert x["edit_distance"] == 1 and x["cigar"] == [{"op": "M", "len": 600}]
