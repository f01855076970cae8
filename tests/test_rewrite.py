"""Rewriting passes, islands, staged anchors and the local search against fixtures and plain versions."""

import random

import numpy as np
import pytest

from helixframe import config
from helixframe.config import policy
from helixframe.operators import anchors, chain, dp, local, mapper, rewrite
from helixframe.operators import cigar as cg

from .dna_helpers import pseudo_dna, rc

P = policy()


def edits(ops, query, ref):
    return cg.metrics(ops, query, ref, P)[1]


def test_repeat_anchors_that_split_one_indel_go():
    """32M2D8M2D8M2D50M in a dinucleotide repeat is one gap of six."""
    unit = "AC" * 20
    left, right = pseudo_dna(60, 7), pseudo_dna(60, 8)
    ref, query = left + unit + right, left + unit[6:] + right
    at = len(left)
    rows = [(0, at + 8, 0), (at + 10, at + 18, at + 8), (at + 20, at + 28, at + 16), (at + 30, len(ref), at + 24)]
    a = np.array([(r0, r1, q0, q0 + r1 - r0, r1 - r0) for r0, r1, q0 in rows], np.int64)
    gaps = rewrite.Gaps(query.encode(), ref.encode(), 0, policy(dissolve_run=2), mapper.fill)
    kept = rewrite.without_repeat_runs(a, gaps)
    assert len(kept) == 2
    ops = gaps.between(*rewrite._gap(kept[0], kept[1]))[0]
    assert ("D", 6) in ops and rewrite.gap_opens(ops) == 1
    assert len(rewrite.without_repeat_runs(a, rewrite.Gaps(query.encode(), ref.encode(), 0, policy(dissolve_run=0), mapper.fill))) == 4
    three = a[:3].copy()
    three[2] = a[3]
    three[2, [chain.REF, chain.QUERY]] = at + 22, at + 18  # 2D, a short anchor, 2D
    fragments = rewrite.Gaps((left + unit[4:] + right).encode(), ref.encode(), 0, P, mapper.fill)
    three = np.array([(0, at + 8, 0, at + 8, at + 8), (at + 10, at + 20, at + 8, at + 18, 10), (at + 22, len(ref), at + 18, len(ref) - 4, len(ref) - at - 22)], np.int64)
    assert len(rewrite.unlocked(three, fragments)) == 2
    plain = np.array([(0, 40, 0, 40, 40), (45, 85, 43, 83, 40), (90, 130, 86, 126, 40)], np.int64)
    s = pseudo_dna(130, 9)
    q = s[:42] + s[44:87] + s[88:]
    assert len(rewrite.unlocked(plain, rewrite.Gaps(q.encode(), s.encode(), 0, P, mapper.fill))) == 3


def test_islands_split_a_long_gap():
    rnd = random.Random(5)
    ref = pseudo_dna(3000, 21)
    query = ref[:700] + pseudo_dna(40, 22) + ref[700:1500] + ref[1560:2400] + "".join(rnd.choice("ACGT") for _ in range(50)) + ref[2450:]
    ops = mapper.fill(query.encode(), ref.encode(), P)
    assert cg.query_length(ops) == len(query) and cg.ref_length(ops) == len(ref)
    assert ("I", 40) in ops and ("D", 60) in ops and edits(ops, query.encode(), ref.encode()) <= 100 + 50
    chained = rewrite.islands(query.encode(), ref.encode())
    assert all(query[i : i + n] == ref[j : j + n] for i, j, n in chained) and sum(n for *_, n in chained) > 2200
    assert rewrite.islands(b"ACG", b"ACGT") == [] and rewrite.islands(b"A" * 200, b"A" * 200) == []
    far = mapper.fill(pseudo_dna(9000, 1).encode(), pseudo_dna(9500, 2).encode(), P)
    assert cg.query_length(far) == 9000 and cg.ref_length(far) == 9500
    ends = rewrite.flanked((ref[:64] + pseudo_dna(500, 3) + ref[-64:]).encode(), (ref[:64] + pseudo_dna(900, 4) + ref[-64:]).encode(), P, dp.align_full)
    assert ends[0][0] == "M" and cg.query_length(ends) == 628 and cg.ref_length(ends) == 1028


def test_terminal_span():
    ref = pseudo_dna(600, 31)
    assert rewrite.terminal_span(ref[200:300].encode(), ref[:400].encode(), False) == (0, 300)
    assert rewrite.terminal_span(ref[200:300].encode(), ref[:400].encode(), True) == (200, 400)
    assert rewrite.terminal_span(b"", ref.encode(), True) is None and rewrite.terminal_span(b"N" * 30, ref.encode(), True) is None


def test_phase_is_repaired_only_where_it_helps():
    ref = pseudo_dna(400, 41)
    for query, op in ((ref[:150] + ref[157:360], ("D", 7)), (ref[:150] + "ACGTTGA" + ref[150:340], ("I", 7))):
        ops = [("M", len(query))]
        got = rewrite.phase_repaired(ops, query.encode(), ref.encode())
        assert op[0] in {o for o, _ in got} and edits(got, query.encode(), ref.encode()) < edits(ops, query.encode(), ref.encode()) / 3
        assert cg.query_length(got) == len(query)
    same = [("M", 400)]
    assert rewrite.phase_repaired(same, ref.encode(), ref.encode()) == same
    noise = pseudo_dna(400, 42).encode()
    assert rewrite.phase_repaired(same, noise, ref.encode()) == same


def test_fragments_are_polished():
    unit = "ACG" * 20
    left, right = pseudo_dna(80, 51), pseudo_dna(80, 52)
    ref, query = (left + unit + right).encode(), (left + unit[9:] + right).encode()
    split = cg.parse("86M3D6M3D6M3D113M")
    assert cg.query_length(split) == len(query) and cg.ref_length(split) == len(ref)
    got = rewrite.polished(split, query, ref, P, dp.align_full)
    assert rewrite.gap_opens(got) == 1 and ("D", 9) in got and cg.query_length(got) == len(query) and cg.ref_length(got) == len(ref)
    assert rewrite.polished(split, query, ref, policy(polish=0), dp.align_full) == split


def test_ends_are_clipped_where_they_differ():
    ref = pseudo_dna(300, 61)
    query = pseudo_dna(30, 62) + ref[30:270] + pseudo_dna(30, 63)
    ops, start = rewrite.without_divergent_ends([("M", 300)], query.encode(), ref.encode(), 1000)
    assert ops[0][0] == "S" and 25 <= ops[0][1] <= 32 and ops[-1][0] == "S" and 25 <= ops[-1][1] <= 32 and start == 1000 + ops[0][1]
    assert rewrite.without_divergent_ends([("M", 300)], ref.encode(), ref.encode(), 5) == ([("M", 300)], 5)
    bad = "".join("ACGT"["ACGT".index(c) - 1] for c in ref[:4])
    ops, start = rewrite.score_clipped([("M", 300)], (bad + ref[4:]).encode(), ref.encode(), 50, P)
    assert ops == [("S", 4), ("M", 296)] and start == 54
    ops, start = rewrite.score_clipped([("M", 300)], (ref[:-3] + "".join("ACGT"["ACGT".index(c) - 2] for c in ref[-3:])).encode(), ref.encode(), 50, P)
    assert ops == [("M", 297), ("S", 3)] and start == 50
    gap = cg.parse("12M1D287M")  # eight exact bases on both sides: it stays
    query = ref[:12] + ref[13:]
    assert rewrite.score_clipped(gap, query.encode(), ref.encode(), 0, P) == (gap, 0) and rewrite.protected(gap, query.encode(), ref.encode()) == [False, True, False]
    loose = cg.parse("2M5D293M")
    query = ref[:2] + ref[7:]
    ops, start = rewrite.score_clipped(loose, query.encode(), ref.encode(), 0, P)
    assert ops == [("S", 2), ("M", 293)] and start == 7


def test_staged_anchors_are_exact_and_stop_early():
    ref = pseudo_dna(6000, 71)
    read = list(ref[1000:5000])
    for k in range(100, 4000, 170):
        read[k] = "ACGT"["ACGT".index(read[k]) - 1]
    read = "".join(read)
    staged = anchors.staged(read.encode(), ref.encode(), 300, P)
    assert anchors.sufficient(staged, len(read))
    for r0, r1, q0, q1, n in staged.tolist():
        assert read[q0:q1] == ref[r0 - 300 : r1 - 300] and n == q1 - q0 >= P.min_anchor
    dense = chain.find_anchors(read.encode(), ref.encode(), 300, P)
    assert {tuple(x) for x in staged.tolist()} <= {tuple(x) for x in dense.tolist()}
    emms = anchors.staged(read.encode(), ref.encode(), 300, policy(paired_emms=True))
    assert (emms[:, chain.SCORE] < emms[:, chain.QUERY_END] - emms[:, chain.QUERY]).any()
    m = anchors.Matcher(read.encode(), ref.encode(), P)
    far = anchors.over_pair((0, 200, 3000, 3200), m)
    assert far is None
    found, pairs = anchors.paired([(0, np.array([10])), (100, np.array([110, 500])), (700, np.array([710]))])
    assert found == {0, 100} and pairs == [(0, 100, 10, 110)]
    assert {tuple(x) for x in anchors.staged(read.encode(), ref.encode(), 300, policy(rarest_first=True)).tolist()}
    sparse = chain.find_anchors(read.encode(), ref.encode(), 300, P, sparse=True)
    assert {tuple(x) for x in sparse.tolist()} <= {tuple(x) for x in dense.tolist()} and len(sparse)


def test_ambiguous_anchors():
    read = (pseudo_dna(50, 81) + "AC" * 30 + pseudo_dna(50, 82)).encode()
    rows = np.array([(1000, 1110, 0, 110, 110), (1060, 1106, 58, 104, 46), (2000, 2040, 0, 40, 40)], np.int64)
    assert anchors.ambiguous(rows, read).tolist() == [True, True, False]


@pytest.mark.parametrize("options", [{}, {"near_exact": True}, {"anchor_stages": True}, {"tiered_candidates": True}, {"reseed": True}, {"phase_repair": False}, {"paired_emms": True}])
def test_options_keep_reads_in_their_place(spark, options):
    """Every option maps reads to where they come from; each changes what the search counts or how it goes."""
    ref = pseudo_dna(30_000, 91)
    rnd = random.Random(92)
    rows = []
    for k in range(12):
        at = rnd.randrange(0, 24_000)
        s = list(ref[at : at + 5000])
        for _ in range(25):
            s[rnd.randrange(5000)] = rnd.choice("ACGT")
        if k % 4 == 3:
            del s[2000:2040]
        s = "".join(s)
        rows.append((k, f"r{k}", rc(s) if k % 2 else s, None, None, at))
    reads = spark.createDataFrame([r[:5] for r in rows], "read_ord long, read_name string, sequence string, qualities string, tags string")
    contigs = spark.createDataFrame([(0, "chr0", ref)], "contig_id long, name string, sequence string")
    p = policy(**options)
    got = {r.read_ord: r for r in mapper.map_reads(reads, contigs, p).where("record_type = 'primary'").collect()}
    for k, _, _, _, _, at in rows:
        assert abs(got[k].ref_start - at) <= 5 and got[k].is_rc == bool(k % 2) and got[k].mapq >= 50 and got[k].edit_distance <= 70
    counts = mapper.diagnostics(reads, contigs, p).agg({c: "sum" for c in mapper.COUNTERS}).first().asDict()
    assert counts["sum(records)"] == 12
    if options.get("near_exact"):
        assert counts["sum(near_exact)"] >= 8
    else:
        assert counts["sum(near_exact)"] == 0 and counts["sum(full_searches)"] >= 10


def test_small_and_large_references_give_the_same(spark, monkeypatch):
    """Joins against the index and tiles, and the search inside a task."""
    a, b = pseudo_dna(150_000, 93), pseudo_dna(9_000, 94)
    rnd = random.Random(95)
    rows = []
    for k in range(16):
        src = a if k % 4 else b
        at = rnd.randrange(0, len(src) - 4000)
        s = list(src[at : at + rnd.randint(400, 4000)])
        for _ in range(len(s) // 150 if k % 3 else 0):
            s[rnd.randrange(len(s))] = rnd.choice("ACGT")
        s = "".join(s)
        rows.append((k, f"r{k}", rc(s) if k % 2 else s, None, None))
    rows.append((50, "split", a[1000:4000] + rc(b[2000:5000]), None, None))
    rows.append((51, "none", pseudo_dna(500, 96), None, None))
    reads = spark.createDataFrame(rows, "read_ord long, read_name string, sequence string, qualities string, tags string")
    contigs = spark.createDataFrame([(0, "a", a), (1, "b", b), (2, "copy", a[:6000]), (3, "empty", "")], "contig_id long, name string, sequence string")
    p = policy(max_secondary=2)
    small = sorted(map(str, mapper.map_reads(reads, contigs, p).collect()))
    monkeypatch.setattr(mapper, "SMALL", 0)
    large = sorted(map(str, mapper.map_reads(reads, contigs, p).collect()))
    assert small == large and len(small) > 17


def test_split_read_is_reseeded():
    """The shorter side of a split read has few seeds: its place is found by votes for what no placement explains."""
    a, b = pseudo_dna(9000, 97), pseudo_dna(9000, 98)
    read = (a[2000:6000] + b[3000:3700]).encode()
    table = local.seed_table([(0, a), (1, b)], P)
    seeds = local.seeds_of(read, table, P)
    [found] = local.voted(seeds, table, [(4000, 4700)], P)
    assert found["contig_id"] == 1 and found["ref_start"] <= 3000 and found["ref_end"] >= 3700
    assert local.voted(seeds, table, [], P) == []


def test_options_and_sizes():
    with pytest.raises(ValueError, match="did you mean 'max_secondary'"):
        policy(max_secundary=1)
    assert [config.parse_size(x) for x in ("768", "64M", "2GiB", "1k", "3TB")] == [768, 64 << 20, 2 << 30, 1024, 3 << 40]
    for bad in ("", "M", "1.5G", "-1", "7X"):
        with pytest.raises(ValueError):
            config.parse_size(bad)


def test_n_gapless_rule_is_exact():
    rnd = random.Random(99)
    for dual in (False, True):
        p = policy(dual_affine=dual)
        for _ in range(200):
            n = rnd.randint(1, 14)
            q = "".join(rnd.choices("ACGTN", (4, 4, 4, 4, 1), k=n))
            r = list(q)
            for _ in range(rnd.randint(0, 4)):
                r[rnd.randrange(n)] = rnd.choice("ACGT")
            q, r = q.encode(), "".join(r).encode()
            if mapper._no_gap_is_better(q, r, p):
                got = dp.align_full(q, r, 32, p)
                assert got.score == cg.metrics([("M", n)], q, r, p)[0]


def test_confidence_is_fitted_and_held_out(spark):
    """Exact reads of two equal contigs have no confidence, so no error of the held-out split is trusted."""
    from pyspark.sql import functions as F

    from helixframe.operators import analytics, mapq
    from helixframe.plans import fixtures

    judged = []
    for held_out in (False, True):
        reads, contigs, truth = fixtures.confidence(spark, held_out, 90)
        found = mapper.map_reads(reads, contigs, P).where("record_type = 'primary'").join(reads.select("read_ord", "read_name"), "read_ord").join(contigs.select("contig_id", "name"), "contig_id")
        own = found.select(F.col("read_name").alias("read"), F.col("name").alias("contig"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), F.when(F.col("is_rc"), "-").otherwise("+").alias("strand"), "mapq")
        judged.append(analytics.judged(own, truth).persist())
    caps = analytics.mapq_caps(judged[0].where("mapq is not null")).select("mapq", "cap")
    bounded = mapq.apply_caps(judged[1], caps)
    row = analytics.calibration(bounded.where("mapq is not null")).first()
    assert row.mapped == 90 and row.errors == judged[1].where("wrong = 1 and mapq = 0").count() and 20 <= row.errors <= 40
    assert judged[1].where("wrong = 1 and mapq > 0").count() == 0


def test_digest_does_not_depend_on_partitions(spark):
    from helixframe.operators import sam
    from helixframe.plans import fixtures

    reads, contigs = fixtures.review(spark, 12, 800, 6000)
    one, two = (fixtures.digest(sam.records(r, mapper.map_reads(r, contigs, P), contigs)) for r in (reads, reads.repartition(5)))
    other = reads.where("read_ord > 0")
    assert one == two != fixtures.digest(sam.records(other, mapper.map_reads(other, contigs, P), contigs))
