"""One query for each operator over the driver's tables; entry points of the whole engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import policy
from ..functions import dna, kmers
from ..operators import analytics, candidates, index, lookup, mapq, probes, sam
from . import data

P = policy()


def _index(spark, d) -> DataFrame:
    return index.build(data.contigs(spark, d), P.k, P.max_stored_hits)


def _asked(spark, d) -> DataFrame:
    """The index's rows that the reads' seeds ask for: few, and asked for several times in a query, so they are kept after one pass over the contigs."""
    return index.build(data.contigs(spark, d), P.k, P.max_stored_hits, _seeds(spark, d)).persist()


def _seeds(spark, d, persisted: bool = False, w: int = P.window) -> DataFrame:
    return kmers.query_minimizers(data.reads(spark, d), P.k, w, persisted)


def _looked(spark, d, asked: DataFrame | None = None) -> DataFrame:
    return lookup.seeds_with_totals(_seeds(spark, d), asked if asked is not None else _asked(spark, d))


def _kmers_of_reads(spark, d) -> DataFrame:
    """Every 15-mer of every read as text: read_ord, query_pos, kmer."""
    r = data.reads(spark, d)
    at = F.explode(F.when(F.length("sequence") >= P.k, F.sequence(F.lit(0), F.length("sequence") - P.k))).alias("query_pos")
    return r.select("read_ord", "sequence", at).select("read_ord", "query_pos", F.substring("sequence", F.col("query_pos") + 1, F.lit(P.k)).alias("kmer"))


def f1_f5_bases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("kmer")
    c = dna.canonical(k)
    return _kmers_of_reads(spark, d).select(
        "read_ord", F.col("query_pos").cast("long").alias("query_pos"), dna.base_code(
            F.substring("kmer", 1, 1)
        ).alias("first_code"), dna.encode_kmer(k).alias("code"), dna.reverse_complement(k).alias("rc"),
        c["kmer"].alias("canonical"), c["is_rc"].alias("is_rc"),
    )


def f6_hash_code(spark, d):
    return kmers.dense_kmers(data.reads(spark, d).withColumnRenamed("read_ord", "contig_id"), P.k).select(
        F.col("contig_id").alias("read_ord"), F.col("ref_pos").alias("query_pos"), "code", dna.hash_code(F.col("code")).alias("hash")
    )


def f8_mismatches(spark, d):
    """Neighbouring reads over their whole common length."""
    r = data.reads(spark, d).select("read_ord", F.col("sequence").alias("s"))
    other = r.select((F.col("read_ord") - 1).alias("read_ord"), F.col("s").alias("t"))
    both = r.join(other, "read_ord").withColumn("n", F.least(F.length("s"), F.length("t")))
    a, b = F.substring("s", F.lit(1), F.col("n")), F.substring("t", F.lit(1), F.col("n"))
    return both.select("read_ord", dna.mismatch_count(a, b).cast("long").alias("mismatches"), F.round(dna.mismatch_rate(a, b), 9).alias("rate"))


def f15_f16_intervals(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    a, b, n = F.col("l_partkey"), F.col("l_suppkey") * 100, F.col("l_linenumber") - 1
    return li.select(
        "l_orderkey", "l_linenumber", dna.interval_overlap(a, a + 500, b, b + 400).alias("overlap"), dna.gap_cost(n).alias("gap"),
        dna.gap_cost_dual(n).alias("gap_dual")
    )


def f17_repeat_period(spark, d):
    """Windows of 24 bases, end to end over every contig."""
    return kmers.repeat_periods(data.contigs(spark, d)).withColumnRenamed("contig_id", "doc_id")


def f9_bases_match(spark, d):
    """Every base of neighbouring reads' common length, on one strand or on both."""
    r = data.reads(spark, d).select("read_ord", F.col("sequence").alias("s"))
    other = r.select((F.col("read_ord") - 1).alias("read_ord"), F.concat(F.lit("N"), "s").alias("t"))
    both = r.join(other, "read_ord")
    i = F.explode(F.sequence(F.lit(1), F.least(F.length("s"), F.length("t")))).alias("i")
    each = both.select("read_ord", "s", "t", i).select(
        "read_ord", F.substring("s", F.col("i"), F.lit(1)).alias("a"), F.substring("t", F.col("i"), F.lit(1)).alias("b")
    )
    same = lambda rc: F.sum(dna.bases_match(F.col("a"), F.col("b"), F.lit(rc)).cast("long"))
    return each.groupBy("read_ord").agg(same(False).alias("forward"), same(True).alias("reverse"))


def f18_saturated(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", dna.saturated((F.col("l_partkey") - 50) * 100_000_000).alias("held"))


def f20_edit_distance(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    return p.join(
        p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey"
    ).select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


def p1_segments(spark, d):
    return data.contigs(spark, d).select(
        "contig_id", F.explode(dna.segments(F.length("sequence"))).alias("s")
    ).select("contig_id", "s.index", "s.start", "s.end")


def i1_index(spark, d):
    hits = F.array_join(
        F.transform(
            "hits", lambda h: F.concat_ws(":", h["contig_id"].cast("string"), h["ref_pos"].cast("string"), h["is_rc"].cast("int").cast("string"))
        ),
        ","
    )
    return _index(spark, d).select("code", "total", F.size("hits").cast("long").alias("stored"), "capped", F.md5(hits.cast("binary")).alias("hits"))


def i2_i3_cap_policies(spark, d):
    return index.kept_by_policy(index.multiplicity(data.contigs(spark, d), P.k), ["adaptive", "drop", "first", "sample-spaced"], 16, 32, 128)


def i2_isolated(spark, d):
    return index.isolated(data.contigs(spark, d), P.k, 16)


def j3_seed_hits(spark, d):
    return lookup.seed_hits(_seeds(spark, d), _asked(spark, d), P.cached_hits)


def _candidates(spark, d, asked: DataFrame | None = None) -> DataFrame:
    r, i = data.reads(spark, d), asked if asked is not None else _asked(spark, d)
    return candidates.find(r, probes.read_probes(r, lookup.seeds_with_totals(_seeds(spark, d), i), P), i, P)


def j5_hits_in_windows(spark, d):
    asked = _asked(spark, d)
    hits = lookup.seed_hits(_seeds(spark, d), asked, P.cached_hits).where("not capped").select(
        "read_ord", "contig_id", "ref_pos", (F.col("q_rc") != F.col("r_rc")).alias("is_rc")
    )
    c = _candidates(spark, d, asked).select("read_ord", "contig_id", "is_rc", "rank", "ref_start", "ref_end")
    near = F.col("ref_pos").between(F.col("ref_start") - P.flank, F.col("ref_end") + P.flank - P.k)
    return hits.join(c, ["read_ord", "contig_id", "is_rc"]).where(near).groupBy("read_ord", "rank").agg(F.count("*").alias("hits"))


def _exact(spark, d):
    return lookup.exact_placements(data.reads(spark, d), _seeds(spark, d), _asked(spark, d), data.contigs(spark, d), P.k)


def a4_seed_coverage(spark, d):
    iv = _looked(spark, d).where("completeness = 'complete'").select("read_ord", F.col("query_pos").alias("start"), (F.col("query_pos") + P.k).alias("end"))
    return analytics.union_coverage(iv, "read_ord")


def _observed(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") * 7 % 61).cast("int").alias("mapq"), (1 - F.col("quality")).alias("wrong"))


def a12_bins(spark, d):
    c = _candidates(spark, d)
    q = mapq.of_candidates(c, P).select("read_ord", "mapq")
    return analytics.bins(c.where("rank = 1").select("read_ord", "contig_id", "ref_start").join(q, "read_ord"), 1000)


def p15_uncovered(spark, d):
    c = data.contigs(spark, d)
    iv = index.places_of(c, P.k, _seeds(spark, d)).select("contig_id", F.col("ref_pos").alias("start"), (F.col("ref_pos") + P.k).alias("end"))
    return analytics.uncovered(iv, c.select("contig_id", F.length("sequence").cast("long").alias("length")), "contig_id")


def q6_q9_calibrated(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    near = mapq.near_exact(F.col("l_discount"), F.col("l_quantity"), F.col("l_linenumber"), 0.10, 256)
    cal = mapq.calibrated(F.col("l_linenumber") + 40, F.lit(1), F.col("l_discount"), F.lit(1.0))
    return li.select("l_orderkey", "l_linenumber", near.alias("near_exact"), cal.cast("int").alias("calibrated"))


def sam_rows(spark, d) -> DataFrame:
    """Exact placements of the reads as SAM lines, unplaced reads too."""
    r, c = data.reads(spark, d), data.contigs(spark, d)
    n = (F.col("ref_end") - F.col("ref_start")).cast("int")
    placed = _exact(spark, d).select(
        "read_ord", F.lit("primary").alias("record_type"), "contig_id", "ref_start", "is_rc", F.lit(60).alias("mapq"), F.array(
            F.struct(F.lit("M").alias("op"), n.alias("len"))
        ).alias("cigar"), F.lit(0).alias("edit_distance"), (2 * n).alias("score")
    )
    # the tags of a FASTX comment are normalised when it is read
    return sam.records(r.withColumn("tags", dna.optional_fields(F.col("tags"))), placed, c)


def b5_variant_differences(spark, d):
    """Calls of odd line numbers that those of even ones lack."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    calls = lambda n: li.where(F.col("l_linenumber") % 2 == n).select(
        F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt")
    ).distinct()
    return analytics.variant_differences(calls(1), calls(0))


QUERIES = {
    "f1_f5_bases": f1_f5_bases,
    "f6_hash_code": f6_hash_code,
    "f8_mismatches": f8_mismatches,
    "f9_bases_match": f9_bases_match,
    "f15_f16_intervals": f15_f16_intervals,
    "f17_repeat_period": f17_repeat_period,
    "f18_saturated": f18_saturated,
    "f20_edit_distance": f20_edit_distance,
    "p1_segments": p1_segments,
    "p2_minimizers": lambda s, d: _seeds(s, d),
    "p3_minimizers": lambda s, d: _seeds(s, d, True),
    "p4_wide_minimizers": lambda s, d: _seeds(s, d, True, 16),
    "i1_index": i1_index,
    "i2_i3_cap_policies": i2_i3_cap_policies,
    "i2_isolated": i2_isolated,
    "i5_cap_distribution": lambda s, d: index.cap_distribution(index.multiplicity(data.contigs(s, d), P.k), 16),
    "i6_position_gaps": lambda s, d: index.position_gaps(data.contigs(s, d), P.k, 40),
    "i7_summary": lambda s, d: index.summary(data.contigs(s, d), index.multiplicity(data.contigs(s, d), P.k), P.k, P.max_stored_hits),
    "j1_seed_lookup": _looked,
    "j3_seed_hits": j3_seed_hits,
    "j5_hits_in_windows": j5_hits_in_windows,
    "j9_exact_placements": _exact,
    "p7_backbone_probes": lambda s, d: probes.backbone(data.reads(s, d), _looked(s, d), P),
    "p8_endpoint_probes": lambda s, d: probes.endpoints(data.reads(s, d), _looked(s, d), P),
    "p9_p10_read_probes": lambda s, d: probes.read_probes(data.reads(s, d), _looked(s, d), P),
    "a1_a3_candidates": _candidates,
    "a4_seed_coverage": a4_seed_coverage,
    "a9_run_summary": lambda s, d: analytics.run_summary(data.reads(s, d), _exact(s, d)),
    "a10_mapq_caps": lambda s, d: analytics.mapq_caps(_observed(s, d)),
    "a11_calibration": lambda s, d: analytics.calibration(_observed(s, d)),
    "a12_bins": a12_bins,
    "p15_uncovered": p15_uncovered,
    "q4_q7_mapq": lambda s, d: mapq.of_candidates(_candidates(s, d), P),
    "q6_q9_calibrated": q6_q9_calibrated,
    "t1_sam": lambda s, d: sam_rows(s, d).select("read_ord", "line"),
    "b5_variant_differences": b5_variant_differences,
}


def map_long_reads(spark, d):
    """Whole mapping of reads that were cut from contigs and changed: alignments with text CIGARs."""
    from ..operators import mapper

    found = mapper.map_reads(data.long_reads(spark, d), data.contigs(spark, d), policy(max_secondary=1))
    return found.select(
        "read_ord", "record_type", "contig_id", "ref_start", "ref_end", "is_rc", "score", "mapq", sam.cigar_text(F.col("cigar")).alias("cigar"),
        "edit_distance"
    )


def map_short_reads(spark, d):
    from ..operators import mapper

    found = mapper.map_reads(data.reads(spark, d), data.contigs(spark, d), P)
    return found.select(
        "read_ord", "record_type", "contig_id", "ref_start", "ref_end", "is_rc", "score", "mapq", sam.cigar_text(F.col("cigar")).alias("cigar"),
        "edit_distance"
    )


QUERIES |= {"k9_map_long_reads": map_long_reads, "k9_map_short_reads": map_short_reads}


def j8_two_ended_loci(spark, d):
    asked = _asked(spark, d)
    return lookup.two_ended_loci(data.reads(spark, d), _looked(spark, d, asked), asked, P.k)


def a7_seed_votes(spark, d):
    return lookup.seed_votes(lookup.seed_hits(_seeds(spark, d), _asked(spark, d), P.cached_hits), P.k)


def c21_cigar_lengths(spark, d):
    """Operations made from line items: their text, and the lengths on read and reference."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    op = lambda c: F.when(c % 3 == 0, "M").when(c % 3 == 1, "I").otherwise("D")
    ops = F.array(
        *(F.struct(op(c).alias("op"), (c % 40 + 1).cast("int").alias("len")) for c in (F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")))
    )
    total = lambda kinds: F.aggregate("ops", F.lit(0), lambda s, o: s + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))
    return li.withColumn("ops", ops).select(
        "l_orderkey", "l_linenumber", sam.cigar_text(F.col("ops")).alias("cigar"), total("MI").alias("query_length"), total("MD").alias("ref_length")
    )


def st_event_sessions(spark, d):
    """Sessions of the events by user: the batch form of the streaming query."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"),
        "n"
    )


def b4_indel_kinds(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("ref"), F.col("p_type").alias("alt"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("ref").alias("other_ref"), F.col("alt").alias("other_alt"))
    return p.join(other, "p_partkey").select(
        "p_partkey", analytics.indel_kind(F.col("ref"), F.col("alt"), F.col("other_ref"), F.col("other_alt")).alias("kind")
    )


def j13_truth(spark, d):
    """The changed long reads against where they were cut from: right and wrong by confidence."""
    from ..operators import mapper

    r = data.long_reads(spark, d)
    found = mapper.map_reads(r, data.contigs(spark, d), P).where("record_type = 'primary'")
    got = found.select(
        F.col("read_ord").alias("read"), F.col("contig_id").alias("contig"), F.col("ref_start").alias("start"),
        F.when(F.col("is_rc"), "-").otherwise("+").alias("strand"), "mapq"
    )
    truth = data.windows(spark, d).select(F.col("read_ord").alias("read"), F.col("contig_id").alias("contig"), "start", F.lit("+").alias("strand"))
    return analytics.judged(got, truth, 5)


QUERIES |= {
    "j8_two_ended_loci": j8_two_ended_loci, "a7_seed_votes": a7_seed_votes, "c21_cigar_lengths": c21_cigar_lengths,
    "st_event_sessions": st_event_sessions, "b4_indel_kinds": b4_indel_kinds, "j13_truth": j13_truth
}


def a8_diagnostics(spark, d):
    """Counters of the stages over all reads: one row of sums and maxima."""
    r = data.reads(spark, d)
    looked = _looked(spark, d)
    each = looked.groupBy("read_ord").agg(
        F.count("*").alias("seeds"), F.sum(
            (F.col("completeness") == "complete").cast("long")
        ).alias("complete"), F.sum((F.col("completeness") == "sampled").cast("long")).alias("sampled"), F.sum("stored").alias("hits")
    )
    probes_ = probes.read_probes(r, looked, P).groupBy("read_ord").agg(F.count("*").alias("probes"))
    joined = r.select("read_ord").join(each, "read_ord", "left").join(probes_, "read_ord", "left").na.fill(0)
    return joined.agg(
        F.count("*").alias("reads"), *(F.sum(c).alias(c) for c in ("seeds", "complete", "sampled", "hits", "probes")),
        F.max("hits").alias("max_hits"), F.max("probes").alias("max_probes")
    )


QUERIES["a8_diagnostics"] = a8_diagnostics
