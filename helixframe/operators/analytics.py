"""Reports over placements: calibration, bins, coverage, run summary, differences between call sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.959963984540054


def mapq_caps(observations: DataFrame, z: float = Z) -> DataFrame:
    """(mapq, total, errors) -> (mapq, total, errors, cap): Phred floor of the Wilson upper bound, monotone in mapq.

    observations: mapq, wrong (0 or 1).  At most 61 groups reach the window."""
    each = observations.groupBy("mapq").agg(F.count("*").alias("total"), F.sum("wrong").alias("errors"))
    n, p = F.col("total").cast("double"), F.col("errors") / F.col("total")
    z2 = F.lit(z * z)
    upper = F.least(F.lit(1.0), (p + z2 / (2 * n) + F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n))
    phred = F.when(upper >= 1, F.lit(0)).otherwise(F.floor(-10 * F.log10(upper))).cast("int")
    own = F.greatest(F.lit(0), F.least(F.lit(60), F.col("mapq"), phred))
    from_here = Window.orderBy("mapq").rowsBetween(0, Window.unboundedFollowing)
    return each.withColumn("own", own).select("mapq", "total", "errors", F.min("own").over(from_here).cast("int").alias("cap"))


def calibration(observations: DataFrame) -> DataFrame:
    """One row: placements, errors seen, and errors that the confidences expect."""
    return observations.agg(
        F.count("*").alias("mapped"), F.sum("wrong").alias("errors"),
        F.round(F.sum(F.pow(F.lit(10.0), -F.col("mapq") / 10.0)), 6).alias("expected_errors")
    )


def judged(alignments: DataFrame, truth: DataFrame, tolerance: int = 0) -> DataFrame:
    """alignments (read, contig, start, strand, mapq) against truth (read, contig, start, end, strand): a row for each read of either.

    wrong is 0 or 1, and null with a null mapq for a read that was not mapped; where both sides have an ``end``, it counts too.  A mapped read
    that the truth does not know fails the job."""
    t = truth.select(
        "read",
        *(
            F.col(c).alias(f"t_{c}") for c in (
                "contig", "start", "strand", *(["end"] if {"end"} <= set(truth.columns) & set(alignments.columns) else [])
            )
        )
    )
    right = (F.col("contig") == F.col("t_contig")) & (F.col("strand") == F.col("t_strand")) & (F.abs(F.col("start") - F.col("t_start")) <= tolerance)
    if "t_end" in t.columns:
        right = right & (F.abs(F.col("end") - F.col("t_end")) <= tolerance)
    known = F.when(F.col("t_contig").isNull(), F.raise_error(F.concat(F.lit("the truth does not know read "), F.col("read").cast("string"))).cast("int"))
    wrong = F.when(F.col("contig").isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(known, F.when(right, 0).otherwise(1)))
    return alignments.join(t, "read", "full").select("read", "mapq", wrong.alias("wrong"))


def bins(placements: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Placements by contig and bin of the reference, with mean confidence; with ``cigar`` also the share of clipped bases (``clipped``)."""
    grouped = placements.groupBy("contig_id", F.floor(F.col("ref_start") / size).alias("bin"))
    extra = []
    if "cigar" in placements.columns:
        total = lambda kinds: F.sum(F.aggregate("cigar", F.lit(0), lambda s, o: s + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0)))
        extra = [F.round(total("S") / total("SM"), 6).alias("clipped")]
    return grouped.agg(F.count("*").alias("placements"), F.round(F.avg("mapq"), 6).alias("mean_mapq"), *extra)


def union_coverage(intervals: DataFrame, *keys: str) -> DataFrame:
    """Bases that the union of (start, end) intervals of each key covers."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reach, F.col("start"))))
    return intervals.withColumn("added", added).groupBy(*keys).agg(F.sum("added").alias("covered"))


def uncovered(intervals: DataFrame, lengths: DataFrame, key: str, least: int = 500, stretch: int = 1 << 20) -> DataFrame:
    """Stretches of at least ``least`` that no interval of a key covers; lengths has (key, length).

    Intervals are worked on by key and part of the key's length, so a long contig is many windows: what the parts before
    reach is carried in a table of a row for each part."""
    edge = lengths.select(key, F.col("length").alias("start"), F.col("length").alias("end"))
    own = intervals.select(key, "start", "end").unionByName(edge).withColumn("part", F.floor(F.col("start") / stretch))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy(key, "part").agg(F.max("end").alias("reach")).select(key, "part", F.max("reach").over(before).alias("before"))
    order = Window.partitionBy(key, "part").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = own.withColumn("inside", F.max("end").over(order)).join(carried, [key, "part"])
    gaps = gaps.withColumn("from", F.coalesce(F.greatest("inside", "before"), F.lit(0)))
    return gaps.where(F.col("start") - F.col("from") >= least).select(key, F.col("from").alias("start"), F.col("start").alias("end"))


def run_summary(reads: DataFrame, placements: DataFrame) -> DataFrame:
    """One row: reads, mapped, unmapped, aligned bases."""
    joined = reads.select("read_ord", F.length("sequence").alias("n")).join(placements.select("read_ord", "ref_start", "ref_end"), "read_ord", "left")
    mapped = F.col("ref_start").isNotNull()
    return joined.agg(
        F.count("*").alias("reads"), F.sum(mapped.cast("long")).alias("mapped"), F.sum((~mapped).cast("long")).alias("unmapped"), F.sum(
            F.coalesce(F.col("ref_end") - F.col("ref_start"), F.lit(0))
        ).alias("aligned_bases")
    )


def variant_differences(a: DataFrame, b: DataFrame, window: int = 50) -> DataFrame:
    """Keys (contig, pos, ref, alt) of a that b lacks, and whether b has any within ``window``: lost, or shifted.

    The near join is on contig and bin, three bins for each row, so it stays an equi-join."""
    lost = a.join(b, ["contig", "pos", "ref", "alt"], "left_anti")
    near = b.select("contig", F.col("pos").alias("near"), F.explode(F.array(*(F.floor(F.col("pos") / window) + d for d in (-1, 0, 1)))).alias("bin"))
    met = lost.withColumn("bin", F.floor(F.col("pos") / window)).join(near, ["contig", "bin"], "left")
    close = F.abs(F.col("near") - F.col("pos"))
    return met.groupBy("contig", "pos", "ref", "alt").agg(F.min(F.when(close <= window, close)).alias("distance")).withColumn(
        "kind", F.when(F.col("distance").isNull(), "missed").otherwise("shifted")
    )


def unit_of(c):
    """The least number of letters that a string repeats, a whole number of times; its length if it repeats none."""
    n = F.length(c)
    fits = F.filter(
        F.sequence(F.lit(1), F.greatest(F.floor(n / 2).cast("int"), F.lit(1))),
        lambda p: (n % p == 0) & (F.repeat(F.substring(c, F.lit(1), p), (n / p).cast("int")) == c) & (p < n)
    )
    return F.coalesce(F.get(fits, F.lit(0)), n)


def indel_disagreements(truth: DataFrame, calls: DataFrame, window: int = 50) -> DataFrame:
    """How calls (contig, pos, ref, alt) disagree with indels of the truth that they lack.

    missed: none within ``window``; fragmented: several; at the place itself copy_number (a whole number of the indel's own
    units too short or too long), length, or spelling; shifted: one, elsewhere.  The near join is on bins."""
    key = ["contig", "pos", "ref", "alt"]
    lost = truth.join(calls, key, "left_anti")
    near = calls.select(
        "contig", F.col("pos").alias("at"), F.struct("ref", "alt").alias("call"),
        F.explode(F.array(*(F.floor(F.col("pos") / window) + d for d in (-1, 0, 1)))).alias("bin")
    )
    met = lost.withColumn("bin", F.floor(F.col("pos") / window)).join(near, ["contig", "bin"], "left").where("at is null or abs(at - pos) <= " + str(window))
    some = lost.join(
        met.where("at is not null").groupBy(*key).agg(
            F.count("*").alias("n"), F.min(F.when(F.col("at") == F.col("pos"), F.col("call"))).alias("same")
        ),
        key, "left"
    )
    grown = F.length("alt") - F.length("ref")
    payload = F.when(grown > 0, F.substring("alt", 2, 1 << 20)).otherwise(F.substring("ref", 2, 1 << 20))
    gap = F.abs(grown) - F.abs(F.length("same.alt") - F.length("same.ref"))
    unit = unit_of(payload)
    at_place = F.when((unit > 1) & (gap != 0) & (gap % unit == 0), "copy_number").when(gap != 0, "length").otherwise("spelling")
    kind = F.when(F.col("n").isNull(), "missed").when(F.col("n") > 1, "fragmented").when(F.col("same").isNotNull(), at_place).otherwise("shifted")
    return some.select(*key, kind.alias("kind"))


def indel_kind(ref, alt, other_ref, other_alt):
    """How two indel calls at one place disagree: copy number, length or spelling."""
    grow, other = F.length(alt) - F.length(ref), F.length(other_alt) - F.length(other_ref)
    return F.when(
        (ref == other_ref) & (alt == other_alt), "same"
    ).when(F.signum(grow) != F.signum(other), "direction").when(grow != other, "length").otherwise("spelling")
