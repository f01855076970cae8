"""Joins of query seeds with the index, and exact placements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna
from . import reference


def seeds_with_totals(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """Each query seed with total, stored hits and completeness (complete, sampled, absent). No hit list is read."""
    about = index.select("code", "total", F.size("hits").alias("stored"), "capped")
    kind = F.when(F.col("total").isNull(), "absent").when(F.col("capped"), "sampled").otherwise("complete")
    return seeds.join(about, "code", "left").select(
        "read_ord", "query_pos", "is_rc", "code", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("stored", F.lit(0)).alias("stored"),
        kind.alias("completeness")
    )


def endpoint_seeds(seeds: DataFrame, reads: DataFrame, k: int, window: int = 1000) -> DataFrame:
    """The seeds of reads' ends only: a filter before the join with the index, for searches that need no others."""
    n = reads.select("read_ord", F.length("sequence").alias("n"))
    ends = seeds.join(n, "read_ord").where((F.col("query_pos") + k <= F.least(F.lit(window), F.col("n"))) | (F.col("query_pos") >= F.greatest(F.col("n") - window, F.lit(0))))
    return ends.drop("n")


def seed_hits(seeds: DataFrame, index: DataFrame, most: int = 128) -> DataFrame:
    """Each query seed with its first ``most`` hits as rows: the read's hit cache."""
    hits = index.select("code", "total", "capped", F.slice("hits", 1, most).alias("hits"))
    joined = seeds.join(hits, "code").select("read_ord", "query_pos", F.col("is_rc").alias("q_rc"), "code", "total", "capped", F.explode("hits").alias("h"))
    return joined.select("read_ord", "query_pos", "q_rc", "code", "total", "capped", "h.contig_id", "h.ref_pos", F.col("h.is_rc").alias("r_rc"))


def exact_placements(reads: DataFrame, seeds: DataFrame, index: DataFrame, contigs: DataFrame, k: int, tries: int = 3) -> DataFrame:
    """Reads that a unique seed places without a difference: read_ord, contig_id, ref_start, ref_end, is_rc.

    The first ``tries`` seeds with one place are projected; one that would begin before its contig ends
    the search, one that would end after it is passed over.  Only the reads' own windows of contigs are compared."""
    one = index.where((F.col("total") == 1) & ~F.col("capped")).select("code", F.element_at("hits", 1).alias("h"))
    met = seeds.join(one, "code").select("read_ord", "query_pos", (F.col("is_rc") != F.col("h.is_rc")).alias("is_rc"), "h.contig_id", "h.ref_pos")
    order = Window.partitionBy("read_ord").orderBy("query_pos")
    first = met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= tries)
    sized = first.join(reads.select("read_ord", "sequence"), "read_ord")
    n = F.length("sequence")
    start = F.when(F.col("is_rc"), F.col("ref_pos") - (n - F.col("query_pos") - k)).otherwise(F.col("ref_pos") - F.col("query_pos"))
    placed = sized.withColumn("ref_start", start.cast("long")).withColumn("ref_end", (F.col("ref_start") + n).cast("long"))
    placed = placed.withColumn("under", F.max((F.col("ref_start") < 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("under = 0")
    oriented = F.when(F.col("is_rc"), dna.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence"))
    # compared tile by tile of the contig; a tile that lies beyond its end is missing
    parts = reference.cut_out(placed.withColumn("oriented", F.upper(oriented)), contigs, F.col("ref_start"), F.col("ref_end"))
    own = F.substring("oriented", (F.col("piece_start") - F.col("ref_start") + 1).cast("int"), F.length("piece"))
    each = parts.withColumn("same", F.when(F.upper("piece") == own, F.length("piece")).otherwise(F.lit(0)))
    fits = each.groupBy("read_ord", "rn", "contig_id", "ref_start", "ref_end", "is_rc").agg(F.sum("same").alias("same")).where("same = ref_end - ref_start")
    best = fits.groupBy("read_ord").agg(F.min(F.struct("rn", "contig_id", "ref_start", "ref_end", "is_rc")).alias("b"))
    return best.select("read_ord", "b.contig_id", "b.ref_start", "b.ref_end", "b.is_rc")


def two_ended_loci(
    reads: DataFrame, looked_up: DataFrame, index: DataFrame, k: int, window: int = 1000, seeds: int = 8, hits: int = 32, drift: int = 1000,
    band: int = 2000, loci: int = 8
) -> DataFrame:
    """Loci where seeds of both ends of a read lie about as far apart as on the read.

    read_ord, contig_id, is_rc, band, drift and the coordinates of the tightest pair; the ``loci`` tightest bands.
    Few seeds of an end and few hits of a seed keep the pairs of a read bounded."""
    n = F.length("sequence")
    usable = looked_up.where((F.col("completeness") == "complete") & F.col("total").between(1, hits)).join(reads.select("read_ord", n.alias("n")), "read_ord")
    sides = usable.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    inside = sides.where(
        F.when(
            F.col("side") == 0, F.col("query_pos") + k <= F.least(F.lit(window), F.col("n"))
        ).otherwise(F.col("query_pos") >= F.greatest(F.col("n") - window, F.lit(0)))
    )
    order = Window.partitionBy("read_ord", "side").orderBy("total", "query_pos", "code")
    some = inside.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= seeds)
    placed = some.join(index.select("code", F.explode("hits").alias("h")), "code").select(
        "read_ord", "side", F.col("query_pos").alias("q"), F.col("h.contig_id").alias("contig_id"), F.col("h.ref_pos").alias("r"), (
            F.col("is_rc") != F.col("h.is_rc")
        ).alias("is_rc")
    )
    left = placed.where("side = 0").select("read_ord", "contig_id", "is_rc", F.col("q").alias("q1"), F.col("r").alias("r1"))
    right = placed.where("side = 1").select("read_ord", "contig_id", "is_rc", F.col("q").alias("q2"), F.col("r").alias("r2"))
    far = F.when(F.col("is_rc"), F.col("r1") - F.col("r2")).otherwise(F.col("r2") - F.col("r1"))
    pairs = left.join(right, ["read_ord", "contig_id", "is_rc"]).where("q2 > q1").withColumn(
        "drift", F.abs(far - (F.col("q2") - F.col("q1")))
    ).where((far > 0) & (F.col("drift") <= drift))
    diagonal = F.when(F.col("is_rc"), F.col("q1") + F.col("r1")).otherwise(F.col("r1") - F.col("q1"))
    best = pairs.groupBy(
        "read_ord", "contig_id", "is_rc", F.floor(diagonal / band).alias("band")
    ).agg(F.min(F.struct("drift", "q1", "r1", "q2", "r2")).alias("b"))
    flat = best.select("read_ord", "contig_id", "is_rc", "band", "b.drift", "b.q1", "b.r1", "b.q2", "b.r2")
    rank = Window.partitionBy("read_ord").orderBy("drift", "contig_id", "is_rc", "band")
    return flat.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= loci)


def seed_votes(hits: DataFrame, k: int, most: int = 250, band: int = 2000, least: int = 2) -> DataFrame:
    """For each read the (contig, strand, diagonal band) that most hits vote for: where to look for a stretch that no chain explains.

    hits: columns of ``seed_hits``, of the seeds in the stretch. Diagonals are divided towards zero. Ties go to the lowest contig,
    forward strand and band."""
    rc = F.col("q_rc") != F.col("r_rc")
    diagonal = dna.diagonal(F.col("query_pos"), F.col("ref_pos"), rc, F.lit(k))
    zone = F.expr(f"diagonal div {band}") if band > 0 else F.col("diagonal")
    own = hits.where(~F.col("capped") & (F.col("total") <= most)).select("read_ord", "contig_id", rc.alias("is_rc"), diagonal.alias("diagonal"))
    votes = own.groupBy("read_ord", "contig_id", "is_rc", zone.alias("band")).agg(F.count("*").alias("support")).where(F.col("support") >= least)
    best = votes.groupBy("read_ord").agg(F.min(F.struct((-F.col("support")).alias("s"), "contig_id", "is_rc", "band")).alias("b"))
    return best.select("read_ord", "b.contig_id", "b.is_rc", "b.band", (-F.col("b.s")).alias("support"))
