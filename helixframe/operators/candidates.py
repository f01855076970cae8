"""Candidate loci: probe hits clustered by diagonal, scored and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Policy
from ..functions import dna
from .probes import LEFT, RIGHT


def probe_hits(probes: DataFrame, index: DataFrame, p: Policy) -> DataFrame:
    """Hits of a read's probes in turn, until ``max_total_hits`` have been looked at."""
    order = Window.partitionBy("read_ord").orderBy("ord", "code", "read_pos", "is_rc")
    before = F.coalesce(F.sum("frequency").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = probes.withColumn("before", before).where(F.col("before") < p.max_total_hits)
    hits = index.where(~F.col("capped")).select("code", "hits")
    rows = turn.join(hits, "code").select("*", F.posexplode("hits").alias("i", "h")).where(F.col("before") + F.col("i") < p.max_total_hits)
    rc = F.col("is_rc") != F.col("h.is_rc")
    out = rows.select("read_ord", "segment_index", "read_pos", "code", "frequency", "h.contig_id", "h.ref_pos", rc.alias("is_rc"))
    return out.withColumn("diagonal", dna.diagonal(F.col("read_pos"), F.col("ref_pos"), F.col("is_rc"), F.lit(p.k)))


def clusters(hits: DataFrame, reads: DataFrame, p: Policy) -> DataFrame:
    """Candidates: hits of one read, contig and strand whose diagonals follow each other within the tolerance."""
    group = ["read_ord", "contig_id", "is_rc"]
    order = Window.partitionBy(*group).orderBy("diagonal", "read_pos", "ref_pos", "code", "segment_index")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    marked = hits.withColumn("new", F.when(gap.isNull() | (gap > p.diagonal_tolerance), 1).otherwise(0))
    numbered = marked.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = numbered.groupBy(*group, "cluster").agg(
        F.count_distinct("segment_index").alias("supporting_segments"),
        F.count_distinct("code", "read_pos").alias("unique_probes"),
        F.count("*").alias("n_hits"),
        F.min("ref_pos").alias("ref_start"),
        (F.max("ref_pos") + p.k).alias("ref_end"),
        F.min("read_pos").alias("q_start"),
        (F.max("read_pos") + p.k).alias("q_end"),
        F.min("frequency").alias("best_probe_frequency"),
        F.sum("frequency").alias("sum_frequency"),
        F.sum("diagonal").alias("sum_diagonal"),
        F.array_sort(F.collect_list("diagonal")).alias("diagonals"),
        F.array_sort(F.collect_set(F.when(F.col("segment_index") < 0, F.struct("segment_index", "diagonal")))).alias("ends"),
    )
    mean = F.expr("sum_diagonal div n_hits")
    # the median is kept as a 32-bit float, as ends are compared with it
    median = F.element_at("diagonals", (F.floor(F.col("n_hits") / 2) + 1).cast("int")).cast("float")
    some = each.where(F.col("supporting_segments") >= p.min_segments).withColumns({"diagonal_mean": mean, "diagonal_median": median})

    def end(which):
        near = lambda x: F.least(
            F.abs(x["diagonal"] - F.col("diagonal_mean")), F.abs(x["diagonal"] - F.col("diagonal_median").cast("long"))
        ) <= p.diagonal_tolerance
        return F.exists("ends", lambda x: (x["segment_index"] == which) & near(x))

    support = F.when(end(LEFT) & end(RIGHT), "both").when(end(LEFT), "left").when(end(RIGHT), "right").otherwise("internal")
    sized = some.join(reads.select("read_ord", F.length("sequence").alias("read_len")), "read_ord").withColumn("endpoint_support", support)
    bonus = endpoint_bonus(F.col("endpoint_support"), F.col("read_len"))
    score = F.col("supporting_segments") * 100 + F.col("unique_probes") * 10 + F.col("n_hits") + bonus
    return sized.select(
        "read_ord", "contig_id", "q_start", "q_end", "ref_start", "ref_end", "is_rc", "supporting_segments", "unique_probes", "n_hits",
        "sum_frequency", "best_probe_frequency", "diagonal_mean", F.col(
            "diagonal_median"
        ).cast("long").alias("diagonal_median"), "endpoint_support", score.alias("score"), "read_len",
    )


def endpoint_bonus(support, read_len):
    return F.when(support == "both", 250).when(support.isin("left", "right"), 60).when(read_len >= 2000, -50).otherwise(0)


def top(candidates: DataFrame, p: Policy) -> DataFrame:
    """The best ``max_regions`` candidates of each read."""
    order = Window.partitionBy("read_ord").orderBy(F.desc("score"), "contig_id", "ref_start", "ref_end", "is_rc")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.max_regions)


def find(reads: DataFrame, probes: DataFrame, index: DataFrame, p: Policy) -> DataFrame:
    return top(clusters(probe_hits(probes, index, p), reads, p), p)
