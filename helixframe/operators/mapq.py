"""Confidence of placements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def minimap2(best: Column, second: Column, span: Column, anchors: Column, covered: Column, competing: Column) -> Column:
    """``second`` is null if there is no rival; a rival with the same score gives 0, a better best at least 1."""
    span_factor = F.when((span >= 0.5) | (covered >= 1000), F.lit(1.0)).otherwise(_clamp(span / 0.5, 0.1, 1.0))
    anchor_factor = F.when((anchors >= 10) | (covered >= 200), F.lit(1.0)).otherwise(_clamp(anchors / 10.0, 0.1, 1.0))
    x = _clamp(F.greatest(second, F.lit(0)) / F.greatest(best, F.lit(1)), 0.0, 1.0)
    ratio = 40.0 * (1.0 - x * x) * F.ln(F.greatest(best / 2.0, F.lit(2.0)))
    base = F.when(second.isNull(), F.lit(60.0)).otherwise(F.least(ratio, 3.0 * (best - second)))
    penalty = F.when(competing > 1, 4.343 * F.ln(competing)).otherwise(F.lit(0.0))
    q = F.round(_clamp(base - penalty, 0.0, 60.0) * span_factor * anchor_factor).cast("int")
    return F.when(second >= best, F.lit(0)).when((best > second) & (q == 0), F.lit(1)).otherwise(q)


def legacy(best: Column, second: Column, coverage: Column) -> Column:
    margin = F.when(second.isNull(), F.lit(1.0)).when(best > 0, _clamp(F.greatest(best - second, F.lit(0)) / best, 0.0, 1.0)).otherwise(F.lit(0.0))
    return F.round(60.0 * margin * F.least(_clamp(coverage, 0.0, 1.0) / 0.8, F.lit(1.0))).cast("int")


def near_exact(divergence: Column, drift: Column, frequency: Column, max_divergence: float = 0.10, max_drift: int = 256) -> Column:
    ceiling = max(max_divergence, 0.02 + 1e-6)
    sequence = _clamp((ceiling - divergence) / (ceiling - 0.02), 0.0, 1.0)
    geometry = 1.0 - 0.5 * _clamp(drift / float(max(max_drift, 1)), 0.0, 1.0)
    return F.round(_clamp(60.0 * sequence * geometry * F.when(frequency <= 1, 1.0).otherwise(0.85), 0.0, 60.0)).cast("int")


def capped(q: Column, limited: Column, rival: Column, ambiguous: Column, limited_cap: int = 50, ambiguity_cap: int = 5) -> Column:
    """A limited search without a rival, and an ambiguous one, bound the confidence."""
    q = F.when(limited & ~rival, F.least(q, F.lit(limited_cap))).otherwise(q)
    return F.when(ambiguous, F.least(q, F.lit(ambiguity_cap))).otherwise(q)


def search_is_limited(retained: Column, clustering_cap: int, budget: int) -> Column:
    return (retained >= clustering_cap) | (retained > budget)


def calibrated(q: Column, score: Column, edits: Column, aligned: Column) -> Column:
    """Lower for alignments that differ by more than 2 %."""
    divergence = edits / aligned
    identity = _clamp(1.0 - divergence, 0.0, 1.0)
    low = F.round(_clamp(q * F.pow(identity / 0.98, F.lit(2.0)), 0.0, 60.0)).cast("int")
    return F.when((q == 0) | (score <= 0) | (aligned == 0), F.lit(0)).when(divergence > 0.02, low).otherwise(q)


def of_candidates(candidates: DataFrame, p) -> DataFrame:
    """Each read's best candidate with its rival and confidence, candidate scores standing for alignment scores."""
    order = Window.partitionBy("read_ord").orderBy("rank")
    rival = F.lead("score").over(order)
    many = F.count("*").over(Window.partitionBy("read_ord"))
    best = candidates.withColumns({"second": rival, "n": many}).where("rank = 1")
    span = (F.col("q_end") - F.col("q_start")) / F.col("read_len")
    q = minimap2(F.col("score"), F.col("second"), span, F.col("unique_probes"), F.col("q_end") - F.col("q_start"), F.col("n"))
    limited = search_is_limited(F.col("n"), p.max_regions, p.max_candidates)
    return best.select(
        "read_ord", "contig_id", "score", "second", F.col("n").alias("n_candidates"), q.alias("mapq_mm2"), legacy(
            F.col("score"), F.col("second"), span
        ).alias("mapq_legacy"),
        capped(q, limited, F.col("second").isNotNull(), F.lit(False), p.limited_cap, p.ambiguity_cap).alias("mapq"),
    )


def apply_caps(alignments: DataFrame, caps: DataFrame) -> DataFrame:
    """Bound mapq by a table (mapq, cap) of at most 61 rows."""
    return alignments.join(
        F.broadcast(caps.where("mapq between 0 and 60").groupBy("mapq").agg(F.min("cap").alias("cap"))), "mapq", "left"
    ).withColumn("mapq", F.least("mapq", F.coalesce("cap", "mapq"))).drop("cap")
