"""Probe selection: which of a read's seeds look for candidate loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Policy
from ..functions import dna

LEFT, RIGHT = -2, -1


def usable(looked_up: DataFrame, most: int) -> DataFrame:
    """Seeds that are complete and not too frequent."""
    return looked_up.where((F.col("completeness") == "complete") & F.col("total").between(1, most)).withColumnRenamed("total", "frequency")


def backbone(reads: DataFrame, looked_up: DataFrame, p: Policy) -> DataFrame:
    """Per segment the rarest seeds, first those apart from each other by the spacing, then any other place.

    The greedy choice is a fold over a segment's sorted seeds: at most a segment's worth of rows in an array."""
    parts = reads.select(
        "read_ord", F.explode(dna.segments(F.length("sequence"), p.segment, p.overlap)).alias("s")
    ).select("read_ord", "s.index", "s.start", "s.end")
    seeds = usable(looked_up, p.max_probe_frequency)
    inside = parts.join(seeds, "read_ord").where((F.col("query_pos") >= F.col("start")) & (F.col("query_pos") + p.k <= F.col("end")))
    row = F.struct("frequency", F.col("query_pos").alias("pos"), "code", "is_rc")
    groups = inside.groupBy("read_ord", "index", (F.col("end") - F.col("start")).alias("size")).agg(F.array_sort(F.collect_list(row)).alias("c"))
    spacing = F.greatest(F.floor(F.col("size") / (p.probes_per_segment + 1)), F.lit(50))
    empty = F.slice("c", 1, 0)
    n = p.probes_per_segment

    def apart(acc, x):
        ok = (F.size(acc) < n) & F.forall(acc, lambda s: F.abs(s["pos"] - x["pos"]) >= spacing)
        return F.when(ok, F.array_append(acc, x)).otherwise(acc)

    def relaxed(acc, x):
        ok = (F.size(acc) < n) & ~F.exists(acc, lambda s: s["pos"] == x["pos"])
        return F.when(ok, F.array_append(acc, x)).otherwise(acc)

    chosen = groups.withColumn("a", F.aggregate("c", empty, apart)).withColumn("b", F.aggregate("c", F.col("a"), relaxed))
    by_place = F.array_sort(
        F.transform(
            "b", lambda x: F.struct(x["pos"].alias("pos"), x["code"].alias("code"), x["is_rc"].alias("is_rc"), x["frequency"].alias("frequency"))
        )
    )
    out = chosen.select("read_ord", F.col("index").alias("segment_index"), F.posexplode(by_place).alias("i", "x"))
    return out.select("read_ord", "segment_index", F.col("x.pos").alias("read_pos"), "x.is_rc", "x.code", "x.frequency", (F.col("i") + 1).alias("rank"))


def endpoints(reads: DataFrame, looked_up: DataFrame, p: Policy) -> DataFrame:
    """The rarest seeds of each end of a read."""
    n = F.length("sequence")
    sides = F.array(
        F.struct(F.lit(LEFT).alias("segment_index"), F.lit(0).alias("start"), F.least(n, F.lit(p.endpoint_window)).alias("end")),
        F.struct(F.lit(RIGHT).alias("segment_index"), F.greatest(n - p.endpoint_window, F.lit(0)).alias("start"), n.alias("end")),
    )
    ends = reads.select("read_ord", F.explode(sides).alias("s")).select("read_ord", "s.*")
    seeds = usable(looked_up, p.endpoint_max_frequency)
    inside = ends.join(seeds, "read_ord").where((F.col("query_pos") >= F.col("start")) & (F.col("query_pos") + p.k <= F.col("end")))
    order = Window.partitionBy("read_ord", "segment_index").orderBy("frequency", "query_pos", "code")
    top = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.endpoint_probes)
    return top.select("read_ord", "segment_index", F.col("query_pos").alias("read_pos"), "is_rc", "code", "frequency", "rank")


def deduplicated(probes: DataFrame) -> DataFrame:
    """One probe for each (read, code, strand, place): an endpoint's copy wins, but keeps the first one's turn (``ord``).

    Turns: segments in order, then the left end, then the right; inside them by rank."""
    turn = F.when(F.col("segment_index") == LEFT, 1 << 29).when(
        F.col("segment_index") == RIGHT, (1 << 29) + 1
    ).otherwise(F.col("segment_index")).cast("long") * 1024 + F.col("rank")
    row = F.struct(F.when(F.col("segment_index") < 0, 0).otherwise(1).alias("inner"), turn.alias("turn"), "segment_index", "frequency", "rank")
    best = probes.groupBy("read_ord", "code", "is_rc", "read_pos").agg(F.min(row).alias("b"), F.min(turn).alias("ord"))
    return best.select("read_ord", "b.segment_index", "read_pos", "is_rc", "code", "b.frequency", "b.rank", "ord")


def read_probes(reads: DataFrame, looked_up: DataFrame, p: Policy) -> DataFrame:
    return deduplicated(backbone(reads, looked_up, p).unionByName(endpoints(reads, looked_up, p)))
