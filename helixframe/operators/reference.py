"""Contigs in tiles: parts of chromosomes are joined by (contig_id, tile), so no task gets a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 1 << 16


def tiles(contigs: DataFrame) -> DataFrame:
    """contig_id, tile, piece: TILE bases each, the last of a contig shorter; empty contigs have none."""
    n = F.length("sequence")
    at = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / TILE).cast("int"))).alias("tile")
    return contigs.where(n > 0).select("contig_id", "sequence", at).select(
        "contig_id", "tile", F.substring("sequence", F.col("tile") * TILE + 1, F.lit(TILE)).alias("piece")
    )


def cut_out(places: DataFrame, contigs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Each row of places (contig_id) once for every tile that start .. end meets: ``tile``, ``piece_start`` (on the contig) and ``piece``.

    Pieces of a row, in the order of their tiles, are the bases from start to end or to the contig's end."""
    low, high = F.floor(start / TILE).cast("int"), F.floor((end - 1) / TILE).cast("int")
    rows = places.withColumns({"_start": start.cast("long"), "_end": end.cast("long")})
    spread = rows.where("_end > _start").withColumn("tile", F.explode(F.sequence(low, high)))
    met = spread.join(tiles(contigs), ["contig_id", "tile"])
    begin = F.greatest(F.col("_start"), F.col("tile").cast("long") * TILE)
    size = F.least(F.col("_end"), (F.col("tile").cast("long") + 1) * TILE) - begin
    piece = F.substring("piece", (begin - F.col("tile").cast("long") * TILE + 1).cast("int"), size.cast("int"))
    return met.withColumns({"piece_start": begin, "piece": piece}).drop("_start", "_end")
