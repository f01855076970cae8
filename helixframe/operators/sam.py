"""SAM text of placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna


def cigar_text(ops: Column) -> Column:
    """array<struct<op,len>> as text; empty: ``*``."""
    return F.when(F.size(ops) == 0, F.lit("*")).otherwise(F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))


def quality_text(q: Column, reverse: Column) -> Column:
    """``*`` without qualities; reversed for reverse placements, with bytes outside the printable range as ``!``."""
    back = F.regexp_replace(F.reverse(q), "[^!-~]", "!")
    return F.when(q.isNull(), F.lit("*")).when(reverse, back).otherwise(q)


def header(contigs: DataFrame, carried: list[str] | None = None) -> list[str]:
    """Header lines; a line for each contig, which is the format's own size. Contigs are read once: the driver sorts what it gets."""
    lines = ["@HD\tVN:1.6\tSO:unknown"]
    rows = contigs.select("contig_id", "name", F.length("sequence").alias("length")).toArrow().sort_by("contig_id")
    lines += [f"@SQ\tSN:{name}\tLN:{n}" for name, n in zip(rows["name"].to_pylist(), rows["length"].to_pylist(), strict=True)]
    return lines + [x for x in carried or [] if x.startswith(("@RG", "@CO"))]


def records(reads: DataFrame, alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """read_ord, turn (0 primary, then secondary, then supplementary), line, and the place it sorts by: contig_id and ref_start (null: unplaced).

    alignments: read_ord, record_type, contig_id, ref_start, is_rc, mapq, cigar, edit_distance, score. They are computed once: a
    read's entries for SA are gathered by a window over the partitioning that the join with its read needs anyway."""
    names = contigs.select("contig_id", "name")
    placed = alignments.join(names, "contig_id").withColumn("cigar_text", cigar_text(F.col("cigar")))
    strand = F.when(F.col("is_rc"), "-").otherwise("+")
    entry = F.concat_ws(
        ",", "name", (F.col("ref_start") + 1).cast("string"), strand, "cigar_text", F.col("mapq").cast("string"),
        F.concat(F.col("edit_distance").cast("string"), F.lit(";"))
    )
    kind = F.when(F.col("record_type") == "primary", 0).when(F.col("record_type") == "secondary", 1).otherwise(2)
    placed = placed.withColumns({"kind": kind, "entry": entry})
    own = F.when(F.col("kind") != 1, F.struct("kind", "contig_id", "ref_start", "entry"))
    placed = placed.withColumn("set", F.array_sort(F.collect_list(own).over(Window.partitionBy("read_ord"))))
    whole = reads.join(placed, "read_ord", "left")
    flag = F.when(F.col("kind").isNull(), 4).otherwise(
        F.when(F.col("is_rc"), 16).otherwise(0) + F.when(F.col("kind") == 1, 256).when(F.col("kind") == 2, 2048).otherwise(0)
    )
    seq = F.when(F.col("is_rc"), dna.sam_complement(F.col("sequence"))).otherwise(F.col("sequence"))
    others = F.transform(F.filter("set", lambda x: x["entry"] != F.col("entry")), lambda x: x["entry"])
    sa = F.when((F.col("kind") != 1) & (F.size("set") > 1), F.concat(F.lit("SA:Z:"), F.array_join(others, "")))
    tags = F.when(F.col("kind").isNull(), F.nullif("tags", F.lit(""))).otherwise(F.nullif(dna.optional_fields(F.col("tags"), ("NM", "AS", "SA")), F.lit("")))
    mapped = F.col("kind").isNotNull()
    line = F.concat_ws(
        "\t",
        F.col("read_name"),
        flag.cast("string"),
        F.coalesce("name", F.lit("*")),
        F.coalesce((F.col("ref_start") + 1).cast("string"), F.lit("0")),
        F.coalesce(F.col("mapq").cast("string"), F.lit("0")),
        F.coalesce("cigar_text", F.lit("*")),
        F.lit("*"), F.lit("0"), F.lit("0"),
        seq,
        quality_text(F.col("qualities"), F.coalesce("is_rc", F.lit(False))),
        F.when(mapped, F.concat(F.lit("NM:i:"), F.col("edit_distance").cast("string"))),
        F.when(mapped, F.concat(F.lit("AS:i:"), F.col("score").cast("string"))),
        tags,
        sa,
    )
    return whole.select("read_ord", F.coalesce("kind", F.lit(0)).alias("turn"), line.alias("line"), "contig_id", "ref_start")


def checked(reads: DataFrame) -> DataFrame:
    """reads, whose names, qualities and sequences may go into a tab-separated line: a tab or a line break in one fails the job."""
    bad = F.lit(False)
    for c in ("read_name", "sequence", "qualities"):
        bad = bad | F.coalesce(F.col(c).rlike(r"[\t\r\n]"), F.lit(False))
    fine = F.when(
        bad, F.raise_error(F.concat(F.lit("a field of read "), F.col("read_ord").cast("string"), F.lit(" holds a tab or a line break")))
    ).otherwise(F.col("read_name"))
    return reads.withColumn("read_name", fine)


def valid_reads(reads: DataFrame) -> DataFrame:
    """Reads that can be mapped: a name, a sequence, and as many qualities as bases if there are any."""
    whole = F.col("qualities").isNull() | (F.length("qualities") == F.length("sequence"))
    return reads.where((F.length(F.trim("read_name")) > 0) & (F.length("sequence") > 0) & whole)


def split_statistics(alignments: DataFrame) -> DataFrame:
    """One row about split reads: reads, records, reads with a supplementary record, of those on several contigs or on both strands, and the
    supplementary records themselves."""
    each = alignments.where("record_type <> 'secondary'").groupBy("read_ord").agg(
        F.count("*").alias("records"), F.count_distinct("contig_id").alias("contigs"), F.count_distinct("is_rc").alias("strands")
    )
    split = F.col("records") > 1
    count = lambda c: F.sum(c.cast("long"))
    return each.agg(
        F.count("*").alias("reads"), F.sum("records").alias("records"), count(split).alias("split_reads"), count(
            split & (F.col("contigs") > 1)
        ).alias("several_contigs"),
        count(split & (F.col("strands") > 1)).alias("both_strands"), F.sum(F.col("records") - 1).alias("supplementary"),
    )
