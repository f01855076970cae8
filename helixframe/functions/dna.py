"""Column functions over DNA strings, seeds and intervals. All are built-in expressions: they stay in the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM's complements, IUPAC codes included, in both cases.
_CODES, _COMPLEMENTS = "ACGTUNRYSWKMBVDHacgtunryswkmbvdh", "TGCAANYRSWMKVBHDtgcaanyrswmkvbhd"


def base_code(c: Column) -> Column:
    """A, C, G, T (either case) as 0 .. 3, else null."""
    return F.when(F.upper(c).isin("A", "C", "G", "T"), F.instr(F.lit("ACGT"), F.upper(c)) - 1)


def encode_kmer(c: Column) -> Column:
    """Two bits a base, first base highest; null if empty, longer than 31 or ambiguous."""
    ok = F.upper(c).rlike("^[ACGT]{1,31}$")
    return F.when(ok, F.conv(F.translate(F.upper(c), "ACGT", "0123"), 4, 10).cast("long"))


def reverse_complement(c: Column) -> Column:
    """Of A, C, G, T (either case, upper-cased); anything else becomes N."""
    return F.translate(F.regexp_replace(F.reverse(F.upper(c)), "[^ACGT]", "N"), "ACGT", "TGCA")


def sam_complement(c: Column) -> Column:
    """Reverse complement that keeps case and complements IUPAC codes."""
    return F.translate(F.reverse(c), _CODES, _COMPLEMENTS)


def canonical(c: Column) -> Column:
    """struct(kmer, is_rc): the smaller of a k-mer and its reverse complement (equal: forward); null if ambiguous."""
    rc = reverse_complement(c)
    return F.when(F.upper(c).rlike("^[ACGT]+$"), F.struct(F.least(F.upper(c), rc).alias("kmer"), (rc < F.upper(c)).alias("is_rc")))


def hash_code(c: Column) -> Column:
    """XXH64 of the 8 little-endian bytes, seed 42: Spark's own xxhash64."""
    return F.xxhash64(c.cast("long"))


def mismatch_count(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ, whatever their case."""
    return F.aggregate(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def bases_match(a: Column, b: Column, is_rc: Column) -> Column:
    """Whether two bases pair up, on opposite strands as complements; an ambiguous base matches nothing."""
    other = F.when(is_rc, F.translate(F.upper(b), "ACGT", "TGCA")).otherwise(F.upper(b))
    return F.coalesce(F.upper(a).isin("A", "C", "G", "T") & (F.upper(a) == other), F.lit(False))


def mismatch_rate(a: Column, b: Column) -> Column:
    """1.0 for empty strings."""
    return F.when(F.length(a) == 0, F.lit(1.0)).otherwise(mismatch_count(a, b) / F.length(a))


def diagonal(query_pos: Column, ref_pos: Column, is_rc: Column, span) -> Column:
    return F.when(is_rc, query_pos + ref_pos + span - 1).otherwise(query_pos - ref_pos).cast("long")


def interval_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def repeat_period(c: Column, periods: int = 8) -> Column:
    """The least period up to ``periods`` at which three quarters of the places (of six or more bases) repeat, else null."""

    def holds(p):
        n = F.length(c) - p
        same = F.aggregate(
            F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(F.substring(c, i, F.lit(1)) == F.substring(c, i + p, F.lit(1)), 1).otherwise(0)
        )
        return (n > 0) & (4 * same >= 3 * n)

    return F.when(
        F.length(c) >= 6,
        F.get(F.filter(F.sequence(F.lit(1), F.lit(periods)), lambda p: F.when(F.length(c) > p, holds(p)).otherwise(F.lit(False))), F.lit(0))
    )


def gap_cost(n: Column, open_: int = 6, extend: int = 1) -> Column:
    return F.when(n > 0, open_ + extend * n).otherwise(F.lit(0))


def gap_cost_dual(n: Column, opens=(6, 24), extends=(2, 1)) -> Column:
    return F.when(n > 0, F.least(*(o + e * n for o, e in zip(opens, extends, strict=True)))).otherwise(F.lit(0))


def saturated(c: Column) -> Column:
    """A long as an int, held at the int's ends."""
    return F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), c)).cast("int")


_TAG = (
    r"^[A-Za-z][A-Za-z0-9]:(A:[!-~]|i:[+-]?[0-9]{1,18}|f:[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|Z:[ -~]*|H:([0-9A-Fa-f]{2})*"
    r"|B:[cCsSiI](,[+-]?[0-9]+)+|B:f(,[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)+)$"
)
_RANGES = {"c": (-128, 127), "C": (0, 255), "s": (-(2**15), 2**15 - 1), "S": (0, 2**16 - 1), "i": (-(2**31), 2**31 - 1), "I": (0, 2**32 - 1)}


def optional_fields(comment: Column, excluded: tuple[str, ...] = ()) -> Column:
    """The valid SAM tags of a comment, tab-joined; the first of equal names stays, ``excluded`` names go."""

    def in_range(t):
        values = F.slice(F.split(F.substring(t, 6, 1 << 30), ","), 2, 1 << 20)
        ok = F.lit(True)
        for kind, (low, high) in _RANGES.items():
            ok = ok & F.when(F.substring(t, 6, 1) == kind, F.forall(values, lambda v: v.try_cast("decimal(38,0)").between(low, high))).otherwise(F.lit(True))
        return F.when(F.substring(t, 4, 1) == "B", ok).otherwise(F.lit(True))

    good = F.filter(F.split(comment, r"\s+"), lambda t: t.rlike(_TAG) & in_range(t) & ~F.substring(t, 1, 2).isin(*excluded, ""))
    first = F.aggregate(
        good,
        F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda a: F.substring(a, 1, 2) == F.substring(t, 1, 2)), acc).otherwise(F.array_append(acc, t)),
    )
    return F.array_join(first, "\t")


def segments(length: Column, size: int = 2048, overlap: int = 512) -> Column:
    """Array of (index, start, end): overlapping windows that cover a read; the last is moved left to end with it."""
    step = size - min(overlap, size - 1)
    one = F.array(F.struct(F.lit(0).alias("index"), F.lit(0).alias("start"), length.cast("int").alias("end")))
    last = F.ceil((length - size) / step).cast("int")
    many = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("index"), F.least(i * step, length - size).cast("int").alias("start"), F.least(i * step + size, length).cast("int").alias("end")
        ),
    )
    return F.when(length <= 0, F.array().cast("array<struct<index:int,start:int,end:int>>")).when(length <= size, one).otherwise(many)
