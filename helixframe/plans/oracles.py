"""DuckDB SQL with the results of the queries, built from shared table expressions."""

from __future__ import annotations

from .data import BASES, LETTERS

DNA = f"translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"
BASE = f"""
contigs as (select doc_id as contig_id, 'c' || doc_id as name, {DNA} as sequence from documents),
reads as (select item_id as read_ord, 'r' || item_id as read_name, case when item_id % 2 = 1 then translate(reverse({DNA}), 'ACGT', 'TGCA') else
  {DNA} end as sequence from benchmark)
"""
CODE = "list_sum(list_transform(range(1, 16), lambda i: (strpos('ACGT', substr({0}, i, 1)) - 1) * (4::bigint ** (15 - i))::bigint))::bigint"
KMERS = BASE + """,
places as (select contig_id, sequence, unnest(range(0, greatest(length(sequence) - 14, 0))) as ref_pos from contigs),
kmers as (select contig_id, ref_pos, substr(sequence, ref_pos + 1, 15) as f from places),
dense as (select contig_id, ref_pos, least(f, translate(reverse(f), 'ACGT', 'TGCA')) as kmer, translate(reverse(f), 'ACGT', 'TGCA') < f as is_rc
  from kmers),
ranked as (select *, row_number() over (partition by kmer order by contig_id, ref_pos) - 1 as off, count(*) over (partition by kmer) as total from
  dense)
"""
_M = "18446744073709551616::uhugeint"


def _mul(a: str, b: int) -> str:
    return f"((({a})::uhugeint * {b}::uhugeint) % {_M})::ubigint"


def _steps(name: str, source: str, steps: list[tuple[str, str]]) -> str:
    """Nested steps, each a column on top of the one before."""
    inner = source
    for column, expression in steps:
        inner = f"select *, {expression} as {column} from ({inner})"
    return f"{name} as ({inner})"


def _roll(a: str, r: int) -> str:
    return f"((({a})::uhugeint * {2**r}::uhugeint) % {_M} + ({a})::uhugeint // {2 ** (64 - r)}::uhugeint)::ubigint"


def _down(a: str, r: int) -> str:
    return f"(({a}) // {2**r}::ubigint)::ubigint"


P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SPLITMIX = [
    (
        "h1", f"xor(code::ubigint, {_down('code::ubigint', 30)})"
    ), ("h2", _mul("h1", 0xBF58476D1CE4E5B9)), ("h3", f"xor(h2, {_down('h2', 27)})"), ("h4", _mul("h3", 0x94D049BB133111EB)),
    ("h", f"xor(h4, {_down('h4', 31)})"),
]
XXH64 = [
    ("x1", _mul("code::ubigint", P2)), ("x2", _mul(_roll("x1", 31), P1)), ("x3", f"xor({(42 + P5 + 8) % 2**64}::ubigint, x2)"),
    ("x4", f"((({_mul(_roll('x3', 27), P1)})::uhugeint + {P4}::uhugeint) % {_M})::ubigint"), ("x5", _mul(f"xor(x4, {_down('x4', 33)})", P2)),
    ("x6", _mul(f"xor(x5, {_down('x5', 29)})", P3)), ("h", f"xor(x6, {_down('x6', 32)})"),
]
QUERY_KMERS = """
qplaces as (select read_ord, sequence, unnest(range(0, greatest(length(sequence) - 14, 0))) as query_pos from reads),
qk as (select read_ord, query_pos, substr(sequence, query_pos + 1, 15) as f from qplaces),
qc as (select read_ord, query_pos, least(f, translate(reverse(f), 'ACGT', 'TGCA')) as kmer, translate(reverse(f), 'ACGT', 'TGCA') < f as is_rc from
  qk),
qcode as (select *, """ + CODE.format("kmer") + " as code from qc)"


def seeds(hashed: list[tuple[str, str]], window: int = 8) -> str:
    """Minimizers: least (hash, place) of each window of 8 (of all, if there are fewer); all reads are unambiguous."""
    return (
        QUERY_KMERS + ",\n" + _steps("qh", "select * from qcode", hashed) + f""",
qw as (select read_ord, query_pos, count(*) over (partition by read_ord) as n,
  min(struct_pack(h := h, p := query_pos)) over (partition by read_ord order by query_pos rows between current row and {window - 1} following) as m
    from qh),
seeds as (select distinct read_ord, m.p as query_pos from qw where query_pos <= n - least({window}, n)),
qseeds as (select qh.read_ord, qh.query_pos, qh.code, qh.kmer, qh.is_rc from qh join seeds using (read_ord, query_pos))
"""
    )


INDEXED = KMERS + ",\n" + """idx as (select kmer, any_value(total) as total, any_value(total) > 256 as capped, least(any_value(total), 256) as
  stored from ranked group by kmer)
"""
LOOKUP = INDEXED + ",\n" + seeds(SPLITMIX) + """,
looked as (select q.read_ord, q.query_pos, q.is_rc, q.code, q.kmer, coalesce(i.total, 0) as total, coalesce(i.stored, 0) as stored,
  case when i.total is null then 'absent' when i.capped then 'sampled' else 'complete' end as completeness from qseeds q left join idx i using (kmer))
"""
PROBES = LOOKUP + """,
lens as (select read_ord, length(sequence) as n from reads),
segs as (select read_ord, n, unnest(case when n <= 2048 then [0] else range(0, ceil((n - 2048) / 1536.0)::bigint + 1) end) as segment_index from
  lens where n > 0),
seg as (select read_ord, segment_index, case when n <= 2048 then 0 else least(segment_index * 1536, n - 2048) end as s, case when n <= 2048 then n
  else least(segment_index * 1536 + 2048, n) end as e from segs),
inseg as (select seg.read_ord, segment_index, e - s as size, list(struct_pack(frequency := total, pos := query_pos, code := code, is_rc := is_rc)
  order by total, query_pos, code, is_rc) as c
  from seg join looked l on l.read_ord = seg.read_ord and completeness = 'complete' and total between 1 and 40 and query_pos >= s and query_pos +
    15 <= e group by all),
firstpass as (select *, greatest(size // 7, 50) as spacing, list_reduce(list_prepend([]::struct(frequency bigint, pos bigint, code bigint, is_rc
  boolean)[], list_transform(c, lambda x: [x])),
  lambda acc, x: case when len(acc) < 6 and len(list_filter(acc, lambda s: abs(s.pos - x[1].pos) < greatest(size // 7, 50))) = 0 then
    list_concat(acc, x) else acc end) as a from inseg),
secondpass as (select *, list_reduce(list_prepend(a, list_transform(c, lambda x: [x])),
  lambda acc, x: case when len(acc) < 6 and len(list_filter(acc, lambda s: s.pos = x[1].pos)) = 0 then list_concat(acc, x) else acc end) as b from
    firstpass),
chosen as (select read_ord, segment_index, unnest(b) as x from secondpass),
backbone as (select read_ord, segment_index, x.pos as read_pos, x.is_rc as is_rc, x.code as code, x.frequency as frequency, row_number() over
  (partition by read_ord, segment_index order by x.pos) as rank from chosen),
sides as (select read_ord, -2 as segment_index, 0 as s, least(n, 1000) as e from lens union all select read_ord, -1, greatest(n - 1000, 0), n from
  lens),
ends as (select * from (select l.read_ord, segment_index, query_pos as read_pos, is_rc, code, total as frequency, row_number() over (partition by
  l.read_ord, segment_index order by total, query_pos, code) as rank
  from sides join looked l on l.read_ord = sides.read_ord and completeness = 'complete' and total between 1 and 250 and query_pos >= s and
    query_pos + 15 <= e) where rank <= 4),
allp as (select *, case segment_index when -2 then 1 << 29 when -1 then (1 << 29) + 1 else segment_index end * 1024 + rank as turn from (select *
  from backbone union all select * from ends)),
probes as (select read_ord, b.segment_index as segment_index, read_pos, is_rc, code, b.frequency as frequency, b.rank as rank, ord from (
  select read_ord, code, is_rc, read_pos, min(struct_pack(i := case when segment_index < 0 then 0 else 1 end, turn := turn, segment_index :=
    segment_index, frequency := frequency, rank := rank)) as b, min(turn) as ord
  from allp group by all))
"""
CANDIDATES = PROBES + """,
ridx as (select kmer, contig_id, ref_pos, is_rc as r_rc, off from ranked where total <= 256),
pk as (select p.*, (select any_value(kmer) from looked l where l.code = p.code) as kmer from probes p),
turned as (select *, coalesce(sum(frequency) over (partition by read_ord order by ord, code, read_pos, is_rc rows between unbounded preceding and 1
  preceding), 0) as before from pk),
phits as (select read_ord, segment_index, read_pos, code, frequency, contig_id, ref_pos, is_rc <> r_rc as is_rc,
  case when is_rc <> r_rc then read_pos + ref_pos + 14 else read_pos - ref_pos end as diagonal from turned join ridx using (kmer) where before +
    off < 8000),
lagged as (select *, diagonal - lag(diagonal) over w as gap from phits window w as (partition by read_ord, contig_id, is_rc order by diagonal,
  read_pos, ref_pos, code, segment_index)),
numbered as (select *, sum(case when gap is null or gap > 2000 then 1 else 0 end) over (partition by read_ord, contig_id, is_rc order by diagonal,
  read_pos, ref_pos, code, segment_index rows unbounded preceding) as cluster from lagged),
agg as (select read_ord, contig_id, is_rc, cluster, count(distinct segment_index) as supporting_segments, count(distinct struct_pack(a := code, b
  := read_pos)) as unique_probes, count(*) as n_hits,
  min(ref_pos) as ref_start, max(ref_pos) + 15 as ref_end, min(read_pos) as q_start, max(read_pos) + 15 as q_end, min(frequency) as
    best_probe_frequency, sum(frequency)::bigint as sum_frequency,
  trunc(sum(diagonal)::double / count(*))::bigint as diagonal_mean, list_extract(list(diagonal order by diagonal), (count(*) // 2 +
    1)::bigint)::float::bigint as diagonal_median from numbered group by all having count(distinct segment_index) >= 2),
endc as (select a.read_ord, a.contig_id, a.is_rc, a.cluster, coalesce(bool_or(segment_index = -2), false) as l, coalesce(bool_or(segment_index =
  -1), false) as r from agg a
  left join numbered b on a.read_ord = b.read_ord and a.contig_id = b.contig_id and a.is_rc = b.is_rc and a.cluster = b.cluster and segment_index <
    0 and least(abs(diagonal - diagonal_mean), abs(diagonal - diagonal_median)) <= 2000 group by all),
scored as (select agg.*, case when l and r then 'both' when l then 'left' when r then 'right' else 'internal' end as endpoint_support, n as read_len,
  supporting_segments * 100 + unique_probes * 10 + n_hits + case when l and r then 250 when l or r then 60 when n >= 2000 then -50 else 0 end as score
  from agg join endc using (read_ord, contig_id, is_rc, cluster) join lens using (read_ord)),
candidates as (select * exclude (cluster) from (select *, row_number() over (partition by read_ord order by score desc, contig_id, ref_start,
  ref_end, is_rc) as rank from scored) where rank <= 20)
"""
EXACT = LOOKUP + """,
one as (select kmer, any_value(contig_id) as contig_id, any_value(ref_pos) as ref_pos, any_value(is_rc) as r_rc from ranked where total = 1 group
  by kmer),
met as (select q.read_ord, q.query_pos, q.is_rc <> r_rc as is_rc, contig_id, ref_pos, row_number() over (partition by q.read_ord order by
  q.query_pos) as rn from qseeds q join one using (kmer)),
proj as (select met.*, r.sequence as q, case when is_rc then ref_pos - (length(r.sequence) - query_pos - 15) else ref_pos - query_pos end as
  ref_start from met join reads r using (read_ord) where rn <= 3),
safe as (select *, max((ref_start < 0)::int) over (partition by read_ord order by query_pos rows unbounded preceding) as under from proj),
fit as (select s.* from safe s join contigs c using (contig_id) where under = 0 and ref_start + length(q) <= length(c.sequence)
  and substr(c.sequence, ref_start + 1, length(q)) = case when is_rc then translate(reverse(q), 'ACGT', 'TGCA') else q end),
exact as (select * from (select read_ord, contig_id, ref_start, ref_start + length(q) as ref_end, is_rc, row_number() over (partition by read_ord
  order by rn) as k from fit) where k = 1)
"""
CAND_COLUMNS = (
    "read_ord, contig_id, q_start, q_end, ref_start, ref_end, is_rc, supporting_segments, unique_probes, n_hits, sum_frequency, "
    "best_probe_frequency, diagonal_mean, diagonal_median, endpoint_support, score, read_len, rank"
)
_Q = "greatest(0.0, least(60.0, {0}))"
MAPQ = """,
ranked_c as (select *, lead(score) over (partition by read_ord order by rank) as second, count(*) over (partition by read_ord) as n from candidates),
best as (select *, (q_end - q_start)::double / read_len as span, q_end - q_start as covered from ranked_c where rank = 1),
raw as (select *, case when second is null then 60.0 else least(40.0 * (1.0 - (second::double / score) * (second::double / score)) *
  ln(greatest(score / 2.0, 2.0)), 3.0 * (score - second)) end
    - case when n > 1 then 4.343 * ln(n) else 0.0 end as base,
  case when span >= 0.5 or covered >= 1000 then 1.0 else greatest(0.1, span / 0.5) end * case when unique_probes >= 10 or covered >= 200 then 1.0
    else greatest(0.1, unique_probes / 10.0) end as factor,
  case when second is null then 1.0 else greatest(score - second, 0)::double / score end as margin from best),
quality as (select *, round(greatest(0.0, least(60.0, base)) * factor)::int as q, round(60.0 * margin * least(least(span, 1.0) / 0.8, 1.0))::int as
  mapq_legacy from raw),
final as (select *, case when second >= score then 0 when score > second and q = 0 then 1 else q end as mapq_mm2 from quality),
judged as (select read_ord, contig_id, score, second, n as n_candidates, mapq_mm2, mapq_legacy, case when n >= 20 and second is null then
  least(mapq_mm2, 50) else mapq_mm2 end as mapq from final)
"""


def sql(body: str, select: str) -> str:
    return f"with {body} {select}"


ORACLES: dict[str, str] = {
    "f1_f5_bases": sql(
        BASE + ",\n" + QUERY_KMERS,
        "select read_ord, query_pos, strpos('ACGT', substr(f, 1, 1)) - 1 as first_code, "
        + CODE.format("f")
        + """ as code, translate(reverse(f), 'ACGT', 'TGCA') as rc, least(f, translate(reverse(f), 'ACGT', 'TGCA')) as canonical,
        translate(reverse(f), 'ACGT', 'TGCA') < f as is_rc from qk""",
    ),
    "f6_hash_code": sql(
        BASE + ",\n" + QUERY_KMERS + ",\n" + _steps("qh", "select * from qcode", XXH64),
        (
            "select read_ord, query_pos, code, (case when h >= 9223372036854775808::ubigint then h::hugeint - 18446744073709551616::hugeint else "
            "h::hugeint end)::bigint as hash from qh"
        )
    ),
    "f8_mismatches": sql(
        BASE,
        """, p as (select a.read_ord, a.sequence as s, b.sequence as t, least(length(a.sequence), length(b.sequence)) as n from reads a join reads
          b on b.read_ord = a.read_ord + 1),
        m as (select read_ord, n, coalesce(list_sum(list_transform(range(1, n + 1), lambda i: case when substr(s, i, 1) = substr(t, i, 1) then 0
          else 1 end)), 0)::bigint as mismatches from p)
        select read_ord, mismatches, case when n = 0 then 1.0::double else round(mismatches::double / n, 9) end as rate from m""",
    ),
    "f9_bases_match": sql(
        BASE,
        """, p as (select a.read_ord, a.sequence as s, 'N' || b.sequence as t from reads a join reads b on b.read_ord = a.read_ord + 1),
        e as (select read_ord, s, t, unnest(range(1, least(length(s), length(t)) + 1)) as i from p)
        select read_ord, sum((substr(s, i, 1) = substr(t, i, 1))::int)::bigint as forward, sum((substr(s, i, 1) = translate(substr(t, i, 1),
          'ACGT', 'TGCA'))::int)::bigint as reverse
        from e group by read_ord""",
    ),
    "f15_f16_intervals": (
        "select l_orderkey, l_linenumber, greatest(0, least(l_partkey + 500, l_suppkey * 100 + 400) - greatest(l_partkey, l_suppkey * "
        "100)) as overlap, case when l_linenumber - 1 > 0 then 6 + (l_linenumber - 1) else 0 end as gap, case when l_linenumber - 1 > "
        "0 then least(6 + 2 * (l_linenumber - 1), 24 + (l_linenumber - 1)) else 0 end as gap_dual from lineitem"
    ),
    "f17_repeat_period": "with c as (select doc_id, "
    + DNA
    + """ as c from documents), t as (select doc_id, c, unnest(range(0, length(c), 24)) as start from c), w as (select doc_id, start, substr(c,
      start + 1, 24) as s from t)
    select doc_id, start, case when length(s) >= 6 then list_extract(list_filter(range(1, 9), lambda p: length(s) > p
      and 4 * len(list_filter(range(1, length(s) - p + 1), lambda i: substr(s, i, 1) = substr(s, i + p, 1))) >= 3 * (length(s) - p)), 1) end::int as period from w""",
    "f18_saturated": "select l_orderkey, l_linenumber, greatest(-2147483648, least(2147483647, (l_partkey - 50) * 100000000))::int as held from lineitem",
    "f20_edit_distance": "select a.p_partkey, levenshtein(a.p_name, b.p_name)::int as distance from part a join part b on b.p_partkey = a.p_partkey + 1",
    "p1_segments": sql(
        BASE,
        (
            "select contig_id, i as index, case when n <= 2048 then 0 else least(i * 1536, n - 2048) end as start, case when n <= 2048 then n else "
            "least(i * 1536 + 2048, n) end as \"end\" from (select contig_id, length(sequence) as n, unnest(case when length(sequence) <= 2048 then "
            "[0] else range(0, ceil((length(sequence) - 2048) / 1536.0)::bigint + 1) end) as i from contigs where length(sequence) > 0)"
        )
    ),
    "p2_minimizers": sql(BASE + ",\n" + seeds(SPLITMIX), "select read_ord, query_pos, code, is_rc from qseeds"),
    "p3_minimizers": sql(BASE + ",\n" + seeds(XXH64), "select read_ord, query_pos, code, is_rc from qseeds"),
    "p4_wide_minimizers": sql(BASE + ",\n" + seeds(XXH64, 16), "select read_ord, query_pos, code, is_rc from qseeds"),
    "i1_index": sql(
        INDEXED,
        "select " + CODE.format(
            "kmer"
        ) + (
            " as code, total, stored, capped, md5(h) as hits from idx join (select kmer, string_agg(contig_id || ':' || ref_pos || ':' "
            "|| is_rc::int, ',' order by contig_id, ref_pos) as h from ranked where off < 256 group by kmer) using (kmer)"
        )
    ),
    "i2_i3_cap_policies": sql(KMERS + """, pol(policy) as (values ('adaptive'), ('drop'), ('first'), ('sample-spaced')),
kept as (select policy, kmer, off from ranked, pol where total <= 16 or (policy = 'first' and off < 16) or (policy = 'adaptive' and total <= 32)
  or ((policy = 'sample-spaced' or (policy = 'adaptive' and total <= 128)) and len(list_filter(range(0, 16), lambda i: (i * total) // 16 = off)) > 0))""", "select policy, count(*) as hits, count(distinct kmer) as seeds, sum(off)::bigint as offsets from kept group by policy"),
    "i5_cap_distribution": sql(
        INDEXED,
        (
            "select case when total <= 32 then 32 when total <= 64 then 64 when total <= 128 then 128 when total <= 256 then 256 when total <= 1024 "
            "then 1024 when total <= 4096 then 4096 when total <= 65536 then 65536 else 4294967295 end as up_to, count(*) as seeds, "
            "sum(total)::bigint as occurrences, round(avg(16.0::double / total), 6) as kept_share from idx where total > 16 group by 1"
        )
    ),
    "i6_position_gaps": sql(
        KMERS + (
            ", pl as (select distinct contig_id, ref_pos from ranked where total <= 40), g as (select ref_pos - lag(ref_pos) over "
            "(partition by contig_id order by ref_pos) as gap from pl)"
        ),
        (
            "select case when gap <= 16 then 16 when gap <= 32 then 32 when gap <= 64 then 64 when gap <= 128 then 128 when gap <= 512 then 512 when "
            "gap <= 2048 then 2048 when gap <= 16384 then 16384 else 9223372036854775807 end as up_to, count(*) as gaps from g where gap is not null "
            "group by 1"
        )
    ),
    "i7_summary": sql(
        INDEXED,
        (
            "select (select count(*) from contigs) as contigs, (select sum(length(sequence))::bigint from contigs) as bases, count(*) as seeds, "
            "sum(total)::bigint as places, sum(stored)::bigint as stored, sum(capped::int)::bigint as capped_seeds, max(total) as max_total, 15 as "
            "k, 256 as max_stored_hits from idx"
        )
    ),
    "j1_seed_lookup": sql(LOOKUP, "select read_ord, query_pos, is_rc, code, total, stored, completeness from looked"),
    "j3_seed_hits": sql(
        LOOKUP,
        (
            "select q.read_ord, q.query_pos, q.is_rc as q_rc, q.code, r.total, r.total > 256 as capped, r.contig_id, r.ref_pos, r.is_rc as r_rc from "
            "qseeds q join ranked r using (kmer) where off < 128"
        )
    ),
    "j5_hits_in_windows": sql(
        CANDIDATES,
        (
            "select c.read_ord, c.rank, count(*) as hits from candidates c join (select q.read_ord, q.query_pos, r.contig_id, r.ref_pos, q.is_rc <> "
            "r.is_rc as is_rc from qseeds q join ranked r using (kmer) where off < 128 and total <= 256) h on h.read_ord = c.read_ord and "
            "h.contig_id = c.contig_id and h.is_rc = c.is_rc and h.ref_pos >= c.ref_start - 1024 and h.ref_pos <= c.ref_end + 1024 - 15 group by all"
        )
    ),
    "j9_exact_placements": sql(EXACT, "select read_ord, contig_id, ref_start, ref_end, is_rc from exact"),
    "p7_backbone_probes": sql(PROBES, "select * from backbone"),
    "p8_endpoint_probes": sql(PROBES, "select * from ends"),
    "p9_p10_read_probes": sql(PROBES, "select * from probes"),
    "a1_a3_candidates": sql(CANDIDATES, f"select {CAND_COLUMNS} from candidates"),
    "a4_seed_coverage": sql(
        LOOKUP + (
            ", iv as (select read_ord, query_pos as s, query_pos + 15 as e, max(query_pos + 15) over (partition by read_ord order by "
            "query_pos rows between unbounded preceding and 1 preceding) as r from looked where completeness = 'complete')"
        ),
        "select read_ord, sum(greatest(0, e - greatest(s, coalesce(r, s))))::bigint as covered from iv group by 1"
    ),
    "a9_run_summary": sql(
        EXACT,
        (
            "select count(*) as reads, count(e.read_ord) as mapped, count(*) - count(e.read_ord) as unmapped, coalesce(sum(ref_end - ref_start), "
            "0)::bigint as aligned_bases from reads left join exact e using (read_ord)"
        )
    ),
    "a10_mapq_caps": (
        "with o as (select (doc_id * 7 % 61)::int as mapq, 1 - quality as wrong from labels), g as (select mapq, count(*) as total, "
        "sum(wrong)::bigint as errors from o group by 1), u as (select *, errors::double / total as p, 1.959963984540054::double as z "
        "from g), w as (select *, least(1.0, (p + z * z / (2 * total) + z * sqrt(p * (1 - p) / total + z * z / (4.0 * total * total))) "
        "/ (1 + z * z / total)) as upper from u) select mapq, total, errors, min(greatest(0, least(60, mapq, case when upper >= 1 then "
        "0 else floor(-10 * log10(upper))::int end))) over (order by mapq rows between current row and unbounded following)::int as "
        "cap from w"
    ),
    "a11_calibration": (
        "with o as (select (doc_id * 7 % 61)::int as mapq, 1 - quality as wrong from labels) select count(*) as mapped, "
        "sum(wrong)::bigint as errors, round(sum(pow(10.0::double, -mapq / 10.0::double)), 6) as expected_errors from o"
    ),
    "a12_bins": sql(
        CANDIDATES + MAPQ,
        (
            "select c.contig_id, c.ref_start // 1000 as bin, count(*) as placements, round(avg(j.mapq), 6) as mean_mapq from judged j join "
            "candidates c on c.read_ord = j.read_ord and c.rank = 1 group by all"
        )
    ),
    "p15_uncovered": sql(
        LOOKUP + (
            ", iv as (select contig_id, ref_pos as s, ref_pos + 15 as e from ranked r join (select distinct kmer from qseeds) using "
            "(kmer) union all select contig_id, length(sequence), length(sequence) from contigs), g as (select *, coalesce(max(e) over "
            "(partition by contig_id order by s, e rows between unbounded preceding and 1 preceding), 0) as f from iv)"
        ),
        'select contig_id, f as start, s as "end" from g where s - f >= 500'
    ),
    "q4_q7_mapq": sql(CANDIDATES + MAPQ, "select * from judged"),
    "q6_q9_calibrated": (
        "select l_orderkey, l_linenumber, round(greatest(0.0, least(60.0, 60.0 * greatest(0.0, least(1.0, (0.1 - l_discount) / 0.08)) "
        "* (1 - 0.5 * least(1.0, l_quantity / 256.0)) * case when l_linenumber <= 1 then 1.0 else 0.85 end)))::int as near_exact, case "
        "when l_discount > 0.02 then round(greatest(0.0, least(60.0, (l_linenumber + 40) * pow((1 - l_discount) / 0.98, 2))))::int "
        "else l_linenumber + 40 end as calibrated from lineitem"
    ),
    "t1_sam": sql(
        EXACT + ", e as (select reads.*, exact.contig_id, ref_start, is_rc from reads left join exact using (read_ord))",
        (
            "select read_ord, read_name || chr(9) || case when contig_id is null then '4' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || "
            "chr(9) || '*' else case when is_rc then '16' else '0' end || chr(9) || 'c' || contig_id || chr(9) || (ref_start + 1) || chr(9) || '60' "
            "|| chr(9) || length(sequence) || 'M' end || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || case when is_rc then "
            "translate(reverse(sequence), 'ACGT', 'TGCA') else sequence end || chr(9) || '*' || case when contig_id is null then '' else chr(9) || "
            "'NM:i:0' || chr(9) || 'AS:i:' || 2 * length(sequence) end || chr(9) || 'RG:Z:g' || read_ord % 3 || chr(9) || 'XI:i:' || read_ord || "
            "case when contig_id is null then chr(9) || 'NM:i:9' else '' end as line from e"
        )
    ),
    "b5_variant_differences": (
        "with a as (select l_suppkey::bigint as contig, l_partkey as pos, l_returnflag as ref, l_linestatus as alt from lineitem where "
        "l_linenumber % 2 = 1 group by all), b as (select l_suppkey::bigint as contig, l_partkey as pos, l_returnflag as ref, "
        "l_linestatus as alt from lineitem where l_linenumber % 2 = 0 group by all), lost as (select * from a anti join b using "
        "(contig, pos, ref, alt)), n as (select lost.*, min(abs(b.pos - lost.pos)) as distance from lost left join b on b.contig = "
        "lost.contig and abs(b.pos - lost.pos) <= 50 group by all) select *, case when distance is null then 'missed' else 'shifted' "
        "end as kind from n"
    ),
}

ORACLES |= {
    "j8_two_ended_loci": sql(LOOKUP + """,
us as (select l.*, length(r.sequence) as n from looked l join reads r using (read_ord) where completeness = 'complete' and total between 1 and 32),
sd as (select *, 0 as side from us where query_pos + 15 <= least(1000, n) union all select *, 1 from us where query_pos >= greatest(n - 1000, 0)),
tp as (select * from (select *, row_number() over (partition by read_ord, side order by total, query_pos, code) as rn from sd) where rn <= 8),
pl as (select t.read_ord, side, query_pos as q, contig_id, ref_pos as r, t.is_rc <> k.is_rc as is_rc from tp t join ranked k using (kmer)),
pr as (select a.read_ord, a.contig_id, a.is_rc, a.q as q1, a.r as r1, b.q as q2, b.r as r2, case when a.is_rc then a.r - b.r else b.r - a.r end as far
  from pl a join pl b on a.side = 0 and b.side = 1 and a.read_ord = b.read_ord and a.contig_id = b.contig_id and a.is_rc = b.is_rc and b.q > a.q),
bd as (select *, abs(far - (q2 - q1)) as drift, floor(case when is_rc then q1 + r1 else r1 - q1 end / 2000.0)::bigint as band from pr where far > 0
  and abs(far - (q2 - q1)) <= 1000),
bs as (select read_ord, contig_id, is_rc, band, min(struct_pack(drift := drift, q1 := q1, r1 := r1, q2 := q2, r2 := r2)) as b from bd group by all)
""", "select * from (select read_ord, contig_id, is_rc, band, b.drift as drift, b.q1 as q1, b.r1 as r1, b.q2 as q2, b.r2 as r2, row_number() over (partition by read_ord order by b.drift, contig_id, is_rc, band) as rank from bs) where rank <= 8"),
    "a7_seed_votes": sql(
        LOOKUP
        + """,
d as (select q.read_ord, r.contig_id, q.is_rc <> r.is_rc as is_rc, case when q.is_rc <> r.is_rc then query_pos + ref_pos + 14 else query_pos -
  ref_pos end as diagonal
  from qseeds q join ranked r using (kmer) where off < 128 and total <= 250),
v as (select read_ord, contig_id, is_rc, (sign(diagonal) * (abs(diagonal) // 2000))::bigint as band, count(*) as support from d group by all having
  count(*) >= 2)
""",
        (
            "select read_ord, contig_id, is_rc, band, support from (select *, row_number() over (partition by read_ord order by "
            "support desc, contig_id, is_rc, band) as k from v) where k = 1"
        ),
    ),
    "c21_cigar_lengths": (
        "with o as (select l_orderkey, l_linenumber, [l_partkey, l_suppkey, l_linenumber] as c from lineitem) select l_orderkey, "
        "l_linenumber, list_aggregate(list_transform(c, lambda x: (x % 40 + 1)::varchar || case x % 3 when 0 then 'M' when 1 then 'I' "
        "else 'D' end), 'string_agg', '') as cigar, list_sum(list_transform(c, lambda x: case when x % 3 in (0, 1) then x % 40 + 1 "
        "else 0 end))::int as query_length, list_sum(list_transform(c, lambda x: case when x % 3 in (0, 2) then x % 40 + 1 else 0 "
        "end))::int as ref_length from o"
    ),
    "st_event_sessions": (
        "with l as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events), m as (select *, "
        "sum(case when gap is null or gap >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows "
        "unbounded preceding) as s from l) select user_id, min(ts) as start, max(ts) + interval 30 minutes as \"end\", count(*) as n "
        "from m group by user_id, s"
    ),
    "b4_indel_kinds": (
        "select a.p_partkey, case when a.p_brand = b.p_brand and a.p_type = b.p_type then 'same' when sign(length(a.p_type) - "
        "length(a.p_brand)) <> sign(length(b.p_type) - length(b.p_brand)) then 'direction' when length(a.p_type) - length(a.p_brand) "
        "<> length(b.p_type) - length(b.p_brand) then 'length' else 'spelling' end as kind from part a join part b on b.p_partkey = "
        "a.p_partkey + 1"
    ),
    "i2_isolated": sql(
        KMERS + (
            ", small as (select distinct contig_id, ref_pos from ranked where total <= 16), big as (select contig_id, ref_pos from "
            "ranked where total > 16), near as (select b.contig_id, b.ref_pos, count(s.ref_pos) as k from big b left join small s on "
            "s.contig_id = b.contig_id and s.ref_pos between b.ref_pos - 512 and b.ref_pos + 512 group by all)"
        ),
        "select b.contig_id, count(*) as hits from big b join near n using (contig_id, ref_pos) where n.k = 0 group by 1"
    ),
}
ORACLES["a8_diagnostics"] = sql(
    PROBES + (
        ", e as (select read_ord, count(*) as seeds, sum((completeness = 'complete')::int) as complete, sum((completeness = "
        "'sampled')::int) as sampled, sum(stored) as hits from looked group by 1), p as (select read_ord, count(*) as probes from "
        "probes group by 1)"
    ),
    (
        "select count(*) as reads, coalesce(sum(seeds), 0)::bigint as seeds, coalesce(sum(complete), 0)::bigint as complete, "
        "coalesce(sum(sampled), 0)::bigint as sampled, coalesce(sum(hits), 0)::bigint as hits, coalesce(sum(probes), 0)::bigint as "
        "probes, max(coalesce(hits, 0))::bigint as max_hits, max(coalesce(probes, 0))::bigint as max_probes from reads left join e "
        "using (read_ord) left join p using (read_ord)"
    ),
)
