"""Reads to alignments: a read's candidate loci are searched in turn, compete, and are assembled into records.

A read meets at most ``max_regions`` windows of about its own length.  Tasks work on many reads together, so that
what is sequential in one read is one numpy step for all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Policy
from ..functions import kmers
from . import anchors, blocks, candidates, chain, dp, local, lookup, mapq, probes, reference, rewrite
from . import cigar as cg

ALIGNMENT = (
    "read_ord long, record_type string, contig_id long, ref_start long, ref_end long, query_start int, query_end int, is_rc boolean, "
    "score int, mapq int, cigar array<struct<op:string,len:int>>, edit_distance int"
)
_TURNED = bytes(next((b"TGCA"["ACGT".index(c)] if c in "ACGT" else b"tgca"["acgt".index(c)]) if c in "ACGTacgt" else 78 for c in [chr(k)]) for k in range(256))
#: Bases of a reference that is sent to every task whole, and reads that a task works on together.
SMALL, TOGETHER = 4_000_000, 64


def reverse_complement(s: bytes) -> bytes:
    return s.translate(_TURNED)[::-1]


def fill(query: bytes, ref: bytes, p: Policy, depth: int = 0) -> cg.Ops:
    """Operations for what lies between two anchors.

    In turn: one side is empty; no gap can be better; a small matrix; exact islands with smaller gaps between them; a medium
    matrix in a narrower band; aligned ends around a middle without detail; matches from both sides and one gap."""
    nq, nr = len(query), len(ref)
    if not nq or not nr:
        return [("I", nq), ("D", nr)]
    if nq == nr and _no_gap_is_better(query, ref, p):
        return [("M", nq)]
    delta = abs(nq - nr)

    def matrix(most: int, slack: int, band: int) -> cg.Ops | None:
        if max(nq, nr) > most or delta > slack:
            return None
        got = dp.align_full(query, ref, max(16, min(band, dp.MAX_WINDOW)), p)
        return None if isinstance(got, str) else got.cigar

    ops = matrix(p.small_gap, p.small_delta, delta + 256)
    if ops is not None:
        return _escalated(ops, query, ref, p, depth)
    split = rewrite.filled_islands(query, ref, p, fill, depth) if depth < p.island_depth else None
    if split is not None:
        return split
    return matrix(p.medium_gap, p.medium_delta, delta + 32) or rewrite.flanked(query, ref, p, dp.align_full) or _one_gap(query, ref)


def _escalated(ops: cg.Ops, query: bytes, ref: bytes, p: Policy, depth: int, rate: float = 0.35, least: int = 64) -> cg.Ops:
    """A small gap that differs a lot may be two events with an exact island between them: the better score holds."""
    score, edits = cg.metrics(ops, query, ref, p)
    if min(len(query), len(ref)) < least or edits <= rate * len(query) or depth >= p.island_depth:
        return ops
    other = rewrite.filled_islands(query, ref, p, fill, depth)
    return other if other is not None and cg.metrics(other, query, ref, p)[0] > score else ops


def _one_gap(query: bytes, ref: bytes) -> cg.Ops:
    """One long gap: exact matches from both sides, the rest in the middle."""
    m = min(len(query), len(ref))
    left = _common(query, ref, m)
    right = _common(query[::-1], ref[::-1], m - left)
    return [("M", m - right), ("I", len(query) - m), ("D", len(ref) - m), ("M", right)]


def _no_gap_is_better(query: bytes, ref: bytes, p: Policy) -> bool:
    """Whether no alignment of two equally long sequences scores more than the one without gaps: any other has an insertion, a deletion and a base less."""
    if query == ref:
        return True
    x, y = dp.encode(query), dp.encode(ref)
    known = (x < 4) & (y < 4)
    lost = len(x) * p.match - int(np.where(known, np.where(x == y, p.match, -p.mismatch), 0).sum())
    return lost <= p.match + 2 * cg.gap_cost(1, p)


def _common(a: bytes, b: bytes, most: int) -> int:
    x, y = np.frombuffer(a[:most], np.uint8), np.frombuffer(b[:most], np.uint8)
    different = np.flatnonzero(x != y)
    return int(different[0]) if len(different) else most


def assemble(c: chain.Chain, read: bytes, window: bytes, offset: int, p: Policy) -> tuple[int, cg.Ops]:
    """Reference start and operations of a chain: anchors, what is between them, the ends, then the rewriting passes."""
    a = c.anchors.copy()
    for k in range(1, len(a)):  # the later anchor gives way where two overlap, and by a flank more if enough of it is left
        over = max(a[k - 1, chain.QUERY_END] - a[k, chain.QUERY], a[k - 1, chain.REF_END] - a[k, chain.REF], 0)
        if over > p.overlap_flank_min and a[k, chain.QUERY_END] - a[k, chain.QUERY] - over - p.overlap_flank >= 16:
            over += p.overlap_flank
        a[k, chain.QUERY] += over
        a[k, chain.REF] += over
    a = a[(a[:, chain.QUERY_END] > a[:, chain.QUERY])]
    keep = [0]
    for k in range(1, len(a)):
        if a[k, chain.QUERY] >= a[keep[-1], chain.QUERY_END] and a[k, chain.REF] >= a[keep[-1], chain.REF_END]:
            keep.append(k)
    gaps = rewrite.Gaps(read, window, offset, p, fill)
    a = rewrite.unlocked(rewrite.without_repeat_runs(a[keep], gaps), gaps)
    ops: cg.Ops = []
    at = lambda s, e: window[s - offset : e - offset]
    for k, row in enumerate(a):
        if k:
            ops += gaps.between(int(a[k - 1, chain.QUERY_END]), int(row[chain.QUERY]), int(a[k - 1, chain.REF_END]), int(row[chain.REF]))[0]
        ops.append(("M", int(row[chain.QUERY_END] - row[chain.QUERY])))
    start, end = int(a[0, chain.REF]), int(a[-1, chain.REF_END])
    head, tail = read[: a[0, chain.QUERY]], read[a[-1, chain.QUERY_END] :]
    left, used = terminal(head[::-1], at(max(offset, start - len(head) - 256), start)[::-1], p)
    right, _ = terminal(tail, at(end, min(offset + len(window), end + len(tail) + 256)), p)
    start -= used
    ops = cg.normalized([*left[::-1], *ops, *right])
    if p.phase_repair:
        ops = rewrite.phase_repaired(ops, read, window[start - offset :])
    lead = ops[0][1] if ops and ops[0][0] == "S" else 0
    body, query, ref = ops[bool(lead) :], read[lead:], window[start - offset :]
    tail = body.pop()[1] if body and body[-1][0] == "S" else 0
    body = rewrite.polished(body, query, ref, p, dp.align_full)
    for edit in (cg.merged_gaps, cg.balanced_as_matches):
        body = edit(body, query, ref, p)
    body = cg.balanced_as_matches(cg.left_aligned(body, query, ref), query, ref, p)
    ops, start = rewrite.without_divergent_ends([("S", lead), *body, ("S", tail)], read, ref, start, p.divergent_window)
    ops, start = rewrite.score_clipped(ops, read, window[start - offset :], start, p)
    ops, start = cg.clean_edges(ops, start)
    return start, ops


def terminal(query: bytes, ref: bytes, p: Policy, most: int = 2500) -> tuple[cg.Ops, int]:
    """Operations outward from an outer anchor, and reference bases used; what does not align well is clipped."""
    if not query:
        return [], 0
    n = min(len(query), len(ref))
    if n == len(query) and cg.mismatches(query, ref[:n]) <= 0.08 * n:
        return [("M", n)], n
    got = dp.align_local(query[:most], ref[: most + 256], 256, p) if ref else None
    if got is not None and got.score > 0 and got.edits <= 0.15 * max(got.query_end, 1):
        return cg.normalized([*got.cigar, ("S", len(query) - got.query_end)]), got.ref_end
    span = rewrite.terminal_span(query, ref, False)  # where the outermost rare k-mer says that the end lies
    if span is not None and span[1]:
        ops = fill(query, ref[: span[1]], p)
        score, edits = cg.metrics(ops, query, ref[: span[1]], p)
        if score > 0 and edits <= 0.15 * len(query):
            return ops, span[1]
    return [("S", len(query))], 0


def overlap(a0, a1, b0, b1) -> int:
    return max(0, min(a1, b1) - max(a0, b0))


def compete_for_query(a, b, most: float) -> bool:
    short = min(a.q_end - a.q_start, b.q_end - b.q_start)
    return short <= 0 or overlap(a.q_start, a.q_end, b.q_start, b.q_end) / short > most


def compete_for_reference(a, b, most: float) -> bool:
    (ka, ca), (kb, cb) = a, b
    if ka != kb:
        return False
    short = min(ca.ref_end - ca.ref_start, cb.ref_end - cb.ref_start)
    return short <= 0 or overlap(ca.ref_start, ca.ref_end, cb.ref_start, cb.ref_end) / short > most


def _to_read(c: chain.Chain, n: int, rc: bool) -> chain.Chain:
    """Query coordinates of a chain on the read as it came, for competition between strands."""
    from dataclasses import replace

    return replace(c, q_start=n - c.q_end, q_end=n - c.q_start) if rc else c


def budget_of(loci: list[dict], p: Policy) -> tuple[int, bool]:
    """How many of a read's candidates are searched, and whether so many score alike that fewer are."""
    top = max((x["score"] for x in loci), default=0)
    budget = min(p.max_candidates, p.max_regions)
    near = 0
    while near < min(budget, len(loci)) and loci[near]["score"] >= int(top * p.ambiguity_score):
        near += 1
    ambiguous = near >= p.ambiguity_count
    return min(budget, p.ambiguity_budget) if ambiguous else budget, ambiguous


class Search:
    """One read's way through its candidates: what is placed so far, and what was left undone."""

    def __init__(self, read: bytes, loci: list[dict], p: Policy):
        self.read, self.loci, self.p, self.n = read, loci, p, len(read)
        self.turned: bytes | None = None
        self.placed: list[tuple] = []  # rank, chain on the read as it came, chain on the oriented read, locus
        self.counts = dict.fromkeys(COUNTERS, 0)
        top = max((x["score"] for x in loci), default=0)
        budget, self.ambiguous = budget_of(loci, p)
        self.counts["ambiguous_stops"] = int(self.ambiguous)
        self.limited = len(loci) >= p.max_regions or len(loci) > budget
        self.counts["candidates"] = len(loci)
        self.todo, self.top, self.over, self.counting = loci[:budget], top, False, False

    def oriented(self, rc: bool) -> bytes:
        if rc and self.turned is None:
            self.turned = reverse_complement(self.read)
        return self.turned if rc else self.read

    def explains_more(self, locus: dict) -> bool:
        """Whether the locus covers enough of the read that no placement does."""
        start, end = locus["q_start"], locus["q_end"]
        covered = sum(overlap(start, end, x[1].q_start, x[1].q_end) for x in self.placed)
        return end - start - min(covered, end - start) >= self.p.supplementary_bases

    def satisfied(self) -> tuple[bool, float]:
        fraction = max((x[1].covered for x in self.placed), default=0) / max(self.n, 1)
        span = max((x[1].q_end - x[1].q_start for x in self.placed), default=0) / max(self.n, 1)
        return fraction >= self.p.high_coverage or (span >= 0.85 and fraction >= 0.30), fraction

    def skip(self, why: str) -> None:
        self.limited = True
        self.counts[why] += 1

    def wants(self, k: int) -> tuple[dict, bool] | None:
        """The k-th candidate and whether it is searched in full; None if it is passed over."""
        p, locus = self.p, self.todo[k]
        if k >= 2 and self.placed:
            new = self.explains_more(locus)
            if self.loci[0]["support"] == "both" and locus["support"] == "internal" and not new:
                self.skip("internal_skips")
                return None
            if locus["score"] < int(self.top * p.competitive_score):
                if not new:
                    self.skip("score_breaks")
                    self.over = True
                    return None
                self.counts["split_kept"] += 1
            if not new and locus["score"] < int(self.top * p.weak_candidate) and self.satisfied()[0]:
                self.skip("score_breaks")
                self.over = True
                return None
        if k >= p.without_placement and not self.placed:
            self.skip("no_placement_breaks")
            self.over = True
            return None
        full = p.full_search_score <= 0 or locus["score"] >= int(self.top * p.full_search_score) or (not self.placed and k < p.without_placement)
        self.counts["full_searches" if full else "sparse_searches"] += 1
        if not full:
            self.limited = True
        return locus, full

    def anchors(self, locus: dict, full: bool) -> np.ndarray:
        own = self.oriented(locus["is_rc"])
        find = anchors.staged if self.p.anchor_stages or self.p.paired_emms else chain.find_anchors
        found = find(own, locus["window"], locus["offset"], self.p, sparse=not full)
        if self.p.snp_anchors:
            found = chain.without_contained(chain.over_mismatches(found, own, locus["window"], locus["offset"]), self.p.max_anchors)
        self.counts["anchors"] += len(found)
        if self.counting:
            self.counts["ambiguous_anchors"] += int(anchors.ambiguous(found, own).sum())
        return found

    def too_thin(self, k: int, locus: dict, found: np.ndarray) -> bool:
        """Whether a late candidate's anchors are far fewer than what is placed covers."""
        if k < 2 or not self.placed or self.explains_more(locus):
            return False
        enough, fraction = self.satisfied()
        if enough and (found[:, chain.QUERY_END] - found[:, chain.QUERY]).sum() / max(self.n, 1) < fraction * self.p.low_coverage:
            self.skip("thin_skips")
            return True
        return False

    def place(self, made: list[chain.Chain], locus: dict) -> None:
        made = list(made)
        strong = [c for c in made if c.covered >= 500]
        for c in strong:
            for other in strong:
                if other is not c and (both := chain.bridge(c, other, self.n, self.p)) is not None and not any(
                    x.bridged and x.covered >= both.covered for x in made
                ):
                    made.append(both)
        made.sort(key=lambda c: (-c.score, -c.covered, c.q_start))
        self.counts["chains"] += len(made)
        for c in made[:4]:
            if 5 * c.covered >= self.n or c.covered >= 300:
                self.placed.append((c.score + locus["bonus"], _to_read(c, self.n, locus["is_rc"]), c, locus))

    def ranked(self) -> list[tuple]:
        """Placements best first; the same place from two windows counts once."""
        self.placed.sort(key=lambda x: (-x[0], -x[1].covered, x[1].q_start, x[3]["contig_id"], x[2].ref_start, x[3]["is_rc"]))
        out: list[tuple] = []
        for x in self.placed:
            key = (x[3]["contig_id"], x[3]["is_rc"])
            if not any(
                key == (y[3]["contig_id"], y[3]["is_rc"])
                and overlap(x[2].ref_start, x[2].ref_end, y[2].ref_start, y[2].ref_end) > 0.9 * (x[2].ref_end - x[2].ref_start)
                and compete_for_query(x[1], y[1], 0.9)
                for y in out
            ):
                out.append(x)
        return out

    def uncovered(self) -> list[tuple[int, int]]:
        """Stretches of the read that no placement covers."""
        at, out = 0, []
        for start, end in sorted((x[1].q_start, x[1].q_end) for x in self.placed) + [(self.n, self.n)]:
            if start - at >= self.p.supplementary_bases:
                out.append((at, start))
            at = max(at, end)
        return out

    def record(self, kind: str, x: tuple, placed: list[tuple]) -> dict:
        rank, view, c, locus = x
        own = self.oriented(locus["is_rc"])
        start, ops = assemble(c, own, locus["window"], locus["offset"], self.p)
        lead = ops[0][1] if ops and ops[0][0] == "S" else 0
        score, edits = cg.metrics([o for o in ops if o[0] != "S"], own[lead:], locus["window"][start - locus["offset"] :], self.p)
        rivals = [y[0] for y in placed if y is not x and compete_for_query(view, y[1], self.p.query_overlap)]
        return {
            "record_type": kind, "contig_id": locus[
                "contig_id"
            ], "ref_start": start, "ref_end": start + cg.ref_length(ops), "query_start": 0, "query_end": self.n, "is_rc": locus["is_rc"],
            "score": score, "cigar": ops, "edit_distance": edits, "rank": rank, "second": max(rivals, default=None), "near": 1 + sum(
                r >= 0.6 * rank for r in rivals
            ),
            "span": (
                c.q_end - c.q_start
            ) / max(self.n, 1), "anchors": len(c.anchors), "covered": c.covered, "limited": self.limited, "ambiguous": self.ambiguous, "whole": None,
        }

    def records(self) -> list[dict]:
        """The primary, then supplementary and secondary alignments."""
        p, placed = self.p, self.ranked()
        if not placed:
            return []
        first = placed[0]
        out, chosen = [self.record("primary", first, placed)], [first]
        for x in sorted((x for x in placed[1:] if x[1].covered >= p.supplementary_bases), key=lambda x: (-x[1].covered, -x[1].score, x[1].q_start)):
            here = ((x[3]["contig_id"], x[3]["is_rc"]), x[2])
            clash = any(
                compete_for_query(y[1], x[1], p.query_overlap) or compete_for_reference(
                    ((y[3]["contig_id"], y[3]["is_rc"]), y[2]), here, p.ref_overlap
                ) for y in chosen
            )
            if not clash and len(chosen) <= p.max_supplementary:
                chosen.append(x)
                out.append(self.record("supplementary", x, placed))
        left = p.max_secondary
        for x in [x for x in placed[1:] if not any(x is y for y in chosen)]:
            longer = max(first[1].q_end - first[1].q_start, x[1].q_end - x[1].q_start)
            if left > 0 and x[0] >= p.secondary_ratio * first[0] and 2 * overlap(first[1].q_start, first[1].q_end, x[1].q_start, x[1].q_end) >= longer:
                left -= 1
                out.append(self.record("secondary", x, placed))
        self.counts["records"] = len(out)
        return out


#: What a read's search counts.
COUNTERS = (
    "candidates", "ambiguous_stops", "internal_skips", "score_breaks", "split_kept", "no_placement_breaks", "full_searches", "sparse_searches", "promotions", "thin_skips", "anchors", "ambiguous_anchors", "chains", "reseeded",
    "exact", "near_exact", "records",
)


def run(searches: list[Search], p: Policy) -> None:
    """The candidates of all reads in turn: the n-th candidates of all reads are chained together."""
    for k in range(max((len(s.todo) for s in searches), default=0)):
        jobs = []
        for s in searches:
            if not s.over and k < len(s.todo) and (found := s.wants(k)) is not None:
                locus, full = found
                found_anchors = s.anchors(locus, full)
                if len(found_anchors) and not s.too_thin(k, locus, found_anchors):
                    jobs.append((s, locus, full, found_anchors))
        made = _chained(jobs, p)
        again = []
        for (s, locus, full, _), chains in zip(jobs, made, strict=True):
            if not full and chains:  # a sparse search that threatens what is placed is repeated in full
                best = max((x[0] for x in s.placed), default=None)
                if (5 * chains[0].covered >= s.n or chains[0].covered >= 300) and (best is None or chains[0].score + locus["bonus"] >= best):
                    s.counts["promotions"] += 1
                    again.append((s, locus, True, s.anchors(locus, True)))
                    continue
            s.place(chains, locus)
        for (s, locus, _, _), chains in zip(again, _chained(again, p), strict=True):
            s.place(chains, locus)


def _chained(jobs: list[tuple], p: Policy) -> list[list[chain.Chain]]:
    return chain.chains_of_many([a for *_, a in jobs], [s.n for s, *_ in jobs], p, best=4, covered=500)


def align_read(read: bytes, loci: list[dict], p: Policy) -> list[dict]:
    """All records of one read from the windows of its candidates, best first, as ``Search.record`` has them; operations as dictionaries."""
    s = Search(read, [{"q_start": 0, "q_end": len(read), "support": "internal", "score": 0} | x for x in loci], p)
    run([s], p)
    return [r | {"cigar": [{"op": o, "len": n} for o, n in r["cigar"]]} for r in s.records()]


def whole_read(read: bytes, locus: dict, p: Policy) -> dict | None:
    """The whole read against one two-ended locus in a band a little wider than its drift; None if they differ too much.

    locus: contig_id, is_rc, offset, window, drift (of its pair of seeds), frequency."""
    own = reverse_complement(read) if locus["is_rc"] else read
    if locus["drift"] > p.near_exact_drift:
        return None
    got = dp.align_banded(own, locus["window"], locus["drift"] + p.near_exact_slack, p)
    if isinstance(got, str) or got.edits > p.near_exact_divergence * len(read):
        return None
    ops = cg.left_aligned(cg.merged_gaps(got.cigar, own, locus["window"], p), own, locus["window"])
    ops, start = cg.clean_edges(ops, 0)
    score, edits = cg.metrics([o for o in ops if o[0] != "S"], own[ops[0][1] if ops[0][0] == "S" else 0 :], locus["window"][start:], p)
    return _whole(
        read, locus["contig_id"], locus["is_rc"], locus["offset"] + start, ops, score, edits
    ) | {"whole": (edits / max(1, len(read)), locus["drift"], locus["frequency"])}


def _whole(read: bytes, contig: int, rc: bool, start: int, ops: cg.Ops, score: int, edits: int) -> dict:
    """The one record of a read that needed no search."""
    return {
        "record_type": "primary", "contig_id": contig, "ref_start": start, "ref_end": start + cg.ref_length(ops), "query_start": 0, "query_end": len(
            read
        ), "is_rc": rc, "score": score, "cigar": ops,
        "edit_distance": edits, "rank": None, "second": None, "near": 1, "span": 1.0, "anchors": 1, "covered": len(
            read
        ), "limited": False, "ambiguous": False, "whole": None,
    }


RAW = (
    "read_ord long, record_type string, contig_id long, ref_start long, ref_end long, query_start int, query_end int, is_rc boolean, score int, cigar array<struct<op:string,len:int>>, edit_distance int, "
    "rank int, second int, near int, span double, anchors int, covered int, limited boolean, ambiguous boolean, divergence double, drift int, frequency int"
)
_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
    "array<struct<op:string,len:int>>": pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
}


def _raw(found: list[tuple[int, dict]]) -> pa.RecordBatch:
    """Records of reads as a batch of RAW."""
    rows = [r | {"read_ord": k} | dict(zip(("divergence", "drift", "frequency"), r["whole"] or (None, None, None), strict=True)) for k, r in found]
    names, arrays = [], []
    for field in RAW.split(", "):
        name, kind = field.split(" ")
        names.append(name)
        if name == "cigar":
            ops = [o for r in rows for o in r["cigar"]]
            ends = np.cumsum([0] + [len(r["cigar"]) for r in rows]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array([o for o, _ in ops], pa.string()), pa.array([n for _, n in ops], pa.int32())], ["op", "len"])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
        else:
            arrays.append(pa.array([r[name] for r in rows], _KINDS[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def judged(raw: DataFrame, p: Policy) -> DataFrame:
    """ALIGNMENT of RAW: the confidence of each record (``mapq``)."""
    c, aligned = F.col, F.aggregate("cigar", F.lit(0), lambda s, o: s + F.when(o["op"] == "S", 0).otherwise(o["len"]))
    rank, second = c("rank"), c("second")
    if p.mapq_mode == "mm2":
        q = mapq.minimap2(rank, second, c("span"), c("anchors"), c("covered"), c("near"))
    else:
        q = mapq.legacy(rank, second, c("covered") / F.greatest(c("query_end"), F.lit(1)))
    capped = mapq.calibrated(
        mapq.capped(q, c("limited"), second.isNotNull(), c("ambiguous"), p.limited_cap, p.ambiguity_cap), c("score"), c("edit_distance"), aligned
    )
    near = mapq.near_exact(c("divergence"), c("drift"), c("frequency"), p.near_exact_divergence, p.near_exact_drift)
    final = F.when(c("record_type") == "secondary", F.lit(0)).when(c("drift").isNotNull(), near).when(rank.isNull(), F.lit(60)).otherwise(capped)
    return raw.withColumn("mapq", final.cast("int")).select(*(f.split(" ")[0] for f in ALIGNMENT.split(", ")))


def windows(reads: DataFrame, found: DataFrame, contigs: DataFrame, p: Policy) -> DataFrame:
    """Each candidate with the window of its contig that the whole read could lie on, in pieces: a row for every tile of the contig."""
    n = F.length("sequence")
    flank = F.least(F.lit(p.flank), n)
    before = F.when(F.col("is_rc"), n - F.col("q_end")).otherwise(F.col("q_start"))
    after = F.when(F.col("is_rc"), F.col("q_start")).otherwise(n - F.col("q_end"))
    about = ["read_ord", "contig_id", "is_rc", "q_start", "q_end", "ref_start", "ref_end", "endpoint_support", "score", "rank"]
    placed = found.select(*about).join(reads.select("read_ord", "sequence"), "read_ord")
    placed = placed.withColumn("offset", F.greatest(F.lit(0), F.col("ref_start") - before - flank).cast("long"))
    parts = reference.cut_out(
        placed.withColumn("bonus", candidates.endpoint_bonus(F.col("endpoint_support"), n).cast("int")), contigs, F.col("offset"),
        F.col("ref_end") + after + flank
    )
    # the read's own bases travel with its first piece only
    first = (F.col("rank") == 1) & (F.col("piece_start") == F.col("offset"))
    return parts.select(
        "read_ord", "rank", "tile", "contig_id", "is_rc", "q_start", "q_end", "offset", "endpoint_support", "score", "bonus", "piece",
        F.when(first, F.col("sequence")).alias("sequence")
    )


def _searches(batches, p: Policy):
    """Reads with the windows of their candidates, from rows of ``windows`` sorted by read, rank and tile; TOGETHER at a time."""
    out, read, rows = [], None, []

    def search():
        sequence = next(r["sequence"] for r in rows if r["sequence"] is not None).encode()
        loci: list[dict] = []
        for r in rows:
            if not loci or loci[-1]["rank"] != r["rank"]:
                loci.append(r | {"window": b"", "support": r["endpoint_support"]})
            loci[-1]["window"] += r["piece"].encode()
        return read, Search(sequence, loci, p)

    for batch in batches:
        for r in batch.to_pylist():
            if r["read_ord"] != read:
                if rows:
                    out.append(search())
                    if len(out) == TOGETHER:
                        yield out
                        out = []
                read, rows = r["read_ord"], []
            rows.append(r)
    if rows:
        out.append(search())
    if out:
        yield out


def align(reads: DataFrame, found: DataFrame, contigs: DataFrame, p: Policy) -> DataFrame:
    """Alignments (columns of ALIGNMENT) of reads on their candidates. Many reads of a task are worked on together."""

    def kernel(batches):
        for some in _searches(batches, p):
            run([s for _, s in some], p)
            yield _raw([(k, r) for k, s in some for r in s.records()])

    n = max(1, int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = windows(reads, found, contigs, p).repartition(n, "read_ord").sortWithinPartitions("read_ord", "rank", "tile")
    return judged(rows.mapInArrow(kernel, RAW), p)


def local_search(read: bytes, table: local.SeedTable, p: Policy) -> tuple[dict | None, Search | None, local.Seeds]:
    """A read's one record if it needs no search, else its candidates."""
    seeds = local.seeds_of(read, table, p)
    turned = reverse_complement(read)
    exact = local.exact_place(read, turned, table, seeds, p)
    if exact is not None:
        ops = [("M", len(read))]
        own = turned if exact["is_rc"] else read
        score, edits = cg.metrics(ops, own, table.contigs[exact["contig_id"]][exact["ref_start"] :], p)
        return _whole(read, exact["contig_id"], exact["is_rc"], exact["ref_start"], ops, score, edits) | {"how": "exact"}, None, seeds
    loci = None
    if p.near_exact:
        ended = local.two_ended(len(read), table, seeds, p)
        if len(ended) == 1:
            [locus] = ended
            contig = table.contigs[locus["contig_id"]]
            found = whole_read(read, locus | {"offset": locus["ref_start"], "window": contig[locus["ref_start"] : locus["ref_end"]]}, p)
            if found is not None:
                return found | {"how": "near_exact"}, None, seeds
            loci = [
                {
                    "contig_id": locus["contig_id"], "is_rc": locus["is_rc"], "q_start": 0, "q_end": len(read), "ref_start": locus["ref_start"],
                    "ref_end": locus["ref_end"], "support": "both", "bonus": 250, "score": len(read)
                }
            ]
    if loci is None:
        rows = local.probes_of(len(read), seeds, p)
        loci = local.candidates_of(len(read), local.hits_of(rows, table, seeds, p), p)
    return None, Search(read, [local.window_of(c, len(read), table.contigs[c["contig_id"]], p) for c in loci], p), seeds


def _local(table, p: Policy, counted: bool):
    """Reads against a small reference, from their seeds to their records; or what each read's search counted."""

    def kernel(batches):
        for batch in batches:
            reads = list(zip(batch.column("read_ord").to_pylist(), batch.column("sequence").to_pylist(), strict=True))
            for at in range(0, len(reads), TOGETHER):
                done, some, counts = [], [], {}
                for k, sequence in reads[at : at + TOGETHER]:
                    record, search, seeds = local_search((sequence or "").encode().upper(), table.value, p)
                    if record is not None:
                        done.append((k, record))
                        counts[k] = dict.fromkeys(COUNTERS, 0) | {record["how"]: 1, "records": 1}
                    else:
                        some.append((k, search, seeds))
                for _, s, _ in some:
                    s.counting = counted
                run([s for _, s, _ in some], p)
                if p.reseed:
                    for _, s, seeds in some:
                        s.todo, s.over = local.voted(seeds, table.value, s.uncovered(), p) if s.placed else [], False
                        s.counts["reseeded"] = len(s.todo)
                    run([s for _, s, _ in some if s.todo], p)
                done += [(k, r) for k, s, _ in some for r in s.records()]
                counts |= {k: s.counts for k, s, _ in some}
                if counted:
                    own = sorted(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64()), *(pa.array([counts[k][c] for k in own], pa.int32()) for c in COUNTERS)],
                        names=["read_ord", *COUNTERS]
                    )
                elif done:
                    yield _raw(sorted(done, key=lambda x: x[0]))

    return kernel


def bases_of(contigs: DataFrame) -> int:
    return contigs.agg(F.coalesce(F.sum(F.length("sequence").cast("long")), F.lit(0))).first()[0]


def small_table(contigs: DataFrame, p: Policy, size: int):
    """The reference as a broadcast if it has at most SMALL bases (``size``), else None."""
    if size > SMALL:
        return None
    rows = contigs.select("contig_id", "sequence").toArrow()
    return contigs.sparkSession.sparkContext.broadcast(local.seed_table(list(zip(rows["contig_id"].to_pylist(), rows["sequence"].to_pylist(), strict=True)), p))


def _blocked(reads: DataFrame, contigs: DataFrame, p: Policy, size: int) -> DataFrame:
    """Reads against a larger reference: ``blocks`` brings them their candidates' windows, and a task aligns the reads of a block, TOGETHER at a time."""
    rows, together = blocks.searches(reads, contigs, p, size, lambda loci: budget_of(loci, p)[0])

    def kernel(batches):
        for block in together(batches):
            for at in range(0, len(block), TOGETHER):
                done, some = [], []
                for k, read, exact, loci in block[at : at + TOGETHER]:
                    record = next((r for r in (_exact(read, x, p) for x in exact) if r is not None), None)
                    if record is not None:
                        done.append((k, record))
                    else:
                        some.append((k, Search(read, loci, p)))
                run([s for _, s in some], p)
                done += [(k, r) for k, s in some for r in s.records()]
                if done:
                    yield _raw(done)

    return judged(rows.mapInArrow(kernel, RAW), p)


def _exact(read: bytes, place: dict, p: Policy) -> dict | None:
    """The record of a read at a place where it may be whole; None if it differs from the bases there."""
    own = reverse_complement(read) if place["is_rc"] else read
    if own.upper() != place["window"].upper():
        return None
    ops = [("M", len(read))]
    score, edits = cg.metrics(ops, own, place["window"], p)
    return _whole(read, place["contig_id"], place["is_rc"], place["ref_start"], ops, score, edits)


def map_reads(reads: DataFrame, contigs: DataFrame, p: Policy, seed_index: DataFrame | None = None, caps: DataFrame | None = None) -> DataFrame:
    """Reads to alignments; ``seed_index`` may be one that was built and stored before, ``caps`` a table (mapq, cap) that bounds confidences.

    A reference of at most SMALL bases (which is checked) goes to every task, and a read is mapped where it is; a larger
    one meets the reads in blocks and buckets (``blocks``), or by joins with a stored index.  All give the same alignments (``near_exact`` and
    ``reseed`` are only there for small references)."""
    if caps is not None:
        return mapq.apply_caps(map_reads(reads, contigs, p, seed_index), caps).select(*(f.split(" ")[0] for f in ALIGNMENT.split(", ")))
    size = bases_of(contigs) if seed_index is None else None
    table = small_table(contigs, p, size) if size is not None else None
    if table is not None:
        return judged(reads.select("read_ord", "sequence").mapInArrow(_local(table, p, False), RAW), p)
    if p.near_exact or p.reseed:
        raise ValueError(f"near_exact and reseed need a reference of at most {SMALL} bases")
    if seed_index is None:
        return _blocked(reads, contigs, p, size)
    reads = reads.withColumn("sequence", F.upper("sequence"))
    seeds = kmers.query_minimizers(reads, p.k, p.window)
    looked = lookup.seeds_with_totals(seeds, seed_index)
    exact = lookup.exact_placements(reads, seeds, seed_index, contigs, p.k)
    rest = reads.join(exact.select("read_ord"), "read_ord", "left_anti")
    found = candidates.find(rest, probes.read_probes(rest, looked.join(exact.select("read_ord"), "read_ord", "left_anti"), p), seed_index, p)
    known = exact.join(reads.select("read_ord", "sequence"), "read_ord").withColumn("n", F.length("sequence"))
    score = p.match * F.length(F.regexp_replace("sequence", "[^ACGT]", ""))
    whole = known.select(
        "read_ord", F.lit("primary").alias(
            "record_type"
        ), "contig_id", "ref_start", "ref_end", F.lit(0).alias("query_start"), F.col("n").alias("query_end"), "is_rc", score.cast("int").alias("score"),
        F.lit(60).alias("mapq"), F.array(F.struct(F.lit("M").alias("op"), F.col("n").alias("len"))).alias("cigar"), F.lit(0).alias("edit_distance"),
    )
    return whole.unionByName(align(rest, found, contigs, p))


def diagnostics(reads: DataFrame, contigs: DataFrame, p: Policy) -> DataFrame:
    """For each read what its search did (COUNTERS); of a small reference."""
    table = small_table(contigs, p, bases_of(contigs))
    if table is None:
        raise ValueError(f"diagnostics need a reference of at most {SMALL} bases")
    return reads.select("read_ord", "sequence").mapInArrow(_local(table, p, True), "read_ord long, " + ", ".join(f"{c} int" for c in COUNTERS))
