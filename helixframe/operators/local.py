"""Candidate search in numpy against a small reference that every task holds: seeds, probes and clusters of one read at a time.

The same definitions as ``lookup``, ``probes`` and ``candidates``, which serve references of any size by joins.  A
reference is small if ``mapper`` has checked that it has at most ``mapper.SMALL`` bases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import Policy
from ..functions import kmers
from .probes import LEFT, RIGHT


@dataclass
class SeedTable:
    """A reference's contigs by id, its sorted codes with their true totals, and the stored hits of each from ``first``."""

    contigs: dict[int, bytes]
    codes: np.ndarray
    total: np.ndarray
    first: np.ndarray
    contig: np.ndarray
    place: np.ndarray
    rc: np.ndarray

    def find(self, code: np.ndarray) -> np.ndarray:
        """Index of each code in ``codes``, -1 where it is absent."""
        if not len(self.codes):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)


def seed_table(contigs: list[tuple[int, str]], p: Policy) -> SeedTable:
    by_id = {i: (s or "").encode() for i, s in sorted(contigs)}
    parts = []
    for i, s in by_id.items():
        code, rc, ok = kmers.codes(s, p.k)
        at = np.flatnonzero(ok)
        parts.append((code[at].astype(np.int64), np.full(len(at), i, np.int64), at, rc[at]))
    code, contig, place, rc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4
    by = np.argsort(code, kind="stable")  # contigs and places are ascending
    code, contig, place, rc = code[by], contig[by], place[by], rc[by].astype(bool)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
    return SeedTable(by_id, code[first], np.diff(np.append(first, len(code))), first, contig, place, rc)


@dataclass
class Seeds:
    """A read's seeds with what the table says of them; ``capped`` totals are sampled, 0 is absent."""

    place: np.ndarray
    code: np.ndarray
    rc: np.ndarray
    at: np.ndarray
    total: np.ndarray
    complete: np.ndarray


def seeds_of(read: bytes, table: SeedTable, p: Policy) -> Seeds:
    place, code, rc = kmers.minimizers(read, p.k, p.window)
    code = code.astype(np.int64)
    at = table.find(code)
    total = np.where(at >= 0, table.total[at], 0) if len(table.codes) else np.zeros(len(code), np.int64)
    return Seeds(place, code, rc, at, total, (total > 0) & (total <= p.max_stored_hits))


def segments(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    if n <= size:
        return [(0, n)] if n > 0 else []
    step = size - min(overlap, size - 1)
    return [(min(i * step, n - size), min(i * step + size, n)) for i in range(-(-(n - size) // step) + 1)]


def probes_of(n: int, s: Seeds, p: Policy) -> np.ndarray:
    """Rows (segment, place, is_rc, code, frequency, rank, seed), in turn, without duplicates."""
    out = []
    usable = np.flatnonzero(s.complete & (s.total <= p.max_probe_frequency))
    for segment, (start, end) in enumerate(segments(n, p.segment, p.overlap)):
        own = usable[(s.place[usable] >= start) & (s.place[usable] + p.k <= end)]
        own = own[np.lexsort((s.rc[own], s.code[own], s.place[own], s.total[own]))]
        place, picked = s.place[own], []
        spacing = max((end - start) // (p.probes_per_segment + 1), 50)
        for apart in (spacing, 1):  # first apart from each other, then any other place
            free = np.ones(len(own), bool)
            for k in picked:
                free &= np.abs(place - place[k]) >= apart
            while len(picked) < p.probes_per_segment and free.any():
                k = int(free.argmax())
                picked.append(k)
                free &= np.abs(place - place[k]) >= apart
        picked.sort(key=lambda k: (place[k], s.code[own[k]], s.rc[own[k]], s.total[own[k]]))
        out += [(segment * 1024 + r + 1, segment, own[k], r + 1) for r, k in enumerate(picked)]
    usable = np.flatnonzero(s.complete & (s.total <= p.endpoint_max_frequency))
    for turn, segment, start, end in ((1 << 29, LEFT, 0, min(n, p.endpoint_window)), ((1 << 29) + 1, RIGHT, max(n - p.endpoint_window, 0), n)):
        own = usable[(s.place[usable] >= start) & (s.place[usable] + p.k <= end)]
        own = own[np.lexsort((s.code[own], s.place[own], s.total[own]))][: p.endpoint_probes]
        out += [(turn * 1024 + r + 1, segment, k, r + 1) for r, k in enumerate(own)]
    best: dict[int, tuple] = {}
    for turn, segment, seed, rank in out:  # an endpoint's copy wins, but keeps the first one's turn
        key = (0 if segment < 0 else 1, turn, segment, rank)
        old = best.get(seed)
        best[seed] = (min(old[0], turn), min(old[1], key)) if old else (turn, key)
    rows = [(turn, s.code[seed], s.place[seed], s.rc[seed], key[2], s.total[seed], seed) for seed, (turn, key) in best.items()]
    rows.sort(key=lambda r: r[:4])
    return np.array([(r[4], r[2], r[3], r[1], r[5], r[6]) for r in rows], np.int64).reshape(-1, 6)


def hits_of(rows: np.ndarray, table: SeedTable, s: Seeds, p: Policy) -> tuple[np.ndarray, ...]:
    """segment, read place, code, frequency, contig, reference place, strand: the probes' hits in turn, at most ``max_total_hits``."""
    if not len(rows):
        return (np.empty(0, np.int64),) * 7
    frequency = rows[:, 4]
    before = np.cumsum(frequency) - frequency
    count = np.clip(p.max_total_hits - before, 0, frequency)
    one = np.repeat(np.arange(len(rows)), count)
    hit = table.first[s.at[rows[one, 5]]] + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
    return rows[one, 0], rows[one, 1], rows[one, 3], frequency[one], table.contig[hit], table.place[hit], table.rc[hit] != (rows[one, 2] > 0)


def candidates_of(n: int, hits: tuple[np.ndarray, ...], p: Policy) -> list[dict]:
    """Clusters of hits by diagonal, best first, at most ``max_regions``."""
    segment, place, code, frequency, contig, ref, rc = hits
    if not len(place):
        return []
    diagonal = np.where(rc, place + ref + p.k - 1, place - ref)
    by = np.lexsort((segment, code, ref, place, diagonal, rc, contig))
    segment, place, code, frequency, contig, ref, rc, diagonal = (x[by] for x in (segment, place, code, frequency, contig, ref, rc, diagonal))
    new = np.append(True, (contig[1:] != contig[:-1]) | (rc[1:] != rc[:-1]) | (np.diff(diagonal) > p.diagonal_tolerance))
    cuts = np.append(np.flatnonzero(new), len(new))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = slice(a, b)
        parts = np.unique(segment[own])
        if len(parts) < p.min_segments:
            continue
        total = int(diagonal[own].sum())
        mean = abs(total) // (b - a) * (1 if total >= 0 else -1)
        median = int(np.float32(diagonal[a + (b - a) // 2]))
        near = np.minimum(np.abs(diagonal[own] - mean), np.abs(diagonal[own] - median)) <= p.diagonal_tolerance
        left, right = bool((near & (segment[own] == LEFT)).any()), bool((near & (segment[own] == RIGHT)).any())
        support = "both" if left and right else "left" if left else "right" if right else "internal"
        bonus = endpoint_bonus(support, n)
        different = len(set(zip(code[own].tolist(), place[own].tolist(), strict=True)))
        out.append({
            "contig_id": int(contig[a]), "is_rc": bool(rc[a]), "q_start": int(
                place[own].min()
            ), "q_end": int(place[own].max()) + p.k, "ref_start": int(ref[own].min()),
            "ref_end": int(ref[own].max()) + p.k, "support": support, "bonus": bonus, "score": len(parts) * 100 + different * 10 + (b - a) + bonus,
        })
    out.sort(key=lambda c: (-c["score"], c["contig_id"], c["ref_start"], c["ref_end"], c["is_rc"]))
    return out[: p.max_regions]


def endpoint_bonus(support: str, n: int) -> int:
    return {"both": 250, "left": 60, "right": 60}.get(support, -50 if n >= 2000 else 0)


def window_of(c: dict, n: int, contig: bytes, p: Policy) -> dict:
    """The part of the contig that the whole read could lie on."""
    flank = min(p.flank, n)
    before, after = (n - c["q_end"], c["q_start"]) if c["is_rc"] else (c["q_start"], n - c["q_end"])
    offset = max(0, c["ref_start"] - before - flank)
    return c | {"offset": offset, "window": contig[offset : max(offset, c["ref_end"] + after + flank)]}


def exact_place(read: bytes, turned: bytes, table: SeedTable, s: Seeds, p: Policy, tries: int = 3) -> dict | None:
    """Where a unique seed places the whole read without a difference, if it does."""
    for k in np.flatnonzero(s.complete & (s.total == 1))[:tries].tolist():
        hit = table.first[s.at[k]]
        rc = bool(s.rc[k]) != bool(table.rc[hit])
        start = int(table.place[hit] - (len(read) - s.place[k] - p.k if rc else s.place[k]))
        if start < 0:
            return None
        contig = int(table.contig[hit])
        if table.contigs[contig][start : start + len(read)].upper() == (turned if rc else read).upper():
            return {"contig_id": contig, "is_rc": rc, "ref_start": start}
    return None


def two_ended(n: int, table: SeedTable, s: Seeds, p: Policy, most_seeds: int = 8, most_hits: int = 32, loci: int = 8) -> list[dict]:
    """Loci where seeds of both ends lie about as far apart as on the read, the tightest pair of each band of 2,000 bases; at most ``loci`` of them."""
    window = min(p.endpoint_window, n // 2)
    if not window or n < 2 * window:
        return []
    usable = np.flatnonzero(s.complete & (s.total <= min(p.endpoint_max_frequency, most_hits)) & (s.place + p.k <= n))
    ends = [usable[s.place[usable] < window], usable[(s.place[usable] >= n - window) & (s.place[usable] >= window)]]
    ends = [x[np.lexsort((s.code[x], s.place[x], s.total[x]))][:most_seeds] for x in ends]
    sides = []
    for own in ends:
        one = np.repeat(own, s.total[own])
        hit = table.first[s.at[one]] + np.arange(len(one)) - np.repeat(np.cumsum(s.total[own]) - s.total[own], s.total[own])
        sides.append((one, hit, table.contig[hit], table.rc[hit] != s.rc[one]))
    (a, ha, ca, ra), (b, hb, cb, rb) = sides
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))  # at most 8 * 32 of each end
    ok = (ca[i] == cb[j]) & (ra[i] == rb[j]) & (s.place[b[j]] > s.place[a[i]])
    i, j = i[ok], j[ok]
    x, y = table.place[ha[i]], table.place[hb[j]]
    far = np.where(ra[i], x - y, y - x)
    drift = np.abs(far - (s.place[b[j]] - s.place[a[i]]))
    best: dict[tuple, tuple] = {}
    for k in np.flatnonzero((drift <= 1000) & (far > 0)).tolist():
        low, high = int(min(x[k], y[k])), int(max(x[k], y[k])) + p.k
        front, back = int(s.place[a[i[k]]]), int(n - s.place[b[j[k]]] - p.k)
        front, back = (back, front) if ra[i[k]] else (front, back)
        key = (int(ca[i[k]]), bool(ra[i[k]]), low // 2000)
        found = (int(drift[k]), max(0, low - front), high + back, int(max(s.total[a[i[k]]], s.total[b[j[k]]])))
        if key not in best or found < best[key]:
            best[key] = found
    out: list[dict] = []
    for (contig, rc, band), (d, start, end, frequency) in sorted(best.items(), key=lambda kv: (kv[1], kv[0])):
        if not any(z["contig_id"] == contig and z["is_rc"] == rc and abs(z["band"] - band) <= 1 for z in out):  # neighbouring bands are one locus
            out.append({"contig_id": contig, "is_rc": rc, "band": band, "drift": d, "ref_start": start, "ref_end": end, "frequency": frequency})
    return out[:loci]


def voted(s: Seeds, table: SeedTable, intervals: list[tuple[int, int]], p: Policy) -> list[dict]:
    """For each stretch of the read that no placement explains the place that most of its seeds' hits vote for."""
    out = []
    for start, end in intervals[: p.reseed_intervals]:
        own = np.flatnonzero(s.complete & (s.total <= p.endpoint_max_frequency) & (s.place >= start) & (s.place + p.k <= end))
        one = np.repeat(own, s.total[own])
        if not len(one):
            continue
        hit = table.first[s.at[one]] + np.arange(len(one)) - np.repeat(np.cumsum(s.total[own]) - s.total[own], s.total[own])
        contig, place, rc = table.contig[hit], table.place[hit], table.rc[hit] != s.rc[one]
        diagonal = np.where(rc, s.place[one] + place + p.k - 1, s.place[one] - place)
        tolerance = max(p.diagonal_tolerance, 0)
        band = np.sign(diagonal) * (np.abs(diagonal) // tolerance) if tolerance else diagonal  # towards zero
        keys, at, votes = np.unique(np.stack([contig, rc, band], 1), axis=0, return_inverse=True, return_counts=True)
        k = int(votes.argmax())  # ties: the lowest contig, strand and band
        if votes[k] < p.reseed_hits:
            continue
        mine = place[at.reshape(-1) == k]
        span, name = end - start, int(keys[k, 0])
        low, high = max(0, int(mine.min()) - span), min(len(table.contigs[name]), int(mine.max()) + p.k + span)
        out.append({
            "contig_id": name, "is_rc": bool(keys[k, 1]), "q_start": start, "q_end": end, "ref_start": low, "ref_end": high, "support": "internal", "bonus": endpoint_bonus(
                "internal", 0
            ),
            "score": span, "offset": low, "window": table.contigs[name][low:high],
        })
    return out
