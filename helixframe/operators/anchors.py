"""Anchors in stages: paired minimizers, the other minimizers, then every k-mer, until the read is explained.

Also anchors over pairs of minimizers that single mismatches separate, and marks of anchors that a repeat's period could shift."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..config import Policy
from ..functions import kmers
from . import chain
from .cigar import repeat_period
from .rewrite import _run

#: Distances of a pair on the read, and how far its distance on the reference may differ.
NEAR, FAR, SLACK = 64, 512, 12
RIGHTS, PAIRS, EXACT_PAIRS = 12, 256, 1024


@dataclass
class Coverage:
    """What is already extended, by diagonal: a match inside of it is not extended again."""

    spans: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def holds(self, diagonal: int, start: int, end: int) -> bool:
        return any(a <= start and end <= b for a, b in self.spans.get(diagonal, ()))

    def add(self, diagonal: int, start: int, end: int) -> None:
        self.spans.setdefault(diagonal, []).append((start, end))


class Matcher:
    """K-mers of an oriented read against those of a window."""

    def __init__(self, read: bytes, window: bytes, p: Policy, bucket: int = 128):
        self.read, self.window, self.p, self.bucket = read, window, p, bucket
        self.q, r = kmers.forward(read, p.k), kmers.forward(window, p.k)
        self.order = np.argsort(r, kind="stable")
        self.codes = r[self.order]
        self.x, self.y = np.frombuffer(read, np.uint8), np.frombuffer(window, np.uint8)
        self.covered = Coverage()

    def hits(self, places: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(place on the read, places in the window, ascending) of the k-mers that are there and not too frequent."""
        low, high = np.searchsorted(self.codes, self.q[places], "left"), np.searchsorted(self.codes, self.q[places], "right")
        ok = (self.q[places] >= 0) & (high > low) & (high - low <= self.bucket)
        return [(int(i), self.order[a:b]) for i, a, b in zip(places[ok], low[ok], high[ok], strict=True)]

    def extended(self, hits: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        """Maximal exact matches of at least ``min_anchor`` bases from the hits; in the order of rarity if the policy says so."""
        out, k = [], self.p.k
        for i, places in sorted(hits, key=lambda h: (len(h[1]), h[0])) if self.p.rarest_first else hits:
            for j in places.tolist():
                if self.covered.holds(i - j, i, i + k):
                    continue
                back, ahead = _run(self.x[:i][::-1], self.y[:j][::-1]), _run(self.x[i + k :], self.y[j + k :])
                size = back + k + ahead
                self.covered.add(i - j, i - back, i - back + size)
                if size >= self.p.min_anchor:
                    out.append((j - back, j - back + size, i - back, i - back + size, size))
        return out


def paired(hits: list[tuple[int, np.ndarray]]) -> tuple[set[int], list[tuple[int, int, int, int]]]:
    """Minimizers that lie about as far apart in the window as on the read, and the widest exactly equal pair of each diagonal.

    Of a left one at most RIGHTS right ones are looked at, and PAIRS compatible pairs are enough."""
    found: set[int] = set()
    widest: dict[int, tuple[int, int, int, int]] = {}
    pairs = 0
    for a, (i, left) in enumerate(hits):
        seen = 0
        for j, right in hits[a + 1 :]:
            away = j - i
            if away < NEAR:
                continue
            if away > FAR or seen == RIGHTS:
                break
            seen += 1
            low, high = np.searchsorted(right, left + away - SLACK), np.searchsorted(right, left + away + SLACK, "right")
            if not (high > low).any():
                continue
            found |= {i, j}
            pairs += 1
            for r in left[np.isin(left + away, right)].tolist():
                old = widest.get(r - i)
                if len(widest) < EXACT_PAIRS and (old is None or away > old[1] - old[0]):
                    widest[r - i] = (i, j, r, r + away)
            if pairs == PAIRS:
                return found, list(widest.values())
    return found, list(widest.values())


def over_pair(pair: tuple[int, int, int, int], m: Matcher, most: int = 32, rate: float = 0.08) -> tuple[int, int, int, int, int] | None:
    """One anchor from the left to the right minimizer of a pair: runs of at most ``emms_mismatch`` differing bases with ``emms_relock`` equal
    ones between them, then grown exactly; None if the bases differ more."""
    i, j, r, s = pair
    end = j + m.p.k
    differ = m.x[i:end] != m.y[r : r + end - i]
    misses = int(differ.sum())
    if misses > most or misses > rate * (end - i):
        return None
    edges = np.flatnonzero(np.diff(np.concatenate([[0], differ.astype(np.int8), [0]])))
    begins, ends = edges[0::2], edges[1::2]
    if len(begins) and ((ends - begins).max() > m.p.emms_mismatch or (len(begins) > 1 and (begins[1:] - ends[:-1]).min() < m.p.emms_relock)):
        return None
    back, ahead = _run(m.x[:i][::-1], m.y[:r][::-1]), _run(m.x[end:], m.y[s + m.p.k :])
    size = back + end - i + ahead
    return r - back, r - back + size, i - back, i - back + size, size - misses


def sufficient(found: np.ndarray, n: int) -> bool:
    """Six anchors that span three quarters of the read and cover 35 % of it, or one that spans 98 %."""
    if not len(found):
        return False
    size = found[:, chain.QUERY_END] - found[:, chain.QUERY]
    if size.max() >= 0.98 * n:
        return True
    order = np.argsort(found[:, chain.QUERY])
    reach = np.concatenate([[0], np.maximum.accumulate(found[order, chain.QUERY_END])[:-1]])
    covered = int(np.maximum(found[order, chain.QUERY_END] - np.maximum(found[order, chain.QUERY], reach), 0).sum())
    span = found[:, chain.QUERY_END].max() - found[:, chain.QUERY].min()
    return len(found) >= 6 and span >= 0.75 * n and covered >= 0.35 * n


def staged(read: bytes, window: bytes, offset: int, p: Policy, sparse: bool = False) -> np.ndarray:
    """Anchors of an oriented read in a window that begins at ``offset``, by stages; ``sparse`` leaves out the last one."""
    m = Matcher(read, window, p)
    minimizers = kmers.minimizers(read, p.k, p.window)[0]
    hits = m.hits(minimizers)
    near, pairs = paired(hits)
    rows: list[tuple[int, int, int, int, int]] = []
    if p.paired_emms:
        for pair in pairs:
            if (row := over_pair(pair, m)) is not None:
                rows.append(row)
                m.covered.add(row[2] - row[0], row[2], row[3])
    scanned = np.zeros(len(m.q), bool)
    stages = [[h for h in hits if h[0] in near], [h for h in hits if h[0] not in near]]
    scanned[minimizers] = True
    for k in range(2 if sparse else 3):
        stage = stages[k] if k < 2 else m.hits(np.flatnonzero(~scanned))  # the places that no stage has looked at
        rows += m.extended(stage)
        found = np.array(rows, np.int64).reshape(-1, 5)
        if sufficient(found, len(read)):
            break
    found = np.array(rows, np.int64).reshape(-1, 5)
    found[:, chain.REF] += offset
    found[:, chain.REF_END] += offset
    return chain.without_contained(found, p.max_anchors)


def ambiguous(found: np.ndarray, read: bytes, least: int = 6) -> np.ndarray:
    """Which anchors overlap another on the read by ``least`` bases and half of the shorter, a whole number of a repeat's periods away on the diagonal."""
    out = np.zeros(len(found), bool)
    order = np.argsort(found[:, chain.QUERY], kind="stable")
    for n, a in enumerate(order.tolist()):
        for b in order[n + 1 :].tolist():
            if found[b, chain.QUERY] >= found[a, chain.QUERY_END]:
                break
            start, end = int(max(found[a, chain.QUERY], found[b, chain.QUERY])), int(min(found[a, chain.QUERY_END], found[b, chain.QUERY_END]))
            shorter = min(found[a, chain.QUERY_END] - found[a, chain.QUERY], found[b, chain.QUERY_END] - found[b, chain.QUERY])
            moved = abs(int(found[a, chain.QUERY] - found[a, chain.REF]) - int(found[b, chain.QUERY] - found[b, chain.REF]))
            if end - start < least or 2 * (end - start) < shorter or not moved:
                continue
            period = repeat_period(read[start:end])
            if period and moved % period == 0:
                out[[a, b]] = True
    return out
