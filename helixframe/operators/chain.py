"""Anchors and chains: exact matches of a read in a window of a contig, joined along diagonals."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..config import Policy
from ..functions import kmers

#: Columns of an anchor array: reference start, end; query start, end (of the oriented read); score.
REF, REF_END, QUERY, QUERY_END, SCORE = range(5)


@dataclass
class Chain:
    anchors: np.ndarray
    score: int
    q_start: int
    q_end: int
    ref_start: int
    ref_end: int
    covered: int
    longest: int
    max_query_gap: int
    max_ref_gap: int
    bridged: bool = field(default=False)


def find_anchors(read: bytes, window: bytes, offset: int, p: Policy, max_bucket: int = 128, sparse: bool = False) -> np.ndarray:
    """Maximal exact matches of at least ``min_anchor`` bases of an oriented read in a window that begins at ``offset``.

    ``sparse``: only matches that hold one of the read's minimizers.

    Every k-mer of the read meets those of the window (k-mers more frequent than ``max_bucket`` in it are left out);
    matches that follow each other on one diagonal are one anchor.  Anchors inside a better one are dropped."""
    q, r = kmers.forward(read, p.k), kmers.forward(window, p.k)
    if sparse:
        marked = np.zeros(len(q) + 1, np.int64)
        marked[kmers.minimizers(read, p.k, p.window)[0]] = 1
        marked = np.concatenate([[0], np.cumsum(marked)])
    order = np.argsort(r, kind="stable")
    low, high = np.searchsorted(r[order], q, "left"), np.searchsorted(r[order], q, "right")
    count = np.where((q >= 0) & (high - low <= max_bucket), high - low, 0)
    qi = np.repeat(np.arange(len(q)), count)
    ri = order[np.arange(len(qi)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)] if len(qi) else qi
    by = np.lexsort((qi, qi - ri))
    qi, ri = qi[by], ri[by]
    if not len(qi):
        return np.empty((0, 5), np.int64)
    new = np.append(True, (np.diff(qi - ri) != 0) | (np.diff(qi) != 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(qi)) - 1
    size = qi[tail] - qi[head] + p.k
    ok = size >= p.min_anchor
    if sparse:
        ok &= marked[qi[tail] + 1] > marked[qi[head]]
    qs, rs, size = qi[head][ok], ri[head][ok] + offset, size[ok]
    out = np.stack([rs, rs + size, qs, qs + size, size], 1).astype(np.int64)
    return without_contained(out, p.max_anchors)


def without_contained(anchors: np.ndarray, most: int) -> np.ndarray:
    """Longest first; one inside another on both axes goes; at most ``most`` stay, in query order."""
    anchors = anchors[np.lexsort((anchors[:, REF], anchors[:, QUERY], -anchors[:, SCORE]))]
    for first in (64, len(anchors)):  # inside of what is inside is inside: the longest few rule out most
        better = anchors[:first]
        gone = np.zeros(len(anchors), bool)
        for k in range(0, len(anchors), 512):
            a = anchors[k : k + 512, None]
            inside = (better[:, QUERY] <= a[..., QUERY]) & (
                better[:, QUERY_END] >= a[..., QUERY_END]
            ) & (better[:, REF] <= a[..., REF]) & (better[:, REF_END] >= a[..., REF_END])
            inside &= np.arange(len(better)) < np.arange(k, k + len(a))[:, None]
            gone[k : k + 512] = inside.any(1)
        anchors = anchors[~gone]
        if len(anchors) <= 64:
            break
    kept = anchors[:most]
    return kept[np.lexsort((kept[:, REF_END], kept[:, REF], kept[:, QUERY_END], kept[:, QUERY]))]


def fast_log2(x: np.ndarray) -> np.ndarray:
    """A quadratic approximation on the bits of a 32-bit float."""
    bits = np.asarray(x, np.float32).view(np.uint32)
    exponent = ((bits >> 23) & 255).astype(np.int32) - 128
    m = ((bits & ~np.uint32(255 << 23)) | np.uint32(127 << 23)).view(np.float32)
    return exponent.astype(np.float32) + ((np.float32(-0.34484843) * m + np.float32(2.0246658)) * m - np.float32(0.6748776))


def chains(anchors: np.ndarray, read_length: int, p: Policy) -> list[Chain]:
    """Best first. Each anchor takes its best predecessor of the ``max_iter`` before it within ``max_dist``; ways back are disjoint."""
    return chains_of_many([anchors], [read_length], p)[0]


def chains_of_many(sets: list[np.ndarray], read_lengths: list[int], p: Policy, best: int | None = None, covered: int = 0) -> list[list[Chain]]:
    """``chains`` of many sets of anchors; the n-th anchors of all sets are joined in one step.

    ``best``: only that many chains of a set are built, and all that cover ``covered`` bases."""
    out: list[list[Chain]] = [[] for _ in sets]
    order = sorted((k for k in range(len(sets)) if len(sets[k])), key=lambda k: len(sets[k]))
    at = 0
    while at < len(order):  # sets of about one size together: no more than a quarter of the steps is idle
        to = at + 1
        most = len(sets[order[at]]) * 4 // 3 + 8
        while to < len(order) and len(sets[order[to]]) <= most and to - at < 128:
            to += 1
        own = [sets[k][np.lexsort((sets[k][:, QUERY_END], sets[k][:, REF], sets[k][:, QUERY]))] for k in order[at:to]]
        for k, a, (dp, before) in zip(order[at:to], own, _joined(own, p), strict=True):
            out[k] = _traced(a, dp, before, read_lengths[k], best, covered)
        at = to
    return out


def _joined(sets: list[np.ndarray], p: Policy) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sorted set the best score of a chain that ends at each anchor, and the anchor before it (-1: none)."""
    n = max(map(len, sets))
    size = np.array([len(a) for a in sets])
    a = np.zeros((len(sets), n, 5), np.int64)
    for k, x in enumerate(sets):
        a[k, : len(x)] = x
    dp, before = np.maximum(a[..., SCORE], 0), np.full((len(sets), n), -1)
    # places before the first with an equal query start, and not too far away
    block = np.stack([np.searchsorted(x[:, QUERY], np.append(x[:, QUERY], np.full(n - len(x), -1)), "left") for x in sets])
    near = np.stack([np.searchsorted(x[:, QUERY], np.append(x[:, QUERY], np.full(n - len(x), -1)) - p.max_dist) for x in sets])
    low = np.maximum(np.maximum(block - p.max_iter, near), 0)
    rows = np.arange(len(sets))[:, None]
    for i in range(n):
        wide = int((block[:, i] - low[:, i])[size > i].max(initial=0))
        if wide <= 0:
            continue
        live = np.flatnonzero((size > i) & (block[:, i] > low[:, i]))
        own, row = a[live, i][:, None], rows[live]
        j = block[live, i][:, None] - 1 - np.arange(wide)
        ok = j >= low[live, i][:, None]
        j = np.maximum(j, 0)
        b = a[row, j]
        dq, dr = own[..., QUERY] - b[..., QUERY], own[..., REF] - b[..., REF]
        gap = np.abs(dq - dr)
        ok &= (dr > 0) & (dr <= p.max_dist) & (gap <= max(p.diagonal_tolerance, 0))
        fresh = np.where(
            own[..., QUERY] >= b[..., QUERY_END], own[..., SCORE],
            np.clip(np.minimum(own[..., QUERY_END] - b[..., QUERY_END], own[..., SCORE]), 0, None)
        )
        cost = np.float32(0.5) * gap.astype(np.float32) + np.float32(0.5) * fast_log2((gap + 1).astype(np.float32))
        total = np.where(ok, dp[row, j] + fresh - np.where(gap > 0, cost.astype(np.int64), 0), -(1 << 60))
        k = total.argmax(1)
        score = total[np.arange(len(live)), k]
        better = score > dp[live, i]
        dp[live[better], i] = score[better]
        before[live[better], i] = j[better, k[better]]
    return [(dp[k, :s], before[k, :s]) for k, s in enumerate(size)]


def _traced(a: np.ndarray, dp: np.ndarray, before: np.ndarray, read_length: int, best: int | None, covered: int) -> list[Chain]:
    used, paths, way = [False] * len(a), [], before.tolist()
    for s in np.lexsort((np.arange(len(a)), a[:, QUERY], -dp)).tolist():
        if used[s] or dp[s] <= 15:
            continue
        path, at = [], s
        while at >= 0 and not used[at]:
            path.append(at)
            used[at] = True
            at = way[at]
        paths.append(path[::-1])
    if best is not None and len(paths) > best:
        flat = np.concatenate(paths)
        first = np.concatenate([[0], np.cumsum([len(x) for x in paths])[:-1]])
        score, size = np.add.reduceat(a[flat, SCORE], first), np.add.reduceat((a[:, QUERY_END] - a[:, QUERY])[flat], first)
        # a penalty takes at most 200 off a score
        top = np.flatnonzero((score >= np.sort(score)[-best] - 200) | (size >= max(covered, 1)))
        paths = [paths[k] for k in top]
    return sorted((built(a[x], read_length) for x in paths), key=lambda c: (-c.score, -c.covered, c.q_start))


def built(a: np.ndarray, read_length: int) -> Chain:
    """Score: the anchors' scores, less a bounded penalty if both ends of a long read are far from the chain."""
    a = a[np.lexsort((a[:, QUERY_END], a[:, QUERY]))]
    left, right = int(a[0, QUERY]), read_length - int(a[-1, QUERY_END])
    score = int(a[:, SCORE].sum())
    if read_length >= 2000 and left >= 500 and right >= 500:
        score -= min((left + right) // 10, 200)
    size = a[:, QUERY_END] - a[:, QUERY]
    gaps = lambda s, e: int(max(0, (a[1:, s] - a[:-1, e]).max())) if len(a) > 1 else 0
    return Chain(
        a, score, left, int(a[-1, QUERY_END]), int(a[:, REF].min()), int(a[:, REF_END].max()), int(size.sum()), int(size.max()),
        gaps(QUERY, QUERY_END), gaps(REF, REF_END)
    )


def bridge(left: Chain, right: Chain, read_length: int, p: Policy, context: int = 512, overlap: int = 256) -> Chain | None:
    """Two strong chains around one long insertion or deletion as one chain, or None."""
    if right.q_start < left.q_start:
        left, right = right, left
    dq, dr = right.q_start - left.q_end, right.ref_start - left.ref_end
    strong = all(c.covered >= 500 and (len(c.anchors) >= 2 or c.longest >= 500) for c in (left, right))
    if not strong or not p.structural_min <= abs(dq - dr) <= p.structural_max or min(dq, dr) > context or dq < -overlap or dr < -overlap:
        return None
    whole = built(np.vstack([left.anchors, right.anchors]), read_length)
    whole.score = left.score + right.score - p.structural_penalty
    whole.bridged = True
    return whole


def over_mismatches(anchors: np.ndarray, read: bytes, window: bytes, offset: int, relock: int = 24, most: int = 32, rate: float = 0.08) -> np.ndarray:
    """Anchors grown across single mismatches: each needs ``relock`` equal bases after it, and there are at most ``most`` and ``rate`` of the length.

    Growth stops where the bases also go on after a shift by one, which a one-base indel would do."""
    q, r = np.frombuffer(read, np.uint8), np.frombuffer(window, np.uint8)

    def equal(i: int, j: int, step: int) -> int:
        n = min(len(q) - i, len(r) - j) if step > 0 else min(i, j) + 1
        if n <= 0:
            return 0
        a, b = (q[i : i + n], r[j : j + n]) if step > 0 else (q[i - n + 1 : i + 1][::-1], r[j - n + 1 : j + 1][::-1])
        different = np.flatnonzero(a != b)
        return int(different[0]) if len(different) else n

    out = anchors.copy()
    for a in out:
        misses = 0
        for step, qi, ri in ((1, QUERY_END, REF_END), (-1, QUERY, REF)):
            while misses < most:
                i, j = (int(a[qi]), int(a[ri]) - offset) if step > 0 else (int(a[qi]) - 1, int(a[ri]) - offset - 1)
                n = equal(i + step, j + step, step)
                longer = int(a[QUERY_END] - a[QUERY]) + 1 + n
                shifted = max(equal(i + step, j, step), equal(i, j + step, step))
                if n < relock or (misses + 1) > rate * longer or shifted >= relock:
                    break
                misses += 1
                a[qi] += step * (1 + n)
                a[ri] += step * (1 + n)
        a[SCORE] = a[QUERY_END] - a[QUERY] - misses
    return out
