"""Passes between anchors and the final CIGAR: anchors inside repeats, islands in long gaps, shifted phases, fragments, ends.

Each pass takes and gives operations (or anchors) and is exact about what it compares: a change is kept only if the score
rises, or stays with fewer gaps."""

from __future__ import annotations

import numpy as np

from ..config import Policy
from ..functions import kmers
from . import chain
from . import cigar as cg
from .cigar import repeat_period

#: Shifts tried in phase repair, the window in which bases must lock in again, and the mismatch rates before and after.
SHIFT, RELOCK, TARGET, LOCKED, SHIFTED = 32, 16, 48, 0.06, 0.20


def gap_opens(ops: cg.Ops) -> int:
    return sum(op in "ID" for op, _ in cg.normalized(ops))


class Gaps:
    """Fills between places of a read and a window, each worked out once."""

    def __init__(self, read: bytes, window: bytes, offset: int, p: Policy, fill):
        self.read, self.window, self.offset, self.p, self._fill = read, window, offset, p, fill
        self._known: dict[tuple[int, int, int, int], tuple[cg.Ops, int, int]] = {}

    def between(self, q0: int, q1: int, r0: int, r1: int) -> tuple[cg.Ops, int, int]:
        """Operations, score and gaps of read[q0:q1] on the reference's r0 .. r1."""
        key = (q0, q1, r0, r1)
        if key not in self._known:
            query, ref = self.read[q0:q1], self.window[r0 - self.offset : r1 - self.offset]
            ops = self._fill(query, ref, self.p)
            self._known[key] = (ops, cg.metrics(ops, query, ref, self.p)[0], gap_opens(ops))
        return self._known[key]

    def path(self, anchors: np.ndarray) -> tuple[int, int]:
        """Score and gaps from the end of the first anchor to the beginning of the last, through those between."""
        score, gaps = 0, 0
        for k in range(1, len(anchors)):
            _, s, g = self.between(*_gap(anchors[k - 1], anchors[k]))
            score, gaps = score + s, gaps + g
            if k < len(anchors) - 1:
                a = anchors[k]
                bases = self.read[a[chain.QUERY] : a[chain.QUERY_END]], self.window[a[chain.REF] - self.offset : a[chain.REF_END] - self.offset]
                score += cg.metrics([("M", len(bases[0]))], *bases, self.p)[0]
        return score, gaps

    def better_without(self, anchors: np.ndarray) -> bool:
        """Whether one gap from the first to the last anchor scores more than the way through the others, or as much with fewer gaps."""
        _, whole, opens = self.between(*_gap(anchors[0], anchors[-1]))
        score, gaps = self.path(anchors)
        return whole > score or whole == score and opens < gaps


def _gap(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    return int(a[chain.QUERY_END]), int(b[chain.QUERY]), int(a[chain.REF_END]), int(b[chain.REF])


def without_repeat_runs(anchors: np.ndarray, gaps: Gaps, least: int = 4) -> np.ndarray:
    """Runs of up to ``dissolve_run`` anchors inside a repeat go where the gap they split is one indel of ``least`` bases or more."""
    p, left = gaps.p, 0
    while p.dissolve_run and left + 2 < len(anchors):
        for right in range(min(left + 1 + p.dissolve_run, len(anchors) - 1), left + 1, -1):
            q0, q1, r0, r1 = _gap(anchors[left], anchors[right])
            span = (q1 - q0, r1 - r0)
            if min(span) <= 0 or max(span) > p.medium_gap or abs(span[0] - span[1]) < least:
                continue
            steps = [np.subtract(_gap(anchors[k], anchors[k + 1])[1::2], _gap(anchors[k], anchors[k + 1])[0::2]) for k in range(left, right)]
            if sum(int(q) != int(r) for q, r in steps) < 2:
                continue  # one gap already
            inside = [gaps.read[a[chain.QUERY] : a[chain.QUERY_END]] for a in anchors[left + 1 : right]]
            if not any(map(repeat_period, [*inside, gaps.read[q0:q1], gaps.window[r0 - gaps.offset : r1 - gaps.offset]])):
                continue
            if gaps.better_without(anchors[left : right + 1]):
                anchors = np.delete(anchors, range(left + 1, right), axis=0)
                break
        else:
            left += 1
    return anchors


def unlocked(anchors: np.ndarray, gaps: Gaps, most: int = 48) -> np.ndarray:
    """Short anchors in a repeat whose both sides change the register go where one gap is better."""
    k = 1
    while 0 < k < len(anchors) - 1:
        a = anchors[k]
        before, after = _gap(anchors[k - 1], a), _gap(a, anchors[k + 1])
        moved = [q1 - q0 != r1 - r0 for q0, q1, r0, r1 in (before, after)]
        whole = _gap(anchors[k - 1], anchors[k + 1])
        spans = (whole[1] - whole[0], whole[3] - whole[2])
        short = a[chain.QUERY_END] - a[chain.QUERY] <= most and 0 < min(spans) and max(spans) <= gaps.p.medium_gap
        if short and all(moved) and repeat_period(gaps.read[a[chain.QUERY] : a[chain.QUERY_END]]) and gaps.better_without(anchors[k - 1 : k + 2]):
            anchors = np.delete(anchors, k, axis=0)
            k = max(1, k - 1)
        else:
            k += 1
    return anchors


def islands(query: bytes, ref: bytes, k: int = 13, bucket: int = 16, apart: int = 500, lookback: int = 64) -> list[tuple[int, int, int]]:
    """A chain of exact matches (query start, reference start, length) in a gap: k-mers that are rare in the reference, grown both ways, joined by score.

    An island costs 4 + 2 * the change of diagonal + a sixteenth of the way to it."""
    q, r = kmers.forward(query, k), kmers.forward(ref, k)
    if not len(q) or not len(r):
        return []
    order = np.argsort(r, kind="stable")
    some = np.arange(0, len(q), max(len(query) // 512, 1))
    low, high = np.searchsorted(r[order], q[some], "left"), np.searchsorted(r[order], q[some], "right")
    many = np.where((q[some] >= 0) & (high - low <= bucket), high - low, 0)
    qi = np.repeat(some, many)
    ri = order[np.arange(len(qi)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)] if len(qi) else qi
    x, y = np.frombuffer(query, np.uint8), np.frombuffer(ref, np.uint8)
    found, reach = [], {}
    for i, j in zip(qi.tolist(), ri.tolist(), strict=True):
        if reach.get(i - j, -1) >= i + k:
            continue  # inside an island of this diagonal
        back, ahead = _run(x[:i][::-1], y[:j][::-1]), _run(x[i + k :], y[j + k :])
        found.append((i - back, j - back, back + k + ahead))
        reach[i - j] = i + k + ahead
    found.sort()
    best, before = [n for _, _, n in found], [-1] * len(found)
    for b, (i, j, n) in enumerate(found):
        for a in range(max(0, b - lookback), b):
            u, v, m = found[a]
            dq, dr = i - u - m, j - v - m
            if dq < 0 or dr < 0 or abs(dq - dr) > apart:
                continue
            score = best[a] + n - 4 - 2 * abs(dq - dr) - (dq + dr) // 16
            if score > best[b]:
                best[b], before[b] = score, a
    if not found:
        return []
    at, out = max(range(len(found)), key=lambda b: (best[b], -b)), []
    while at >= 0:
        out.append(found[at])
        at = before[at]
    return out[::-1]


def _run(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    different = np.flatnonzero(x[:n] != y[:n])
    return int(different[0]) if len(different) else n


def filled_islands(query: bytes, ref: bytes, p: Policy, fill, depth: int) -> cg.Ops | None:
    """A long gap as islands and the smaller gaps between them, or None without islands."""
    chained = islands(query, ref)
    if not chained:
        return None
    ops: cg.Ops = []
    q = r = 0
    for i, j, n in [*chained, (len(query), len(ref), 0)]:
        ops += [*fill(query[q:i], ref[r:j], p, depth + 1), ("M", n)]
        q, r = i + n, j + n
    return cg.normalized(ops)


def flanked(query: bytes, ref: bytes, p: Policy, align) -> cg.Ops | None:
    """16 to 64 bases of each end aligned, the middle as one run of matches and one gap; None where an end does not align."""
    n = min(64, (min(len(query), len(ref)) - 1) // 2)
    if n < 16:
        return None
    ends = [align(query[:n], ref[:n], 16, p), align(query[-n:], ref[-n:], 16, p)]
    if any(isinstance(x, str) for x in ends):
        return None
    nq, nr = len(query) - 2 * n, len(ref) - 2 * n
    return cg.normalized([*ends[0].cigar, ("M", min(nq, nr)), ("I", nq - min(nq, nr)), ("D", nr - min(nq, nr)), *ends[1].cigar])


def terminal_span(query: bytes, ref: bytes, leading: bool, k: int = 13, bucket: int = 8) -> tuple[int, int] | None:
    """The part of a reference window that an end of a read lies on, by the rare k-mer nearest to the read's outer end; None if there is none.

    Of equally near ones the one closest to the expected diagonal counts, then the first."""
    k = min(k, len(query), len(ref))
    if not k:
        return None
    q, r = kmers.forward(query, k), kmers.forward(ref, k)
    order = np.argsort(r, kind="stable")
    some = np.arange(0, len(q), max(len(query) // 512, 1))
    low, high = np.searchsorted(r[order], q[some], "left"), np.searchsorted(r[order], q[some], "right")
    many = np.where((q[some] >= 0) & (high - low <= bucket), high - low, 0)
    i = np.repeat(some, many)
    if not len(i):
        return None
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    outer = i if leading else len(query) - i - k
    away = np.abs(j - i - (max(len(ref) - len(query), 0) if leading else 0))
    best = np.lexsort((j, i, away, outer))[0]
    i, j = int(i[best]), int(j[best])
    if leading:
        return (j - i, len(ref)) if 0 <= j - i < len(ref) else None
    end = j + len(query) - i
    return (0, end) if 0 < end <= len(ref) else None


def phase_repaired(ops: cg.Ops, query: bytes, ref: bytes) -> cg.Ops:
    """Stretches of a match that run out of phase (a fifth of the bases or more differ) get the shift of up to SHIFT bases after which they lock in again.

    ref begins where the alignment does. Kept only if the edit distance falls."""
    x, y = np.frombuffer(query.upper(), np.uint8), np.frombuffer(ref.upper(), np.uint8)
    out: cg.Ops = []
    q = r = 0
    for op, n in ops:
        if op != "M":
            out.append((op, n))
            q, r = q + n * (op in "IS"), r + n * (op == "D")
            continue
        end = q + n
        while (found := _phase(x, y, q, r, end - q)) is not None:
            before, shift = found
            out += [("M", before), ("D", shift) if shift > 0 else ("I", -shift)]
            q, r = q + before + max(-shift, 0), r + before + max(shift, 0)
        out.append(("M", end - q))
        q, r = end, r + end - q
    out = cg.normalized(out)
    if out == cg.normalized(ops) or r > len(y) or cg.query_length(out) != cg.query_length(ops) or cg.ref_length(out) > len(ref):
        return ops
    return out if _edits(out, query, ref) < _edits(ops, query, ref) else ops


def _edits(ops: cg.Ops, query: bytes, ref: bytes) -> int:
    return cg.metrics(ops, query, ref, Policy())[1]


def _phase(x: np.ndarray, y: np.ndarray, q: int, r: int, n: int) -> tuple[int, int] | None:
    """The first place of a match that is out of phase, and the shift (positive: a deletion) that mends it."""
    n = min(n, len(x) - q, len(y) - r)
    if n < 2 * RELOCK:
        return None
    differ = x[q : q + n] != y[r : r + n]
    total = np.concatenate([[0], np.cumsum(differ)])
    for at in np.flatnonzero(differ[: n - RELOCK + 1]).tolist():
        size = min(TARGET, n - at)
        rate = (total[at + size] - total[at]) / size
        if rate < SHIFTED:
            continue
        best, best_rate = 0, rate
        for magnitude in range(1, SHIFT + 1):
            for shift in (-magnitude, magnitude):
                i, j = q + at + max(-shift, 0), r + at + max(shift, 0)
                m = min(TARGET, len(x) - i, len(y) - j, n - at - max(-shift, 0))
                if m < RELOCK:
                    continue
                rate = float((x[i : i + m] != y[j : j + m]).mean())
                if rate <= LOCKED and rate < best_rate:
                    best, best_rate = shift, rate
            if best and best_rate == 0:
                break
        if best:
            return at, best
    return None


def polished(ops: cg.Ops, query: bytes, ref: bytes, p: Policy, align, flank: int = 32, least: int = 4) -> cg.Ops:
    """Gaps of one kind with up to ``polish`` matches of a repeat between them are aligned again with their surroundings."""
    k = 1
    while p.polish and k + 2 < len(ops):
        kind = ops[k][0]
        last, matched, evidence, total = k, 0, False, ops[k][1]
        q, r = _consumed(ops[: k + 1])
        for j in range(k + 1, len(ops)):
            op, n = ops[j]
            if op == "M":
                matched += n
                if matched > p.polish:
                    break
                evidence |= bool(repeat_period(query[q : q + n]) or repeat_period(ref[r : r + n]))
            elif op == kind:
                last, total = j, total + n
            else:
                break
            q, r = q + n * (op in "MI"), r + n * (op in "MD")
        if kind not in "ID" or ops[k - 1][0] != "M" or last == k or not evidence or total < least or last + 1 >= len(ops) or ops[last + 1][0] != "M":
            k += 1
            continue
        edge = min(flank, ops[k - 1][1], ops[last + 1][1])
        q, r = _consumed(ops[:k])
        inner = ops[k : last + 1]
        nq, nr = cg.query_length(inner) + 2 * edge, cg.ref_length(inner) + 2 * edge
        own, target = query[q - edge : q - edge + nq], ref[r - edge : r - edge + nr]
        got = align(own, target, abs(nq - nr) + 32, p) if max(nq, nr) <= p.medium_gap else "long"
        old = [("M", edge), *inner, ("M", edge)]
        if not isinstance(got, str):
            now, before = cg.metrics(got.cigar, own, target, p)[0], cg.metrics(old, own, target, p)[0]
            if now > before or now == before and gap_opens(got.cigar) < gap_opens(old):
                ops = cg.normalized([*ops[: k - 1], ("M", ops[k - 1][1] - edge), *got.cigar, ("M", ops[last + 1][1] - edge), *ops[last + 2 :]])
        k += 1
    return ops


def _consumed(ops: cg.Ops) -> tuple[int, int]:
    return cg.query_length(ops), cg.ref_length(ops)


def without_divergent_ends(ops: cg.Ops, query: bytes, ref: bytes, start: int, window: int = 16, most: float = 0.20) -> tuple[cg.Ops, int]:
    """An end whose outermost ``window`` bases differ by more than ``most`` is clipped up to where a window differs by LOCKED at most.

    ref begins where the alignment does, at ``start``."""
    x, y = np.frombuffer(query.upper(), np.uint8), np.frombuffer(ref.upper(), np.uint8)

    def cut(n: int, q: int, r: int, back: bool) -> int:
        """Bases to clip off a match of n bases."""
        n = min(n, len(x) - q, len(y) - r)
        if n < window:
            return 0
        differ = x[q : q + n] != y[r : r + n]
        rates = np.convolve(differ[::-1] if back else differ, np.ones(window), "valid") / window
        stable = np.flatnonzero(rates <= min(LOCKED, most))
        return int(stable[0]) if rates[0] > most and len(stable) else 0

    ops = cg.normalized(ops)
    lead = int(bool(ops) and ops[0][0] == "S")
    if len(ops) > lead and ops[lead][0] == "M":
        clip = cut(ops[lead][1], ops[0][1] if lead else 0, 0, False)
        ops = cg.normalized([("S", (ops[0][1] if lead else 0) + clip), ("M", ops[lead][1] - clip), *ops[lead + 1 :]])
        start, y = start + clip, y[clip:]
    tail = int(bool(ops) and ops[-1][0] == "S")
    at = len(ops) - 1 - tail
    if at >= 0 and ops[at][0] == "M":
        clip = cut(ops[at][1], *_consumed(ops[:at]), True)
        ops = cg.normalized([*ops[:at], ("M", ops[at][1] - clip), ("S", (ops[-1][1] if tail else 0) + clip)])
    return ops, start


def protected(ops: cg.Ops, query: bytes, ref: bytes, exact: int = 8) -> list[bool]:
    """Which gaps have ``exact`` equal bases on both sides: no end is clipped beyond them."""
    out, q, r = [], 0, 0
    for k, (op, n) in enumerate(ops):
        q1, r1 = q + n * (op in "MIS"), r + n * (op in "MD")
        sides = op in "ID" and 0 < k < len(ops) - 1 and ops[k - 1][0] == ops[k + 1][0] == "M" and min(ops[k - 1][1], ops[k + 1][1]) >= exact
        out.append(
            bool(
                sides and query[q - exact : q].upper() == ref[r - exact : r].upper() and query[
                    q1 : q1 + exact
                ].upper() == ref[r1 : r1 + exact].upper()
            )
        )
        q, r = q1, r1
    return out


def score_clipped(ops: cg.Ops, query: bytes, ref: bytes, start: int, p: Policy, search: int = 25, penalty: int = 5, gain: int = 3) -> tuple[cg.Ops, int]:
    """Up to ``search`` bases of either end are clipped, gaps among them too, where the score rises by ``gain`` beyond the clip's ``penalty``.

    A match counts one. Gaps that are ``protected`` stay. ref begins where the alignment does, at ``start``."""

    def one(ops: cg.Ops, query: bytes, ref: bytes) -> tuple[int, int, int, int]:
        """Query and reference bases, whole operations and bases of the next to clip at the front."""
        keep, best, at = protected(ops, query, ref), 0, (0, 0, 0, 0)
        score = q = r = 0
        for k, (op, n) in enumerate(ops):
            if op == "S" or keep[k] or q >= search:
                break
            if op != "M":
                score -= cg.gap_cost(n, p)
                q, r = q + n * (op == "I"), r + n * (op == "D")
                if q <= search and score < best:
                    best, at = score, (q, r, k + 1, 0)
                continue
            m = min(n - 1 if k == len(ops) - 1 else n, search - q)
            x, y = np.frombuffer(query[q : q + m].upper(), np.uint8), np.frombuffer(ref[r : r + m].upper(), np.uint8)
            m = min(len(x), len(y))
            sums = score + np.cumsum(np.where(x[:m] == y[:m], 1, -p.mismatch))
            if m and sums.min() < best:
                i = int(sums.argmin()) + 1
                best, at = int(sums[i - 1]), (q + i, r + i, k, i)
            score, q, r = int(sums[-1]) if m else score, q + n, r + n
        return at if -best - penalty >= gain else (0, 0, 0, 0)

    if not ops or ops[0][0] == "S" or ops[-1][0] == "S":
        return ops, start
    q, r, k, i = one(ops, query, ref)
    body = [(ops[k][0], ops[k][1] - i), *ops[k + 1 :]] if k < len(ops) else []
    if q and not any(op == "M" for op, _ in body):
        return ops, start
    if q:
        query, ref, ops, start = query[q:], ref[r:], body, start + r
    size = cg.ref_length(ops)
    bq, br, k, i = one(ops[::-1], query[::-1], ref[:size][::-1])
    back = ops[::-1]
    body = [(back[k][0], back[k][1] - i), *back[k + 1 :]] if k < len(back) else []
    if bq and any(op == "M" for op, _ in body):
        ops = [*body[::-1], ("S", bq)]
    ops, start = cg.clean_edges(cg.normalized([("S", q), *ops]) if q else ops, start) if not q else (cg.normalized([("S", q), *ops]), start)
    return ops, start
