"""Affine-gap alignment in numpy: one row of the matrix at a time, gaps along the row by a running maximum.

Scores: match 2, mismatch -4, anything with an ambiguous base 0; a gap of n costs the least of
``open + n * extend`` over one or two (open, extend) pairs.  Co-optimal alignments are resolved
towards matches, then deletions, then insertions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import Policy
from . import cigar as cg

MAX_WINDOW, MAX_CELLS = 8192, 16_000_000
MAX_BANDED_SPAN, MAX_BANDED_CELLS = 262_144, 64_000_000
Z_DROP = 100
LOW = np.int32(-(1 << 29))
_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i

EMPTY, BUDGET, BAND, ZDROP = "empty_input", "budget", "impossible_band", "z_drop"


@dataclass(frozen=True)
class Aligned:
    score: int
    query_end: int
    ref_end: int
    cigar: list[tuple[str, int]]
    edits: int


def gaps_of(p: Policy) -> list[tuple[int, int]]:
    return list(zip(p.dual_open, p.dual_extend, strict=True)) if p.dual_affine else [(p.gap_open, p.gap_extend)]


def _matrix(q: np.ndarray, r: np.ndarray, band: int, p: Policy, local: bool):
    """Rows of the band: h[i, j - i + band] for query place i and reference place j; or the reason there are none."""
    n, m = len(q), len(r)
    gaps = gaps_of(p)
    width = 2 * band + 1
    h = np.full((n + 1, width), LOW, np.int32)
    col = np.arange(width) - band
    j = col.copy()
    start = (j >= 0) & (j <= m)
    h[0, start] = np.where(j[start] == 0, 0, -np.min([o + e * j[start] for o, e in gaps], axis=0))
    down = [np.full(width + 1, LOW, np.int32) for _ in gaps]
    best, at = 0, (0, 0)
    padded = np.concatenate([np.full(band + 1, 5, np.int8), r, np.full(max(0, n + band + 1 - m) + 1, 5, np.int8)])
    for i in range(1, n + 1):
        j = i + col
        ok = (j >= 0) & (j <= m)
        base = padded[i : i + width]  # r[j - 1]
        s = np.where(base == q[i - 1], np.int32(p.match), np.int32(-p.mismatch))
        s = np.where((base > 3) | (q[i - 1] > 3), np.int32(0), s)
        row = np.where(j >= 1, h[i - 1] + s, LOW)
        above = np.append(h[i - 1, 1:], LOW)  # same reference place, one query place before
        for k, (o, e) in enumerate(gaps):
            down[k][:width] = np.maximum(np.append(down[k][1:width], LOW) - e, above - (o + e))
            row = np.maximum(row, down[k][:width])
        row = np.where(ok, row, LOW)
        across = row
        for o, e in gaps:
            reach = np.maximum.accumulate(row + e * col)
            across = np.maximum(across, np.append(LOW, reach[:-1] - o) - e * col)
        h[i] = np.where(ok, np.maximum(across, LOW), LOW)
        k = int(h[i].argmax())
        if h[i, k] > best:
            best, at = int(h[i, k]), (i, i + int(col[k]))
        elif best - int(h[i, k]) > Z_DROP + gaps[-1][1] * abs((i - at[0]) - (i + int(col[k]) - at[1])):
            return (h[: i + 1], at, best) if local else ZDROP
    return h, at, best


def _trace(h: np.ndarray, q: np.ndarray, r: np.ndarray, i: int, j: int, band: int, p: Policy) -> list[tuple[str, int]]:
    gaps = gaps_of(p)
    ops: list[tuple[str, int]] = []
    while i > 0 or j > 0:
        here = int(h[i, j - i + band])
        if i > 0 and j > 0:
            a, b = q[i - 1], r[j - 1]
            s = 0 if a > 3 or b > 3 else (p.match if a == b else -p.mismatch)
            if int(h[i - 1, j - i + band]) + s == here:
                ops.append(("M", 1))
                i, j = i - 1, j - 1
                continue
        found = None
        steps = np.arange(1, min(j, band + j - i) + 1)
        if len(steps):  # a deletion: reference places j - n .. j
            left = h[i, j - steps - i + band].astype(np.int64)
            for o, e in gaps:
                k = np.flatnonzero(left - o - e * steps == here)
                if len(k):
                    found = ("D", int(steps[k[0]]))
                    break
        if found is None:
            steps = np.arange(1, min(i, band - (j - i)) + 1)
            up = h[i - steps, j - i + steps + band].astype(np.int64)
            for o, e in gaps:
                k = np.flatnonzero(up - o - e * steps == here)
                if len(k):
                    found = ("I", int(steps[k[0]]))
                    break
        if found is None:
            raise AssertionError("the matrix has no way back")
        ops.append(found)
        i, j = (i, j - found[1]) if found[0] == "D" else (i - found[1], j)
    return cg.normalized(ops[::-1])


def encode(s: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(s, np.uint8)]


def align_full(query: bytes, ref: bytes, band: int, p: Policy) -> Aligned | str:
    """End to end; or why not: empty_input, budget, impossible_band, z_drop."""
    if not query or not ref:
        return EMPTY
    if max(len(query), len(ref)) > MAX_WINDOW or len(query) * len(ref) > MAX_CELLS:
        return BUDGET
    return _global(query, ref, max(1, min(band, MAX_WINDOW)), p)


def align_banded(query: bytes, ref: bytes, band: int, p: Policy) -> Aligned | str:
    """End to end over a long span in a narrow band."""
    if not query or not ref:
        return EMPTY
    span, band = max(len(query), len(ref)), max(1, min(band, MAX_WINDOW))
    if span > MAX_BANDED_SPAN or span * (2 * band + 1) > MAX_BANDED_CELLS:
        return BUDGET
    return _global(query, ref, band, p)


def _global(query: bytes, ref: bytes, band: int, p: Policy) -> Aligned | str:
    if abs(len(query) - len(ref)) > band:
        return BAND
    q, r = encode(query), encode(ref)
    got = _matrix(q, r, band, p, False)
    if isinstance(got, str):
        return got
    ops = _trace(got[0], q, r, len(q), len(r), band, p)
    score, edits = cg.metrics(ops, query, ref, p)
    return Aligned(score, len(q), len(r), ops, edits)


def align_local(query: bytes, ref: bytes, band: int, p: Policy) -> Aligned | None:
    """Forward extension from the beginning of both; trailing gaps are cut off."""
    if not query or not ref or max(len(query), len(ref)) > MAX_WINDOW or len(query) * len(ref) > MAX_CELLS:
        return None
    band = max(1, min(band, MAX_WINDOW, max(len(query), len(ref))))
    q, r = encode(query), encode(ref)
    h, (i, j), _ = _matrix(q, r, band, p, True)
    ops = _trace(h, q, r, i, j, band, p)
    while ops and ops[-1][0] != "M":
        ops.pop()
    nq, nr = cg.query_length(ops), cg.ref_length(ops)
    if not nq or not nr:
        return None
    score, edits = cg.metrics(ops, query[:nq], ref[:nr], p)
    return Aligned(score, nq, nr, ops, edits)
