"""Content-chosen anchors: which few places of a text stand for all its windows.

Every window of a fixed length contains the same grams wherever it occurs, so the gram with the
least hash (the leftmost of equal ones) is its anchor in every document.  Neighbouring windows
share an anchor; such a run, with the text that its windows cover, is one record.  Two windows can
only be equal if their anchors' leading tokens are, which makes a sparse suffix array over
anchors (a few for each hundred tokens) enough to find every repeated window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import common as C

_LOW = 26  # bits that hold a place; pieces of texts are kept shorter than 2**26


@dataclass
class Runs:
    """Runs of windows: row (piece), anchor, first window, number of windows, gram hash, hash of the covered tokens."""

    row: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    span: np.ndarray


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours; shorter than x by w - 1."""
    size, y = 1, x
    while size * 2 <= w:
        y = np.minimum(y[:-size], y[size:])
        size *= 2
    return np.minimum(y[: len(x) - w + 1], y[w - size :]) if size < w else y


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring values, by doubling; shorter than values by k - 1."""
    built: dict[int, np.ndarray] = {1: values}
    size = 1
    with np.errstate(over="ignore"):
        while size * 2 <= k:
            x = built[size]
            y = x[:-size] * C.U64(0x9E3779B97F4A7C15 + 2 * size)
            y += x[size:]
            y ^= y >> C.U64(29)
            built[size * 2] = y
            size *= 2
        out, at = None, 0
        n = len(values) - k + 1
        for s in sorted(built, reverse=True):
            if k & s:
                part = built[s][at : at + n]
                out = part.copy() if out is None else out * C.U64(0xC2B2AE3D27D4EB4F) + part
                at += s
    return C.mix(out)


def find(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, k: int) -> Runs | None:
    """Runs of all windows of the pieces values[starts[i]:ends[i]] (ascending and apart), or None if there are none."""
    n = len(values)
    if n < window:
        return None
    gram = gram_hashes(values, k)
    key = (gram >> C.U64(_LOW) << C.U64(_LOW)) | np.arange(len(gram), dtype=np.uint64)
    least = sliding_min(key, window - k + 1)
    fits = np.zeros(n + 1, np.int32)
    long = (ends - starts) >= window
    if not long.any():
        return None
    s, e = starts[long], ends[long] - window + 1
    np.add.at(fits, s, 1)
    np.add.at(fits, e, -1)
    at = np.flatnonzero(np.cumsum(fits[:-1])[: len(least)])
    anchor = (least[at] & C.U64((1 << _LOW) - 1)).astype(np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.logical_or(anchor[1:] != anchor[:-1], at[1:] != at[:-1] + 1, out=new[1:])
    head = np.flatnonzero(new)
    first, anchor = at[head], anchor[head]
    count = np.diff(np.append(head, len(at)))
    prefix = C.prefix_hash(values)
    span = C.range_hash(prefix, first, first + count - 1 + window)
    with np.errstate(over="ignore"):
        span = C.mix(span + (anchor - first).astype(np.uint64) * C.U64(0x9FB21C651E98DF25))
    return Runs(np.searchsorted(starts, first, "right") - 1, anchor, first, count, gram[anchor], span)
