"""Arrays packed into binary columns: one row of a shuffle carries thousands of records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane: the planes of high bytes are nearly empty and deflate away."""
    size = len(next(iter(arrays.values())))
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(size, -1).T.tobytes() for a in arrays.values()) if size else b""
    return size.to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if size else b"")


def unpack(blob: bytes, **kinds: str) -> dict[str, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return {name: np.empty(0, kind) for name, kind in kinds.items()}
    widths = {name: np.dtype(kind).itemsize for name, kind in kinds.items()}
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size * sum(widths.values()), codec="zstd"), np.uint8)
    out, at = {}, 0
    for name, width in widths.items():
        out[name] = np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).view(kinds[name]).reshape(-1)
        at += size * width
    return out


def dealt(bucket: np.ndarray, n: int):
    """Each bucket (0 .. n - 1) that occurs with the places of its records, in their order."""
    by = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), by[ends[k] : ends[k + 1]]
