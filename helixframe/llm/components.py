"""Connected components of an edge table, by contracting what each task can see and joining the roots that nodes share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows of a level that may be broadcast (16 bytes each), which is checked; larger ones are joined.
SMALL = 500_000
PACKED = "bucket int, pack binary"
LEVEL = "node long, root long, merged boolean"


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node of each one's component: roots take the lesser of the two they meet, and ways are halved."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            return nodes, nodes[parent]
        x, y = x[apart], y[apart]
        low, high = np.minimum(px[apart], py[apart]), np.maximum(px[apart], py[apart])
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contract(n: int):
    def run(batches):
        edges = [(C.longs(x.column("a")), C.longs(x.column("b"))) for x in batches if x.num_rows]
        if not edges:
            return
        node, root = contracted(*map(np.concatenate, zip(*edges, strict=True)))
        bucket = (C.mix(node.astype(np.uint64)) % C.U64(n)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(n + 1))
        full = np.flatnonzero(np.diff(ends))
        packs = [C.pack(node=node[by[ends[k] : ends[k + 1]]], root=root[by[ends[k] : ends[k + 1]]]) for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packs, pa.binary())], names=["bucket", "pack"])

    return run


def _met(batches):
    """The least root of each node (merged false), and for each of its other roots an edge to that (merged true)."""
    held: dict[int, list] = {}
    for batch in batches:
        for k, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            held.setdefault(k, []).append(C.unpack(pack, node="<i8", root="<i8"))
    for k in list(held):
        r = C.joined(held.pop(k))
        by = np.lexsort((r["root"], r["node"]))
        node, root = r["node"][by], r["root"][by]
        new = np.append(True, node[1:] != node[:-1])
        least = root[np.flatnonzero(new)][np.cumsum(new) - 1]
        other = root != least
        pairs = np.unique(np.stack([root[other], least[other]], 1), axis=0)
        columns = [np.concatenate([node[new], pairs[:, 0]]), np.concatenate([root[new], pairs[:, 1]]), np.append(np.zeros(new.sum(), bool), np.ones(len(pairs), bool))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "root", "merged"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b long) -> (node, root): root is the smallest node of the component. Nodes without an edge are absent.

    A round has one shuffle.  Each task contracts its own edges to stars; stars are dealt out by their members, packed, so the
    centre of a star of any width is no key; a member that stands in several stars joins their roots by edges, which are the
    next round's.  Rounds end when no member does.  Every round is a written level (node, root), and levels are followed from
    the first: a small one is broadcast (SMALL rows, which is checked), a large one joined with its hot roots broadcast.
    Raises RuntimeError if ``rounds`` are not enough (each one joins at least the roots that meet; a path takes about log2 of its length)."""
    n = C.partitions(edges.sparkSession)
    now, levels = edges.where("a <> b").select("a", "b"), []
    for _ in range(rounds):
        level = C.cut(now.mapInArrow(_contract(n), PACKED).repartition(n, "bucket").mapInArrow(_met, LEVEL), "level")
        counts = {r.merged: r["count"] for r in level.groupBy("merged").count().collect()}
        levels.append((level.where("not merged").select("node", "root"), counts.get(False, 0)))
        if not counts.get(True):
            return _followed(levels)
        now = level.where("merged").select(F.col("node").alias("a"), F.col("root").alias("b"))
    raise RuntimeError(f"components: {rounds} rounds did not finish")


def _followed(levels: list[tuple[DataFrame, int]]) -> DataFrame:
    out, total = levels[0]
    for level, rows in levels[1:]:
        above = level.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if rows <= SMALL:
            out = out.join(F.broadcast(above), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        else:
            sizes = out.groupBy("root").agg(F.count("*").alias("m"))
            every = sizes.join(above, "root", "left").select("root", F.coalesce("top", "root").alias("top"), "m")
            out = C.join_each(out, every, "root", total, "m").select("node", F.col("top").alias("root"))
    return out
