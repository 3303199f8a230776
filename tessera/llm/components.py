"""Connected components of an edge table, without collecting edges.

Partitions of at most LOCAL_EDGES edges are first contracted on their own: each becomes stars around the least nodes
that its edges reach. If that was one partition, it is the result; else alternating large and small stars, whose rounds
are joins and aggregations, connect what partitions share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import settle

#: Edges that one task holds at most (16 MB).
LOCAL_EDGES = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each): the least node that edges a-b reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _contracted(e: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) as stars of each partition."""

    def f(batches):
        held, size = [], 0

        def out():
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            nodes, root = local_roots(a, b)
            other = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(root[other])], ["u", "v"])

        for x in batches:
            held.append(x)
            size += x.num_rows
            if size >= 2 * LOCAL_EDGES:  # an uneven partition is contracted piece by piece
                held = [out()]
                size = held[0].num_rows
                if size >= LOCAL_EDGES:
                    yield held.pop()
                    size = 0
        if held:
            yield out()

    return e.coalesce(parts).mapInArrow(f, "u long, v long")


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges; root is the smallest node that can be reached.

    Each round keeps at most one row for each edge; both sides of its joins hold a node's least neighbour, aggregated
    before the shuffle, and AQE splits the rows of a node with very many neighbours. An empty frame gives an empty one.
    """
    e = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "edges")
    parts = max(1, math.ceil(e.count() / LOCAL_EDGES))
    e = settle(_contracted(e, parts), "contracted")
    before = None
    while parts > 1:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        e = settle(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
