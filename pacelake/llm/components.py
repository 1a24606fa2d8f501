"""Distributed union-find: connected components of an edge table.

``hook`` unites labels of one worker's edges by numpy and so leaves a forest.
``components`` alternates large-star and small-star rounds (Kiveris et al., 2014) over a
table of edges: every node hangs itself and its larger neighbours on the smallest label
it sees, until all edges are stars; rounds grow with the logarithm of the longest path.
Each round is a written table, so that a lost executor costs no more than its tasks,
and only a count of unsettled nodes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] and b[i] in ``parent``, whose entries are roots before and after; roots are the smallest of their component."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def pivot_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group and hub: the pivots, as bits, of the component of pivots that holds most lines."""
    for b in batches:
        hubs = []
        for seen in b.column("seen").to_pylist():
            parts: list[list[int]] = []  # bits and lines of each component
            for bits, n in ((x["near"], x["n"]) for x in seen if x["near"]):
                touched = [p for p in parts if p[0] & bits]
                parts = [p for p in parts if not p[0] & bits]
                for p in touched:
                    bits, n = bits | p[0], n + p[1]
                parts.append([bits, n])
            hubs.append(max(parts, key=lambda p: (p[1], p[0]), default=[0, 0])[0])
        yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(hubs, pa.int32())], ["group", "hub"])


def _unsettled(edges: DataFrame) -> int:
    """Nodes that keep the edges from being stars: children of two nodes, or children that are parents."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return node.agg(F.count_if((F.col("child") > 1) | (F.col("child") + F.col("parent") > 1)).alias("n")).first().n


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) for every node of an edge but the roots.

    Nulls and edges of a node with itself are left out; repeated edges count once; no edges give an
    empty table.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct(), "edges")
    while _unsettled(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(hung.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
