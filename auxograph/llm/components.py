"""Connected components of a graph given as a table of edges.

First every task replaces the edges it reads, in runs of bounded size, by spanning forests of them,
which loses no connection. What is left goes through alternating stars: every round links each node's
larger neighbours to its smallest one (large star), then its smaller neighbours and itself to the
smallest of them (small star), until each component is a star around its smallest node. There a
node's neighbours are never gathered: a minimum is aggregated and joined back, so a node with very
many neighbours is pre-aggregated, and the join's large side can be split. Each round is written to
the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auxograph.llm.shared import Scratch

#: Edges that a task joins at once: some 100 MB of memory.
TOGETHER = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the smallest of its component, with the smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        # every root takes the smallest root across its edges, then paths are halved until they are flat
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    inner = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[inner], nodes[parent[inner]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    size = 0

    def done() -> pa.RecordBatch:
        nodes, roots = forest(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])

    for batch in batches:
        us.append(batch.column("u").to_numpy())
        vs.append(batch.column("v").to_numpy())
        size += batch.num_rows
        if size >= TOGETHER:
            yield done()
            us, vs, size = [], [], 0
    if size:
        yield done()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that has an edge and is not itself the smallest of its component.

    ``edges``: columns u, v of type long, without nulls; loops and repeated edges do no harm.
    """
    stars, n = scratch.keep(edges.select("u", "v").mapInArrow(_forests, "u long, v long"), f"{name}-0"), 0
    while True:
        # they are done when no end of an edge has two middles or is a middle itself
        middles = stars.select(F.col("v").alias("u")).distinct().withColumn("is_middle", F.lit(True))
        ends = stars.groupBy("u").agg(F.count("*").alias("n")).join(middles, "u", "left")
        if not ends.where("n > 1 or is_middle").head(1):
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n += 1
        stars = scratch.keep(_small_star(_large_star(stars)), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
