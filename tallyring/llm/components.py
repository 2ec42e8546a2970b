"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyring.llm import scratch

#: Edges that a task writes at least where a table is small; edges whose components are found at once.
FEW, CHUNK = 4096, 1 << 20


def _least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and of each the smallest that these edges lead to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges u, v of a task, ``CHUNK`` at a time, as u, v with the smallest node that they lead to as v."""
    held, n = [], 0

    def found() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        nodes, least = _least_nodes(u, v)
        other = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(least[other])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield found()
            held, n = [], 0
    if n:
        yield found()


def stars(edges: DataFrame) -> DataFrame:
    """u, v: edges with the same components, shorter paths and no more than one of a node and task, as long
    as a task has no more than ``CHUNK``. Rows stay where they are."""
    return edges.select("u", "v").mapInArrow(_stars, "u long, v long")


def tasks_of(n: int) -> int:
    """Tasks that write n small rows, or a column each of what has so many: ``FEW`` a task, or fewer."""
    return -(-n // FEW) + 1


def _with_least(edges: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Edges with the smallest v of their u as m, and the table of those. As it is written first, the
    join deals both its sides itself and can split a u with very many edges."""
    least = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
    return edges.join(least, "u"), least


def _open(edges: DataFrame, tasks: int) -> bool:
    """Whether a node has two edges to smaller ones, or has them on both sides."""
    ends = edges.select(F.col("u").alias("node"), F.lit(2).alias("by")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("by")))
    # a node with one smaller neighbour and no larger one has the sum 2, one without smaller ones 0
    told = ends.groupBy("node").agg(F.sum("by").alias("by"), F.min("by").alias("least"))
    return not told.where((F.col("by") > 2) | (F.col("by") > F.col("least"))).coalesce(tasks).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (u, v: long).

    Each task first settles its own edges. Then nodes are joined with their smallest neighbour, bigger
    neighbours first, then smaller ones, until each has one that has none, which takes a number of rounds
    about the logarithm of the longest path's length; each round is written, so its lineage is one read,
    and the one before deleted. Small tables are written by few tasks, however many partitions are set."""
    now = scratch.table(stars(edges), "edges")
    while True:
        tasks = tasks_of(now.count())
        if not _open(now, tasks):
            break
        both, of_both = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), tasks)
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large.coalesce(tasks), "large")
        small, of_large = _with_least(large, tasks)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, scratch.table(small.coalesce(tasks), "edges")
        for t in (before, large, of_both, of_large):
            scratch.drop(t)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(tasks)
    out = scratch.table(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    scratch.drop(now)
    return out
