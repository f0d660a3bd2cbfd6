"""Connected components of an edge table, by repeated contraction to stars with no graph on the driver.

Each task replaces its edges by a spanning forest's stars (over one Arrow stream, a million edges at a time), so
the edges left are at most the nodes seen by each task; tasks are as many as there are millions of edges.  Large-star and small-star
steps alternate with that, each written to the shared folder, until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import drop, keep

_TOGETHER = 1 << 20  # edges that a task contracts at once


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node but the roots."""
    names, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(names))
    x, y = flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _contract(batches):
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    size = 0

    def out():
        node, root = roots(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a.append(batch.column("u").to_numpy())
        b.append(batch.column("v").to_numpy())
        size += batch.num_rows
        if size >= _TOGETHER:
            yield out()
            a, b, size = [], [], 0
    if size:
        yield out()


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges u > v; hot nodes are pre-aggregated by partial minima."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # large-star: every larger neighbour of u is linked to u's smallest neighbour
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small-star: every node and its smaller neighbours are linked to the smallest of them
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return small.where("u <> v").mapInArrow(_contract, "u long, v long").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (the smallest node reachable) for every node that an edge names; other nodes are their own.

    Nulls and loops are ignored; repeated edges change nothing; no edges give no rows.  Each round gives a task as many edges
    as it contracts at once, so rounds end soon, and with the first one where all edges are one such lot.
    """
    ordered = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now = keep(ordered.mapInArrow(_contract, "u long, v long"), "edges")
    while True:
        lots = -(-now.count() // _TOGETHER)
        packed = now.coalesce(lots).mapInArrow(_contract, "u long, v long") if lots else now
        if lots <= 1:
            return packed.select(F.col("u").alias("node"), F.col("v").alias("component"))
        new = keep(packed.distinct(), "edges")
        drop(now)
        now = new
        if _is_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        new = keep(_step(now), "edges")
        drop(now)
        now = new


def _is_stars(edges: DataFrame) -> bool:
    """Every node is either a centre or the member of one centre (which is smaller, as edges point down)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("member"), F.lit(0).alias("centre")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("member").alias("m"), F.max("centre").alias("c"))
    return roles.where("m > 1 or (m > 0 and c > 0)").isEmpty()
