"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmesh.plans.staging import stage_table, unstage

MAX_ROUNDS = 60
LOCAL_EDGES = 500_000  # 8 MB; as many are joined in one task, without rounds and the plans of each, which the driver holds


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and component of every vertex of the edges of all batches."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)]), return_inverse=True)
    a, b = np.split(ends.ravel(), 2)
    up = np.arange(len(ids))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[up])], ["id", "component"])


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, component) for every vertex of edges(a, b); component is the smallest id reachable.

    Edges keep shrinking into stars around the smallest vertex; the rounds grow with the
    logarithm of a chain's length. Each round is written, so none recomputes another. Raises if
    max_rounds don't suffice. As soon as no more than LOCAL_EDGES are left, one task does the rest.
    Loops and repeated edges are fine; nulls are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    e, n = stage_table(e, "edges"), 0
    sums = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
    was = sums(e)
    while True:
        if was[0] <= LOCAL_EDGES and all(kind == "bigint" for _, kind in e.dtypes):
            out = stage_table(e.coalesce(1).mapInArrow(_smallest, "id long, component long"), "components")
            unstage(e)
            return out
        before = e
        # large star: the larger neighbours of a vertex move to the smallest vertex around it
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a vertex, and itself, move to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        j = e.join(low, "a")
        e = j.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e, n = stage_table(e, "edges"), n + 1
        unstage(before)
        now = sums(e)
        if was == now:
            break
        was = now
        if n >= max_rounds:
            raise RuntimeError(f"components not settled after {n} rounds")
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
