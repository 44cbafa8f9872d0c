"""Greedy suppression in rank order, as rounds of a lexicographically first independent set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmesh.operators.proximity import near_packed_cells, packed_side, square_distance, with_cells
from weirmesh.plans.staging import stage_table, unstage


def greedy_suppress(points: DataFrame, order: list[Column], radius: int, max_rounds: int = 1000) -> DataFrame:
    """The rows of points(id, x, y, ..) kept when they are taken in order and a row is dropped
    iff an already kept one is nearer than radius (strictly).

    order must end in a unique key. Each round keeps every undecided row without an undecided row
    before it, and drops its neighbours. A small cell holds no more than one kept row, so only its first
    row is compared with the cells around; pairs are never written.
    """
    rank = F.struct(*[F.struct(c.isNull().alias("n"), c.alias("v")) for c in order]).alias("r")
    at = points.filter("x is not null and y is not null").select("id", "x", "y", rank)
    live, dropped = stage_table(with_cells(at, packed_side(radius)), "live"), None
    for _ in range(max_rounds):
        if live.isEmpty():
            return points if dropped is None else points.join(dropped, "id", "left_anti")
        other = live.select("cx", "cy", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("r").alias("rr"))
        near = lambda rows: rows.join(other.hint("merge"), ["cx", "cy"]).filter((square_distance("x", "y", "rx", "ry") < radius * radius) & F.expr("id <> rid"))  # noqa: B023, E731
        first = live.groupBy("cx", "cy").agg(F.min(F.struct("r", "id", "x", "y")).alias("m")).select("cx", "cy", "m.*")
        late = near(near_packed_cells(first, radius)).filter("rr < r").select("id").distinct()
        heads = stage_table(first.join(late, "id", "left_anti").select("id", "x", "y", "cx", "cy"), "heads")
        around = heads.unionByName(near_packed_cells(heads, radius))
        out = stage_table(near(around).select(F.col("rid").alias("id")).distinct(), "dropped")
        dropped = out if dropped is None else dropped.unionByName(out)
        before, live = live, stage_table(live.join(out.unionByName(heads.select("id")), "id", "left_anti"), "live")
        unstage(before)
        unstage(heads)
    raise RuntimeError("suppression not settled")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
