"""Normalizing, clipping, counting and splitting the registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmesh.constants import HOLDOUT_FRACTION, SAMPLE_GRID, SAMPLE_SIZE

REGISTRY_COLUMNS = ("source", "source_id", "x", "y", "barrier_type", "raw_attributes")


def normalize(df: DataFrame, source: str, source_id: Column, barrier_type: Column, x: str = "x", y: str = "y", attributes: list[str] | None = None) -> DataFrame:
    """One registry's rows in the common schema; the other columns go into a JSON string."""
    rest = attributes if attributes is not None else [c for c in df.columns if c not in (x, y)]
    return df.select(
        F.lit(source).alias("source"), source_id.cast("string").alias("source_id"), F.col(x).alias("x"), F.col(y).alias("y"),
        barrier_type.cast("string").alias("barrier_type"), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in rest])).alias("raw_attributes"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def priority(source: Column, order: dict[str, int], default: int | None = None) -> Column:
    """Rank of a source; unknown ones get the default, null sorts last."""
    known = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    return F.coalesce(F.try_element_at(known, source), F.lit(default).cast("int"))


def falsy_or(first: Column, second: Column) -> Column:
    """The first unless it is null or zero."""
    return F.coalesce(F.nullif(first, F.lit(0).cast("double")), second)


def in_ring(x: str, y: str, ring: list[tuple[int, int]]) -> Column:
    """Point in polygon by crossing parity; the polygon's size is fixed, so its edges are literals."""
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    crossings = [
        F.when(((F.lit(y1) > F.col(y)) != (F.lit(y2) > F.col(y))) & (F.col(x) < F.lit(x1) + (F.col(y) - F.lit(y1)) * F.lit(float(x2 - x1)) / F.lit(float(y2 - y1))), 1).otherwise(0)
        for (x1, y1), (x2, y2) in edges if y1 != y2
    ]
    return (reduce(lambda a, b: a + b, crossings) % 2) == 1


def clip_to_polygon(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points(id, x, y) inside the polygon given as edges(x1, y1, x2, y2), whatever its size: edges
    are banded by y, so that a point meets only those of its band."""
    band = 256
    tall = edges.filter("y1 <> y2").select("*", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band))).alias("band"))
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (
        F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")).cast("double") / (F.col("y2") - F.col("y1")).cast("double"))
    hit = points.withColumn("band", F.floor(F.col("y") / band)).join(tall, "band").filter(crosses)
    odd = hit.groupBy("id").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return points.join(odd, "id", "left_semi")


def field_versus_clip(df: DataFrame, key: str, field: Column, clip: Column) -> DataFrame:
    """How many keys only the text field, only the clip, and both select."""
    f, c = df.filter(field).select(key), df.filter(clip).select(key)
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(f.subtract(c), "only_field").crossJoin(n(c.subtract(f), "only_clip")).crossJoin(n(f.intersect(c), "both"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def seeded_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def grid_cells(df: DataFrame, n: int = SAMPLE_GRID) -> DataFrame:
    """gx, gy of an n x n grid over the extent of all rows, the last edge included."""
    e = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v, a, b: F.least(F.coalesce(F.floor((F.col(v) - F.col(a)) * n / F.nullif(F.col(b) - F.col(a), F.lit(0))), F.lit(0)), F.lit(n - 1)).cast("int")
    return df.crossJoin(F.broadcast(e)).withColumns({"gx": at("x", "x0", "x1"), "gy": at("y", "y0", "y1")}).drop("x0", "x1", "y0", "y1")  # e is one row


def stratified_sample(df: DataFrame, key: str, n: int = SAMPLE_SIZE, grid: int = SAMPLE_GRID, seed: int = 42) -> DataFrame:
    """About n rows, as even over the grid's non-empty cells as can be; the same rows each time."""
    g = grid_cells(df, grid)
    cells = g.select("gx", "gy").distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.count("*"))).alias("per_cell"))
    w = Window.partitionBy("gx", "gy").orderBy(seeded_order(F.col(key), seed), F.col(key))
    few = g.withColumn("rn", F.row_number().over(w)).crossJoin(F.broadcast(cells)).filter("rn <= per_cell").drop("rn", "per_cell")  # cells is one row
    return few.orderBy(seeded_order(F.col(key), seed), F.col(key)).limit(n)


def spot_check(df: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group to look at by hand, the same each time, with the group's size."""
    w = Window.partitionBy(group).orderBy(seeded_order(F.col(key), seed), F.col(key))
    few = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
    return few.join(df.groupBy(group).agg(F.count("*").alias("group_size")), group)


def holdout_split(sample: DataFrame, key: str, fraction: float = HOLDOUT_FRACTION, seed: int = 7, at_least: int = 0) -> DataFrame:
    """The sample with split train/holdout; round(n * fraction) rows are held out."""
    size = max(at_least, round(sample.count() * fraction))
    held = sample.orderBy(seeded_order(F.col(key), seed), F.col(key)).limit(size).select(key, F.lit("holdout").alias("split"))
    return sample.join(held, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))
