"""One record per structure out of the layers' candidates, and its class."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmesh.constants import CONFIRMED_CONFIDENCE, FUSION_RADIUS, MATCH_TOLERANCE, OUTPUT_COLUMNS
from weirmesh.functions.geodesy import ring_centroid
from weirmesh.operators.components import connected_components
from weirmesh.operators.proximity import closest_match, near_packed_cells, packed_side, snap_to_line, square_distance, with_cells
from weirmesh.plans.staging import stage_table
from weirmesh.sources.files import write_csv

#: layer name -> function from that layer's raw table and the river network (x1, y1, x2, y2, line_id)
#: to id, x, y, confidence, source_ref
LAYER_NORMALIZERS: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]] = {}


def normalizer(layer: str):
    def add(f: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
        LAYER_NORMALIZERS[layer] = f
        return f

    return add


@normalizer("layer3_water_signature")
def water_signature(raw: DataFrame, network: DataFrame | None) -> DataFrame:
    """raw(id, tile_id, water_frac, ring, x, y): confirmed water areas, each at the point of the nearest
    river; x, y where they are given, else the centroid of the ring. A large reservoir's centroid lies
    far from its dam, so without a network this raises."""
    if network is None:
        raise ValueError("water areas are placed on a river network")
    c = ring_centroid(F.col("ring"))
    at = raw.select("id", "tile_id", "water_frac", F.coalesce(F.col("x").cast("double"), c["x"]).alias("x"), F.coalesce(F.col("y").cast("double"), c["y"]).alias("y"))
    on = snap_to_line(at, network).select("id", F.col("snap_x").alias("x"), F.col("snap_y").alias("y"))
    return at.drop("x", "y").join(on, "id").select("id", "x", "y", F.col("water_frac").alias("confidence"), F.col("tile_id").alias("source_ref"))


def load_candidates(raw: dict[str, DataFrame], network: DataFrame | None = None) -> DataFrame:
    """All layers by name; unknown layers raise KeyError."""
    out = None
    for layer, df in raw.items():
        rows = LAYER_NORMALIZERS[layer](df, network).withColumn("layer", F.lit(layer))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no layers")
    return out


def cluster(points: DataFrame, radius: int = FUSION_RADIUS) -> DataFrame:
    """points(id, x, y, ..) with cluster, the smallest id linked by steps of at most radius.

    The points of a small cell are all linked, so only cells, by their smallest id, are compared
    and joined, not all pairs of points, which grow with the square of the density.
    """
    at = with_cells(points.filter("x is not null and y is not null").select("id", "x", "y"), packed_side(radius))
    at = stage_table(at.join(at.groupBy("cx", "cy").agg(F.min("id").alias("rep")), ["cx", "cy"]), "placed")
    spot = at.select("rep", "cx", "cy", "x", "y").distinct()
    right = spot.select("cx", "cy", F.col("rep").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = near_packed_cells(spot, radius, half=True).join(right.hint("merge"), ["cx", "cy"])
    links = near.filter(square_distance("x", "y", "rx", "ry") <= radius * radius).select(F.col("rep").alias("a"), "b").distinct()
    twice = at.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("_last")).filter("b < _last").drop("_last")  # an id at several places
    links = links.unionByName(at.join(twice, "id").select(F.col("rep").alias("a"), "b"))
    found = connected_components(links).withColumnRenamed("id", "rep")
    found = at.join(found, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("c"))
    return points.join(found, "id", "left").withColumn("cluster", F.coalesce("c", "id")).drop("c")


def fuse(points: DataFrame, radius: int = FUSION_RADIUS) -> DataFrame:
    """id (the cluster), x, y (mean of its distinct positions, 3 decimals), layers, n_layers,
    confidence (the largest of the rounded per-layer maxima), per_layer_confidence (JSON),
    source_refs, n_members. An empty input gives the same columns."""
    c = cluster(points, radius)
    place = c.groupBy("cluster", "x", "y").agg(F.lit(1)).groupBy("cluster").agg(
        F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y"))
    layer = c.groupBy("cluster", "layer").agg(
        F.bround(F.max("confidence"), 4).alias("conf"), F.collect_set("source_ref").alias("refs"), F.count("*").alias("n"))
    rows = layer.groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("layer", F.col("conf").cast("decimal(10,4)")))).alias("by_layer"),
        F.max("conf").alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))), ";").alias("source_refs"),
        F.sum("n").alias("n_members"),
    )
    return rows.join(place, "cluster").select(
        F.col("cluster").alias("id"), "x", "y",
        F.array_join("by_layer.layer", ";").alias("layers"),
        F.size("by_layer").alias("n_layers"),
        "confidence",
        F.to_json(F.map_from_entries("by_layer")).alias("per_layer_confidence"),
        "source_refs", "n_members",
    )


def classify(n_layers: Column, confidence: Column) -> Column:
    return F.when((n_layers >= 2) | (confidence >= CONFIRMED_CONFIDENCE), "new-confirmed").otherwise("new-uncertain")


def classify_unmatched(matched: DataFrame) -> DataFrame:
    status = F.when(F.col("match_status") == "new", classify(F.col("n_layers"), F.col("confidence"))).otherwise(F.col("match_status"))
    return matched.withColumn("match_status", status)


def fuse_match_classify(points: DataFrame, registry: DataFrame) -> DataFrame:
    """The whole chain: cluster, fuse, closest registry row within 30 m, class of the rest."""
    return classify_unmatched(closest_match(fuse(points), registry, MATCH_TOLERANCE))


def reindex(df: DataFrame, columns: tuple[str, ...] = OUTPUT_COLUMNS) -> DataFrame:
    """A fixed list of columns; the ones that are missing are null strings."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def precision_recall(candidates: DataFrame, inventory: DataFrame, training_ids: DataFrame, radius: int = MATCH_TOLERANCE) -> DataFrame:
    """Hits, totals and ratios both ways, without the inventory rows used in training."""
    held = inventory.join(training_ids, "source_id", "left_anti")
    known = closest_match(candidates.select("id", "x", "y"), held, radius)
    back = closest_match(held.select(F.col("source_id").alias("id"), "x", "y"), candidates.select(F.lit("").alias("source"), F.col("id").alias("source_id"), "x", "y"), radius)
    hits = lambda d, a: d.agg(F.count("*").alias(f"{a}_total"), F.count_if(F.col("match_status") == "known").alias(f"{a}_hits"))
    p, r = hits(known, "candidate"), hits(back, "inventory")
    ratio = lambda a: F.round(F.try_divide(F.col(f"{a}_hits"), F.col(f"{a}_total")), 6)
    return p.crossJoin(r).withColumns({"precision": ratio("candidate"), "recall": ratio("inventory")})


def removed_barriers(registry: DataFrame, candidates: DataFrame, radius: int = MATCH_TOLERANCE) -> DataFrame:
    """Registry rows without any candidate within radius."""
    rows = registry.select(F.struct("source", "source_id").alias("id"), "x", "y")
    cand = candidates.select(F.lit("").alias("source"), F.col("id").alias("source_id"), "x", "y")
    return closest_match(rows, cand, radius).filter("match_status = 'new'").select("id.source", "id.source_id", "x", "y")


def with_thumbnails(df: DataFrame, url: Callable[[float, float], str] | None = None, column: str = "ee_thumbnail_url") -> DataFrame:
    """Adds a picture's address for lon, lat of each row; empty without url, and where it fails."""
    if url is None:
        return df.withColumn(column, F.lit(""))

    @F.pandas_udf("string")
    def each(lon: pd.Series, lat: pd.Series) -> pd.Series:
        def one(a: float, b: float) -> str:
            try:
                return url(a, b) or ""
            except Exception:  # a row without a picture is still to be reviewed
                return ""

        return pd.Series([one(a, b) for a, b in zip(lon, lat, strict=True)], dtype="object")

    return df.withColumn(column, each("lon", "lat"))


def write_outputs(fused: DataFrame, folder: str, url: Callable[[float, float], str] | None = None) -> tuple[str, str]:
    """Both result files as CSV: all records in OUTPUT_COLUMNS, and those to be reviewed, with their pictures."""
    every, review = f"{folder}/pilot_output", f"{folder}/review_uncertain"
    write_csv(reindex(fused), every)
    uncertain = with_thumbnails(fused.filter("match_status = 'new-uncertain'"), url)
    write_csv(reindex(uncertain, (*OUTPUT_COLUMNS, "ee_thumbnail_url")), review)
    return every, review
