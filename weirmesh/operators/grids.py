"""Work tiles, halo chunks and line clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmesh.constants import AOI_BUFFER, CHUNK_BUFFER, CHUNK_CORE, SNAPPED_TILE, TILE_SIZE
from weirmesh.operators.registry import in_ring


def _axis(spark: SparkSession, lo: int, hi: int, size: int, name: str) -> DataFrame:
    return spark.range(max(0, -(-(hi - lo) // size))).select(F.col("id").alias(name))


def box_segment_d2(x0: str, y0: str, x1: str, y1: str) -> F.Column:
    """Squared distance between an axis-aligned box and the segment x1, y1, x2, y2, named s*."""
    near = lambda v, a, b: F.greatest(F.col(a) - v, v - F.col(b), F.lit(0.0))
    # Liang-Barsky: the segment crosses the box iff the parameter interval isn't empty
    dx, dy = F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    lo, hi = [], []
    for d, s, a, b in ((dx, "sx1", x0, x1), (dy, "sy1", y0, y1)):
        t1, t2 = (F.col(a) - F.col(s)) / F.nullif(d.cast("double"), F.lit(0.0)), (F.col(b) - F.col(s)) / F.nullif(d.cast("double"), F.lit(0.0))
        inside = F.col(s).between(F.col(a), F.col(b))
        lo.append(F.coalesce(F.least(t1, t2), F.when(inside, 0.0).otherwise(2.0)))
        hi.append(F.coalesce(F.greatest(t1, t2), F.when(inside, 1.0).otherwise(-2.0)))
    crosses = F.greatest(lo[0], lo[1], F.lit(0.0)) <= F.least(hi[0], hi[1], F.lit(1.0))
    ends = [near(F.col(px), x0, x1) * near(F.col(px), x0, x1) + near(F.col(py), y0, y1) * near(F.col(py), y0, y1) for px, py in (("sx1", "sy1"), ("sx2", "sy2"))]
    corners = []
    for cx in (x0, x1):
        for cy in (y0, y1):
            length = (dx * dx + dy * dy).cast("double")
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((F.col(cx) - F.col("sx1")) * dx + (F.col(cy) - F.col("sy1")) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0))))
            ex, ey = F.col(cx) - (F.col("sx1") + t * dx), F.col(cy) - (F.col("sy1") + t * dy)
            corners.append(ex * ex + ey * ey)
    return F.when(crosses, F.lit(0.0)).otherwise(F.least(*ends, *corners))


def tile_grid(segments: DataFrame, size: int = TILE_SIZE, buffer: int = AOI_BUFFER, name: str = "tile") -> DataFrame:
    """Tiles of the lines' widened extent that come within buffer of a line.

    Indices are integers from the extent's corner, so ids never repeat. A segment meets only the
    tiles that its own widened box touches.
    """
    e = segments.agg(F.floor(F.min(F.least("x1", "x2")) - buffer).cast("long").alias("ax"), F.floor(F.min(F.least("y1", "y2")) - buffer).cast("long").alias("ay"))
    s = segments.selectExpr("x1 sx1", "y1 sy1", "x2 sx2", "y2 sy2").crossJoin(F.broadcast(e))  # e is one row
    at = lambda v, o: F.floor((v - F.col(o)) / size)
    span = lambda a, b, o: F.explode(F.sequence(at(F.least(a, b) - buffer, o), at(F.greatest(a, b) + buffer, o)))
    t = s.select("*", span(F.col("sx1"), F.col("sx2"), "ax").alias("tx")).select("*", span(F.col("sy1"), F.col("sy2"), "ay").alias("ty"))
    t = t.withColumns({"x0": F.col("ax") + F.col("tx") * size, "y0": F.col("ay") + F.col("ty") * size})
    t = t.withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size})
    near = t.filter(box_segment_d2("x0", "y0", "x1", "y1") <= buffer * buffer)
    return near.select(F.format_string(f"{name}_%03d_%03d", "tx", "ty").alias(f"{name}_id"), "tx", "ty", "x0", "y0", "x1", "y1").distinct()


def tile_wkt() -> F.Column:
    return F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", *[F.col(c) for c in ("x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0", "x1", "y0")])


def chunk_grid(points: DataFrame, core: int = CHUNK_CORE, halo: int = CHUNK_BUFFER) -> DataFrame:
    """Non-empty chunks over the points' extent with their core and fetch (core plus halo) bounds."""
    e = points.agg(F.min("x").alias("ax"), F.min("y").alias("ay"))
    at = points.crossJoin(F.broadcast(e)).select("ax", "ay", F.floor((F.col("y") - F.col("ay")) / core).alias("row"), F.floor((F.col("x") - F.col("ax")) / core).alias("col")).distinct()  # e is one row
    at = at.withColumns({"x0": F.col("ax") + F.col("col") * core, "y0": F.col("ay") + F.col("row") * core})
    return at.select(
        F.format_string("dem_chunk_%02d_%02d", "row", "col").alias("chunk_id"), "x0", "y0", (F.col("x0") + core).alias("x1"), (F.col("y0") + core).alias("y1"),
        (F.col("x0") - halo).alias("fx0"), (F.col("y0") - halo).alias("fy0"), (F.col("x0") + core + halo).alias("fx1"), (F.col("y0") + core + halo).alias("fy1"),
    )


def with_halo(cells: DataFrame, core: int, halo: int) -> DataFrame:
    """A row of each cell for every chunk whose core plus halo holds it; is_core marks the owner."""
    reach = -(-halo // core)
    own = cells.withColumns({"ox": F.floor(F.col("x") / core), "oy": F.floor(F.col("y") / core)})
    step = lambda: F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    rep = own.select("*", step().alias("_dx")).select("*", step().alias("_dy"))
    rep = rep.withColumns({"chunk_x": F.col("ox") + F.col("_dx"), "chunk_y": F.col("oy") + F.col("_dy")})
    inside = (F.col("x") >= F.col("chunk_x") * core - halo) & (F.col("x") < (F.col("chunk_x") + 1) * core + halo) & (F.col("y") >= F.col("chunk_y") * core - halo) & (F.col("y") < (F.col("chunk_y") + 1) * core + halo)
    return rep.filter(inside).withColumn("is_core", (F.col("_dx") == 0) & (F.col("_dy") == 0)).drop("ox", "oy", "_dx", "_dy")


def clip_lines(segments: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The parts of segments(x1, y1, x2, y2, ..) inside a box; parts without length go."""
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for d, s, a, b in ((dx, "x1", x0, x1), (dy, "y1", y0, y1)):
        t1, t2 = (F.lit(float(a)) - F.col(s)) / F.nullif(d, F.lit(0.0)), (F.lit(float(b)) - F.col(s)) / F.nullif(d, F.lit(0.0))
        inside = F.col(s).between(a, b)
        lo.append(F.coalesce(F.least(t1, t2), F.when(inside, 0.0).otherwise(2.0)))
        hi.append(F.coalesce(F.greatest(t1, t2), F.when(inside, 1.0).otherwise(-2.0)))
    out = segments.withColumns({"_a": F.greatest(*lo), "_b": F.least(*hi)}).filter("_a < _b").filter("x1 <> x2 or y1 <> y2")
    return out.withColumns({"x1": F.col("x1") + F.col("_a") * dx, "y1": F.col("y1") + F.col("_a") * dy, "x2": F.col("x1") + F.col("_b") * dx, "y2": F.col("y1") + F.col("_b") * dy}).drop("_a", "_b")


def snapped_tiles(segments: DataFrame, size: int = SNAPPED_TILE, buffer: int = AOI_BUFFER, name: str = "tile") -> DataFrame:
    """Tiles at multiples of size that come within buffer of a line, named by their lower left corner."""
    s = segments.selectExpr("x1 sx1", "y1 sy1", "x2 sx2", "y2 sy2")
    span = lambda a, b: F.explode(F.sequence(F.ceil((F.least(a, b) - buffer) / size) - 1, F.floor((F.greatest(a, b) + buffer) / size)))
    t = s.select("*", span(F.col("sx1"), F.col("sx2")).alias("x0")).select("*", span(F.col("sy1"), F.col("sy2")).alias("y0"))
    t = t.withColumns({"x0": F.col("x0") * size, "y0": F.col("y0") * size})
    near = t.withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size}).filter(box_segment_d2("x0", "y0", "x1", "y1") <= buffer * buffer)
    return near.select(F.format_string(f"{name}_%d_%d", "x0", "y0").alias("tile_id"), "x0", "y0", "x1", "y1").distinct()


def clip_lines_to_ring(segments: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """The parts of segments(x1, y1, x2, y2, ..) inside a polygon given by its corners; a part for each row.

    A segment is cut where it meets an edge; the pieces whose middle lies inside stay.
    """
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    cuts = [F.lit(0.0), F.lit(1.0)]
    for (ax, ay), (bx, by) in edges:
        ex, ey = float(bx - ax), float(by - ay)
        qx, qy = F.lit(float(ax)) - F.col("x1"), F.lit(float(ay)) - F.col("y1")
        across = F.nullif(dx * ey - dy * ex, F.lit(0.0))
        t, u = (qx * ey - qy * ex) / across, (qx * dy - qy * dx) / across
        cuts.append(F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t))
    s = segments.withColumn("_t", F.array_sort(F.array_distinct(F.array_compact(F.array(*cuts)))))
    ends = F.filter(F.zip_with("_t", F.slice("_t", 2, F.size("_t")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull())
    s = s.withColumn("_p", F.explode(ends)).withColumn("_m", (F.col("_p.a") + F.col("_p.b")) / 2)
    s = s.withColumns({"_x": F.col("x1") + F.col("_m") * dx, "_y": F.col("y1") + F.col("_m") * dy}).filter(in_ring("_x", "_y", ring)).filter("x1 <> x2 or y1 <> y2")
    at = lambda o, d, e: F.col(o) + F.col(f"_p.{e}") * d
    return s.withColumns({"x1": at("x1", dx, "a"), "y1": at("y1", dy, "a"), "x2": at("x1", dx, "b"), "y2": at("y1", dy, "b")}).drop("_t", "_p", "_m", "_x", "_y")
