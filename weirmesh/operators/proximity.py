"""Distance joins as equi-joins on grid cells, so no plan holds a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weirmesh.plans.staging import stage_table


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(size)).cast("long")


def with_cells(df: DataFrame, size: float, x: str = "x", y: str = "y", reach: int = 0) -> DataFrame:
    """Adds cx, cy; with reach > 0 a row is repeated in the surrounding cells."""
    out = df.withColumns({"cx": cell(x, size), "cy": cell(y, size)})
    if not reach:
        return out
    step = lambda: F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    out = out.select("*", step().alias("_dx")).select("*", step().alias("_dy"))
    return out.withColumns({"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")}).drop("_dx", "_dy")


def square_distance(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def within_distance(left: DataFrame, right: DataFrame, radius: int, strict: bool = False) -> DataFrame:
    """Pairs of left(id, x, y) and right(rid, rx, ry) at most (strict: less than) radius apart.

    Adds d2, the squared distance. Both sides are dealt by cell; the left, taken as the smaller,
    is repeated nine times. Spark doesn't count repeated rows where it sizes a side, so joins with them
    never broadcast. Rows with null coordinates pair with nothing.
    """
    a = with_cells(left.filter("x is not null and y is not null"), radius, reach=1)
    b = with_cells(right.filter("rx is not null and ry is not null"), radius, "rx", "ry")
    d2 = square_distance("x", "y", "rx", "ry")
    pairs = a.join(b.hint("merge"), ["cx", "cy"]).withColumn("d2", d2)
    return pairs.filter(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius).drop("cx", "cy")


def packed_side(radius: float) -> float:
    """Side of cells in which any two places are less than radius apart."""
    return radius * 0.7071


def near_packed_cells(df: DataFrame, radius: float, half: bool = False) -> DataFrame:
    """A row of df(x, y, cx, cy, ..), cells of packed_side, for every other cell that holds places within
    radius of x, y, as cx, cy; with half only for the cells that follow its own."""
    n, side = range(-2, 3), packed_side(radius)
    steps = [(a, b) for a in n for b in n if ((a, b) > (0, 0) if half else (a, b) != (0, 0))]
    to = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    out = df.select("*", to.alias("_to"))

    def gap(c: str, at: str, step: str) -> Column:
        low = (F.col(at) + F.col(step)) * side
        return F.greatest(F.lit(0.0), low - F.col(c), F.col(c) - low - side)

    gx, gy = gap("x", "cx", "_to.a"), gap("y", "cy", "_to.b")
    out = out.filter(gx * gx + gy * gy <= radius * radius * 1.000001)  # a little against rounding
    return out.withColumns({"cx": F.col("cx") + F.col("_to.a"), "cy": F.col("cy") + F.col("_to.b")}).drop("_to")


def neighbour_pairs(points: DataFrame, radius: int, strict: bool = False) -> DataFrame:
    """Undirected pairs (a, b, d2) with a < b of points(id, x, y)."""
    right = points.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = within_distance(points.select("id", "x", "y"), right, radius, strict)
    return pairs.filter("id < rid").select(F.col("id").alias("a"), F.col("rid").alias("b"), "d2")


def closest_match(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """left(id, x, y, ..) with the nearest right(source, source_id, x, y) within radius, or nulls.

    Ties go to the smaller (source, source_id). Adds match_status known/new, matched_source,
    matched_source_id and matched_distance_m (half-even to one decimal).
    """
    b = right.select("source", "source_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = within_distance(left.select("id", "x", "y"), b, radius)
    best = near.groupBy("id").agg(F.min(F.struct("d2", "source", "source_id")).alias("m"))
    return left.join(best, "id", "left").select(
        *left.columns,
        F.when(F.col("m").isNull(), "new").otherwise("known").alias("match_status"),
        F.col("m.source").alias("matched_source"),
        F.col("m.source_id").alias("matched_source_id"),
        F.bround(F.sqrt(F.col("m.d2").cast("double")), 1).alias("matched_distance_m"),
    )


def segment_d2(px: str, py: str) -> Column:
    """Squared distance of a point to the segment x1, y1, x2, y2."""
    t = segment_t(px, py)
    ex = F.col(px) - (F.col("x1") + t * (F.col("x2") - F.col("x1")))
    ey = F.col(py) - (F.col("y1") + t * (F.col("y2") - F.col("y1")))
    return ex * ex + ey * ey


def segment_t(px: str, py: str) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = (F.col(px) - F.col("x1")) * dx + (F.col(py) - F.col("y1")) * dy
    length = (dx * dx + dy * dy).cast("double")
    return F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / length)))


def segment_cells(segments: DataFrame, size: int, reach: int) -> DataFrame:
    """A row of each segment for every cell that holds places within reach metres of it, and few more:
    in each column of cells those beside the part of the segment that comes near the column."""
    x1, y1, dx, dy = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    span = lambda a, b, more: F.explode(F.sequence(cell(F.least(a, b) - more, size), cell(F.greatest(a, b) + more, size)))
    out = segments.select("*", span(x1, F.col("x2"), reach).alias("cx"))
    t = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x1) / F.nullif(dx, F.lit(0))))
    a, b = t(F.col("cx") * size - reach - 1), t((F.col("cx") + 1) * size + reach + 1)  # a metre against rounding
    a, b = F.when(dx == 0, F.lit(0.0)).otherwise(a), F.when(dx == 0, F.lit(1.0)).otherwise(b)
    return out.select("*", span(y1 + a * dy, y1 + b * dy, reach + 1).alias("cy"))


def near_line_ids(points: DataFrame, segments: DataFrame, radius: int) -> DataFrame:
    """The distinct ids of points(id, x, y) within radius of some segment."""
    a = with_cells(points.select("id", "x", "y"), radius)
    b = segment_cells(segments.select("x1", "y1", "x2", "y2"), radius, radius)
    return a.join(b.hint("merge"), ["cx", "cy"]).filter(segment_d2("x", "y") <= radius * radius).select("id").distinct()


def near_line(points: DataFrame, segments: DataFrame, radius: int) -> DataFrame:
    """Left semi join: the points within radius of some segment."""
    return points.join(near_line_ids(points, segments, radius), "id", "left_semi")


def first_radius(e: Row, cell_size: int) -> int:
    """cell_size, or a quarter of it time and again as long as a place of the map still has three segments or more
    within that radius on average, and segments cut into such cells aren't more rows than there are points."""
    total, area, radius = float(e["total"] or 0), max(float(e["w"] or 0), 1.0) * max(float(e["h"] or 0), 1.0), cell_size
    while (r := radius // 4) >= 1 and (2 * r * total + 3.14 * r * r * e["n"]) >= 3 * area and 9 * e["n"] + 4 * total / r <= (e["points"] or 0):
        radius = r
    return radius


def snap_to_line(points: DataFrame, segments: DataFrame, cell_size: int = 500) -> DataFrame:
    """Each point's nearest position on any segment, without a radius; points without x or y go.

    Rings of cells widen fourfold until every point is settled: a hit within the ring's radius
    is final. What the last ring, as wide as the whole extent, finds is final too. Each ring's finds
    are written, so that a wider one doesn't search the narrower ones again. Where segments crowd the first
    ring is narrower than cell_size, as the pairs in a cell grow with points times segments.
    Distances are rounded before they are held against the radius, so ties on its border are seen whole.
    """
    points = points.filter("x is not null and y is not null")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length")
    ends = points.select("x", "y", F.lit(None).cast("double").alias("length"), F.lit(1).alias("point")).unionByName(
        segments.select(F.col("x1").alias("x"), F.col("y1").alias("y"), length, F.lit(0).alias("point")))
    spread = ends.agg(
        F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
        F.count("length").alias("n"), F.sum("length").alias("total"), F.sum("point").alias("points")).first()
    extent, radius, left, done = 4 * int(spread["m"] or 0) + cell_size, first_radius(spread, cell_size), points, None
    while True:
        b = segment_cells(segments, radius, radius + 1)
        hit = with_cells(left, radius).join(b.hint("merge"), ["cx", "cy"]).withColumn("d2", F.round(segment_d2("x", "y"), 6))
        best = hit.filter(F.col("d2") <= float(radius) ** 2).groupBy("id").agg(
            F.min(F.struct("d2", "line_id", (F.col("x1") + segment_t("x", "y") * (F.col("x2") - F.col("x1"))).alias("sx"),
                           (F.col("y1") + segment_t("x", "y") * (F.col("y2") - F.col("y1"))).alias("sy"))).alias("m"))
        found = left.join(best, "id").select("id", "x", "y", F.col("m.line_id").alias("line_id"), F.col("m.sx").alias("snap_x"), F.col("m.sy").alias("snap_y"))
        found = stage_table(found, "snapped")
        done = found if done is None else done.unionByName(found)
        if radius >= extent:
            return done
        left, radius = left.join(found.select("id"), "id", "left_anti"), radius * 4
        if left.isEmpty():
            return done
