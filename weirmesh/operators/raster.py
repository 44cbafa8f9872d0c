"""Raster operators on cell tables (tile, row, col, value..), and kernels for whole tiles."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmesh.constants import BOX_LEAST_AREA, BOX_MOST_OF_FRAME, BOX_REACH, DEFAULT_HALF_WIDTH, EXCESS_AREA, EXCESS_FRACTION, HALF_WIDTH_BY_STRAHLER, RIVER_TOLERANCE, STEP_ACCUM, STEP_DOWN, STEP_RATIO, STEP_UP, STEP_WINDOW, WATER_HSV
from weirmesh.operators.components import connected_components
from weirmesh.operators.proximity import near_line_ids, segment_cells, segment_d2, with_cells

#: Fixed value: the eight neighbours, in the order that settles ties of the steepest descent.
D8_OFFSETS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def median_composite(observations: DataFrame, cell: list[str], bands: list[str]) -> DataFrame:
    return observations.groupBy(*cell).agg(*[F.median(b).alias(b) for b in bands])


def percentile_stretch(pixels: DataFrame, by: list[str], bands: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    cuts = [F.percentile(b, F.lit(p)).alias(f"{b}_{n}") for b in bands for n, p in (("low", low), ("high", high))]
    return pixels.groupBy(*by).agg(*cuts)


def mosaic_first_wins(pixels: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Of overlapping pixels the one from the first file; nodata (null) never covers."""
    rest = [c for c in pixels.columns if c not in cell and c != order]
    return pixels.groupBy(*cell).agg(F.min_by(F.struct(order, *rest), order).alias("m")).select(*cell, "m.*")


def masked_fraction(cells: DataFrame, by: list[str], mask: Column) -> DataFrame:
    return cells.groupBy(*by).agg(F.avg(mask.cast("int")).alias("fraction"))


def mask_components(cells: DataFrame, width: int = 1 << 31) -> DataFrame:
    """Statistics of the 8-connected components of cells(row, col).

    A component is named row * width + col of its first cell. Columns from 0 to width - 2 have
    ids of their own; another column, or a row beyond 2 ** 31, is an error.
    """
    at = cells.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    fits = F.col("col").between(0, width - 2) & (F.abs("row") < (1 << 31))
    ids = at.withColumn("id", F.when(fits, F.col("row") * width + F.col("col")).otherwise(F.raise_error(F.lit("cell outside the frame"))))
    half = F.array(*[F.lit(r * width + c) for r, c in D8_OFFSETS[4:]])  # each pair from one side
    near = ids.select(F.col("id").alias("a"), F.explode(F.transform(half, lambda o: F.col("id") + o)).alias("b"))
    edges = near.join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    label = ids.join(connected_components(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return label.groupBy("component").agg(
        F.count("*").alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"),
        F.round(F.avg("row"), 6).alias("row_mean"), F.round(F.avg("col"), 6).alias("col_mean"),
    )


def near_centre_box(components: DataFrame, height: int, width: int, least: int = BOX_LEAST_AREA, reach: float = BOX_REACH, most: float = BOX_MOST_OF_FRAME) -> DataFrame:
    """Box x0, y0, x1, y1 (ends excluded) of the largest of mask_components whose centroid lies near
    the frame's centre; ties go to the first in row order. No row if none qualifies, or if the
    chosen one's box fills nearly the whole frame, which tells of a bad crop, not of large water.
    """
    off = F.hypot(F.col("col_mean") - width / 2, F.col("row_mean") - height / 2)
    fit = components.filter((F.col("area") >= least) & (off <= min(height, width) * reach))
    best = fit.agg(F.max_by(F.struct(*fit.columns), F.struct("area", -F.col("component"))).alias("m")).select("m.*")
    box = best.select(F.col("col0").alias("x0"), F.col("row0").alias("y0"), (F.col("col1") + 1).alias("x1"), (F.col("row1") + 1).alias("y1"), "area")
    return box.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= most * height * width)


def dilate(cells: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """cells(row, col) and all within reach on either axis, inside a frame of height x width."""
    out = cells.select("row", "col").distinct()
    for c, n in (("row", height), ("col", width)):
        out = out.withColumn(c, F.explode(F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(n - 1))))).distinct()
    return out


def erode(cells: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """Cells whose square of reach lies in cells(row, col); what is outside the frame doesn't count."""
    out = cells.select("row", "col").distinct()
    for c, n in (("row", height), ("col", width)):
        lo, hi = F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(n - 1))
        held = out.withColumn(c, F.explode(F.sequence(lo, hi))).groupBy("row", "col").agg(F.count("*").alias("held"))
        out = held.filter(F.col("held") == hi - lo + 1).select("row", "col")
    return out


def clean_mask(cells: DataFrame, height: int, width: int, opening: int = 1, closing: int = 12) -> DataFrame:
    """Opening by a square of 3 cells, then closing by one of 25."""
    opened = dilate(erode(cells, opening, height, width), opening, height, width)
    return erode(dilate(opened, closing, height, width), closing, height, width)


def excess_area(subcells: DataFrame, segments: DataFrame, reach: int, sub: int = 1) -> DataFrame:
    """Anomalous widening on cell sets: subcells(id, x, y) are squares of sub metres.

    A subcell is channel if some segment passes within its half_width. Returns id, total, excess
    (m2) and touches for every id; keep those with touches, excess > 400 and excess > 0.3 total.
    """
    size = max(reach, 1)
    seg = segment_cells(segments.select("x1", "y1", "x2", "y2", "half_width"), size, reach)
    channel = with_cells(subcells.select("id", "x", "y"), size).join(seg.hint("merge"), ["cx", "cy"]).filter(segment_d2("x", "y") <= F.col("half_width") * F.col("half_width")).select("id", "x", "y").distinct().groupBy("id").agg(F.count("*").alias("c"))
    total = subcells.groupBy("id").agg(F.count("*").alias("n"))
    return total.join(channel, "id", "left").select(
        "id", (F.col("n") * sub * sub).alias("total"), ((F.col("n") - F.coalesce("c", F.lit(0))) * sub * sub).alias("excess"), F.col("c").isNotNull().alias("touches"))


def with_half_width(network: DataFrame, extra: DataFrame | None = None, fixed: dict[int, int] = HALF_WIDTH_BY_STRAHLER, default: int = DEFAULT_HALF_WIDTH) -> DataFrame:
    """x1, y1, x2, y2, half_width of network(.., strahler), by order, and of a second network without
    orders, at the default. Segments of the first without an order go."""
    ends = ["x1", "y1", "x2", "y2"]
    width = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in fixed.items() for v in kv]), F.col("strahler").cast("int")), F.lit(default))
    out = network.filter("strahler is not null").select(*ends, width.alias("half_width"))
    return out if extra is None else out.unionByName(extra.select(*ends, F.lit(default).alias("half_width")))


def anomalous_widening(subcells: DataFrame, segments: DataFrame, tolerance: int = RIVER_TOLERANCE, sub: int = 1) -> DataFrame:
    """id, total, excess and keep of every id of subcells(id, x, y), water areas as squares of sub metres.

    keep: some subcell lies within tolerance of a segment (of any width), some lies in a channel, and
    what lies outside every channel is more than EXCESS_AREA m2 and EXCESS_FRACTION of the whole.
    """
    near = near_line_ids(subcells, segments, tolerance)
    reach = segments.agg(F.coalesce(F.ceil(F.max("half_width")), F.lit(1))).first()[0]  # one number
    e = excess_area(subcells, segments, int(reach), sub).join(near.withColumn("near", F.lit(True)), "id", "left")
    keep = F.col("near").isNotNull() & F.col("touches") & (F.col("excess") > EXCESS_AREA) & (F.col("excess") > EXCESS_FRACTION * F.col("total"))
    return e.select("id", "total", "excess", keep.alias("keep"))


def step_profile(points: DataFrame, path: str, order: list[str], elev: str) -> DataFrame:
    """Positions of each path where a flat reach meets a drop (windows of six cells)."""
    k = STEP_WINDOW
    w = Window.partitionBy(path).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(path))
    p = points.withColumns({"pos": F.row_number().over(w) - 1, "n": n, "a6": F.lag(elev, k).over(w), "a1": F.lag(elev, 1).over(w), "b5": F.lead(elev, k - 1).over(w)})
    p = p.withColumns({"up_slope": F.abs(F.col("a6") - F.col("a1")) / k, "down_slope": F.abs(F.col(elev) - F.col("b5")) / k})
    flag = (F.col("pos") >= k) & (F.col("pos") <= F.col("n") - k - 1) & (F.col("n") >= 2 * k + 2)
    flag &= (F.col("up_slope") < STEP_UP) & (F.col("down_slope") > STEP_DOWN) & (F.col("down_slope") > STEP_RATIO * F.greatest("up_slope", F.lit(1e-6)))
    return p.filter(flag).drop("a6", "a1", "b5", "n")


def fill_depressions(dem: np.ndarray) -> np.ndarray:
    """Priority flood from the edge inwards; NaN cells are outside."""
    out, done = dem.astype(float).copy(), np.isnan(dem)
    rows, cols = dem.shape
    heap = []
    for r, c in np.ndindex(rows, cols):
        edge = r in (0, rows - 1) or c in (0, cols - 1) or done[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2].any()
        if edge and not np.isnan(dem[r, c]):
            heap.append((out[r, c], r, c))
    for _, r, c in heap:
        done[r, c] = True
    heapq.heapify(heap)
    while heap:
        level, r, c = heapq.heappop(heap)
        for i, j in ((r + a, c + b) for a, b in D8_OFFSETS):
            if 0 <= i < rows and 0 <= j < cols and not done[i, j]:
                done[i, j] = True
                out[i, j] = max(out[i, j], level)
                heapq.heappush(heap, (out[i, j], i, j))
    return out


def steepest(dem: np.ndarray) -> np.ndarray:
    """For each cell the index of its steepest neighbour's offset, -1 without one; ties: the first."""
    rows, cols = dem.shape
    pad = np.pad(dem.astype(float), 1, constant_values=np.nan)
    drop = np.stack([(dem - pad[1 + a : 1 + a + rows, 1 + b : 1 + b + cols]) / np.hypot(a, b) for a, b in D8_OFFSETS])
    none = np.isnan(drop).all(axis=0)
    return np.where(none, -1, np.argmax(np.where(np.isnan(drop), -np.inf, drop), axis=0))


def flow_accumulation(dem: np.ndarray) -> np.ndarray:
    """Cells that drain through each cell, itself included; highest first, only downhill."""
    to, acc = steepest(dem), np.where(np.isnan(dem), 0, 1).astype(np.int64)
    for at in np.argsort(-np.nan_to_num(dem, nan=-np.inf), axis=None, kind="stable"):
        r, c = divmod(int(at), dem.shape[1])
        if to[r, c] >= 0:
            a, b = D8_OFFSETS[to[r, c]]
            if dem[r + a, c + b] < dem[r, c]:
                acc[r + a, c + b] += acc[r, c]
    return acc


def analyze_tile(dem: np.ndarray, accum: int = STEP_ACCUM, steps: int = 200) -> list[tuple[int, int, float, float, int]]:
    """Fill, accumulate, walk down every stream and report row, col, slopes and accumulation of steps.

    Everything is read off the filled surface, so that a pit in a stream makes no step.
    """
    filled = fill_depressions(dem)
    acc, to, k = flow_accumulation(filled), steepest(filled), STEP_WINDOW
    stream, seen, found = acc > accum, np.zeros(dem.shape, bool), []
    for r, c in zip(*np.nonzero(stream), strict=True):
        if seen[r, c]:
            continue
        path = [(r, c)]
        while len(path) <= steps and to[path[-1]] >= 0:
            a, b = D8_OFFSETS[to[path[-1]]]
            nxt = (path[-1][0] + a, path[-1][1] + b)
            if not stream[nxt]:
                break
            path.append(nxt)
        for p in path:
            seen[p] = True
        e = np.array([filled[p] for p in path])
        if len(e) < 2 * k + 2:
            continue
        i = np.arange(k, len(e) - k)
        up, down = np.abs(e[i - k] - e[i - 1]) / k, np.abs(e[i] - e[i + k - 1]) / k
        for j in np.nonzero((up < STEP_UP) & (down > STEP_DOWN) & (down > STEP_RATIO * np.maximum(up, 1e-6)))[0]:
            p = path[i[j]]
            found.append((int(p[0]), int(p[1]), round(float(up[j]), 4), round(float(down[j]), 4), int(acc[p])))
    return found


def pixel_to_map(row: Column, col: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """x, y of a pixel's upper left corner; affine is (a, b, c, d, e, f) of x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = map(float, affine)
    return a * col + b * row + c, d * col + e * row + f


def north_up(x0: float, y1: float, size: float) -> tuple[float, ...]:
    """The affine of an image whose upper left corner is x0, y1 and whose rows go south."""
    return size, 0.0, x0, 0.0, -size, y1


def without_nodata(cells: DataFrame, nodata: float | None, column: str = "elev") -> DataFrame:
    """The value that stands for nodata, and NaN, as null."""
    v = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return cells.withColumn(column, v if nodata is None else F.nullif(v, F.lit(float(nodata))))


def hsv(blue: Column, green: Column, red: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees (0 to 179), saturation and value (0 to 255) of 8-bit channels."""
    top, low = F.greatest(blue, green, red), F.least(blue, green, red)
    span = F.nullif((top - low).cast("double"), F.lit(0.0))
    turn = F.when(top == red, (green - blue) / span).when(top == green, 2 + (blue - red) / span).otherwise(4 + (red - green) / span)
    hue = F.coalesce(F.round(F.pmod(turn * 30 + 180, F.lit(180.0))).cast("int") % 180, F.lit(0))
    return hue, F.coalesce(F.round(255 * span / top).cast("int"), F.lit(0)), top.cast("int")


def in_colour_range(pixels: DataFrame, low: tuple[int, int, int] = WATER_HSV[0], high: tuple[int, int, int] = WATER_HSV[1]) -> DataFrame:
    """The pixels(blue, green, red, ..) whose hue, saturation and value all lie in a range, ends included."""
    keep = F.lit(True)
    for v, a, b in zip(hsv(F.col("blue"), F.col("green"), F.col("red")), low, high, strict=True):
        keep = keep & v.between(a, b)
    return pixels.filter(keep)


def terrain_steps(cells: DataFrame, accum: int = STEP_ACCUM, affine: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """cells(tile_id, row, col, elev): steps along the streams of each tile, a tile per group, with
    x, y of their pixels' corners. Cells that are absent or null are outside; so are rows without row or col."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        dem = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.nan)
        dem[pdf["row"], pdf["col"]] = pdf["elev"]
        rows = analyze_tile(dem, accum) if not np.isnan(dem).all() else []
        out = pd.DataFrame(rows, columns=["row", "col", "up_slope", "down_slope", "flow_accum"])
        out.insert(0, "tile_id", pdf["tile_id"].iloc[0])
        return out

    kind = cells.schema["tile_id"].dataType.simpleString()
    use = cells.filter("row is not null and col is not null").select("tile_id", F.col("row").cast("long"), F.col("col").cast("long"), F.col("elev").cast("double"))
    out = use.groupBy("tile_id").applyInPandas(one, f"tile_id {kind}, row long, col long, up_slope double, down_slope double, flow_accum long")
    x, y = pixel_to_map(F.col("row"), F.col("col"), affine)
    return out.withColumns({"x": x, "y": y})
