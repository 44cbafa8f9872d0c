"""The queries: one for each operator, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmesh import constants as K
from weirmesh.functions.geodesy import extent, project, ring_area, ring_centroid, unproject, wkt_vertices
from weirmesh.operators import fusion, grids, manifest, raster, registry as reg
from weirmesh.operators.proximity import closest_match, near_line, neighbour_pairs, snap_to_line
from weirmesh.operators.suppression import first_per_key, greedy_suppress
from weirmesh.plans import tables as T
from weirmesh.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    from weirmesh.plans import io_queries  # noqa: F401  registers its queries here

    return dict(_all)


@query
def registry_normalize(s, d):
    rows = T.registry(s, d)
    parts = [reg.normalize(rows.filter(F.col("source") == a), a, F.col("source_id"), F.col("barrier_type"), attributes=["barrier_type"]) for a in "ABC"]
    return reg.union_all(parts)


@query
def registry_source_counts(s, d):
    return reg.value_counts(T.registry(s, d), "source")


@query
def field_vs_clip(s, d):
    return reg.field_versus_clip(T.registry(s, d, T.DENSE), "source_id", F.col("source") == "B", reg.in_ring("x", "y", T.RING))


@query
def clip_points(s, d):
    ring = list(zip(T.RING, T.RING[1:] + T.RING[:1], strict=True))
    edges = s.createDataFrame([(*a, *b) for a, b in ring], "x1 long, y1 long, x2 long, y2 long")
    pts = T.registry(s, d, T.DENSE).withColumnRenamed("source_id", "id")
    return reg.clip_to_polygon(pts, edges).select("id", "x", "y")


@query
def bbox_filter(s, d):
    return T.registry(s, d, T.DENSE).filter(F.col("x").between(500, 1500) & F.col("y").between(400, 1400)).select("source_id", "x", "y")


@query
def priority_map(s, d):
    r = T.registry(s, d).withColumn("name", F.element_at(F.array(F.lit("SNCZI"), F.lit("OSM"), F.lit("DAM_OR_WEIR")), F.ascii("source") - 64))
    ranked = r.select("source", reg.priority(F.col("name"), K.SOURCE_PRIORITY).alias("full"), reg.priority(F.col("name"), K.SOURCE_PRIORITY_MICRO).alias("micro"))
    return ranked.groupBy("source", "full", "micro").agg(F.count("*").alias("n"))


@query
def half_width_map(s, d):
    width = reg.priority(F.col("strahler").cast("string"), {str(k): v for k, v in K.HALF_WIDTH_BY_STRAHLER.items()}, K.DEFAULT_HALF_WIDTH)
    return T.segments(s, d).filter("strahler is not null").select("line_id", width.alias("half_width"))


@query
def falsy_coalesce(s, d):
    return T.load(s, d, "customer").select("c_custkey", reg.falsy_or((F.col("c_nationkey") % 5).cast("double"), F.col("c_acctbal")).alias("v"))


def _registry_points(s, d):
    return T.registry(s, d, T.DENSE).withColumnRenamed("source_id", "id")


@query
def greedy_dedup_priority(s, d):
    pts = _registry_points(s, d).filter("priority is not null")
    return greedy_suppress(pts, [F.col("priority"), F.col("id")], K.DEDUP_RADIUS).select("id", "x", "y")


@query
def greedy_dedup_missing_priority(s, d):
    return greedy_suppress(_registry_points(s, d), [F.col("priority"), F.col("id")], K.DEDUP_RADIUS).select("id", "priority")


@query
def greedy_dedup_area(s, d):
    c = T.load(s, d, "customer")
    pts = c.select(F.col("c_custkey").alias("id"), *T.place(F.col("c_custkey"), T.DENSE), F.col("c_acctbal").alias("area"))
    return greedy_suppress(pts, [-F.col("area"), F.col("id")], K.DEDUP_RADIUS).select("id", "area")


@query
def greedy_dedup_confidence(s, d):
    return greedy_suppress(T.candidates(s, d), [-F.col("confidence"), F.col("id")], K.DEDUP_RADIUS).select("id", "confidence")


@query
def proximity_pairs(s, d):
    return neighbour_pairs(T.candidates(s, d), K.FUSION_RADIUS)


@query
def match_closest(s, d):
    m = closest_match(T.candidates(s, d), T.registry(s, d), K.MATCH_TOLERANCE)
    return m.select("id", "match_status", "matched_source", "matched_source_id", "matched_distance_m")


@query
def river_touch_semi(s, d):
    return near_line(T.candidates(s, d), T.segments(s, d), K.RIVER_TOLERANCE).select("id", "x", "y")


@query
def snap_to_river(s, d):
    r = snap_to_line(T.candidates(s, d).select("id", "x", "y"), T.segments(s, d))
    return r.select("id", "line_id", F.round("snap_x", 3).alias("snap_x"), F.round("snap_y", 3).alias("snap_y"))


@query
def cluster_components(s, d):
    return fusion.cluster(T.candidates(s, d)).select("id", "cluster")


@query
def fuse_candidates(s, d):
    return fusion.fuse(T.candidates(s, d))


@query
def classify(s, d):
    f = fusion.fuse(T.candidates(s, d))
    return f.select("id", "n_layers", "confidence", fusion.classify(F.col("n_layers"), F.col("confidence")).alias("class"))


@query
def flagship_pipeline(s, d):
    return fusion.fuse_match_classify(T.candidates(s, d), T.registry(s, d))


@query
def match_status_counts(s, d):
    return reg.value_counts(fusion.fuse_match_classify(T.candidates(s, d), T.registry(s, d)), "match_status")


@query
def stratified_sample(s, d):
    return reg.stratified_sample(T.registry(s, d), "source_id").select("source_id", "gx", "gy")


@query
def train_holdout_split(s, d):
    return reg.holdout_split(reg.stratified_sample(T.registry(s, d), "source_id"), "source_id").select("source_id", "split")


@query
def tile_grid(s, d):
    t = grids.tile_grid(T.segments(s, d), size=1000)
    return t.withColumn("wkt", grids.tile_wkt()).select("tile_id", "tx", "ty", "x0", "y0", "wkt")


@query
def chunk_halo(s, d):
    return grids.chunk_grid(T.candidates(s, d), 4000, 500)


@query
def halo_cells(s, d):
    h = grids.with_halo(T.candidates(s, d).select("id", "x", "y"), 4000, 500)
    return h.groupBy("chunk_x", "chunk_y").agg(F.count("*").alias("cells"), F.count_if("is_core").alias("core_cells"))


@query
def clip_lines(s, d):
    c = grids.clip_lines(T.segments(s, d).drop("strahler"), 4000, 4000, 16000, 20000)
    return c.select("line_id", *[F.round(k, 4).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query
def step_profile(s, d):
    li = T.load(s, d, "lineitem").withColumn("elev", F.col("l_quantity") / 100)
    p = raster.step_profile(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"], "elev")
    return p.select("l_suppkey", "pos", F.round("up_slope", 6).alias("up_slope"), F.round("down_slope", 6).alias("down_slope"))


@query
def median_composite(s, d):
    return raster.median_composite(T.water_cells(s, d), ["row", "col"], ["green", "nir"])


def _ndwi(s, d):
    m = raster.median_composite(T.water_cells(s, d), ["row", "col"], ["green", "nir"])
    return m.withColumn("ndwi", raster.normalized_difference(F.col("green"), F.col("nir")))


@query
def ndwi_cells(s, d):
    return _ndwi(s, d).filter(F.col("ndwi") > K.NDWI_THRESHOLD).select("row", "col", F.round("ndwi", 6).alias("ndwi"))


@query
def mask_components(s, d):
    return raster.mask_components(_ndwi(s, d).filter("ndwi > 0.55")).filter("area > 1")


@query
def water_fraction(s, d):
    f = raster.masked_fraction(_ndwi(s, d), ["row"], F.col("ndwi") > K.NDWI_THRESHOLD)
    return f.select("row", F.round("fraction", 6).alias("fraction"), (F.col("fraction") > K.WATER_FRACTION_CONFIRM).alias("confirmed"))


@query
def percentile_stretch(s, d):
    p = raster.percentile_stretch(T.water_cells(s, d).withColumn("tile", F.col("row") % 10), ["tile"], ["green", "nir"])
    return p.select("tile", *[F.round(c, 6).alias(c) for c in p.columns if c != "tile"])


@query
def mosaic_first_wins(s, d):
    o = T.load(s, d, "orders").select((F.col("o_custkey") % 50).alias("row"), (F.col("o_orderkey") % 40).alias("col"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return raster.mosaic_first_wins(o, ["row", "col"], "o_orderkey")


@query
def excess_area(s, d):
    seg = T.segments(s, d).filter("strahler is not null")
    width = reg.priority(F.col("strahler").cast("string"), {str(k): v for k, v in K.HALF_WIDTH_BY_STRAHLER.items()}, K.DEFAULT_HALF_WIDTH)
    blob = T.segments(s, d).select(F.col("line_id").alias("id"), (F.col("x1") - F.col("line_id") % 40).alias("bx"), (F.col("y1") - 10).alias("by"))
    step = lambda: F.explode(F.sequence(F.lit(0), F.lit(29)))
    sub = blob.select("*", step().alias("i")).select("*", step().alias("j")).select("id", (F.col("bx") + F.col("i")).alias("x"), (F.col("by") + F.col("j")).alias("y"))
    e = raster.excess_area(sub, seg.withColumn("half_width", width), reach=max(K.HALF_WIDTH_BY_STRAHLER.values()))
    keep = F.col("touches") & (F.col("excess") > K.EXCESS_AREA) & (F.col("excess") > K.EXCESS_FRACTION * F.col("total"))
    return e.withColumn("keep", keep)


@query
def center_third_recall(s, d):
    e = T.load(s, d, "events").select("user_id", (F.col("event_id") % 600).alias("px"), ((F.col("event_id") * 7) % 600).alias("py"), F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"))
    hit = (F.col("conf") >= 0.15) & (F.col("px") > 200) & (F.col("px") < 400) & (F.col("py") > 200) & (F.col("py") < 400)
    by = e.groupBy("user_id").agg(F.bool_or(hit).alias("hit"))
    return by.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("recall", F.round(F.try_divide("hits", "n"), 6))


@query
def box_labels(s, d):
    p = T.load(s, d, "part").select("p_partkey", (F.col("p_partkey") % 300).alias("x0"), (F.col("p_partkey") % 200).alias("y0"), (F.col("p_partkey") % 300 + F.col("p_size")).alias("x1"), (F.col("p_partkey") % 200 + 2 * F.col("p_size")).alias("y1"))
    box = [(F.col("x0") + F.col("x1")) / 1200, (F.col("y0") + F.col("y1")) / 1200, (F.col("x1") - F.col("x0")) / 600, (F.col("y1") - F.col("y0")) / 600]
    return p.select("p_partkey", F.format_string("0 %.6f %.6f %.6f %.6f", *box).alias("label"))


@query
def name_exclude(s, d):
    bad = F.array(F.lit("PROMO"), F.lit("STANDARD"), F.lit("econ"))
    return T.load(s, d, "part").filter(~F.exists(bad, lambda b: F.contains(F.lower("p_type"), F.lower(b)))).select("p_partkey", "p_type")


@query
def pending_tiles(s, d):
    return manifest.pending(T.tiles(s, d), T.status_log(s, d), "layer1")


@query
def latest_status(s, d):
    return manifest.latest_status(T.status_log(s, d))


@query
def progress_summary(s, d):
    return manifest.progress_summary(T.tiles(s, d), T.status_log(s, d))


@query
def add_tiles(s, d):
    t = T.tiles(s, d)
    new = t.withColumn("tile_id", F.col("tile_id") * 2).withColumn("name", F.concat(F.lit("new_"), "tile_id"))
    return t.unionByName(manifest.add_tiles(t, new))


def _keys(s, d):
    c = T.candidates(s, d)
    key = manifest.candidate_key(F.col("layer"), -6 + F.col("x") / 10000, 37 + F.col("y") / 10000)
    return c.select("id", key.alias("key"))


@query
def candidate_key(s, d):
    return _keys(s, d)


@query
def resume_anti_join(s, d):
    k = _keys(s, d)
    return manifest.remaining(k, k.filter("id % 3 = 0"))


@query
def resume_limit(s, d):
    k = _keys(s, d)
    return manifest.remaining(k, k.filter("id % 3 = 0"), limit=50)


@query
def worst_case_probe(s, d):
    return manifest.worst_case(T.load(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


@query
def chunk_assign(s, d):
    return manifest.chunk_assign(T.load(s, d, "customer").select("c_custkey"), "c_custkey", 15)


@query
def first_detection(s, d):
    e = T.load(s, d, "events").select("user_id", "event_type", "event_id", "value")
    return first_per_key(e, ["user_id", "event_type"], [F.col("value").desc(), F.col("event_id")])


@query
def reindex_output(s, d):
    return fusion.reindex(T.candidates(s, d).select("confidence", F.col("layer").alias("layers"), F.col("source_ref").alias("source_refs")))


@query
def precision_recall(s, d):
    r = T.registry(s, d)
    return fusion.precision_recall(T.candidates(s, d), r, r.filter("source = 'A'").select("source_id"))


@query
def removed_barriers(s, d):
    return fusion.removed_barriers(T.registry(s, d), T.candidates(s, d))


@query
def project_grid(s, d):
    c = T.load(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 500 / 100 - 8).alias("lon"), (F.col("c_custkey") % 300 / 100 + 36).alias("lat"))
    x, y = project(F.col("lon"), F.col("lat"))
    return c.select("c_custkey", F.round(x, 2).alias("x_m"), F.round(y, 2).alias("y_m"))


@query
def terrain_steps(s, d):
    li = T.load(s, d, "lineitem")
    cells = li.select((F.col("l_suppkey") % 4).alias("tile_id"), (F.col("l_partkey") % 40).alias("row"), (F.col("l_orderkey") % 40).alias("col"), "l_quantity")
    dem = cells.groupBy("tile_id", "row", "col").agg((F.avg("l_quantity") / 1e5 + 200 - 0.001 * F.col("row") - F.greatest(F.col("row") - 19, F.lit(0))).alias("elev"))
    return raster.terrain_steps(dem, accum=10)


@query
def clean_mask(s, d):
    return raster.clean_mask(_ndwi(s, d).filter("ndwi > -0.1"), 200, 100)


@query
def prefix_match(s, d):
    o = T.load(s, d, "orders").select(F.concat(F.lit("tile_"), "o_custkey", F.lit("_"), "o_orderkey").alias("name"))
    return manifest.match_by_prefix(o, T.tiles(s, d).filter("tile_id % 3 > 0").select(F.col("name").alias("stem")))


@query
def spot_check(s, d):
    m = closest_match(T.candidates(s, d), T.registry(s, d), K.MATCH_TOLERANCE)
    return reg.spot_check(m.select("id", "match_status"), "id", "match_status", 20)


@query
def near_centre_box(s, d):
    return raster.near_centre_box(raster.mask_components(_ndwi(s, d).filter("ndwi > 0.35")), 200, 100, least=3)


def _triangles(s, d):
    k, x, y = F.col("p_partkey"), F.col("x"), F.col("y")
    p = T.load(s, d, "part").select("p_partkey", "p_size", *T.place(k, T.DENSE))
    ends = [x, y, x + 3 * F.col("p_size"), y + k % 7, x - k % 11, y + 2 * F.col("p_size"), x, y]
    return p.select("p_partkey", wkt_vertices(F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d))", *ends)).alias("ring"))


@query
def polygon_measures(s, d):
    t = _triangles(s, d).select("p_partkey", F.round(ring_area(F.col("ring")), 3).alias("area"), ring_centroid(F.col("ring")).alias("c"), extent(F.col("ring")).alias("e"))
    return t.select("p_partkey", "area", F.round("c.x", 3).alias("x"), F.round("c.y", 3).alias("y"), "e.x0", "e.y0", "e.x1", "e.y1")


@query
def centroid_within(s, d):
    c = _triangles(s, d).select("p_partkey", ring_centroid(F.col("ring")).alias("c")).select("p_partkey", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))
    return c.filter(reg.in_ring("x", "y", T.RING)).select("p_partkey")


@query
def imagery_window(s, d):
    day = F.col("o_orderdate").cast("date")
    o = T.load(s, d, "orders").filter((day >= F.lit("1995-01-01").cast("date")) & (day < F.lit("1997-01-01").cast("date")) & (F.col("o_orderkey") % 100 < 20))
    return o.withColumn("cell", F.col("o_custkey") % 50).groupBy("cell").agg(F.count("*").alias("images"), F.round(F.median("o_totalprice"), 3).alias("composite"))


@query
def geojson_features(s, d):
    c = T.candidates(s, d).select("id", "layer", F.when(F.col("id") % 2 == 0, F.col("x")).alias("lon"), F.format_string('{"type":"Point","coordinates":[%d,%d]}', "x", "y").alias("g"))
    f = files.from_features(files.feature_collection(c, "g", "id"), "id long, layer string, lon long")
    at = F.from_json("coordinates", "array<long>")
    return f.select("id", "layer", "geometry_type", F.coalesce("lon", at[0]).alias("lon"), at[1].alias("lat"))


@query
def unproject_grid(s, d):
    c = T.load(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 700 * 1000 + 100000.0).alias("x"), (F.col("c_custkey") % 400 * 1000 + 4000000.0).alias("y"))
    lon, lat = unproject(F.col("x"), F.col("y"))
    return c.select("c_custkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query
def resume_terminal(s, d):
    k = _keys(s, d)
    status = F.element_at(F.array(*map(F.lit, ("OK", "NO_COVERAGE", "mask_error", "ERROR"))), (F.col("id") % 4 + 1).cast("int"))
    return manifest.remaining(k, manifest.terminal(k.filter("id % 3 = 0").withColumn("status", status)))
