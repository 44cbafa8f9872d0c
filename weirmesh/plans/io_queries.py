"""Queries of the sources and sinks: a table of the driver's is written, read back and reported."""

from __future__ import annotations

import os
import sqlite3
import struct
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmesh import constants as K
from weirmesh.functions.geodesy import line_centroid, polygon_centroid, wkt_vertices
from weirmesh.operators import fusion, grids, manifest, raster
from weirmesh.plans import tables as T
from weirmesh.plans.catalogue import query
from weirmesh.plans.staging import new_path, track
from weirmesh.sources import connectors, files


def _path(s: SparkSession, name: str) -> str:
    return track(new_path(s, name))


def _file(s: SparkSession, name: str, suffix: str) -> str:
    """A path in the shared folder, which must be one that every machine has mounted."""
    path = track(new_path(s, name) + suffix)
    local = urllib.parse.urlparse(path).path
    os.makedirs(os.path.dirname(local), exist_ok=True)
    return local


def _customers(s: SparkSession, d: str) -> DataFrame:
    return T.load(s, d, "customer").select("c_custkey", "c_name", F.concat(F.lit('a "b", é\\'), "c_mktsegment").alias("note"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"), "c_acctbal")


@query
def csv_round_trip(s, d):
    p = _path(s, "csv")
    files.write_csv(_customers(s, d), p)
    return files.read_csv(s, p, "c_custkey long, c_name string, note string, nation int, c_acctbal double")


@query
def json_array_round_trip(s, d):
    p = _path(s, "array")
    files.write_json_array(_customers(s, d), p)
    return files.read_json_array(s, p, "c_custkey long, c_name string, note string, nation int, c_acctbal double")


@query
def jsonl_append_once(s, d):
    """Two overlapping runs; each key stands there once."""
    p, c = _path(s, "jsonl"), _customers(s, d)
    files.append_jsonl(c.filter("c_custkey % 3 > 0"), p, "c_custkey")
    files.append_jsonl(c.filter("c_custkey % 3 < 2"), p, "c_custkey")
    return files.read_jsonl(s, p, "c_custkey long, note string, nation int")


@query
def jsonl_lonlat(s, d):
    p = _path(s, "lonlat")
    c = T.load(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 700 * 1000 + 100000.0).alias("x"), (F.col("c_custkey") % 400 * 1000 + 4000000.0).alias("y"), F.lit(1).alias("helper"))
    files.write_jsonl_lonlat(c, p, ("helper",))
    r = files.read_jsonl(s, p, "c_custkey long, lon double, lat double, x double, helper int").filter("x is null and helper is null")
    return r.select("c_custkey", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query
def missing_as_empty(s, d):
    none = files.read_jsonl(s, _path(s, "never-written"), "c_custkey long, c_name string", missing_ok=True)
    return none.unionByName(T.load(s, d, "customer").select("c_custkey", "c_name"))


@query
def geojson_round_trip(s, d):
    """Two collections' folders, read by a glob."""
    p = _path(s, "geojson")
    c = T.load(s, d, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 2).alias("half"), F.format_string('{"type":"Point","coordinates":[%d,%d]}', F.col("c_custkey") % 90, F.col("c_nationkey")).alias("g"))
    for k in (0, 1):
        files.write_geojson(c.filter(F.col("half") == k).drop("half"), f"{p}/part_{k}", "g")
    r = files.read_geojson(s, f"{p}/part_*", "c_custkey long, c_name string")
    at = F.from_json("coordinates", "array<long>")
    return r.select("c_custkey", "c_name", "geometry_type", at[0].alias("lon"), at[1].alias("lat"))


@query
def layer_round_trip(s, d):
    """Two layers of WKT; the first by name is the default."""
    p = _path(s, "layers")
    c = T.load(s, d, "customer")
    files.write_layer(c.select("c_custkey", F.format_string("POINT (%d %d)", "c_custkey", "c_nationkey").alias("wkt")), p, "points")
    files.write_layer(c.select("c_custkey", F.format_string("LINESTRING (%d 0, %d 5)", "c_custkey", "c_nationkey").alias("wkt")), p, "lines")
    rows = files.read_layer(s, p).select(F.lit("lines").alias("layer"), "*").unionByName(files.read_layer(s, p, "points").select(F.lit("points").alias("layer"), "*"))
    v = wkt_vertices(F.col("wkt"))
    return rows.select("layer", "c_custkey", F.size(v).alias("vertices"), F.get(v, F.lit(0))["x"].alias("x"))


@query
def chunk_checkpoints(s, d):
    """Chunks written, and one of them again; the listing says which chunks are there."""
    p, c = _path(s, "chunks"), manifest.chunk_assign(T.load(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 40)
    files.write_chunks(c, p)
    files.write_chunks(c.filter("chunk = 1").withColumn("c_nationkey", F.col("c_nationkey") + 100), p)
    there = files.file_listing(s, p, "*.parquet").select(F.regexp_extract("path", r"chunk=(\d+)", 1).cast("long").alias("chunk")).distinct()
    return s.read.parquet(p).withColumn("chunk", F.col("chunk").cast("long")).join(there, "chunk", "left_semi").select("chunk", "c_custkey", "c_nationkey")


@query
def mosaic_round_trip(s, d):
    p = _path(s, "mosaic")
    files.write_mosaic(T.water_cells(s, d).groupBy((F.col("row") % 7).alias("tile"), "row", "col").agg(F.count("*").alias("n")), p)
    return s.read.parquet(p).filter("tile = 3").select("row", "col", "n")


def _nations(s: SparkSession, d: str) -> list[tuple]:
    return [tuple(r) for r in T.load(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]  # a fixed table of nations


@query
def gpkg_round_trip(s, d):
    """A file with two layers; one by name, the first by default. The folder must be one that executors can open."""
    path = _file(s, "gpkg", ".gpkg")
    wkb = lambda x, y: b"GP\0\1\0\0\0\0" + struct.pack("<BIdd", 1, 1, x, y)
    db = sqlite3.connect(path)
    db.execute("create table gpkg_contents (table_name text, data_type text)")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    for layer, shift in (("places", 0), ("moved", 1000)):
        db.execute("insert into gpkg_contents values (?, 'features')", (layer,))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom')", (layer,))
        db.execute(f"create table {layer} (fid integer primary key, geom blob, n_name text)")
        db.executemany(f"insert into {layer} values (?, ?, ?)", [(k + 1, wkb(k + shift, r), n) for k, n, r in _nations(s, d)])
    db.commit()
    db.close()
    connectors.register(s)
    read = lambda **o: s.read.format("weirmesh_gpkg").options(path=path, columns="n_name string", rows_per_partition="10", **o).load()
    both = read().select(F.lit("places").alias("layer"), "*").unionByName(read(layer="moved").select(F.lit("moved").alias("layer"), "*"))
    v = F.get("vertices", F.lit(0))
    return both.select("layer", "fid", "n_name", "geometry_type", v["x"].alias("x"), v["y"].alias("y"))


@query
def shapefile_round_trip(s, d):
    path = _file(s, "shp", ".shp")
    with open(path, "wb") as f:
        f.write(bytes(100))
        for k, _, r in _nations(s, d):
            f.write(struct.pack(">ii", k + 1, 10) + struct.pack("<idd", 1, k, r))
    connectors.register(s)
    v = F.get("vertices", F.lit(0))
    return s.read.format("weirmesh_shp").options(path=path).load().select("record", "shape_type", v["x"].alias("x"), v["y"].alias("y"))


@query
def output_files(s, d):
    """Rows of both result files, by status."""
    every, review = fusion.write_outputs(fusion.fuse_match_classify(T.candidates(s, d), T.registry(s, d)), _path(s, "outputs"))
    read = lambda p, more: files.read_csv(s, p, ", ".join(f"{c} string" for c in (*K.OUTPUT_COLUMNS, *more)))
    rows = read(every, ()).select(F.lit("pilot").alias("file"), "match_status").unionByName(read(review, ("ee_thumbnail_url",)).select(F.lit("review").alias("file"), "match_status"))
    return rows.groupBy("file", "match_status").agg(F.count("*").alias("n"))


@query
def water_signature_points(s, d):
    raw = T.candidates(s, d).select("id", F.col("source_ref").alias("tile_id"), F.col("confidence").alias("water_frac"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"), "x", "y")
    r = fusion.load_candidates({"layer3_water_signature": raw}, T.segments(s, d))
    return r.select("layer", "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "confidence", "source_ref")


@query
def anomalous_widening(s, d):
    seg = T.segments(s, d)
    blob = seg.select(F.col("line_id").alias("id"), (F.col("x1") - F.col("line_id") % 40).alias("bx"), (F.col("y1") - 10 + 20 * (F.col("line_id") % 3)).alias("by"))
    step = lambda: F.explode(F.sequence(F.lit(0), F.lit(29)))
    sub = blob.select("*", step().alias("i")).select("*", step().alias("j")).select("id", (F.col("bx") + F.col("i")).alias("x"), (F.col("by") + F.col("j")).alias("y"))
    more = seg.select("line_id", (F.col("x1") + 25).alias("x1"), "y1", (F.col("x2") + 25).alias("x2"), "y2")
    return raster.anomalous_widening(sub, raster.with_half_width(seg, more))


@query
def snapped_tiles(s, d):
    return grids.snapped_tiles(T.segments(s, d), size=500, buffer=200, name="pilot").select("tile_id", "x0", "y0")


@query
def clip_lines_to_ring(s, d):
    s_ = T.segments(s, d, T.DENSE).filter("line_id % 2 = 0").drop("strahler")
    c = grids.clip_lines_to_ring(s_, T.RING)
    return c.groupBy("line_id").agg(F.count("*").alias("parts"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 2).alias("length"))


@query
def centroids(s, d):
    """Lines of two parts, and squares with a square hole."""
    p = T.load(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("n"), (F.col("p_partkey") % 50).cast("double").alias("k"))
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    o = F.lit(0.0)
    lines = F.array(F.array(v(o, o), v(F.col("n"), o), v(F.col("n"), F.col("k"))), F.array(v(o, F.lit(10.0)), v(o, F.lit(12.0))))
    ring = lambda a, w: F.array(v(a, a), v(a + w, a), v(a + w, a + w), v(a, a + w), v(a, a))
    square = F.array(F.array(ring(o, F.col("n") + 4), ring(o + 1, F.lit(2.0))), F.array(ring(F.col("k") + 100, F.lit(3.0))))
    r = p.select("p_partkey", line_centroid(lines).alias("l"), polygon_centroid(square).alias("q"))
    return r.select("p_partkey", F.round("l.x", 5).alias("line_x"), F.round("l.y", 5).alias("line_y"), F.round("q.x", 5).alias("area_x"), F.round("q.y", 5).alias("area_y"))


@query
def pixel_positions(s, d):
    p = T.load(s, d, "part").select("p_partkey", (F.col("p_partkey") % 300).alias("row"), F.col("p_size").alias("col"))
    x, y = raster.pixel_to_map(F.col("row"), F.col("col"), raster.north_up(287000, 4164500, 0.5))
    return p.select("p_partkey", x.alias("x"), y.alias("y"))


@query
def colour_mask(s, d):
    p = T.load(s, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 256).alias("blue"), (F.col("p_partkey") * 13 % 256).alias("green"), (F.col("p_size") * 5).alias("red"))
    return raster.in_colour_range(p).select("p_partkey")


@query
def nodata_cells(s, d):
    c = T.water_cells(s, d).groupBy("row", "col").agg(F.max("green").alias("elev"))
    return raster.without_nodata(c, 50.0).agg(F.count("*").alias("cells"), F.count("elev").alias("valid"))


@query
def key_helpers(s, d):
    """Namespaced keys, file names and stems, last lines, exclusion and error answers."""
    c = T.load(s, d, "customer").filter("c_custkey <> 7")
    key = manifest.namespaced(F.lit("es"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.concat(F.lit("tile_"), "c_custkey"))
    name = files.file_name(key, ".png")
    report = F.concat(F.lit("ok\n"), F.col("c_name"), F.lit("\n\n"))
    answer = F.when(F.col("c_custkey") % 5 == 0, F.lit("<ows:ExceptionReport/>")).otherwise(F.concat(F.repeat(F.lit("x"), 500), F.lit("Exception"))).cast("binary")
    return manifest.excluding(c, "c_custkey", 9).select("c_custkey", key.alias("key"), files.file_stem(name).alias("stem"), files.file_stem(name, "_x.png").alias("name"), files.last_line(report, 12).alias("line"), files.is_exception(answer).alias("failed"))


@query
def outcome_counts(s, d):
    o = T.load(s, d, "orders").select(F.element_at(F.array(*map(F.lit, ("OK", "NO_COVERAGE", "ERROR: x"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"))
    return manifest.outcome_counts(o)


@query
def status_log_appended(s, d):
    """A log created empty, then a status for every tile of a stage."""
    p = _path(s, "log")
    manifest.init_manifest(s, p)
    for seq, status in enumerate(("failed", "done")):
        manifest.set_status(T.tiles(s, d).filter(F.col("tile_id") % (seq + 1) == 0), "layer2", status, F.lit(seq).cast("long")).write.mode("append").parquet(p)
    return manifest.latest_status(manifest.init_manifest(s, p))
