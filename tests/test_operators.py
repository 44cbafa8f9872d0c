"""Hand-computed cases and properties."""

import http.server
import json
import math
import random
import re
import sqlite3
import struct
import threading
import time
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirmesh.functions import geodesy
from weirmesh.operators import components, fusion, manifest, proximity, raster, registry
from weirmesh.operators.components import connected_components
from weirmesh.operators.proximity import closest_match, near_line, neighbour_pairs, segment_cells, snap_to_line, within_distance
from weirmesh.operators.raster import excess_area
from weirmesh.operators.suppression import greedy_suppress
from weirmesh.plans.tables import SPARSE, place
from weirmesh.sources import connectors, files
from weirmesh.sources.connectors import register
from weirmesh.streaming.incremental import confirm_stream

POINTS = "id long, layer string, x long, y long, confidence double, source_ref string"


def points(spark, xs):
    return spark.createDataFrame([(i, "L1", x, 0, 0.5, f"r{i}") for i, x in enumerate(xs)], POINTS)


def test_chain_is_thinned_but_clustered(spark):
    p = points(spark, [0, 40, 80])
    assert {r.id for r in greedy_suppress(p, [F.col("id")], 50).collect()} == {0, 2}
    assert {r.cluster for r in fusion.cluster(p).collect()} == {0}


def test_fifty_metres_apart(spark):
    p = points(spark, [0, 50])
    assert greedy_suppress(p, [F.col("id")], 50).count() == 2
    assert fusion.fuse(p).count() == 1


def test_suppression_is_independent_and_maximal(spark):
    r = random.Random(3)
    p = spark.createDataFrame([(i, "L", r.randrange(800), r.randrange(800), r.random(), "") for i in range(400)], POINTS)
    every = {x.id: x for x in p.collect()}
    kept = {x.id for x in greedy_suppress(p, [-F.col("confidence"), F.col("id")], 50).collect()}
    fold = []
    for x in sorted(every.values(), key=lambda x: (-x.confidence, x.id)):
        if all((x.x - k.x) ** 2 + (x.y - k.y) ** 2 >= 2500 for k in fold):
            fold.append(x)
    assert kept == {x.id for x in fold}


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(120), r.randrange(120)) for _ in range(60)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Each round's plans stay with the driver, whose memory the pipeline outgrew."""
    edges = spark.range(300).selectExpr("id * 5 % 301 as a", "(id + 1) * 5 % 301 as b")
    staged, got, stage = [], [], components.stage_table
    monkeypatch.setattr(components, "stage_table", lambda df, name: staged.append(name) or stage(df, name))
    for limit in (components.LOCAL_EDGES, 300, 299, 0):
        monkeypatch.setattr(components, "LOCAL_EDGES", limit)
        got.append((sorted(map(tuple, connected_components(edges).collect())), len(staged)))
        staged.clear()
    assert all(rows == [(i, 0) for i in range(301)] for rows, _ in got)
    assert got[0][1] == got[1][1] == 2 < got[2][1]
    assert connected_components(edges.limit(0)).collect() == []


def test_closest_match(spark):
    left = spark.createDataFrame([(0, 0, 0), (1, 100, 0), (2, None, 0)], "id long, x long, y long")
    right = spark.createDataFrame([("B", "b", 10, 0), ("A", "a", 20, 0), ("A", "c", 131, 0), ("A", "d", -10, 0)], "source string, source_id string, x long, y long")
    got = {r.id: r for r in closest_match(left, right, 30).collect()}
    assert (got[0].match_status, got[0].matched_source_id, got[0].matched_distance_m) == ("known", "d", 10.0)
    assert got[1].match_status == "new" and got[2].match_status == "new"


def test_fused_record(spark):
    rows = [(0, "L1", 0, 0, 0.12345, "b"), (1, "L1", 0, 0, 0.5, "a"), (2, "L3", 30, 0, 0.9, "a")]
    r = fusion.fuse(spark.createDataFrame(rows, POINTS)).first()
    assert (r.x, r.layers, r.n_layers, r.confidence, r.source_refs) == (15.0, "L1;L3", 2, 0.9, "a;b")
    assert r.per_layer_confidence == '{"L1":0.5000,"L3":0.9000}'
    assert fusion.fuse(spark.createDataFrame([], POINTS)).columns == fusion.fuse(spark.createDataFrame(rows, POINTS)).columns


def test_classes(spark):
    df = spark.createDataFrame([(1, 0.85), (1, 0.8499), (2, 0.1)], "n int, c double")
    assert [r[0] for r in df.select(fusion.classify(F.col("n"), F.col("c"))).collect()] == ["new-confirmed", "new-uncertain", "new-confirmed"]


def test_falsy_and_priority(spark):
    r = spark.range(1).select(registry.falsy_or(F.lit(0.0), F.lit(5.0)), registry.priority(F.lit("X"), {"A": 1})).first()
    assert tuple(r) == (5.0, None)


def test_pairs_equal_brute_force(spark):
    r = random.Random(1)
    pts = [(i, r.randrange(-300, 300), r.randrange(-300, 300)) for i in range(150)]
    got = {(x.a, x.b) for x in neighbour_pairs(spark.createDataFrame(pts, "id long, x long, y long"), 50).collect()}
    assert got == {(a, b) for a, ax, ay in pts for b, bx, by in pts if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= 2500}


@pytest.mark.parametrize(("n", "expected"), [(13, []), (14, [6, 7])])
def test_step_profile(spark, n, expected):
    rows = [(0, i, 100.0 if i <= 6 else 100.0 - (i - 6)) for i in range(n)]
    p = raster.step_profile(spark.createDataFrame(rows, "path long, i long, e double"), "path", ["i"], "e")
    got = sorted(r.pos for r in p.collect())
    assert set(got) <= set(expected) and bool(got) == bool(expected)


def test_manifest(spark):
    tiles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "tile_id string")
    log = spark.createDataFrame([("a", "layer1", "done", 1), ("b", "layer1", "done", 1), ("b", "layer1", "failed", 2), ("c", "layer1", "pending", 1)], "tile_id string, stage string, status string, seq long")
    assert {r.tile_id for r in manifest.pending(tiles, log, "layer1").collect()} == {"b", "c", "d"}
    assert manifest.progress_summary(tiles, log).first().layer1 == "1/4"
    with pytest.raises(ValueError, match="stage"):
        manifest.pending(tiles, log, "layer9")
    assert manifest.add_tiles(tiles, tiles).count() == 0


def test_failed_rows_are_retried_alone(spark):
    def scorer(pdf):
        if (pdf["key"] == "bad").any():
            raise ValueError
        return pdf[["key"]].assign(score=1.0)

    work = spark.createDataFrame([("a",), ("bad",), ("c",)], "key string")
    got = {r.key: r.status for r in manifest.score_resumably(work, scorer, "key string, score double, status string", backoff=0.0).collect()}
    assert got["a"] == got["c"] == "OK" and got["bad"].startswith("ERROR: ")


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-5.41, 37.60), (-3.0, 38.2), (-7.9, 36.1)], "lon double, lat double")
    x, y = geodesy.project(F.col("lon"), F.col("lat"))
    r = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geodesy.unproject(F.col("x"), F.col("y"))
    for row in r.select("lon", "lat", lon.alias("a"), lat.alias("b"), "x", "y").collect():
        assert abs(row.lon - row.a) < 1e-8 and abs(row.lat - row.b) < 1e-8
    assert abs(r.first().x - 287248) < 5 and abs(r.first().y - 4164167) < 5


def test_terrain_kernels():
    dem = np.array([[9, 9, 9, 9], [9, 2, 3, 9], [9, 9, 4, 9], [9, 9, 5, 9]], float)
    filled = raster.fill_depressions(dem)
    assert filled[1, 1] == 5 and filled[3, 2] == 5
    slope = np.add.outer(np.arange(5, 0, -1.0) * 10, np.abs(np.arange(-2, 3)))
    assert raster.flow_accumulation(slope)[-1, 2] == 25


def test_geopackage_and_shapefile(spark, tmp_path):
    register(spark)
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.executescript("create table gpkg_contents(table_name, data_type); create table gpkg_geometry_columns(table_name, column_name); create table r(fid integer primary key, geom blob, name text);"
                     "insert into gpkg_contents values('r', 'features'); insert into gpkg_geometry_columns values('r', 'geom');")  # fmt: skip
    wkb = struct.pack("<BIIdddd", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)
    db.execute("insert into r values(7, ?, 'x')", (b"GP\x00\x01" + struct.pack("<i", 4326) + wkb,))
    db.commit()
    r = spark.read.format("weirmesh_gpkg").option("columns", "name string").load(str(tmp_path / "a.gpkg")).first()
    assert (r.fid, r.geometry_type, r.name, [tuple(v) for v in r.vertices]) == (7, "LineString", "x", [(1.0, 2.0), (3.0, 4.0)])
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, 10) + struct.pack("<idd", 1, 5.0, 6.0))
    r = spark.read.format("weirmesh_shp").load(str(tmp_path / "a.shp")).first()
    assert tuple(r.vertices[0]) == (5.0, 6.0)


def test_stream_scores_each_key_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    score = lambda df: df.withColumn("s", F.length("key"))
    for batch in ([("a",), ("b",), ("a",)], [("b",), ("c",)]):
        spark.createDataFrame(batch, "key string").coalesce(1).write.mode("append").json(src)
        confirm_stream(spark, src, "key string", out, cp, score)
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_box_of_the_largest_blob_near_the_centre(spark):
    def blob(r0, r1, c0, c1):
        return [(r, c) for r in range(r0, r1) for c in range(c0, c1)]

    def box(cells):
        found = raster.near_centre_box(raster.mask_components(spark.createDataFrame(cells, "row long, col long")), 100, 100).collect()
        return [tuple(r) for r in found]

    near, far, small = blob(40, 65, 30, 50), blob(0, 30, 0, 30), blob(70, 80, 60, 70)
    assert box(near + far + small) == [(30, 40, 50, 65, 500)]
    assert box(far + small) == []
    assert box(blob(2, 98, 2, 98)) == []  # nearly the whole frame


def test_only_terminal_states_are_left_alone(spark):
    work = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    log = spark.createDataFrame([("a", "OK"), ("b", "NO_COVERAGE"), ("c", "mask_error"), ("d", "ERROR"), (None, "OK")], "key string, status string")
    assert {r["key"] for r in manifest.remaining(work, manifest.terminal(log)).collect()} == {"d", "e"}


def test_chunks_hold_rows_without_a_key_too(spark):
    rows = spark.createDataFrame([(None,), ("a",), (None,), ("b",), ("c",)], "key string")
    assert sorted(r["n"] for r in manifest.chunk_assign(rows, "key", 2).groupBy("chunk").count().withColumnRenamed("count", "n").collect()) == [1, 2, 2]


def test_features_there_and_back(spark):
    rows = spark.createDataFrame([(1, 'a "quoted" name', '{"type":"Point","coordinates":[1,2.5]}'), (2, None, '{"type":"LineString","coordinates":[[0,0],[1,1]]}')], "id long, name string, g string")
    lines = files.feature_collection(rows, "g", "id").select("feature").union(spark.createDataFrame([("no feature",)], "feature string"))
    got = [tuple(r) for r in files.from_features(lines, "id long, name string").collect()]
    assert got == [(1, 'a "quoted" name', "Point", "[1,2.5]"), (2, None, "LineString", "[[0,0],[1,1]]"), (None, None, None, None)]


def test_measures_of_rings(spark):
    wkt = ["POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", "POLYGON ((1 1, 2 2, 1 1))", "POLYGON EMPTY", None]
    df = spark.createDataFrame([(w,) for w in wkt], "w string").select(geodesy.wkt_vertices(F.col("w")).alias("v"))
    got = df.select(geodesy.ring_area(F.col("v")).alias("a"), geodesy.ring_centroid(F.col("v")).alias("c"), geodesy.extent(F.col("v")).alias("e")).collect()
    assert [r["a"] for r in got] == [8.0, 0.0, 0.0, None]
    assert tuple(got[0]["c"]) == (2.0, 1.0) and tuple(got[0]["e"]) == (0.0, 0.0, 4.0, 2.0)
    assert got[1]["c"]["x"] is None and tuple(got[2]["e"]) == (None,) * 4


def test_snapping_has_no_radius(spark):
    lines = spark.createDataFrame([(1, 0, 0, 100, 0), (2, 0, 50, 100, 50)], "line_id long, x1 long, y1 long, x2 long, y2 long")
    pts = spark.createDataFrame([(1, 10, 5), (2, 10, 30), (3, 10, 25), (4, 9000, -7000), (5, None, 3)], "id long, x long, y long")
    got = {r["id"]: (r["line_id"], r["snap_x"], r["snap_y"]) for r in snap_to_line(pts, lines, cell_size=8).collect()}
    assert got == {1: (1, 10.0, 0.0), 2: (2, 10.0, 50.0), 3: (1, 10.0, 0.0), 4: (1, 100.0, 0.0)}
    assert snap_to_line(pts, lines.limit(0)).count() == 0


def test_snapping_among_crowded_lines_starts_narrow(spark, monkeypatch):
    rng, sizes, cells = random.Random(5), [], proximity.segment_cells
    lines = [(i, *(rng.randrange(2000) for _ in range(2))) for i in range(700)]
    lines = [(i, x, y, x + rng.randrange(-90, 90), y + rng.randrange(-90, 90)) for i, x, y in lines]
    pts = [(i, rng.randrange(2000), rng.randrange(2000)) for i in range(9000)] + [(9000, 3000, -1000)]
    monkeypatch.setattr(proximity, "segment_cells", lambda s, size, reach: sizes.append(size) or cells(s, size, reach))
    ends = "line_id long, x1 long, y1 long, x2 long, y2 long"
    got = snap_to_line(spark.createDataFrame(pts, "id long, x long, y long"), spark.createDataFrame(lines, ends)).collect()
    n, x1, y1, x2, y2 = np.array(lines, float).T
    want = {}
    for i, x, y in pts:
        t = np.clip(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / np.maximum((x2 - x1) ** 2 + (y2 - y1) ** 2, 1), 0, 1)
        d2 = np.round((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2, 6)
        k = int(d2.argmin())
        want[i] = (int(n[k]), round(x1[k] + t[k] * (x2[k] - x1[k]), 3), round(y1[k] + t[k] * (y2[k] - y1[k]), 3))
    assert {r["id"]: (r["line_id"], round(r["snap_x"], 3), round(r["snap_y"], 3)) for r in got} == want
    assert sizes[0] < 500 and sizes[1:] == [4 * a for a in sizes[:-1]]


def test_snapping_sees_ties_across_a_ring(spark):
    """Both lines are as near as the ring is wide, after rounding; the smaller id wins, though it is a hair farther."""
    lines = spark.createDataFrame([(9, -50.0, 8.0, 50.0, 8.0), (3, 8.00000001, -50.0, 8.00000001, 50.0)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    got = snap_to_line(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), lines, cell_size=8).collect()
    assert [r["line_id"] for r in got] == [3]


class Pages(http.server.BaseHTTPRequestHandler):
    """Three layers of 25, 250 and 0 features; the first call of each page of layer b fails, and its
    pages are shorter than asked for."""

    seen: set = set()

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        n, start, count = {"a": 25, "b": 250, "c": 0}[q["layer"]], int(q["start"]), int(q["count"])
        if q["layer"] == "b" and self.path not in self.seen:
            self.seen.add(self.path)
            self.send_error(503)
            return
        most = min(count, 40) if q["layer"] == "b" else count
        found = [{"id": i} for i in range(start, min(start + most, n))]
        self.answer({"features": found} | ({"exceededTransferLimit": start + len(found) < n} if q["layer"] == "b" else {}))

    def do_POST(self):
        asked = self.rfile.read(int(self.headers["Content-Length"])).decode()
        assert 'node["waterway"="weir"](1,2,3,4);' in asked and "out center" in asked
        self.answer({"elements": [{"type": "node", "id": 1, "lat": 0.0, "lon": 5.5, "center": {"lat": 7.0, "lon": 1.0}, "tags": {"a": "b"}}, {"type": "way", "id": 2, "center": {"lat": 1.5, "lon": 2.5}}, {"type": "way", "id": 3}]})

    def answer(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_are_read_to_the_end(spark, service):
    connectors.register(spark)
    url = service + "/q?layer={layer}&start={start}&count={count}&bbox={bbox}"
    got = spark.read.format("weirmesh_paged").options(url=url, layers="a,b,c", page="100", delay="0", backoff="0.01").load().collect()
    ids = {k: sorted(json.loads(r.feature)["id"] for r in got if r.layer == k) for k in "abc"}
    assert ids == {"a": list(range(25)), "b": list(range(250)), "c": []}


def test_overpass_answers(spark, service):
    connectors.register(spark)
    e = spark.read.format("weirmesh_overpass").options(url=service, bboxes="1,2,3,4").load()
    got = sorted((r.source_id, r.lat, r.lon, r.raw_attributes) for r in connectors.overpass_records(e).collect())
    assert got == [("node/1", 7.0, 5.5, '{"a":"b"}'), ("way/2", 1.5, 2.5, "{}")]


def plain_steps(dem, accum, steps=200):
    """The same rules cell by cell, on an already filled surface."""
    rows, cols = len(dem), len(dem[0])
    inside = lambda r, c: 0 <= r < rows and 0 <= c < cols

    def down(r, c):
        best, where = -math.inf, None
        for a, b in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):
            if inside(r + a, c + b):
                drop = (dem[r][c] - dem[r + a][c + b]) / math.sqrt(a * a + b * b)
                if drop > best:
                    best, where = drop, (r + a, c + b)
        return where

    acc = {(r, c): 1 for r in range(rows) for c in range(cols)}
    for r, c in sorted(acc, key=lambda p: (-dem[p[0]][p[1]], p)):
        to = down(r, c)
        if dem[to[0]][to[1]] < dem[r][c]:
            acc[to] += acc[r, c]
    seen, found = set(), []
    for p in sorted(acc):
        if acc[p] <= accum or p in seen:
            continue
        path = [p]
        while len(path) <= steps and acc[down(*path[-1])] > accum:
            path.append(down(*path[-1]))
        seen.update(path)
        e = [dem[r][c] for r, c in path]
        for i in range(6, len(e) - 6) if len(e) >= 14 else ():
            up, low = abs(e[i - 6] - e[i - 1]) / 6, abs(e[i] - e[i + 5]) / 6
            if up < 0.015 and low > 0.05 and low > 3 * max(up, 1e-6):
                found.append((*path[i], round(up, 4), round(low, 4), acc[path[i]]))
    return found


def valley(rows=9, cols=60):
    """A channel along the middle that drops by two metres at column 30."""
    return [[100 + 2 * abs(r - rows // 2) - 0.001 * c - (2 if c >= 30 else 0) - 0.2 * max(0, min(c - 30, 10)) for c in range(cols)] for r in range(rows)]


def test_steps_equal_brute_force(spark):
    dem = valley()
    want = plain_steps(dem, 20)
    assert want and raster.analyze_tile(np.array(dem), 20) == want
    cells = spark.createDataFrame([(7, r, c, v) for r, row in enumerate(dem) for c, v in enumerate(row)] + [(8, 0, 0, None), (9, None, 1, 2.0)], "tile_id int, row int, col int, elev double")
    got = sorted(tuple(r) for r in raster.terrain_steps(cells, 20, raster.north_up(1000.0, 500.0, 5.0)).collect())
    assert [r[1:6] for r in got] == sorted(want) and all(r[0] == 7 and r[6:] == (1000.0 + 5 * r[2], 500.0 - 5 * r[1]) for r in got)


def test_a_pit_makes_no_step():
    flat = [[100 + 2 * abs(r - 4) - 0.001 * c for c in range(60)] for r in range(9)]
    flat[4][20] -= 3
    assert raster.analyze_tile(np.array(flat), 20) == plain_steps(raster.fill_depressions(np.array(flat)).tolist(), 20) == []


def test_cells_far_out_keep_their_own_id(spark):
    wide = spark.createDataFrame([(0, 1 << 20), (1, 0), (5, 3)], "row int, col int")
    assert raster.mask_components(wide).count() == 3
    with pytest.raises(Exception, match="cell outside the frame"):
        raster.mask_components(spark.createDataFrame([(0, -1)], "row int, col int")).collect()


def test_limits_timeouts_and_causes(spark):
    def scorer(pdf):
        if (pdf["key"] == "slow").any():
            time.sleep(5)
        if (pdf["key"] == "limited").any():
            raise manifest.RateLimited("later")
        return pdf[["key"]].assign(score=1.0)

    work = spark.createDataFrame([("a",), ("slow",), ("limited",)], "key string").coalesce(1)
    got = {r.key: r.status for r in manifest.score_resumably(work, scorer, "key string, score double, status string", batch=1, attempts=1, rate_limit_delays=(0.0, 0.0), timeout=0.5).collect()}
    assert got == {"a": "OK", "slow": "ERROR: TimeoutError: no answer within 0.5 s", "limited": "ERROR: RateLimited: later"}


def test_the_probe_gates_the_rest(spark):
    work = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0), (4, None), (None, 1.0)], "id long, cost double")
    run = lambda bad: lambda d: d.select("id", F.when(F.col("id") == bad, "ERROR: x").otherwise("OK").alias("status"))
    assert sorted(str(r.id) for r in manifest.probe_then_rest(work, "id", "cost", run(1)).collect()) == ["1", "2", "3", "4", "None"]
    with pytest.raises(RuntimeError, match="the probe 2 failed"):
        manifest.probe_then_rest(work, "id", "cost", run(2))
    assert manifest.probe_then_rest(work.limit(0), "id", "cost", run(2)).count() == 0


def test_rows_with_a_file(spark, tmp_path):
    for n in ("a_1.png", "b.tar.gz"):
        (tmp_path / n).write_bytes(b"x")
    rows = spark.createDataFrame([("a/1",), ("b.tar",), ("c",), (None,)], "key string")
    assert sorted(r.key for r in files.with_file(rows, "key", files.file_listing(spark, str(tmp_path))).collect()) == ["a/1", "b.tar"]


def test_pictures_that_fail_are_empty(spark):
    def url(lon, lat):
        if lon > 1:
            raise OSError
        return f"u{lon}"

    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "lon double, lat double")
    assert [r[2] for r in fusion.with_thumbnails(rows, url).orderBy("lon").collect()] == ["u1.0", ""]
    assert {r[2] for r in fusion.with_thumbnails(rows).collect()} == {""}


def test_empty_tables_are_written(spark, tmp_path):
    none = spark.createDataFrame([], "id long, g string")
    for name, write, read in (("a", files.write_json_array, lambda p: files.read_json_array(spark, p, "id long")), ("g", lambda d, p: files.write_geojson(d, p, "g"), lambda p: files.read_geojson(spark, p, "id long"))):
        write(none, str(tmp_path / name))
        assert read(str(tmp_path / name)).count() == 0
    assert raster.terrain_steps(spark.createDataFrame([], "tile_id int, row int, col int, elev double")).count() == 0


def test_places_of_large_keys(spark):
    keys = [0, 1, 7, 99_999, 323_900, 599_999, 5_999_999, 1_040_000, -323_901, 3_037_000_500]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *place(F.col("k"), SPARSE)).collect()
    sign = lambda v, p: v % p if v >= 0 else -(-v % p)
    assert {r["k"]: (r["x"], r["y"]) for r in got} == {k: (sign(7919 * k**2 + 31 * k, SPARSE[0]), sign(271 * k**3 + 17 * k, SPARSE[1])) for k in keys}


def test_repeated_rows_are_not_broadcast(spark):
    pts = spark.range(50).select("id", (F.col("id") * 7).alias("x"), (F.col("id") * 5).alias("y"))
    seg = pts.select(F.col("id").alias("line_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 90).alias("x2"), (F.col("y") - 70).alias("y2"))
    right = pts.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    for df in (within_distance(pts, right, 20), near_line(pts, seg, 20).select("id"), excess_area(pts, seg.withColumn("half_width", F.lit(9)), 9)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [cx#" in plan
        assert not re.search(r"BroadcastHashJoin \[cx#", plan)


def test_segment_cells_hold_all_that_is_near(spark):
    rng = random.Random(5)
    segs = [(i, *[rng.randint(-300, 300) for _ in range(4)]) for i in range(60)] + [(60, 5, -200, 5, 200), (61, -200, 5, 200, 5), (62, 9, 9, 9, 9)]
    cells = {}
    for r in segment_cells(spark.createDataFrame(segs, "line_id long, x1 long, y1 long, x2 long, y2 long"), 20, 30).select("line_id", "cx", "cy").collect():
        cells.setdefault(r["line_id"], set()).add((r["cx"], r["cy"]))
    for i, x1, y1, x2, y2 in segs:
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        for x, y in [(x, y) for x in range(-330, 331, 7) for y in range(-330, 331, 7)]:
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0.0
            if (x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2 <= 900:
                assert (x // 20, y // 20) in cells[i]


def _crowd(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-200, 200) if i % 2 else float(rng.randint(-200, 200)), float(rng.randint(-200, 200)), rng.randint(0, 9)) for i in range(400)]
    rows += [(400 + i, 7.0, 7.0, 5) for i in range(40)] + [(440, 1000.0, 0.0, 1), (441, 1020.0, 0.0, 1), (442, 1040.001, 0.0, 1), (443, None, 0.0, 1)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, v int")


def test_suppression_in_a_crowd(spark):
    rows, df = _crowd(spark)
    kept = []
    for i, x, y, v in sorted(rows, key=lambda r: (-r[3], r[0])):
        if x is None or all(b is None or (x - b) ** 2 + (y - c) ** 2 >= 400 for _, b, c in kept):
            kept.append((i, x, y))
    assert sorted(r["id"] for r in greedy_suppress(df, [-F.col("v"), F.col("id")], 20).collect()) == sorted(k[0] for k in kept)


def test_clusters_in_a_crowd_and_without_all_pairs(spark, monkeypatch):
    rows, df = _crowd(spark)
    up = {r[0]: r[0] for r in rows}
    extra = (440, -190.0, -190.0, 0)  # an id at two places links both
    every = [r for r in [*rows, extra] if r[1] is not None]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for p in every:
        for q in every:
            if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 400:
                a, b = sorted((root(p[0]), root(q[0])))
                up[b] = a
    edges = []
    monkeypatch.setattr(fusion, "connected_components", lambda e: edges.append(e.count()) or connected_components(e))
    got = {(r["id"], r["cluster"]) for r in fusion.cluster(df.unionByName(spark.createDataFrame([extra], df.schema)), 20).collect()}
    assert got == {(i, root(i)) for i in up}
    pairs = sum((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 400 for p in every for q in every if p[0] < q[0])
    assert 0 < edges[0] < pairs / 2
