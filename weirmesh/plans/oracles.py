"""The same results as SQL for an independent engine."""

from __future__ import annotations

import math

from weirmesh import constants as K
from weirmesh.constants import OUTPUT_COLUMNS, STAGES
from weirmesh.functions import geodesy as G
from weirmesh.plans.tables import DENSE, RING, SPARSE


def _xy(k: str, p: tuple[int, int]) -> str:
    k = f"CAST({k} AS BIGINT)"
    return f"({k}*{k}*7919 + {k}*31) % {p[0]} AS x, ({k}*{k}*{k}*271 + {k}*17) % {p[1]} AS y"


def _registry(p: tuple[int, int]) -> str:
    return f"""SELECT 'A' AS source, concat('A_', s_suppkey) AS source_id, 0 AS priority, {_xy("s_suppkey", p)}, CAST(s_nationkey AS VARCHAR) AS barrier_type FROM supplier
      UNION ALL SELECT 'B', concat('B_', c_custkey), 1, {_xy("c_custkey + 5000", p)}, c_mktsegment FROM customer
      UNION ALL SELECT 'C', concat('C_', p_partkey), NULL, {_xy("p_partkey + 40000", p)}, p_type FROM part WHERE p_size <= 10"""


_CAND = f"SELECT event_id AS id, event_type AS layer, {_xy('event_id', SPARSE)}, least(value / 100, 1.0) AS confidence, concat('t', user_id) AS source_ref FROM events"
_SEG = f"""SELECT line_id, x AS x1, y AS y1, x + (line_id % 7) * 200 - 600 AS x2, y + (line_id % 5) * 250 - 500 AS y2, strahler
  FROM (SELECT s_suppkey AS line_id, {_xy("s_suppkey + 100", SPARSE)}, nullif(s_nationkey % 11, 0) AS strahler FROM supplier)"""
_OBS = "SELECT l_partkey % 200 AS row, l_suppkey % 100 AS col, l_quantity AS green, 3 * (round(l_discount * 100) + round(l_tax * 100)) + 0.0 AS nir FROM lineitem"
_MED = f"SELECT row, col, median(green) AS green, median(nir) AS nir FROM ({_OBS}) GROUP BY ALL"
_NDWI = f"SELECT *, CASE WHEN green + nir = 0 THEN NULL ELSE (green - nir) / (green + nir) END AS ndwi FROM ({_MED})"
_LOG = f"""SELECT o_custkey AS tile_id, list_extract({list(STAGES)!r}, CAST(o_orderkey % 6 + 1 AS INT)) AS stage,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, o_orderkey AS seq FROM orders"""
_LATEST = f"SELECT tile_id, stage, arg_max(status, seq) AS status FROM ({_LOG}) GROUP BY ALL"
_WIDTH = "CASE strahler " + " ".join(f"WHEN {k} THEN {v}" for k, v in K.HALF_WIDTH_BY_STRAHLER.items()) + f" ELSE {K.DEFAULT_HALF_WIDTH} END"
_KEYS = f"SELECT id, printf('%s_%.6f_%.6f', layer, -6 + x / 10000, 37 + y / 10000) AS key FROM ({_CAND})"


def _ring() -> str:
    edges = [(a, b) for a, b in zip(RING, RING[1:] + RING[:1], strict=True) if a[1] != b[1]]
    one = "CASE WHEN (({y1} > y) <> ({y2} > y)) AND x < {x1} + (y - {y1}) * {dx} / {dy} THEN 1 ELSE 0 END"
    return "(" + " + ".join(one.format(x1=a[0], y1=a[1], y2=b[1], dx=float(b[0] - a[0]), dy=float(b[1] - a[1])) for a, b in edges) + ") % 2 = 1"


def _greedy(points: str, order: str, out: str) -> str:
    return f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM ({points})),
      near AS (SELECT DISTINCT a.rk FROM p a JOIN p b ON a.rk <> b.rk AND a.x BETWEEN b.x - 50 AND b.x + 50 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 2500),
      v AS (SELECT list([{{'rk': rk, 'x': x, 'y': y}}] ORDER BY rk) AS v FROM p WHERE rk IN (SELECT rk FROM near)),
      kept AS (SELECT unnest(list_reduce(v, lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: (k.x-e[1].x)*(k.x-e[1].x) + (k.y-e[1].y)*(k.y-e[1].y) < 2500)) > 0 THEN acc ELSE list_concat(acc, e) END)) AS k FROM v)
      SELECT {out} FROM p WHERE rk NOT IN (SELECT rk FROM near) OR rk IN (SELECT k.rk FROM kept)"""


def _pairs(radius: int = 50) -> str:
    return f"""SELECT a.id AS a, b.id AS b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d2 FROM cand a JOIN cand b
      ON a.id < b.id AND a.x BETWEEN b.x - {radius} AND b.x + {radius} AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {radius * radius}"""


_CLUSTER = f"""WITH RECURSIVE cand AS ({_CAND}), pr AS ({_pairs()}), e AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
  reach AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id),
  comp AS (SELECT c.*, coalesce(m.root, c.id) AS cluster FROM cand c LEFT JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m USING (id))"""
_FUSED = (
    _CLUSTER
    + """, spot AS (SELECT cluster, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM (SELECT DISTINCT cluster, x, y FROM comp) GROUP BY cluster),
  lay AS (SELECT cluster, layer, round_even(max(confidence), 4) AS conf, count(*) AS n FROM comp GROUP BY ALL),
  fused AS (SELECT cluster AS id, spot.x, spot.y, string_agg(layer, ';' ORDER BY layer) AS layers, CAST(count(*) AS INT) AS n_layers, max(conf) AS confidence,
    concat('{', string_agg(concat('"', layer, '":', CAST(conf AS DECIMAL(10, 4))), ',' ORDER BY layer), '}') AS per_layer_confidence,
    (SELECT string_agg(DISTINCT source_ref, ';' ORDER BY source_ref) FROM comp c WHERE c.cluster = lay.cluster) AS source_refs, CAST(sum(n) AS BIGINT) AS n_members
    FROM lay JOIN spot USING (cluster) GROUP BY cluster, spot.x, spot.y)"""
)
_CLASS = "CASE WHEN n_layers >= 2 OR confidence >= 0.85 THEN 'new-confirmed' ELSE 'new-uncertain' END"


def _match(left: str, right: str, radius: int = 30) -> str:
    """left: id, x, y; right: source, source_id, x, y."""
    return f"""SELECT l.id, arg_min({{'s': r.source, 'i': r.source_id, 'd': r.d2}}, {{'d': r.d2, 's': r.source, 'i': r.source_id}}) AS m FROM {left} l
      JOIN LATERAL (SELECT source, source_id, (l.x-b.x)*(l.x-b.x) + (l.y-b.y)*(l.y-b.y) AS d2 FROM {right} b WHERE b.x BETWEEN l.x - {radius} AND l.x + {radius}) r ON r.d2 <= {radius * radius} GROUP BY l.id"""


_MATCHED = "CASE WHEN m IS NULL THEN 'new' ELSE 'known' END"
_MCOLS = "m.s AS matched_source, m.i AS matched_source_id, round_even(sqrt(m.d), 1) AS matched_distance_m"
_FLAG = _FUSED + f", reg AS ({_registry(SPARSE)}), mt AS ({_match('fused', 'reg')}), flag AS (SELECT f.*, CASE WHEN m IS NULL THEN {_CLASS} ELSE 'known' END AS match_status, {_MCOLS} FROM fused f LEFT JOIN mt USING (id))"


def _t(px: str = "x", py: str = "y") -> str:
    return f"CASE WHEN (x2-x1)*(x2-x1) + (y2-y1)*(y2-y1) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (({px}-x1)*(x2-x1) + ({py}-y1)*(y2-y1)) / CAST((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1) AS DOUBLE))) END"


_ONLINE = f"SELECT *, (x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1))) + (y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1))) AS d2, x1+t*(x2-x1) AS sx, y1+t*(y2-y1) AS sy FROM (SELECT c.id, c.x, c.y, s.*, {_t()} AS t FROM ({_CAND}) c, ({_SEG}) s)"
_SAMPLE = f"""SELECT source_id, gx, gy FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY md5(concat(source_id, '|42')), source_id) AS rn FROM
  (SELECT source_id, CAST(least(floor((x - min(x) OVER ()) * 10 / (max(x) OVER () - min(x) OVER ())), 9) AS INT) AS gx, CAST(least(floor((y - min(y) OVER ()) * 10 / (max(y) OVER () - min(y) OVER ())), 9) AS INT) AS gy FROM ({_registry(SPARSE)})))
  WHERE rn <= (SELECT greatest(1, 100 // count(DISTINCT (gx, gy))) FROM (SELECT CAST(least(floor((x - min(x) OVER ()) * 10 / (max(x) OVER () - min(x) OVER ())), 9) AS INT) AS gx, CAST(least(floor((y - min(y) OVER ()) * 10 / (max(y) OVER () - min(y) OVER ())), 9) AS INT) AS gy FROM ({_registry(SPARSE)})))
  ORDER BY md5(concat(source_id, '|42')), source_id LIMIT 100"""


def _tiles(size: int = 1000, buf: int = 200) -> str:
    tk = "(CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (({cx}-x1)*dx + ({cy}-y1)*dy) / CAST(dx*dx+dy*dy AS DOUBLE))) END)"
    corner = [f"(({cx}-(x1+{tk.format(cx=cx, cy=cy)}*dx))*({cx}-(x1+{tk.format(cx=cx, cy=cy)}*dx)) + ({cy}-(y1+{tk.format(cx=cx, cy=cy)}*dy))*({cy}-(y1+{tk.format(cx=cx, cy=cy)}*dy)))" for cx in ("bx0", "bx1") for cy in ("by0", "by1")]
    near = lambda v, a, b: f"greatest({a}-{v}, {v}-{b}, 0)*greatest({a}-{v}, {v}-{b}, 0)"
    ends = [near(f"x{i}", "bx0", "bx1") + " + " + near(f"y{i}", "by0", "by1") for i in (1, 2)]
    lo = lambda d, s, a, b: f"CASE WHEN {d} = 0 THEN CASE WHEN {s} BETWEEN {a} AND {b} THEN 0.0 ELSE 2.0 END ELSE least(({a}-{s})/CAST({d} AS DOUBLE), ({b}-{s})/CAST({d} AS DOUBLE)) END"
    hi = lambda d, s, a, b: f"CASE WHEN {d} = 0 THEN CASE WHEN {s} BETWEEN {a} AND {b} THEN 1.0 ELSE -2.0 END ELSE greatest(({a}-{s})/CAST({d} AS DOUBLE), ({b}-{s})/CAST({d} AS DOUBLE)) END"
    crosses = f"greatest({lo('dx', 'x1', 'bx0', 'bx1')}, {lo('dy', 'y1', 'by0', 'by1')}, 0.0) <= least({hi('dx', 'x1', 'bx0', 'bx1')}, {hi('dy', 'y1', 'by0', 'by1')}, 1.0)"
    return f"""WITH s AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM ({_SEG})), o AS (SELECT min(least(x1, x2)) - {buf} AS ax, min(least(y1, y2)) - {buf} AS ay, max(greatest(x1, x2)) + {buf} AS zx, max(greatest(y1, y2)) + {buf} AS zy FROM s),
      g AS (SELECT tx, ty, ax + tx*{size} AS bx0, ay + ty*{size} AS by0, ax + tx*{size} + {size} AS bx1, ay + ty*{size} + {size} AS by1 FROM o, unnest(range(0, (zx-ax)//{size} + 1)) a(tx), unnest(range(0, (zy-ay)//{size} + 1)) b(ty))
      SELECT DISTINCT printf('tile_%03d_%03d', tx, ty) AS tile_id, tx, ty, bx0 AS x0, by0 AS y0,
        printf('POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))', bx1, by0, bx1, by1, bx0, by1, bx0, by0, bx1, by0) AS wkt
      FROM g, s WHERE CASE WHEN {crosses} THEN 0.0 ELSE least({", ".join(ends + corner)}) END <= {buf * buf}"""


def _clip(x0: int, y0: int, x1: int, y1: int) -> str:
    lo = lambda d, s, a, b: f"CASE WHEN {d} = 0 THEN CASE WHEN {s} BETWEEN {a} AND {b} THEN 0.0 ELSE 2.0 END ELSE least(({a}-{s})/{d}, ({b}-{s})/{d}) END"
    hi = lambda d, s, a, b: f"CASE WHEN {d} = 0 THEN CASE WHEN {s} BETWEEN {a} AND {b} THEN 1.0 ELSE -2.0 END ELSE greatest(({a}-{s})/{d}, ({b}-{s})/{d}) END"
    return f"""SELECT line_id, round(x1 + ta*dx, 4) AS x1, round(y1 + ta*dy, 4) AS y1, round(x1 + tb*dx, 4) AS x2, round(y1 + tb*dy, 4) AS y2 FROM (SELECT *,
      greatest(0.0, {lo("dx", "x1", x0, x1)}, {lo("dy", "y1", y0, y1)}) AS ta, least(1.0, {hi("dx", "x1", x0, x1)}, {hi("dy", "y1", y0, y1)}) AS tb
      FROM (SELECT *, CAST(x2-x1 AS DOUBLE) AS dx, CAST(y2-y1 AS DOUBLE) AS dy FROM ({_SEG}))) WHERE ta < tb AND (dx <> 0 OR dy <> 0)"""


def _project() -> str:
    e, r = repr(G._ECC), repr(G.SCALE * G._RADIUS)
    east = " + ".join(f"({a!r})*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(G._ALPHA, 1))
    north = " + ".join(f"({a!r})*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(G._ALPHA, 1))
    return f"""SELECT c_custkey, round(500000 + {r}*(eta + {east}), 2) AS x_m, round({r}*(xi + {north}), 2) AS y_m FROM (SELECT c_custkey, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta
      FROM (SELECT c_custkey, lam, sinh(atanh(sin(phi)) - {e}*atanh({e}*sin(phi))) AS t FROM (SELECT c_custkey, radians(c_custkey % 500 / 100 - 8 + 3) AS lam, radians(c_custkey % 300 / 100 + 36) AS phi FROM customer)))"""


def _unproject() -> str:
    r = repr(G.SCALE * G._RADIUS)
    xi1 = " - ".join(["xi"] + [f"({b!r})*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, b in enumerate(G._BETA, 1)])
    eta1 = " - ".join(["eta"] + [f"({b!r})*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, b in enumerate(G._BETA, 1)])
    phi = " + ".join(["chi"] + [f"({d!r})*sin({2 * j}*chi)" for j, d in enumerate(G._DELTA, 1)])
    return f"""SELECT c_custkey, round(-3 + degrees(atan2(sinh(eta1), cos(xi1))), 7) AS lon, round(degrees({phi}), 7) AS lat FROM (SELECT *, asin(sin(xi1)/cosh(eta1)) AS chi FROM (SELECT c_custkey, {xi1} AS xi1, {eta1} AS eta1
      FROM (SELECT c_custkey, (c_custkey % 400 * 1000 + 4000000)/{r} AS xi, (c_custkey % 700 * 1000 + 100000 - 500000)/{r} AS eta FROM customer)))"""


_TRI = f"SELECT p_partkey, x AS px, y AS py, x + 3*p_size AS qx, y + p_partkey % 7 AS qy, x - p_partkey % 11 AS rx, y + 2*p_size AS ry FROM (SELECT p_partkey, p_size, {_xy('p_partkey', DENSE)} FROM part)"
_TRI = f"SELECT *, abs((qx-px)*(ry-py) - (rx-px)*(qy-py)) / 2 AS area FROM ({_TRI})"


def _square(of: str, reach: int, grow: bool) -> str:
    """Cells that some square of reach around a cell of a table covers, or that such squares cover fully."""
    area = f"(least(row + {reach}, 199) - greatest(row - {reach}, 0) + 1) * (least(col + {reach}, 99) - greatest(col - {reach}, 0) + 1)"
    moved = f"SELECT row + i AS row, col + j AS col FROM {of}, unnest(range(-{reach}, {reach + 1})) a(i), unnest(range(-{reach}, {reach + 1})) b(j)"
    return f"SELECT row, col FROM ({moved}) WHERE row BETWEEN 0 AND 199 AND col BETWEEN 0 AND 99 GROUP BY row, col" + ("" if grow else f" HAVING count(*) = {area}")


def all_oracles() -> dict[str, str]:
    dense, sparse = _registry(DENSE), _registry(SPARSE)
    reach = math.ceil(max(K.HALF_WIDTH_BY_STRAHLER.values()))
    null_columns = ", ".join({"confidence": "confidence", "layers": "layer AS layers", "source_refs": "source_ref AS source_refs"}.get(c, f"CAST(NULL AS VARCHAR) AS {c}") for c in OUTPUT_COLUMNS)
    return {
        "registry_normalize": f"""SELECT source, source_id, x, y, barrier_type, concat('{{"barrier_type":"', barrier_type, '"}}') AS raw_attributes FROM ({sparse})""",
        "registry_source_counts": f"SELECT source, count(*) AS n FROM ({sparse}) GROUP BY source",
        "field_vs_clip": f"SELECT count(*) FILTER (f AND NOT c) AS only_field, count(*) FILTER (c AND NOT f) AS only_clip, count(*) FILTER (c AND f) AS both FROM (SELECT source = 'B' AS f, {_ring()} AS c FROM ({dense}))",
        "clip_points": f"SELECT source_id AS id, x, y FROM ({dense}) WHERE {_ring()}",
        "bbox_filter": f"SELECT source_id, x, y FROM ({dense}) WHERE x BETWEEN 500 AND 1500 AND y BETWEEN 400 AND 1400",
        "priority_map": f"SELECT source, CAST(CASE source WHEN 'A' THEN 0 WHEN 'B' THEN 4 ELSE 1 END AS INT) AS full, CAST(CASE source WHEN 'A' THEN 0 WHEN 'B' THEN 3 END AS INT) AS micro, count(*) AS n FROM ({sparse}) GROUP BY source",
        "half_width_map": f"SELECT line_id, CAST({_WIDTH} AS INT) AS half_width FROM ({_SEG}) WHERE strahler IS NOT NULL",
        "falsy_coalesce": "SELECT c_custkey, coalesce(nullif(CAST(c_nationkey % 5 AS DOUBLE), 0), c_acctbal) AS v FROM customer",
        "greedy_dedup_priority": _greedy(f"SELECT source_id AS id, x, y, priority FROM ({dense}) WHERE priority IS NOT NULL", "priority, id", "id, x, y"),
        "greedy_dedup_missing_priority": _greedy(f"SELECT source_id AS id, x, y, priority FROM ({dense})", "priority NULLS LAST, id", "id, priority"),
        "greedy_dedup_area": _greedy(f"SELECT c_custkey AS id, {_xy('c_custkey', DENSE)}, c_acctbal AS area FROM customer", "area DESC, id", "id, area"),
        "greedy_dedup_confidence": _greedy(_CAND, "confidence DESC, id", "id, confidence"),
        "proximity_pairs": f"WITH cand AS ({_CAND}) {_pairs()}",
        "match_closest": f"WITH cand AS ({_CAND}), reg AS ({sparse}), mt AS ({_match('cand', 'reg')}) SELECT c.id, {_MATCHED} AS match_status, {_MCOLS} FROM cand c LEFT JOIN mt USING (id)",
        "river_touch_semi": f"SELECT DISTINCT id, x, y FROM ({_ONLINE}) WHERE d2 <= 900",
        "snap_to_river": f"SELECT id, m.line_id AS line_id, round(m.sx, 3) AS snap_x, round(m.sy, 3) AS snap_y FROM (SELECT id, arg_min({{'line_id': line_id, 'sx': sx, 'sy': sy}}, {{'d': round(d2, 6), 'l': line_id}}) AS m FROM ({_ONLINE}) GROUP BY id)",
        "cluster_components": _CLUSTER + " SELECT id, cluster FROM comp",
        "fuse_candidates": _FUSED + " SELECT * FROM fused",
        "classify": _FUSED + f" SELECT id, n_layers, confidence, {_CLASS} AS class FROM fused",
        "flagship_pipeline": _FLAG + " SELECT * FROM flag",
        "match_status_counts": _FLAG + " SELECT match_status, count(*) AS n FROM flag GROUP BY match_status",
        "stratified_sample": _SAMPLE,
        "train_holdout_split": f"SELECT source_id, CASE WHEN row_number() OVER (ORDER BY md5(concat(source_id, '|7')), source_id) <= round_even(0.2 * count(*) OVER (), 0) THEN 'holdout' ELSE 'train' END AS split FROM ({_SAMPLE})",
        "tile_grid": _tiles(),
        "chunk_halo": f"""SELECT DISTINCT printf('dem_chunk_%02d_%02d', r, c) AS chunk_id, ax+c*4000 AS x0, ay+r*4000 AS y0, ax+c*4000+4000 AS x1, ay+r*4000+4000 AS y1, ax+c*4000-500 AS fx0, ay+r*4000-500 AS fy0, ax+c*4000+4500 AS fx1, ay+r*4000+4500 AS fy1
          FROM (SELECT ax, ay, (x-ax)//4000 AS c, (y-ay)//4000 AS r FROM (SELECT x, y, min(x) OVER () AS ax, min(y) OVER () AS ay FROM ({_CAND})))""",
        "halo_cells": f"""WITH c AS ({_CAND}), g AS (SELECT DISTINCT x//4000 + i AS cx, y//4000 + j AS cy FROM c, unnest([-1, 0, 1]) a(i), unnest([-1, 0, 1]) b(j))
          SELECT cx AS chunk_x, cy AS chunk_y, count(*) AS cells, count(*) FILTER (x//4000 = cx AND y//4000 = cy) AS core_cells FROM g JOIN c ON x >= cx*4000-500 AND x < cx*4000+4500 AND y >= cy*4000-500 AND y < cy*4000+4500 GROUP BY ALL""",
        "clip_lines": _clip(4000, 4000, 16000, 20000),
        "step_profile": """SELECT l_suppkey, CAST(pos AS INT) AS pos, round(up, 6) AS up_slope, round(down, 6) AS down_slope FROM (SELECT l_suppkey, pos, n, abs(a6 - a1)/6 AS up, abs(e - b5)/6 AS down FROM (
          SELECT l_suppkey, l_quantity/100 AS e, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n, lag(l_quantity/100, 6) OVER w AS a6, lag(l_quantity/100, 1) OVER w AS a1, lead(l_quantity/100, 5) OVER w AS b5
          FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate))) WHERE n >= 14 AND pos BETWEEN 6 AND n - 7 AND up < 0.015 AND down > 0.05 AND down > 3.0*greatest(up, 1e-6)""",
        "median_composite": _MED,
        "ndwi_cells": f"SELECT row, col, round(ndwi, 6) AS ndwi FROM ({_NDWI}) WHERE ndwi > 0.2",
        "mask_components": f"""WITH RECURSIVE c AS (SELECT row, col, row*2147483648 + col AS id FROM ({_NDWI}) WHERE ndwi > 0.55), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND a.id <> b.id),
          reach AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id), m AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
          SELECT component, count(*) AS area, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, round(avg(row), 6) AS row_mean, round(avg(col), 6) AS col_mean FROM c JOIN m USING (id) GROUP BY component HAVING count(*) > 1""",
        "water_fraction": f"SELECT row, round(f, 6) AS fraction, f > 0.01 AS confirmed FROM (SELECT row, avg(CAST(ndwi > 0.2 AS INT)) AS f FROM ({_NDWI}) GROUP BY row)",
        "percentile_stretch": f"SELECT row % 10 AS tile, round(quantile_cont(green, 0.02), 6) AS green_low, round(quantile_cont(green, 0.98), 6) AS green_high, round(quantile_cont(nir, 0.02), 6) AS nir_low, round(quantile_cont(nir, 0.98), 6) AS nir_high FROM ({_OBS}) GROUP BY 1",
        "mosaic_first_wins": "SELECT o_custkey % 50 AS row, o_orderkey % 40 AS col, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2",
        "excess_area": f"""WITH s AS (SELECT *, {_WIDTH} AS hw FROM ({_SEG}) WHERE strahler IS NOT NULL), p AS (SELECT line_id AS id, x1 - line_id % 40 + i AS x, y1 - 10 + j AS y FROM ({_SEG}), unnest(range(0, 30)) a(i), unnest(range(0, 30)) b(j)),
          h AS (SELECT DISTINCT id, x, y FROM (SELECT p.id, p.x, p.y, s.* , {_t("p.x", "p.y")} AS t FROM p JOIN s ON p.x BETWEEN least(x1, x2)-{reach} AND greatest(x1, x2)+{reach} AND p.y BETWEEN least(y1, y2)-{reach} AND greatest(y1, y2)+{reach}) WHERE (x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1))) + (y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1))) <= hw*hw),
          n AS (SELECT id, count(*) AS c FROM h GROUP BY id)
          SELECT *, touches AND excess > 400 AND excess > 0.3*total AS keep FROM (SELECT id, count(*) AS total, count(*) - coalesce(any_value(c), 0) AS excess, any_value(c) IS NOT NULL AS touches FROM p LEFT JOIN n USING (id) GROUP BY id)""",
        "center_third_recall": """SELECT n, hits, round(hits / n, 6) AS recall FROM (SELECT count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT user_id, bool_or(least(value/100, 1.0) >= 0.15 AND event_id % 600 > 200 AND event_id % 600 < 400 AND event_id*7 % 600 > 200 AND event_id*7 % 600 < 400) AS hit FROM events GROUP BY user_id))""",
        "box_labels": "SELECT p_partkey, printf('0 %.6f %.6f %.6f %.6f', (2*(p_partkey % 300) + p_size)/1200, (2*(p_partkey % 200) + 2*p_size)/1200, p_size/600, 2*p_size/600) AS label FROM part",
        "name_exclude": "SELECT p_partkey, p_type FROM part WHERE NOT (contains(lower(p_type), 'promo') OR contains(lower(p_type), 'standard') OR contains(lower(p_type), 'econ'))",
        "pending_tiles": f"SELECT c_custkey AS tile_id, concat('tile_', c_custkey) AS name FROM customer WHERE c_custkey NOT IN (SELECT tile_id FROM ({_LATEST}) WHERE stage = 'layer1' AND status = 'done')",
        "latest_status": _LATEST,
        "progress_summary": f"WITH l AS (SELECT * FROM ({_LATEST}) WHERE tile_id IN (SELECT c_custkey FROM customer)), n AS (SELECT count(*) AS total FROM customer) SELECT total, " + ", ".join(f"printf('%d/%d', (SELECT count(*) FROM l WHERE stage = '{s}' AND status = 'done'), total) AS {s}" for s in STAGES) + " FROM n",
        "add_tiles": "SELECT c_custkey AS tile_id, concat('tile_', c_custkey) AS name FROM customer UNION ALL SELECT c_custkey*2, concat('new_', c_custkey*2) FROM customer WHERE c_custkey*2 NOT IN (SELECT c_custkey FROM customer)",
        "candidate_key": _KEYS,
        "resume_anti_join": f"SELECT key, id FROM ({_KEYS}) WHERE key NOT IN (SELECT key FROM ({_KEYS}) WHERE id % 3 = 0)",
        "resume_limit": f"SELECT key, id FROM ({_KEYS}) WHERE key NOT IN (SELECT key FROM ({_KEYS}) WHERE id % 3 = 0) ORDER BY key LIMIT 50",
        "worst_case_probe": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
        "chunk_assign": "SELECT c_custkey, (row_number() OVER (ORDER BY CAST(concat('0x', substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4)) AS BIGINT) % 256, c_custkey) - 1) // 15 AS chunk FROM customer",
        "first_detection": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
        "reindex_output": f"SELECT {null_columns} FROM ({_CAND})",
        "precision_recall": f"""WITH cand AS ({_CAND}), reg AS (SELECT * FROM ({sparse}) WHERE source <> 'A'), p AS (SELECT count(*) AS candidate_total, count(*) FILTER (EXISTS (SELECT 1 FROM reg r WHERE r.x BETWEEN c.x-30 AND c.x+30 AND (r.x-c.x)*(r.x-c.x)+(r.y-c.y)*(r.y-c.y) <= 900)) AS candidate_hits FROM cand c),
          q AS (SELECT count(*) AS inventory_total, count(*) FILTER (EXISTS (SELECT 1 FROM cand c WHERE r.x BETWEEN c.x-30 AND c.x+30 AND (r.x-c.x)*(r.x-c.x)+(r.y-c.y)*(r.y-c.y) <= 900)) AS inventory_hits FROM reg r)
          SELECT *, round(candidate_hits/candidate_total, 6) AS precision, round(inventory_hits/inventory_total, 6) AS recall FROM p, q""",
        "removed_barriers": f"WITH cand AS ({_CAND}) SELECT source, source_id, x, y FROM ({sparse}) r WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE r.x BETWEEN c.x-30 AND c.x+30 AND (r.x-c.x)*(r.x-c.x)+(r.y-c.y)*(r.y-c.y) <= 900)",
        "project_grid": _project(),
        "clean_mask": f"WITH m AS (SELECT row, col FROM ({_NDWI}) WHERE ndwi > -0.1), a AS ({_square('m', 1, False)}), b AS ({_square('a', 1, True)}), c AS ({_square('b', 12, True)}) {_square('c', 12, False)}",
        "prefix_match": "WITH o AS (SELECT concat('tile_', o_custkey, '_', o_orderkey) AS name, concat('tile_', o_custkey) AS stem FROM orders) SELECT name, t.stem FROM o LEFT JOIN (SELECT concat('tile_', c_custkey) AS stem FROM customer WHERE c_custkey % 3 > 0) t USING (stem)",
        "spot_check": f"""WITH cand AS ({_CAND}), reg AS ({sparse}), mt AS ({_match('cand', 'reg')}), f AS (SELECT c.id, {_MATCHED} AS match_status FROM cand c LEFT JOIN mt USING (id))
          SELECT id, match_status, count(*) OVER (PARTITION BY match_status) AS group_size FROM f QUALIFY row_number() OVER (PARTITION BY match_status ORDER BY md5(concat(id, '|42')), id) <= 20""",
        "near_centre_box": f"""WITH RECURSIVE c AS (SELECT row, col, row*2147483648 + col AS id FROM ({_NDWI}) WHERE ndwi > 0.35), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND a.id <> b.id),
          reach AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id), m AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
          k AS (SELECT component, count(*) AS area, min(row) AS y0, max(row) + 1 AS y1, min(col) AS x0, max(col) + 1 AS x1 FROM c JOIN m USING (id) GROUP BY component
            HAVING count(*) >= 3 AND (avg(row) - 100)*(avg(row) - 100) + (avg(col) - 50)*(avg(col) - 50) <= 35*35 ORDER BY area DESC, component LIMIT 1)
          SELECT x0, y0, x1, y1, area FROM k WHERE (x1-x0)*(y1-y0) <= 0.85*200*100""",
        "polygon_measures": f"""SELECT p_partkey, CAST(area AS DOUBLE) AS area, round(CASE WHEN area > 0 THEN (px+qx+rx)/3 END, 3) AS x, round(CASE WHEN area > 0 THEN (py+qy+ry)/3 END, 3) AS y,
          CAST(least(px, qx, rx) AS DOUBLE) AS x0, CAST(least(py, qy, ry) AS DOUBLE) AS y0, CAST(greatest(px, qx, rx) AS DOUBLE) AS x1, CAST(greatest(py, qy, ry) AS DOUBLE) AS y1 FROM ({_TRI})""",
        "centroid_within": f"SELECT p_partkey FROM (SELECT p_partkey, round((px+qx+rx)/3, 6) AS x, round((py+qy+ry)/3, 6) AS y FROM ({_TRI}) WHERE area > 0) WHERE {_ring()}",
        "imagery_window": "SELECT o_custkey % 50 AS cell, count(*) AS images, round(median(o_totalprice), 3) AS composite FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' AND o_orderkey % 100 < 20 GROUP BY 1",
        "geojson_features": f"SELECT id, layer, 'Point' AS geometry_type, x AS lon, y AS lat FROM ({_CAND})",
        "unproject_grid": _unproject(),
        "resume_terminal": f"SELECT key, id FROM ({_KEYS}) WHERE key NOT IN (SELECT key FROM ({_KEYS}) WHERE id % 3 = 0 AND id % 4 < 3)",
    } | _io_oracles()


_CUSTOMERS = "SELECT c_custkey, c_name, concat('a \"b\", é\\', c_mktsegment) AS note, nullif(c_nationkey, 3) AS nation, c_acctbal FROM customer"


def _io_oracles() -> dict[str, str]:
    seg2 = f"SELECT x1, y1, x2, y2, {_WIDTH} AS hw FROM ({_SEG}) WHERE strahler IS NOT NULL UNION ALL SELECT x1 + 25, y1, x2 + 25, y2, {K.DEFAULT_HALF_WIDTH} FROM ({_SEG})"
    d2 = "(x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1))) + (y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1)))"
    reach = max(K.HALF_WIDTH_BY_STRAHLER.values())
    dense = _SEG.replace(_xy("s_suppkey + 100", SPARSE), _xy("s_suppkey + 100", DENSE))
    seen = "LATERAL (SELECT line_id, (x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1))) + (y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1))) AS d2"
    size, buf = 500, 200
    return {
        "csv_round_trip": _CUSTOMERS,
        "json_array_round_trip": _CUSTOMERS,
        "jsonl_append_once": f"SELECT c_custkey, note, nation FROM ({_CUSTOMERS})",
        "jsonl_lonlat": _unproject(),
        "missing_as_empty": "SELECT c_custkey, c_name FROM customer",
        "geojson_round_trip": "SELECT c_custkey, c_name, 'Point' AS geometry_type, c_custkey % 90 AS lon, c_nationkey AS lat FROM customer",
        "layer_round_trip": "SELECT 'points' AS layer, c_custkey, 1 AS vertices, CAST(c_custkey AS DOUBLE) AS x FROM customer UNION ALL SELECT 'lines', c_custkey, 2, CAST(c_custkey AS DOUBLE) FROM customer",
        "chunk_checkpoints": f"SELECT chunk, c_custkey, CAST(n.c_nationkey + CASE WHEN chunk = 1 THEN 100 ELSE 0 END AS INT) AS c_nationkey FROM ({_chunks(40)}) JOIN customer n USING (c_custkey)",
        "mosaic_round_trip": f"SELECT row, col, count(*) AS n FROM ({_OBS}) WHERE row % 7 = 3 GROUP BY ALL",
        "gpkg_round_trip": "SELECT l.layer, n_nationkey + 1 AS fid, n_name, 'Point' AS geometry_type, CAST(n_nationkey + l.s AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation, (VALUES ('places', 0), ('moved', 1000)) l(layer, s)",
        "shapefile_round_trip": "SELECT CAST(n_nationkey + 1 AS INT) AS record, 1 AS shape_type, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation",
        "output_files": f"{_FLAG} SELECT 'pilot' AS file, match_status, count(*) AS n FROM flag GROUP BY 2 UNION ALL SELECT 'review', match_status, count(*) FROM flag WHERE match_status = 'new-uncertain' GROUP BY 2",
        "water_signature_points": f"SELECT 'layer3_water_signature' AS layer, r.id, r.snap_x AS x, r.snap_y AS y, c.confidence, c.source_ref FROM ({all_oracles_snap()}) r JOIN ({_CAND}) c USING (id)",
        "anomalous_widening": f"""WITH s AS ({seg2}), p AS (SELECT line_id AS id, x1 - line_id % 40 + i AS x, y1 - 10 + 20 * (line_id % 3) + j AS y FROM ({_SEG}), unnest(range(0, 30)) a(i), unnest(range(0, 30)) b(j)),
          h AS (SELECT id, x, y, min({d2}) AS near, bool_or({d2} <= hw*hw) AS inside FROM (SELECT p.id, p.x, p.y, s.*, {_t("p.x", "p.y")} AS t FROM p JOIN s ON p.x BETWEEN least(x1, x2)-{reach} AND greatest(x1, x2)+{reach} AND p.y BETWEEN least(y1, y2)-{reach} AND greatest(y1, y2)+{reach}) GROUP BY id, x, y),
          n AS (SELECT id, count(*) FILTER (inside) AS c, min(near) AS near FROM h GROUP BY id)
          SELECT id, total, excess, near <= 900 AND c > 0 AND excess > 400 AND excess > 0.3*total AS keep FROM (SELECT id, count(*) AS total, count(*) - coalesce(any_value(c), 0) AS excess, coalesce(any_value(c), 0) AS c, coalesce(any_value(near), 1e9) AS near FROM p LEFT JOIN n USING (id) GROUP BY id)""",
        "snapped_tiles": _snapped(size, buf),
        "clip_lines_to_ring": _ring_clip(dense),
        "centroids": """SELECT p_partkey, round((n*n/2 + k*n + 0) / (n + k + 2), 5) AS line_x, round((k*k/2 + 2*11) / (n + k + 2), 5) AS line_y,
          round(((n+4)*(n+4)*(n+4)/2 - 4*2 + 9*(k+101.5)) / ((n+4)*(n+4) - 4 + 9), 5) AS area_x, round(((n+4)*(n+4)*(n+4)/2 - 4*2 + 9*(k+101.5)) / ((n+4)*(n+4) - 4 + 9), 5) AS area_y
          FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, CAST(p_partkey % 50 AS DOUBLE) AS k FROM part)""",
        "pixel_positions": "SELECT p_partkey, 287000 + 0.5 * p_size + 0.0 AS x, 4164500 - 0.5 * (p_partkey % 300) + 0.0 AS y FROM part",
        "colour_mask": """SELECT p_partkey FROM (SELECT p_partkey, mx, CASE WHEN mx = mn THEN 0 ELSE round(255.0*(mx-mn)/mx) END AS sat, CASE WHEN mx = mn THEN 0 ELSE round((CASE WHEN mx = r THEN CAST(g-b AS DOUBLE)/(mx-mn) WHEN mx = g THEN 2 + CAST(b-r AS DOUBLE)/(mx-mn) ELSE 4 + CAST(r-g AS DOUBLE)/(mx-mn) END) * 30) END AS h
          FROM (SELECT *, greatest(b, g, r) AS mx, least(b, g, r) AS mn FROM (SELECT p_partkey, p_partkey * 7 % 256 AS b, p_partkey * 13 % 256 AS g, p_size * 5 AS r FROM part)))
          WHERE h BETWEEN 35 AND 140 AND sat BETWEEN 25 AND 255 AND mx BETWEEN 20 AND 220""",
        "nodata_cells": f"SELECT count(*) AS cells, count(nullif(elev, 50)) AS valid FROM (SELECT row, col, max(green) AS elev FROM ({_OBS}) GROUP BY ALL)",
        "key_helpers": """SELECT c_custkey, key, replace(key, '/', '_') AS stem, replace(key, '/', '_') || '.png' AS name, left(c_name, 12) AS line, c_custkey % 5 = 0 AS failed
          FROM (SELECT *, CASE WHEN c_mktsegment <> 'BUILDING' THEN concat('es/', c_mktsegment, '/tile_', c_custkey) END AS key FROM customer WHERE c_custkey NOT IN (7, 9))""",
        "outcome_counts": "SELECT count(*) FILTER (o_orderkey % 3 < 2) AS done, count(*) FILTER (o_orderkey % 3 = 2) AS failed FROM orders",
        "status_log_appended": "SELECT c_custkey AS tile_id, 'layer2' AS stage, CASE WHEN c_custkey % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM customer",
    }


def all_oracles_snap() -> str:
    return f"SELECT id, round(sx, 3) AS snap_x, round(sy, 3) AS snap_y FROM (SELECT id, arg_min({{'sx': sx, 'sy': sy}}, {{'d': round(d2, 6), 'l': line_id, 'sx': sx, 'sy': sy}}) AS m FROM ({_ONLINE}) GROUP BY id) , LATERAL (SELECT m.sx AS sx, m.sy AS sy)"


def _chunks(size: int) -> str:
    """Rows by 256 hash buckets of the key, then by key, size of them in a chunk."""
    b = "CAST(concat('0x', substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4)) AS BIGINT) % 256"
    return f"SELECT c_custkey, (row_number() OVER (ORDER BY {b}, c_custkey) - 1) // {size} AS chunk FROM customer"


def _snapped(size: int, buf: int) -> str:
    """Tiles met by a line widened by buf: a tile's distance to a segment is 0 or reached at an end or a corner."""
    tk = "(CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (({cx}-x1)*dx + ({cy}-y1)*dy) / CAST(dx*dx+dy*dy AS DOUBLE))) END)"
    corner = [f"(({cx}-(x1+{tk.format(cx=cx, cy=cy)}*dx))*({cx}-(x1+{tk.format(cx=cx, cy=cy)}*dx)) + ({cy}-(y1+{tk.format(cx=cx, cy=cy)}*dy))*({cy}-(y1+{tk.format(cx=cx, cy=cy)}*dy)))" for cx in ("bx0", "bx1") for cy in ("by0", "by1")]
    near = lambda v, a, b: f"greatest({a}-{v}, {v}-{b}, 0)*greatest({a}-{v}, {v}-{b}, 0)"
    ends = [near(f"x{i}", "bx0", "bx1") + " + " + near(f"y{i}", "by0", "by1") for i in (1, 2)]
    part = lambda d, s, a, b, f, no: f"CASE WHEN {d} = 0 THEN CASE WHEN {s} BETWEEN {a} AND {b} THEN {no[0]} ELSE {no[1]} END ELSE {f}(({a}-{s})/CAST({d} AS DOUBLE), ({b}-{s})/CAST({d} AS DOUBLE)) END"
    lo = [part(d, s, a, b, "least", (0.0, 2.0)) for d, s, a, b in (("dx", "x1", "bx0", "bx1"), ("dy", "y1", "by0", "by1"))]
    hi = [part(d, s, a, b, "greatest", (1.0, -2.0)) for d, s, a, b in (("dx", "x1", "bx0", "bx1"), ("dy", "y1", "by0", "by1"))]
    return f"""WITH s AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM ({_SEG})), o AS (SELECT min(least(x1, x2)) - {buf} AS ax, min(least(y1, y2)) - {buf} AS ay, max(greatest(x1, x2)) + {buf} AS zx, max(greatest(y1, y2)) + {buf} AS zy FROM s),
      g AS (SELECT a.i*{size} AS bx0, b.i*{size} AS by0, a.i*{size} + {size} AS bx1, b.i*{size} + {size} AS by1 FROM o, unnest(range(CAST(floor(ax / {size}.0) AS BIGINT), CAST(floor(zx / {size}.0) AS BIGINT) + 1)) a(i), unnest(range(CAST(floor(ay / {size}.0) AS BIGINT), CAST(floor(zy / {size}.0) AS BIGINT) + 1)) b(i))
      SELECT DISTINCT printf('pilot_%d_%d', bx0, by0) AS tile_id, bx0 AS x0, by0 AS y0 FROM g JOIN s ON (greatest({lo[0]}, {lo[1]}, 0.0) <= least({hi[0]}, {hi[1]}, 1.0)) OR least({", ".join([*ends, *corner])}) <= {buf * buf}"""


def _ring_clip(segments: str) -> str:
    """Cuts at every edge by unnesting them, then parts whose middle is inside."""
    edges = ", ".join(f"({a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for a, b in zip(RING, RING[1:] + RING[:1], strict=True))
    return f"""WITH s AS (SELECT line_id, x1, y1, CAST(x2-x1 AS DOUBLE) AS dx, CAST(y2-y1 AS DOUBLE) AS dy FROM ({segments}) WHERE line_id % 2 = 0), e(ax, ay, ex, ey) AS (VALUES {edges}),
      c AS (SELECT line_id, x1, y1, dx, dy, unnest([0.0, 1.0]) AS t FROM s UNION
        SELECT line_id, x1, y1, dx, dy, t FROM (SELECT s.*, ((ax-x1)*(ey-ay) - (ay-y1)*(ex-ax)) / nullif(dx*(ey-ay) - dy*(ex-ax), 0) AS t, ((ax-x1)*dy - (ay-y1)*dx) / nullif(dx*(ey-ay) - dy*(ex-ax), 0) AS u FROM s, e) WHERE t > 0 AND t < 1 AND u BETWEEN 0 AND 1),
      p AS (SELECT *, lead(t) OVER (PARTITION BY line_id ORDER BY t) AS t2 FROM c), m AS (SELECT line_id, t, t2, dx, dy, x1 + (t+t2)/2*dx AS x, y1 + (t+t2)/2*dy AS y FROM p WHERE t2 IS NOT NULL AND (dx <> 0 OR dy <> 0))
      SELECT line_id, count(*) AS parts, round(sum((t2-t)*sqrt(dx*dx + dy*dy)), 2) AS length FROM m WHERE {_ring()} GROUP BY line_id"""
