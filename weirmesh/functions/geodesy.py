"""Transverse Mercator by Krueger's series as Spark expressions, and plane geometry of vertex lists."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 ellipsoid, and the zone 30 north grid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
SCALE, FALSE_EASTING, CENTRAL_MERIDIAN = 0.9996, 500000.0, -3.0

_n = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_ECC = 2 * math.sqrt(_n) / (1 + _n)
_ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
_BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
_DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of longitude and latitude in degrees."""
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    return FALSE_EASTING + SCALE * _RADIUS * east, SCALE * _RADIUS * north


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of easting and northing in metres."""
    xi, eta = y / (SCALE * _RADIUS), (x - FALSE_EASTING) / (SCALE * _RADIUS)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return CENTRAL_MERIDIAN + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def ring_area(ring: Column) -> Column:
    """Area of a closed or open ring array<struct<x, y>> by the shoelace rule."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_centroid(ring: Column) -> Column:
    """struct<x, y> of a ring's centroid; null without area."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, nxt, lambda a, b: F.struct(
        (a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("sx"), (a["y"] + b["y"]).alias("sy")))
    total = lambda f: F.aggregate(F.transform(parts, f), F.lit(0.0), lambda s, v: s + v)
    area3 = F.nullif(total(lambda p: p["c"]) * 3, F.lit(0.0))
    return F.struct((total(lambda p: p["c"] * p["sx"]) / area3).alias("x"), (total(lambda p: p["c"] * p["sy"]) / area3).alias("y"))


def wkt_vertices(wkt: Column) -> Column:
    """array<struct<x, y>> of all vertices in a WKT string."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)? -?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))


def extent(vertices: Column) -> Column:
    """struct<x0, y0, x1, y1> of an array<struct<x, y>>; nulls if it is empty."""
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def line_centroid(parts: Column) -> Column:
    """struct<x, y> of lines array<array<struct<x, y>>>, by length; the mean vertex where they have none, null without vertices."""
    def pieces(line: Column) -> Column:
        return F.zip_with(line, F.slice(line, 2, F.size(line)), lambda a, b: F.when(b["x"].isNotNull(), F.struct(
            F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("w"), ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))))

    return _weighted(F.array_compact(F.flatten(F.transform(parts, pieces))), F.flatten(parts))


def polygon_centroid(polygons: Column) -> Column:
    """struct<x, y> of polygons array<array<ring>>, each an outer ring and its holes; the mean vertex where they have no area."""
    def rings(p: Column) -> Column:
        return F.transform(p, lambda r, i: F.struct((ring_area(r) * F.when(i == 0, 1.0).otherwise(-1.0)).alias("w"), ring_centroid(r).alias("c")))

    parts = F.filter(F.flatten(F.transform(polygons, rings)), lambda r: r["w"] != 0)
    return _weighted(F.transform(parts, lambda r: F.struct(r["w"].alias("w"), r["c"]["x"].alias("x"), r["c"]["y"].alias("y"))), F.flatten(F.flatten(polygons)))


def _weighted(parts: Column, vertices: Column) -> Column:
    total = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, v: s + v)
    n, all_w = F.nullif(F.size(vertices).cast("double"), F.lit(0.0)), F.nullif(total(parts, lambda p: p["w"]), F.lit(0.0))
    at = lambda c: F.coalesce(total(parts, lambda p: p["w"] * p[c]) / all_w, total(vertices, lambda v: v[c].cast("double")) / n)
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def is_empty(vertices: Column) -> Column:
    """True for a geometry without vertices, null included."""
    return F.coalesce(F.size(vertices), F.lit(0)) <= 0
