"""Python data sources: GeoPackage layers, shapefiles and paged feature services.

Each is registered with register(spark). Files must be in a folder that executors can open.
"""

from __future__ import annotations

import http.client
import json
import sqlite3
import struct
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def wkb_vertices(wkb: bytes) -> tuple[str, list[tuple[float, float]]]:
    """Type name and all vertices of a WKB geometry, multi-part ones flattened."""
    names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}

    def read(at: int) -> tuple[int, list[tuple[float, float]], int]:
        order = "<" if wkb[at] else ">"
        kind = struct.unpack_from(order + "I", wkb, at + 1)[0]
        width, at = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3), at + 5
        kind %= 1000

        def take(at: int, n: int) -> tuple[list[tuple[float, float]], int]:
            v = struct.unpack_from(f"{order}{n * width}d", wkb, at)
            return list(zip(v[::width], v[1::width], strict=True)), at + 8 * n * width

        if kind == 1:
            points, at = take(at, 1)
            return kind, points, at
        n = struct.unpack_from(order + "I", wkb, at)[0]
        at += 4
        if kind == 2:
            points, at = take(at, n)
            return kind, points, at
        out: list[tuple[float, float]] = []
        for _ in range(n):
            if kind == 3:
                m = struct.unpack_from(order + "I", wkb, at)[0]
                points, at = take(at + 4, m)
            else:
                _, points, at = read(at)
            out += points
        return kind, out, at

    kind, points, _ = read(0)
    return names.get(kind, str(kind)), points


def gpkg_wkb(blob: bytes) -> bytes:
    """WKB without the GeoPackage header, whose envelope size is coded in the flags."""
    return blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :]


class GeoPackageSource(DataSource):
    """Options: path, layer (the first feature table if absent), columns (SQL schema of attributes)."""

    @classmethod
    def name(cls) -> str:
        return "weirmesh_gpkg"

    def schema(self) -> str:
        more = self.options.get("columns", "")
        return "fid long, geometry_type string, vertices array<struct<x: double, y: double>>" + (", " + more if more else "")

    def reader(self, schema) -> DataSourceReader:
        return _GeoPackageReader(dict(self.options), [f.name for f in schema.fields[3:]])


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path, self.layer, self.columns, self.rows = options["path"], options.get("layer"), columns, int(options.get("rows_per_partition", 50000))

    def _open(self) -> tuple[sqlite3.Connection, str, str]:
        db = sqlite3.connect(f"file:{urllib.parse.quote(self.path)}?mode=ro", uri=True)
        layer = self.layer or db.execute("select table_name from gpkg_contents where data_type = 'features' order by rowid limit 1").fetchone()[0]
        return db, layer, db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]

    def partitions(self) -> list[InputPartition]:
        db, layer, _ = self._open()
        low, high = db.execute(f'select min(rowid), max(rowid) from "{layer}"').fetchone()
        db.close()
        return [] if low is None else [_Range(i, min(i + self.rows, high + 1)) for i in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        db, layer, geometry = self._open()
        names = "".join(f', "{c}"' for c in self.columns)
        for fid, blob, *rest in db.execute(f'select rowid, "{geometry}"{names} from "{layer}" where rowid >= ? and rowid < ?', (partition.low, partition.high)):
            kind, points = wkb_vertices(gpkg_wkb(blob)) if blob else (None, [])
            yield (fid, kind, [{"x": x, "y": y} for x, y in points], *rest)
        db.close()


class ShapefileSource(DataSource):
    """Option: path of the .shp file. Yields record number, shape type and vertices."""

    @classmethod
    def name(cls) -> str:
        return "weirmesh_shp"

    def schema(self) -> str:
        return "record int, shape_type int, vertices array<struct<x: double, y: double>>"

    def reader(self, schema) -> DataSourceReader:
        return _ShapeReader(self.options["path"])


class _ShapeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(100)
            while len(head := f.read(8)) == 8:
                number, words = struct.unpack(">ii", head)
                body = f.read(2 * words)
                kind = struct.unpack_from("<i", body)[0]
                points: list[tuple[float, ...]] = []
                if kind % 10 == 1:
                    points = [struct.unpack_from("<2d", body, 4)]
                elif kind % 10 in (3, 5):
                    parts, n = struct.unpack_from("<ii", body, 36)
                    v = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
                    points = list(zip(v[::2], v[1::2], strict=True))
                elif kind % 10 == 8:
                    n = struct.unpack_from("<i", body, 36)[0]
                    v = struct.unpack_from(f"<{2 * n}d", body, 40)
                    points = list(zip(v[::2], v[1::2], strict=True))
                yield number, kind, [{"x": p[0], "y": p[1]} for p in points]


class PagedFeatureSource(DataSource):
    """Options: url with {start}, {count}, {bbox} and {layer}; layers (by comma), bboxes (by semicolon),
    page (1000), delay (seconds between pages, 0.2), attempts (3), backoff (2), timeout (90).

    A partition reads one layer in one bbox to its end: until a page is empty, or is short and the
    answer doesn't say that there is more. One feature's JSON for each row. Features that lie in
    several bboxes come once for each.
    """

    @classmethod
    def name(cls) -> str:
        return "weirmesh_paged"

    def schema(self) -> str:
        return "layer string, page int, feature string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _Part(InputPartition):
    def __init__(self, layer: str, bbox: str) -> None:
        self.layer, self.bbox = layer, bbox


def fetch(request: str | urllib.request.Request, attempts: int, backoff: float, timeout: float) -> bytes:
    """An answer's body; a failed call is repeated after backoff, backoff ** 2, .. seconds."""
    for k in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.read()
        except (OSError, http.client.HTTPException):
            if k == attempts:
                raise
            time.sleep(backoff**k)
    raise ValueError("no attempts")


class _ServiceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        number = lambda name, default: float(options.get(name, default))
        self.url, self.page, self.delay = options["url"], int(number("page", 1000)), number("delay", 0.2)
        self.attempts, self.backoff, self.timeout = int(number("attempts", 3)), number("backoff", 2), number("timeout", 90)
        self.layers, self.bboxes = options.get("layers", "").split(","), options.get("bboxes", options.get("bbox", "")).split(";")

    def partitions(self) -> list[InputPartition]:
        return [_Part(layer, bbox) for layer in self.layers for bbox in self.bboxes]


class _PagedReader(_ServiceReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        start, page = 0, 0
        while True:
            quoted = urllib.parse.quote(partition.bbox, safe=",")
            answer = json.loads(fetch(self.url.format(start=start, count=self.page, bbox=quoted, layer=partition.layer), self.attempts, self.backoff, self.timeout))
            if "error" in answer:
                raise RuntimeError(f"the service reports {answer['error']}")
            found = answer.get("features", [])
            for f in found:
                yield partition.layer, page, json.dumps(f)
            start, page = start + len(found), page + 1
            matched = answer.get("numberMatched")
            more = answer.get("exceededTransferLimit") or answer.get("properties", {}).get("exceededTransferLimit") or isinstance(matched, int) and matched > start
            if not found or len(found) < self.page and not more:
                return
            time.sleep(self.delay)


class OverpassSource(DataSource):
    """Options: url, bboxes (south,west,north,east by semicolon), tag (waterway=weir), and those of a
    paged source for attempts. A partition posts one bbox; one element's JSON for each row."""

    @classmethod
    def name(cls) -> str:
        return "weirmesh_overpass"

    def schema(self) -> str:
        return "element string"

    def reader(self, schema) -> DataSourceReader:
        return _OverpassReader(dict(self.options))


class _OverpassReader(_ServiceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.key, _, self.value = options.get("tag", "waterway=weir").partition("=")

    def read(self, partition: _Part) -> Iterator[tuple]:
        wanted = "".join(f'{kind}["{self.key}"="{self.value}"]({partition.bbox});' for kind in ("node", "way"))
        body = f"[out:json][timeout:60];({wanted});out center;".encode()
        answer = json.loads(fetch(urllib.request.Request(self.url, body, {"Content-Type": "text/plain"}), self.attempts, self.backoff, self.timeout))
        for e in answer.get("elements", []):
            yield (json.dumps(e),)


def overpass_records(elements: DataFrame, source: str = "OSM", barrier_type: str = "weir") -> DataFrame:
    """Registry rows out of elements(element): a way lies at its centre; elements without a place go."""
    kind = "struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: string>"
    e = elements.select(F.from_json("element", kind).alias("e"))
    at = lambda c: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit(0.0)), F.col(f"e.center.{c}"))
    out = e.select(
        F.lit(source).alias("source"), F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("source_id"), at("lat").alias("lat"), at("lon").alias("lon"),
        F.lit(barrier_type).alias("barrier_type"), F.coalesce("e.tags", F.lit("{}")).alias("raw_attributes"))
    return out.filter("lat is not null and lon is not null")


def register(spark: SparkSession) -> None:
    for source in (GeoPackageSource, ShapefileSource, PagedFeatureSource, OverpassSource):
        spark.dataSource.register(source)
