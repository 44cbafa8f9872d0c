"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmesh.functions.geodesy import unproject


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False) -> DataFrame:
    """JSON lines; with missing_ok a missing path is an empty table of the same schema."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row for each feature of the collections under path (a glob may be given): the
    properties, geometry_type, and coordinates as JSON text, whose nesting varies by type."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of files with a header each, written side by side; single makes it one file by one task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str, key: str | None = None) -> None:
    """Appends rows; with a key only those whose key isn't there yet, one of each, so that a repeated
    run adds nothing. A null key is a key like any other."""
    if key is not None:
        df = df.dropDuplicates([key])
        if exists(df.sparkSession, path):
            kind = df.schema[key].dataType.simpleString()
            there = df.sparkSession.read.schema(f"`{key}` {kind}").json(path).select(F.col(key).alias("_there"))
            df = df.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti")
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def _write_wrapped(lines: DataFrame, path: str, head: str, tail: str) -> None:
    """A text file for each task: head, the lines with commas between them, tail."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        first = True
        for b in batches:
            rows = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": pa.array([x if first and not i else "," + x for i, x in enumerate(rows)], pa.string())})
            first = first and not rows
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    lines.mapInArrow(wrap, "value string").write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """JSON arrays of row objects, one in each file; read_json_array reads them together."""
    _write_wrapped(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), path, "[", "]")


def write_geojson(df: DataFrame, path: str, geometry_json: str) -> None:
    """GeoJSON feature collections, one in each file; all columns but the geometry are properties."""
    features = feature_collection(df.withColumn("_k", F.lit(0)), geometry_json, "_k").select("feature") if df.columns != [geometry_json] else None
    if features is None:
        raise ValueError("no properties")
    _write_wrapped(features, path, '{"type":"FeatureCollection","features":[', "]}")


def write_layer(df: DataFrame, path: str, layer: str) -> None:
    """A named layer (geometry as WKT or vertices) as a Parquet folder under path; layers don't touch each other."""
    df.write.mode("overwrite").parquet(f"{path}/layer={layer}")


def layers(spark: SparkSession, path: str) -> list[str]:
    """Names of the layers under path, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(x.getPath().getName()[6:] for x in found if x.getPath().getName().startswith("layer="))


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer by name, the first by name without one; no such layer is an error."""
    names = layers(spark, path)
    if not names or layer is not None and layer not in names:
        raise ValueError(f"no layer {layer or ''} in {path}")
    return spark.read.parquet(f"{path}/layer={layer or names[0]}")


def write_jsonl_lonlat(df: DataFrame, path: str, drop: tuple[str, ...] = (), x: str = "x", y: str = "y") -> None:
    """JSON lines without helper columns, plane coordinates turned into lon and lat in degrees."""
    lon, lat = unproject(F.col(x).cast("double"), F.col(y).cast("double"))
    out = df.withColumns({"lon": lon, "lat": lat}).drop(x, y, *drop)
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_mosaic(cells: DataFrame, path: str, tile: str = "tile") -> None:
    """Raster cells as a folder of Parquet for each tile, which scans prune by tile."""
    cells.write.mode("overwrite").partitionBy(tile).parquet(path)


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Each chunk replaces only itself, so that a rerun is idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def feature_collection(df: DataFrame, geometry_json: str, key: str) -> DataFrame:
    """A GeoJSON feature text for each row; a sink writes them as lines."""
    props = [c for c in df.columns if c != geometry_json]
    head = F.concat(F.lit('{"type":"Feature","geometry":'), F.col(geometry_json), F.lit(',"properties":'))
    return df.select(key, F.concat(head, F.to_json(F.struct(*props)), F.lit("}")).alias("feature"))


def from_features(lines: DataFrame, properties: str, feature: str = "feature") -> DataFrame:
    """Properties, geometry_type and coordinates (JSON text) of GeoJSON feature texts; what isn't one is all null."""
    schema = f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"
    f = lines.select(F.from_json(feature, schema).alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and length of files, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def file_name(key: Column, suffix: str = "") -> Column:
    """A file's name out of an id, whose slashes become underscores."""
    return F.concat(F.replace(key, F.lit("/"), F.lit("_")), F.lit(suffix))


def file_stem(path: Column, suffix: str | None = None) -> Column:
    """The last part of a path without its suffix: the given one if it ends in it, else what follows the last dot."""
    name = F.element_at(F.split(path, "/"), -1)
    if suffix is None:
        return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(F.endswith(name, F.lit(suffix)), F.left(name, F.length(name) - len(suffix))).otherwise(name)


def with_file(df: DataFrame, key: str, listing: DataFrame) -> DataFrame:
    """The rows whose file is in a listing(path, ..), by the name that file_name gives it."""
    names = listing.select(file_stem(F.col("path")).alias("_stem")).distinct()
    return df.join(names, file_name(F.col(key)) == F.col("_stem"), "left_semi")


def is_exception(content: Column) -> Column:
    """True for a server's error report sent as an answer: the word stands in the first 500 bytes."""
    return F.contains(F.substring(content, 1, 500).cast("string"), F.lit("Exception"))


def last_line(text: Column, most: int | None = None) -> Column:
    """The last line of a text that isn't blank, cut to most characters; empty without one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    line = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    return line if most is None else F.left(line, F.lit(most))
