"""The driver's tables, and plane fixtures derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Moduli of the polynomial coordinates: sparse for fusion, dense for suppression.
SPARSE, DENSE = (24007, 24019), (3001, 3011)
#: Fixed ring of the test polygon.
RING = [(200, 100), (2400, 300), (2800, 1500), (2000, 1300), (2300, 2700), (900, 2900), (100, 1800), (700, 1100)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(k: Column, p: tuple[int, int]) -> list[Column]:
    """x = (7919 k^2 + 31 k) % p[0] and y = (271 k^3 + 17 k) % p[1], of remainders, as the cube of a key
    beyond 320,000 outgrows a long. A negative key's remainder is negative, so the signs stay."""
    a, b = k.cast("long") % p[0], k.cast("long") % p[1]
    return [((a * a * 7919 + a * 31) % p[0]).alias("x"), ((b * b % p[1] * b * 271 + b * 17) % p[1]).alias("y")]


def registry(spark: SparkSession, sf: str, p: tuple[int, int] = SPARSE) -> DataFrame:
    """source, source_id, priority, x, y, barrier_type out of supplier, customer and small parts."""

    def part(df: DataFrame, source: str, key: str, offset: int, rank: int | None, kind: str) -> DataFrame:
        at = place(F.col(key) + offset, p)
        return df.select(F.lit(source).alias("source"), F.concat(F.lit(source + "_"), key).alias("source_id"), F.lit(rank).cast("int").alias("priority"), *at, F.col(kind).cast("string").alias("barrier_type"))

    a = part(load(spark, sf, "supplier"), "A", "s_suppkey", 0, 0, "s_nationkey")
    b = part(load(spark, sf, "customer"), "B", "c_custkey", 5000, 1, "c_mktsegment")
    c = part(load(spark, sf, "part").filter("p_size <= 10"), "C", "p_partkey", 40000, None, "p_type")
    return a.unionByName(b).unionByName(c)


def candidates(spark: SparkSession, sf: str, p: tuple[int, int] = SPARSE) -> DataFrame:
    """id, layer, x, y, confidence, source_ref out of events."""
    e = load(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("layer"), *place(F.col("event_id"), p), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), F.concat(F.lit("t"), "user_id").alias("source_ref"))


def segments(spark: SparkSession, sf: str, p: tuple[int, int] = SPARSE) -> DataFrame:
    """line_id, x1, y1, x2, y2, strahler out of supplier."""
    s = load(spark, sf, "supplier")
    x, y = place(F.col("s_suppkey") + 100, p)
    return s.select(F.col("s_suppkey").alias("line_id"), x.alias("x1"), y.alias("y1"), F.nullif(F.col("s_nationkey") % 11, F.lit(0)).alias("strahler"), "s_suppkey").select(
        "line_id", "x1", "y1", (F.col("x1") + (F.col("s_suppkey") % 7) * 200 - 600).alias("x2"), (F.col("y1") + (F.col("s_suppkey") % 5) * 250 - 500).alias("y2"), "strahler")


def water_cells(spark: SparkSession, sf: str) -> DataFrame:
    """row, col, green, nir medians out of lineitem."""
    li = load(spark, sf, "lineitem")
    nir = 3 * (F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100)) + 0.0
    obs = li.select((F.col("l_partkey") % 200).alias("row"), (F.col("l_suppkey") % 100).alias("col"), F.col("l_quantity").alias("green"), nir.alias("nir"))
    return obs


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    from weirmesh.constants import STAGES

    o = load(spark, sf, "orders")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    return o.select(F.col("o_custkey").alias("tile_id"), stage.alias("stage"), status.alias("status"), F.col("o_orderkey").alias("seq"))


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("tile_id"), F.concat(F.lit("tile_"), F.col("c_custkey")).alias("name"))
