"""Written tables that cut lineage.

They live in the folder the session names in ``spark.checkpoint.dir``, which every executor
shares, so a lost executor loses nothing. Only where that is unset (tests, local runs) a
temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by driver and executors."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="weirmesh-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weirmesh-{name}-{uuid.uuid4().hex}"


def track(path: str) -> str:
    """Has drop_stage_tables delete a path as well."""
    _written.append(path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns the table that was written. Spark first deletes the shuffle files of
    earlier plans that nothing refers to any more."""
    spark = df.sparkSession
    spark.sparkContext._jvm.System.gc()
    path = new_path(spark, name)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_stage_tables(spark: SparkSession) -> int:
    """Deletes the tables this process staged; results that read them can't be used afterwards."""
    n = len(_written)
    while _written:
        drop_path(spark, _written.pop())
    return n


def unstage(df: DataFrame) -> None:
    """Deletes the files of one staged table that no later plan reads."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        for path in [p for p in _written if f.endswith(p.rsplit("/", 1)[1])]:
            drop_path(df.sparkSession, path)
            _written.remove(path)
