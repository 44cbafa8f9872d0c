"""A confirmer over a growing folder of candidates, as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirmesh.operators.manifest import remaining
from weirmesh.sources.files import exists


def confirm_stream(spark: SparkSession, folder: str, schema: str, progress: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]):
    """Scores rows (with a key) of files that arrive in folder, each key once.

    Keys already in the progress table are skipped, so that replayed batches and repeated rows
    add nothing. Processes what is there and stops; call again for what arrives later.
    """

    def batch(df: DataFrame, _: int) -> None:
        fresh = df.dropDuplicates(["key"])
        if exists(spark, progress):
            fresh = remaining(fresh, spark.read.parquet(progress))
        score(fresh).write.mode("append").parquet(progress)

    rows = spark.readStream.schema(schema).json(folder)
    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
