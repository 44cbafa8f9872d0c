"""Tile manifest as an append-only status log, and resumable work on top of it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmesh.constants import RATE_LIMIT_DELAYS, STAGES, STATUSES, TERMINAL_STATUSES
from weirmesh.sources.files import exists

LOG_SCHEMA = "tile_id long, stage string, status string, seq long"


def validate(stage: str | None = None, status: str | None = None) -> None:
    if stage is not None and stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")


def add_tiles(existing: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Insert-or-ignore: rows of new whose key is not there yet, one for each key."""
    key = key or ["tile_id"]
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def set_status(keys: DataFrame, stage: str, status: str, seq: Column) -> DataFrame:
    """Rows to append to the log."""
    validate(stage, status)
    return keys.select("tile_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), seq.alias("seq"))


def latest_status(log: DataFrame) -> DataFrame:
    return log.groupBy("tile_id", "stage").agg(F.max_by("status", "seq").alias("status"))


def pending(tiles: DataFrame, log: DataFrame, stage: str) -> DataFrame:
    """Tiles not done in a stage: failed ones and those without an entry too."""
    validate(stage)
    done = latest_status(log.filter(F.col("stage") == stage)).filter("status = 'done'")
    return tiles.join(done, "tile_id", "left_anti")


def progress_summary(tiles: DataFrame, log: DataFrame) -> DataFrame:
    """One row: total, and done/total for every stage, in one pass over the log."""
    known = latest_status(log).join(tiles.select("tile_id"), "tile_id", "left_semi")
    done = known.agg(*[F.count_if((F.col("stage") == s) & (F.col("status") == "done")).alias(s) for s in STAGES])
    both = tiles.agg(F.count("*").alias("total")).crossJoin(done)
    return both.select("total", *[F.format_string("%d/%d", s, "total").alias(s) for s in STAGES])


def candidate_key(tile: Column, lon: Column, lat: Column) -> Column:
    return F.format_string("%s_%.6f_%.6f", tile, lon, lat)


def match_by_prefix(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """outputs(name, ..) with stem, the smallest of inputs(stem) that name continues after a "_".

    Every beginning of a name that ends before a "_" is a key of an equi-join.
    """
    parts = F.split("name", "_")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    cut = outputs.select("name", F.explode(keys).alias("stem")).filter(F.contains("name", F.lit("_")))
    first = cut.join(inputs.select("stem"), "stem").groupBy("name").agg(F.min("stem").alias("stem"))
    return outputs.join(first, "name", "left")


def terminal(progress: DataFrame, lasting: tuple[str, ...] = TERMINAL_STATUSES) -> DataFrame:
    """Entries that no later run takes up again; errors aren't among them."""
    return progress.filter(F.col("status").isin(*lasting))


def remaining(work: DataFrame, progress: DataFrame, key: str = "key", limit: int | None = None) -> DataFrame:
    """Work without a terminal entry in progress; a limit applies after that."""
    left = work.join(progress.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def chunk_assign(df: DataFrame, key: str, size: int, buckets: int = 256) -> DataFrame:
    """Adds chunk, size rows each, in a stable order: by hash bucket of the key, then by key.

    Only the buckets are numbered as a whole, so no task sorts all rows.
    """
    at = df.withColumn("_b", F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 4), 16, 10).cast("long") % buckets)
    counts = at.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_o", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")  # one row for each bucket
    w = Window.partitionBy("_b").orderBy(key)
    pos = F.coalesce("_o", F.lit(0)) + F.row_number().over(w) - 1
    return at.join(before, "_b").withColumn("chunk", F.floor(pos / size)).drop("_b", "_o")


def worst_case(tiles: DataFrame, key: str, cost: str) -> DataFrame:
    """The most expensive unit, to be probed first; ties go to the smallest key."""
    return tiles.agg(F.max(F.struct(F.col(cost), -F.col(key))).alias("m")).select((-F.col(f"m.col2")).alias(key), F.col(f"m.{cost}").alias(cost))


def excluding(work: DataFrame, key: str, value) -> DataFrame:
    """Work without one unit, as the one that was probed; rows without a key stay."""
    return work.filter(~F.col(key).eqNullSafe(F.lit(value)))


def probe_then_rest(work: DataFrame, key: str, cost: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs the most expensive unit first and, only if it comes out with status OK, the others.

    Raises otherwise, before anything else is begun. Without work nothing is run but an empty table.
    """
    first = worst_case(work.filter(F.col(key).isNotNull() & F.col(cost).isNotNull()), key, cost).first()  # one row
    if first is None or first[key] is None:
        return run(work)
    probe = run(work.filter(F.col(key) == F.lit(first[key])).limit(1))
    rows = probe.collect()  # one row
    if not rows or rows[0]["status"] != "OK":
        raise RuntimeError(f"the probe {first[key]} failed: {rows[0]['status'] if rows else 'no result'}")
    return work.sparkSession.createDataFrame(rows, probe.schema).unionByName(run(excluding(work, key, first[key])))


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row: how many units are done and how many failed."""
    done = F.col("status").isin(*TERMINAL_STATUSES)
    return results.agg(F.count_if(done).alias("done"), F.count_if(~F.coalesce(done, F.lit(False))).alias("failed"))


def namespaced(*parts: Column) -> Column:
    """One key out of several, as country/basin/tile; null if one of them is."""
    return F.when(F.greatest(*[p.isNull() for p in parts]) == F.lit(False), F.concat_ws("/", *parts))


def init_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The status log's table, created empty where there is none yet."""
    if not exists(spark, path):
        spark.createDataFrame([], LOG_SCHEMA).write.parquet(path)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


class RateLimited(Exception):
    """A scorer's service asks to be called less often."""


def _within(seconds: float | None, scorer: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame) -> pd.DataFrame:
    """The scorer's answer, or TimeoutError; a call that hangs is left behind in a thread that ends with the process."""
    if seconds is None:
        return scorer(rows)
    box: dict = {}

    def call() -> None:
        try:
            box["value"] = scorer(rows)
        except Exception as e:  # handed on to the caller
            box["error"] = e

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    if "error" in box:
        raise box["error"]
    if "value" not in box:
        raise TimeoutError(f"no answer within {seconds} s")
    return box["value"]


def score_resumably(
    work: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 8, attempts: int = 3, backoff: float = 2.0,
    rate_limit_delays: tuple[float, ...] = RATE_LIMIT_DELAYS, timeout: float | None = None,
) -> DataFrame:
    """Applies a batched scorer. A batch that keeps failing is retried row by row; rows that fail
    still come out with status ERROR: and the cause, which is no terminal state, so a later run takes
    them again.

    Attempts are backoff, backoff ** 2, .. seconds apart; after RateLimited the delays are longer and
    have a count of their own. timeout bounds each call. scorer returns the rows' key and its result
    columns; schema lists them and ends in status.
    """

    def attempt(rows: pd.DataFrame, tries: int) -> tuple[pd.DataFrame | None, str]:
        failed, limited = 0, 0
        while True:
            try:
                return _within(timeout, scorer, rows).assign(status="OK"), ""
            except RateLimited as e:
                cause, limited = e, limited + 1
                if limited > len(rate_limit_delays):
                    break
                time.sleep(rate_limit_delays[limited - 1])
            except Exception as e:  # any other fault of the scorer
                cause, failed = e, failed + 1
                if failed >= tries:
                    break
                time.sleep(backoff**failed)
        return None, f"ERROR: {type(cause).__name__}: {cause}"[:200]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch]
                got, _ = attempt(rows, attempts)
                if got is not None:
                    yield got
                    continue
                for j in range(len(rows)):
                    one, cause = attempt(rows.iloc[j : j + 1], 1)
                    yield rows.iloc[j : j + 1][["key"]].assign(status=cause) if one is None else one

    names = [x.split()[0] for x in schema.split(",")]
    return work.mapInPandas(lambda it: (p.reindex(columns=names) for p in run(it)), schema)
