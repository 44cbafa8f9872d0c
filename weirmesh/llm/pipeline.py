"""Documents to a training mix: language, near copies, repeated passages, benchmark leaks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmesh.llm import decontaminate, langid, mixing, near_dedup, suffix_dedup
from weirmesh.plans.staging import stage_table

LEAST_SCORE = 0.5  # mean probability of the predicted language below which a text is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is predicted with a score of at least LEAST_SCORE."""
    out = langid.identify(docs, langid.train(docs))
    return out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, and one of those whose doc_id and text are equal.

    Rows with one doc_id and texts that are not alike all stay.
    """
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")]
    own = F.struct("doc_id", "h")
    kept = near_dedup.groups(docs).filter(F.col("doc_id").isNotNull() & (F.coalesce("leader", own) == own)).select("doc_id", "h").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key)
    one = rows.join(kept, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return one.select("row.*").unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte of strings of 200 bytes that occur more than once; n_chars follows the text."""
    out = suffix_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("item_id is null").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; documents it doesn't take go."""
    return mixing.mix(docs).filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs


#: Trained and byte-level stages have no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None
