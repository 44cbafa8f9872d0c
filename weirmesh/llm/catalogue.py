"""The registered queries of these operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmesh.llm import decontaminate, html_extract, langid, language_model, license_scan, mixing, near_dedup, pipeline, quality, suffix_dedup, toxicity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.judge(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op2_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return language_model.score(docs, language_model.build(docs.filter(~language_model.held_out())))


def op3_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf, "documents"))


def op4_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs.drop("lang"), langid.train(docs))
    return out.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, _table(spark, sf, "labels")))
    return out.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).drop("source")


def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.removal_digest(_table(spark, sf, "documents"))


def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf, "documents"))


def op9_license_passages(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.passages(_table(spark, sf, "documents"))


def op9_license_files(spark: SparkSession, sf: str) -> DataFrame:
    names = _table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return license_scan.scan(license_scan.wrapped_files(names)).select("doc_id", "license")


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf, "benchmark"))
    return found.select("row.doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), "items")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(ops.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    more = {"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}
    return {"op7_mixing": mixing.SQL, "op9_license_scan": license_scan.sql(), "op9_license_passages": license_scan.passages_sql(), "op9_license_files": license_scan.files_sql()} | more
