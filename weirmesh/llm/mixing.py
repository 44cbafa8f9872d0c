"""Mixing sources to target weights by capped water-filling; no Python on the executors.

Targets grow in proportion to weight; a source whose target would pass its most epochs is clamped
there and the excess goes to the others, until all fit. Each document is then taken whole as often
as fits, and a seeded order decides which ones are taken once more, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmesh.plans.staging import stage_table

WEIGHTS, PERCENT, EPOCHS, SEED = (3, 1, 2), 150, 2, 11
WORD = r"[^\x20\x09-\x0D]+"


def seeded(doc_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"|{seed}")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, source_size), a row for each source, with weight and target (double).

    Sources in order, null last, have the weights in turn. Taken by rising size for their weight,
    the first source that its share doesn't overfill sets the level for all that follow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int"))
    s = sizes.withColumns({"k": k, "weight": weight}).withColumn("cap", F.col("source_size") * epochs)
    every, fill = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "budget": F.sum("source_size").over(every) * percent,
        "place": F.row_number().over(fill),
    })
    level = (F.col("budget") - 100 * F.col("clamped")).cast("double") / (100 * F.col("weights")).cast("double")
    s = s.withColumn("fits", level <= F.col("cap") / F.col("weight"))
    first = F.min(F.when(F.col("fits"), F.struct("place", "budget", "clamped", "weights"))).over(every)
    s = s.withColumn("at", first)
    share = (F.col("weight") * (F.col("at.budget") - 100 * F.col("at.clamped"))).cast("double") / (100 * F.col("at.weights")).cast("double")
    return s.select("source", "source_size", "weight", F.when(F.col("place") >= F.col("at.place"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of docs(doc_id, text, source, ..).

    size counts words (null text: 0). taken never passes epochs * size, and a source's sum is its
    target rounded to a word. Rows with equal doc_id are ordered by size; rows that agree in both
    are alike, so reruns give the same rows. Null doc_id and null source are values of their own.
    A source whose documents are all empty has target 0; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = seeded("doc_id", seed)
    sized = stage_table(docs.select("doc_id", "source", size.alias("size"), order.alias("h")), "sizes")
    want = stage_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, epochs), "targets")
    # thousands of buckets in seeded order, so a source of any size is summed up in parallel
    part = sized.withColumn("bucket", F.substring("h", 1, 3))
    sums = part.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("ahead"))
    of = want.select(F.col("source").alias("s"), "source_size", "target")
    base = sums.join(of, sums["s"].eqNullSafe(of["s"])).select(sums["s"], "b", "ahead", "source_size", "target")
    rows = part.join(base, part["source"].eqNullSafe(base["s"]) & (part["bucket"] == base["b"]))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    left = F.round("target").cast("long") - whole * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), left - ahead))
    return rows.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + more).alias("taken"))


#: The same in SQL, for documents, default weights, share and epochs.
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|{SEED}')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, {EPOCHS} * source_size AS cap FROM s),
x AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM w),
y AS (SELECT *, row_number() OVER f AS place, coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
  sum(weight) OVER () - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights, {PERCENT} * sum(source_size) OVER () AS budget
  FROM x WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, k)),
z AS (SELECT *, (SELECT min(place) FROM y WHERE CAST(budget - 100 * clamped AS DOUBLE) / CAST(100 * weights AS DOUBLE) <= CAST(cap AS DOUBLE) / weight) AS first FROM y),
t AS (SELECT source, source_size, CASE WHEN place >= first THEN CAST(weight * (SELECT budget - 100 * clamped FROM z WHERE place = first) AS DOUBLE) / CAST((SELECT 100 * weights FROM z WHERE place = first) AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target FROM z),
c AS (SELECT d.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size, round(target) - whole * source_size - ahead)) AS BIGINT) AS taken FROM c
"""
