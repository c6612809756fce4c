"""Mixing sources to target weights: repetition rates from each source's words, then whole copies.

A source's rate is its target over its size; every document is emitted floor(rate) times, and once
more with probability rate - floor(rate), decided by the hash of its id. The hash gives a number u in
[0, 1); the draw is (u + k / DRAWS) mod 1 < fraction, where k is, for each source, the one of DRAWS
rotations whose words come nearest the target (ties: smallest). Each rotation is a fair draw; choosing
among them keeps small sources near their targets too.

Defined results: a null source is a source of its own, last in order. Null or empty texts have size 0
and copies like any other. Rows with one doc_id share their draw. A source of size 0 has target 0. An
empty table gives no rows. Columns besides doc_id, source and text pass through `mix` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE, MOST, DRAWS = 1.5, 2.0, 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """52 bits of the id's md5, as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row for each source.

    The shares that stop at MOST times the size are those with the smallest MOST * size / weight: with
    sources in that order, `level` is what a unit of weight gets if all before a row have stopped."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")))
    src = src.withColumn("most", F.lit(MOST) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    run = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("total", F.lit(TOTAL_SHARE) * F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(run), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(run), F.lit(0.0))))
    src = src.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return src.select("source", "source_size", F.least("most", F.col("final") * F.col("weight")).alias("target"))


def rates(sized: DataFrame) -> DataFrame:
    """source, source_size, target, whole, part, turn: what each document of a source needs for its copies.

    sized: source, size, u. One row for each source; the draws' sums are pre-aggregated by each task."""
    t = targets(sized).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    t = t.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    drawn = sized.join(t.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s")))
    sums = drawn.groupBy("source").agg(*[F.sum(F.when(turned("u", k) < F.col("part"), F.col("size")).otherwise(F.lit(0))).alias(f"d{k}") for k in range(DRAWS)])
    sums = sums.withColumnRenamed("source", "s")
    t = t.join(sums, F.col("source").eqNullSafe(F.col("s")))
    off = F.array(*[F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"d{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)])
    return t.select("source", "source_size", "target", "whole", "part", F.array_min(off)["k"].alias("turn"))


def turned(u: str, k: int | Column) -> Column:
    x = F.col(u) + (F.lit(k / DRAWS) if isinstance(k, int) else k / F.lit(float(DRAWS)))
    return x - F.floor(x)


def copies(u: str) -> Column:
    return F.col("whole") + F.when(turned(u, F.col("turn")) < F.col("part"), F.lit(1)).otherwise(F.lit(0))


def sizes(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size"), uniform(F.col("doc_id")).alias("u")), "mix-sizes")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: documents of docs, each as often as the mix takes it, with docs' columns."""
    r = F.struct("source_size", "target", "whole", "part", "turn").alias("__rate")
    rated = rates(sizes(docs)).select(F.col("source").alias("__source"), r)
    kept = docs.join(rated, docs["source"].eqNullSafe(F.col("__source"))).withColumn("__u", uniform(docs["doc_id"]))
    n = F.col("__rate.whole") + F.when(turned("__u", F.col("__rate.turn")) < F.col("__rate.part"), F.lit(1)).otherwise(F.lit(0))
    kept = kept.withColumn("__n", n.cast("int")).where("__n > 0")
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sizes(table(spark, sf_dir, "documents"))
    r = rates(sized).withColumnRenamed("source", "s")
    got = sized.join(r, F.col("source").eqNullSafe(F.col("s")))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * copies("u")).cast("long").alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0 AS u
  FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s2 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
         2e0 * source_size AS most FROM s1),
s3 AS (SELECT *, most / weight AS ratio, 1.5e0 * (SELECT sum(source_size)::DOUBLE FROM s1) AS total, (SELECT sum(weight) FROM s2) AS weights FROM s2),
s4 AS (
  SELECT *, (total - coalesce(sum(most) OVER w, 0e0)) / (weights - coalesce(sum(weight) OVER w, 0e0)) AS level FROM s3
  WINDOW w AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM s4 WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
t AS (
  SELECT source, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate
        FROM (SELECT source, source_size, least(most, (SELECT level FROM f) * weight) AS target FROM s4))),
k AS (SELECT unnest(range(16)) AS k),
o AS (
  SELECT t.source, k, any_value(t.whole) * any_value(t.source_size) + sum(CASE WHEN (u + k / 16e0) - floor(u + k / 16e0) < part THEN size ELSE 0 END) - any_value(target) AS diff
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN k GROUP BY t.source, k),
b AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(diff), k) AS r FROM o) WHERE r = 1)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN (u + k / 16e0) - floor(u + k / 16e0) < part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
