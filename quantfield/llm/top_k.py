"""Exact top-k inner products by norm buckets.

Vectors become integer vectors floor(64 * x). Candidates are grouped into buckets of similar length, and buckets
cut into blocks; a stated query set is held against all rows. The k-th best score against the SEED longest candidates is a
lower limit for each query, and the limit divided by the query's length the length that a candidate needs. Queries of
similar need are blocks too, and a block of queries meets once each block of candidates whose longest vector is long
enough. In a block, candidates are in order of length, and a query's end where they are too short (length pruning).
The limit divided by both lengths is the cosine a candidate needs: where it is
high (STEEP or more), only candidates whose value at the query's largest coordinate allows that cosine are kept
(coordinate pruning) in place of it. All products that count are integers, computed exactly.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without vec_id. Rows with one vec_id count once, the smallest vector of them. Vectors of different dimension
never meet. Ties go to the smaller vec_id. Inner products that 64 bits can't hold raise an
error. Empty tables give no rows. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table

SCALE, K, QUERY_EVERY = 64, 20, 20
SEED, CANDIDATES, QUERIES = 1024, 4096, 8192
STEEP = 0.8


def integer_vectors(df: DataFrame) -> DataFrame:
    """vec_id, v (array of double with whole values), dim, norm; one row for each vec_id."""
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and size(e) > 0")
    x = x.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    x = x.groupBy("vec_id").agg(F.min("e").alias("e"))
    floor = F.transform("e", lambda c: F.floor(c * F.lit(float(SCALE))).cast("double"))
    x = x.select("vec_id", floor.alias("v"), F.size("e").alias("dim"))
    return x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most >= 2**62:
        # Whole numbers without limit; those that 64 bits can't hold raise an OverflowError.
        return (np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= limit)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def search_block(q_ids, q, q_norm, limit, c_ids, c, c_norm, k=K):
    """(query, candidate, score) that can be among a query's k best. limit: what a score must reach, for each query."""
    out = []
    down = np.argsort(-c_norm, kind="stable")
    c_ids, c, c_norm = c_ids[down], c[down], c_norm[down]
    longest = c_norm.max(initial=0.0)
    # Rounding of norms must not lose a candidate: bounds are widened by a little.
    alive = np.flatnonzero(q_norm * longest * (1 + 1e-9) + 1e-6 >= limit)
    need = np.where((q_norm > 0) & (longest > 0), limit / np.maximum(q_norm * longest, 1e-300), -1.0) * (1 - 1e-9) - 1e-9
    steep = alive[need[alive] >= STEEP]
    flat = alive[need[alive] < STEEP]
    unit = c / np.maximum(c_norm, 1e-300)[:, None] if len(steep) else None
    for i in steep.tolist():
        f = int(np.abs(q[i]).argmax())
        u, t = q[i, f] / q_norm[i], min(1.0, need[i])
        slack = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - u * u)) + 1e-9
        # A cosine of t or more leaves the unit vector this range at coordinate f, up to 1 or down to -1 where u is that steep itself.
        keep = np.flatnonzero(((unit[:, f] >= u * t - slack) | (u <= -t)) & ((unit[:, f] <= u * t + slack) | (u >= t)))
        out.append((i, keep, exact_products(q[i : i + 1], c[keep])[0]))
    # The length a candidate needs; those of a lesser one are the end of the block.
    length = np.where(q_norm > 0, (limit - 1e-6) / np.maximum(q_norm, 1e-300), -1.0) * (1 - 1e-9)
    flat = flat[np.argsort(length[flat], kind="stable")]
    for j in range(0, len(flat), 64):
        some = flat[j : j + 64]
        n = int(np.searchsorted(-c_norm, -length[some[0]], "right"))
        for i, s in zip(some.tolist(), exact_products(q[some], c[:n])):
            out.append((i, np.arange(n), s))
    found = []
    for i, at, s in out:
        ok = (s >= limit[i]) & (c_ids[at] != q_ids[i])
        at, s = at[ok], s[ok]
        b = best(s, c_ids[at], k)
        found.append((np.full(len(b), q_ids[i]), c_ids[at[b]], s[b]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def blocks(vectors: DataFrame, by: str, rows: int, name: str) -> DataFrame:
    """vectors with a column `name`: about `rows` of one dimension and of similar `by` have one number."""
    bucket = F.when(F.col(by) > 0, F.floor(4 * F.log2(by))).otherwise(F.lit(-(2**30))).cast("long")
    v = vectors.withColumn("bucket", bucket)
    # One row for each dimension and power of 2 ** (1 / 4): a few thousand at most for each dimension.
    sizes = v.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("dim", F.desc("bucket")).collect()
    plan, base = [], 0
    for r in sizes:
        of = -(-r.n // rows)
        plan.append((r.dim, r.bucket, base, of))
        base += of
    plan_df = vectors.sparkSession.createDataFrame(plan, "dim int, bucket long, base long, of long")
    return v.join(F.broadcast(plan_df), ["dim", "bucket"]).withColumn(name, F.col("base") + F.pmod(F.xxhash64("vec_id"), "of")).drop("bucket", "base", "of")


def unpacked(items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = items.field("v")
    ids = items.field("vec_id").to_numpy()
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), items.field("norm").to_numpy()


def top_k(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    vectors = materialize(integer_vectors(embeddings), "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0)
    # SEED rows at most: they only set limits, all candidates are met below.
    seed = vectors.orderBy(F.desc("norm"), "vec_id").limit(SEED).collect()
    seeds: dict[int, tuple] = {}
    for d in {r.dim for r in seed}:
        rs = [r for r in seed if r.dim == d]
        seeds[d] = np.array([r.vec_id for r in rs]), np.array([r.v for r in rs])
    shared = spark.sparkContext.broadcast(seeds)

    def limits(batches):
        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            out = []
            for i, x in zip(ids.tolist(), v.to_pylist()):
                c_ids, c = shared.value.get(len(x), (np.zeros(0, np.int64), np.zeros((0, len(x)))))
                s = np.sort(exact_products(np.array([x]), c)[0][c_ids != i])
                out.append(float(s[-k]) if len(s) >= k else -float("inf"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=["vec_id", "v", "dim", "norm", "limit"])

    limited = queries.select("vec_id", "v", "dim", "norm").mapInArrow(limits, "vec_id long, v array<double>, dim int, norm double, limit double")
    need = F.when(F.col("norm") > 0, F.greatest(F.lit(0.0), (F.col("limit") - 1e-6) / F.col("norm"))).otherwise(F.lit(0.0))
    asked = blocks(materialize(limited.withColumn("need", need), "limited"), "need", QUERIES, "qblock")
    offered = blocks(vectors, "norm", CANDIDATES, "block")
    # Blocks of queries meet the blocks whose longest vector can reach what one of them needs; the others are passed over whole.
    shortest = asked.groupBy("qblock", "dim").agg(F.min("need").alias("need"))
    longest = offered.groupBy("block", "dim").agg(F.max("norm").alias("longest"))
    pairs = shortest.join(longest, "dim").where(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("need")).select("qblock", "block")
    q_blocks = asked.groupBy("qblock").agg(F.collect_list(F.struct("vec_id", "v", "norm", "limit")).alias("asked"))
    c_blocks = offered.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v", "norm")).alias("items"))
    met = pairs.join(q_blocks, "qblock").join(c_blocks, "block").select("asked", "items").repartition(partitions(spark))

    def search(batches):
        for b in batches:
            for r in range(b.num_rows):
                asked, items = b.column(0)[r].values, b.column(1)[r].values
                got = search_block(*unpacked(asked), asked.field("limit").to_numpy(), *unpacked(items), k)
                for i in range(0, len(got[0]), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 10_000], pa.int64()) for x in got], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH v AS (
  SELECT vec_id, min(e) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0)
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY vec_id),
i AS (SELECT vec_id, list_transform(e, lambda x: floor({SCALE}e0 * x)) AS v FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM i q JOIN i c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
