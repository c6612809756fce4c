"""Tables as fields: cell views (one row for each cell, index columns i0, i1, ...) of driver tables.

A long first dimension is cut into slabs of SLAB planes. Stencils start anew in each slab, so windows
stay short and slabs run in parallel, whatever the length of the field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLAB = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(df: DataFrame, key: str, order: list[str], x: str, keep: list[str] = ()) -> DataFrame:
    """key, i0 (from 0 in each key), x: one-dimensional fields, one for each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).alias("key"), (F.row_number().over(w) - 1).cast("long").alias("i0"), F.col(x).alias("x"), *keep)


def event_series(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    return series(table(spark, sf_dir, "events"), key, ["ts", "event_id"], "value")


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
    return series(table(spark, sf_dir, "lineitem"), "l_suppkey", order, "l_extendedprice")


def grid(spark: SparkSession, sf_dir: str, edges: tuple[int, ...] = (64,)) -> DataFrame:
    """slab, i0, i1, ..., x: vectors as planes, their 64 values as a grid of the given edges."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("p", "x"))
    cols, rest = [], F.col("p")
    size = 64
    for k, edge in enumerate(edges):
        size //= edge
        cols.append((F.floor(rest / size)).cast("long").alias(f"i{k + 1}"))
        rest = rest % size
    return e.select(F.floor(F.col("i0") / SLAB).cast("long").alias("slab"), "i0", *cols, F.col("x").cast("double").alias("x"))


def dims_of(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if len(c) == 2 and c[0] == "i" and c[1].isdigit())
