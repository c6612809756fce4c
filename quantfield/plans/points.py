"""Bounds, quantizers, filters and distortion metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import bound, code, d, lattice, recovered
from ..operators.fields import event_series, grid, price_series, series, table
from .sqltext import EVENTS, PRICES, code as sql_code, grid as sql_grid, lattice as sql_lattice

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


BOUNDS = {
    "bound_abs": (("ABS", {"abs_bound": 0.5}), "0.5e0"),
    "bound_rel": (("REL", {"rel_bound": 2.0**-7}), "0.0078125e0 * (max(value) - min(value))"),
    "bound_psnr": (("PSNR", {"psnr": 60.0}), "(max(value) - min(value)) * pow(10e0, -(60e0 + 10e0 * log10(1e0 - 0.66e0)) / 20e0)"),
    "bound_l2": (("L2NORM", {"l2": 4.0}), "sqrt(3e0 / count(*)) * 4e0"),
    "bound_abs_and_rel": (("ABS_AND_REL", {"abs_bound": 0.5, "rel_bound": 2.0**-7}), "least(0.5e0, 0.0078125e0 * (max(value) - min(value)))"),
    "bound_abs_or_rel": (("ABS_OR_REL", {"abs_bound": 0.5, "rel_bound": 2.0**-7}), "greatest(0.5e0, 0.0078125e0 * (max(value) - min(value)))"),
}


def _bound(mode: str, args: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        finite = table(spark, sf_dir, "events").where("not isnan(value)")
        agg = finite.groupBy("event_type").agg((F.max("value") - F.min("value")).alias("value_range"), F.count("value").alias("n"))
        return agg.select("event_type", "n", F.round(bound(mode, F.col("value_range"), F.col("n"), **args), 9).alias("eb"))

    return run


for _name, (_args, _sql) in BOUNDS.items():
    query(_name, f"SELECT event_type, count(value) AS n, round({_sql}, 9) AS eb FROM events WHERE NOT isnan(value) GROUP BY event_type")(_bound(*_args))


@query("range_by_series", "SELECT user_id AS key, max(value) - min(value) AS value_range, count(*) AS n FROM events GROUP BY user_id")
def range_by_series(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg((F.max("value") - F.min("value")).alias("value_range"), F.count(F.lit(1)).alias("n"))


@query("nopred_quantize", f"SELECT code, count(*) AS n FROM (SELECT {sql_code('0e0', 0.5, 32768)} AS code FROM (SELECT value AS x FROM events)) GROUP BY code")
def nopred_quantize(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(code(F.col("value"), d(0), 0.5).alias("code"))
    return e.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("nopred_recover", f"SELECT l_orderkey, l_linenumber, l_partkey, x, code, CASE WHEN code <> 0 THEN 2e0 * (code - 32768) ELSE x END AS back FROM (SELECT *, {sql_code('0e0', 1.0, 32768)} AS code FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x FROM lineitem))")
def nopred_recover(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"))
    x = x.withColumn("code", code(F.col("x"), d(0), 1.0))
    return x.withColumn("back", recovered(F.col("code"), d(0), F.col("x"), 1.0))


@query("nopred_int_field", f"SELECT p_partkey, {sql_code('0e0', 2.0, 32768)} AS code FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)")
def nopred_int_field(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", code(F.col("p_size").cast("double"), d(0), 2.0).alias("code"))


@query("unpredictable_cells", f"SELECT key, count(*) AS n, count(*) FILTER (WHERE code = 0) AS kept_raw FROM (SELECT key, {sql_code('0e0', 1.0, 16384)} AS code FROM {PRICES}) GROUP BY key")
def unpredictable_cells(spark, sf_dir):
    x = price_series(spark, sf_dir).select("key", code(F.col("x"), d(0), 1.0, 16384).alias("code"))
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("code") == 0, 1)).alias("kept_raw"))


@query("prefilter_clamp", "SELECT event_id, CASE WHEN value BETWEEN 10e0 AND 90e0 THEN value ELSE 50e0 END AS x FROM events")
def prefilter_clamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("value").between(10.0, 90.0), F.col("value")).otherwise(d(50)).alias("x"))


@query("transpose_axes", f"SELECT i2 AS j0, i0 AS j1, i1 AS j2, x FROM {sql_grid((8, 8))}")
def transpose_axes(spark, sf_dir):
    """Axes permuted: a field is its index columns, so they are renamed."""
    return grid(spark, sf_dir, (8, 8)).select(F.col("i2").alias("j0"), F.col("i0").alias("j1"), F.col("i1").alias("j2"), "x")


@query("constant_block_filter", f"SELECT i0 // 8 AS b0, i1 // 8 AS b1, max(x) - min(x) AS spread FROM {sql_grid()} GROUP BY ALL HAVING max(x) - min(x) > 0.5e0")
def constant_block_filter(spark, sf_dir):
    b = grid(spark, sf_dir).groupBy(F.floor(F.col("i0") / 8).cast("long").alias("b0"), F.floor(F.col("i1") / 8).cast("long").alias("b1"))
    return b.agg((F.max("x") - F.min("x")).alias("spread")).where("spread > 0.5e0")


@query("log_relative_transform", "SELECT o_orderkey, sign(o_totalprice)::INTEGER AS sgn, CASE WHEN o_totalprice = 0 THEN NULL ELSE floor(log2(abs(o_totalprice)) / (2e0 * 0.0078125e0) + 0.5e0)::BIGINT END AS q FROM orders")
def log_relative_transform(spark, sf_dir):
    """Point-wise relative bounds: signs apart, magnitudes quantized by their logarithms."""
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.signum(x).cast("int").alias("sgn"), F.when(x != 0, lattice(F.log2(F.abs(x)), 2.0**-7)).alias("q"))


def _reconstructed(spark, sf_dir):
    return event_series(spark, sf_dir).withColumn("back", lattice(F.col("x"), 0.5) * d(1.0))


BACK = f"(SELECT *, q * 1e0 AS back FROM {sql_lattice(EVENTS, 0.5)})"


@query("verify_metrics", f"""SELECT max(abs(back - x)) AS max_err, round(max(abs(back - x)) / (max(x) - min(x)), 9) AS max_rel, round(avg((back - x) * (back - x)), 6) AS mse,
 round(20e0 * log10(max(x) - min(x)) - 10e0 * log10(avg((back - x) * (back - x))), 6) AS psnr, round(sqrt(avg((back - x) * (back - x))) / (max(x) - min(x)), 9) AS nrmse,
 round(sqrt(sum((back - x) * (back - x))) / sqrt(sum(back * back)), 9) AS l2_rel, round(corr(x, back), 9) AS correlation FROM {BACK}""")
def verify_metrics(spark, sf_dir):
    e = F.col("back") - F.col("x")
    a = _reconstructed(spark, sf_dir).agg(F.max(F.abs(e)).alias("max_err"), (F.max("x") - F.min("x")).alias("r"), F.avg(e * e).alias("mse0"), F.sqrt(F.sum(e * e)).alias("l2"), F.sqrt(F.sum(F.col("back") * F.col("back"))).alias("l2b"), F.corr("x", "back").alias("c"))
    psnr = F.when((F.col("mse0") > 0) & (F.col("r") > 0), d(20) * F.log10("r") - d(10) * F.log10("mse0"))
    return a.select("max_err", F.round(F.try_divide("max_err", "r"), 9).alias("max_rel"), F.round("mse0", 6).alias("mse"), F.round(psnr, 6).alias("psnr"), F.round(F.try_divide(F.sqrt("mse0"), F.col("r")), 9).alias("nrmse"), F.round(F.try_divide("l2", "l2b"), 9).alias("l2_rel"), F.round("c", 9).alias("correlation"))


@query("verify_pointwise_rel", f"SELECT key, round(max(CASE WHEN x <> 0 THEN abs(back - x) / abs(x) END), 9) AS max_pw_rel FROM {BACK} GROUP BY key")
def verify_pointwise_rel(spark, sf_dir):
    x = F.col("x")
    return _reconstructed(spark, sf_dir).groupBy("key").agg(F.round(F.max(F.when(x != 0, F.abs(F.col("back") - x) / F.abs(x))), 9).alias("max_pw_rel"))


@query("error_autocorr", f"""SELECT key, round(coalesce((sum((e - m) * (nxt - m)) / nullif(count(*) - 1, 0)) / nullif(avg((e - m) * (e - m)), 0), 0), 6) AS lag1 FROM (
 SELECT key, back - x AS e, avg(back - x) OVER (PARTITION BY key) AS m, lead(back - x) OVER (PARTITION BY key ORDER BY i0) AS nxt FROM {BACK}) GROUP BY key""")
def error_autocorr(spark, sf_dir):
    e = _reconstructed(spark, sf_dir).select("key", "i0", (F.col("back") - F.col("x")).alias("e"))
    e = e.withColumn("m", F.avg("e").over(Window.partitionBy("key"))).withColumn("nxt", F.lead("e").over(Window.partitionBy("key").orderBy("i0")))
    a, b = F.col("e") - F.col("m"), F.col("nxt") - F.col("m")
    return e.groupBy("key").agg(F.round(F.coalesce(F.try_divide(F.try_divide(F.sum(a * b), F.count(F.lit(1)) - 1), F.avg(a * a)), d(0)), 6).alias("lag1"))


@query("chunked_rel_vs_global_rel", "SELECT event_type, round(0.0078125e0 * (max(value) - min(value)), 9) AS eb, round(0.0078125e0 * (SELECT max(value) - min(value) FROM events), 9) AS global_eb FROM events GROUP BY event_type")
def chunked_rel_vs_global_rel(spark, sf_dir):
    """A relative bound for each chunk, and the bound that the whole field gives: partial ranges, then one range."""
    part = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    whole = part.agg((F.max("hi") - F.min("lo")).alias("r"))  # one row
    return part.join(F.broadcast(whole), F.lit(True)).select("event_type", F.round(d(2.0**-7) * (F.col("hi") - F.col("lo")), 9).alias("eb"), F.round(d(2.0**-7) * F.col("r"), 9).alias("global_eb"))


def int_series(spark, sf_dir):
    return series(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "user_id")
