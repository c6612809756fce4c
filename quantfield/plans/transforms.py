"""Wavelets, logarithms, axes, bits, bounds that differ by cell, and further stencils."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.expressions import d
from ..operators import wavelet
from ..operators.fields import event_series, grid, price_series, table
from .sqltext import EVENTS, PRICES, code as sql_code, grid as sql_grid, lattice as sql_lattice

QUERIES, ORACLES = {}, {}
EBG = 2.0**-7


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


SIZE = 64


def _wave_sql() -> str:
    """The levels one after the other, each from the table of the one before."""
    steps, n, kept = ["w64 AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings)"], SIZE, []
    while n > 2:
        part = lambda taps: "[" + " + ".join(f"s[(2 * k + {j}) % {n} + 1] * {t!r}e0" for j, t in enumerate(taps)) + f" FOR k IN range({n // 2})]"  # noqa: E731, B023
        steps.append(f"w{n // 2} AS MATERIALIZED (SELECT vec_id{''.join(', ' + c for c in kept)}, {part(wavelet.DETAIL)} AS d{n // 2}, {part(wavelet.TAPS)} AS s FROM w{n})")
        n //= 2
        kept.append(f"d{n}")
    return f"WITH {', '.join(steps)} SELECT vec_id, p - 1 AS p, round((s || d2 || d4 || d8 || d16 || d32)[p], 6) + 0e0 AS w FROM w2, (SELECT unnest(range(1, {SIZE + 1})) AS p)"


@query("wavelet_forward", _wave_sql())
def wavelet_forward(spark, sf_dir):
    """All coefficients of each vector, smooth ones first."""
    w = wavelet.on_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIZE)
    w = w.select("vec_id", F.posexplode("w").alias("p", "w"))
    return w.select("vec_id", F.col("p").cast("long").alias("p"), (F.round("w", 6) + d(0)).alias("w"))


@query("wavelet_roundtrip", f"SELECT i0 AS vec_id, i1 AS p, round(x, 6) + 0e0 AS x FROM {sql_grid()}")
def wavelet_roundtrip(spark, sf_dir):
    w = wavelet.on_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIZE)
    back = wavelet.on_vectors(w, "vec_id", "w", SIZE, back=True).select("vec_id", F.posexplode("w").alias("p", "x"))
    return back.select("vec_id", F.col("p").cast("long").alias("p"), (F.round("x", 6) + d(0)).alias("x"))


# --- point-wise relative bounds --------------------------------------------------------------------------------
PW = 2.0**-7
_LB = f"log2(1e0 + {PW!r}e0)"


@query("log_relative_roundtrip", f"""SELECT o_orderkey, round(back, 4) AS back, abs(back - x) <= {PW * (1 + 1e-9)!r}e0 * abs(x) AS within FROM (SELECT *, CASE WHEN x = 0 THEN 0e0 ELSE sign(x) * pow(2e0, 2e0 * {_LB} * floor(log2(abs(x)) / (2e0 * {_LB}) + 0.5e0)) END AS back
 FROM (SELECT o_orderkey, o_totalprice AS x FROM orders))""")
def log_relative_roundtrip(spark, sf_dir):
    """Signs and quantized logarithms back to values: with the bound log2(1 + e) each is within e of its own size; zeros stay zeros."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    b = F.log2(d(1) + d(PW))
    back = F.when(F.col("x") == 0, d(0)).otherwise(F.signum("x") * F.pow(d(2), d(2) * b * F.floor(F.log2(F.abs("x")) / (d(2) * b) + d(0.5))))
    return x.withColumn("back", back).select("o_orderkey", F.round("back", 4).alias("back"), (F.abs(F.col("back") - F.col("x")) <= d(PW * (1 + 1e-9)) * F.abs("x")).alias("within"))


# --- axes and bits ---------------------------------------------------------------------------------------------
@query("axes_apart", f"SELECT i1 % 3 AS axis, i0, i1 // 3 AS atom, x FROM {sql_grid()} WHERE i1 < 63")
def axes_apart(spark, sf_dir):
    """Frames of atoms of three coordinates (the first 63 values of a vector) as three fields, one for each axis."""
    return grid(spark, sf_dir).where("i1 < 63").select((F.col("i1") % 3).alias("axis"), "i0", F.floor(F.col("i1") / 3).cast("long").alias("atom"), "x")


@query("axes_together", f"SELECT i0, i1 // 3 AS atom, max(x) FILTER (i1 % 3 = 0) AS x, max(x) FILTER (i1 % 3 = 1) AS y, max(x) FILTER (i1 % 3 = 2) AS z FROM {sql_grid()} WHERE i1 < 63 GROUP BY 1, 2")
def axes_together(spark, sf_dir):
    pick = lambda k: F.max(F.when(F.col("axis") == k, F.col("v")))
    return axes_apart(spark, sf_dir).withColumnRenamed("x", "v").groupBy("i0", "atom").agg(pick(0).alias("x"), pick(1).alias("y"), pick(2).alias("z"))


@query("float_bits", "SELECT event_id, (value::FLOAT::BIT)::VARCHAR AS bits FROM events")
def float_bits(spark, sf_dir):
    """The 32 bits of each value as a float, sign first."""
    whole = F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), F.col("value").cast("float")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.lpad(F.bin(whole.bitwiseAND(F.lit(0xFFFFFFFF))), 32, "0").alias("bits"))


# --- quantizers --------------------------------------------------------------------------------------------------
def _anchor(stride: int):
    return (F.col("i0") % stride == 0) & (F.col("i1") % stride == 0)


@query("quantize_anchors", f"SELECT i0, i1, CASE WHEN i0 % 32 = 0 AND i1 % 32 = 0 THEN 0 ELSE {sql_code('0e0', EBG, 32768)} END AS code, CASE WHEN i0 % 32 = 0 AND i1 % 32 = 0 THEN x END AS raw FROM {sql_grid()}")
def quantize_anchors(spark, sf_dir):
    """Anchors are kept raw, under code 0, whatever the quantizer could do."""
    x = F.col("x")
    return grid(spark, sf_dir).select("i0", "i1", F.when(_anchor(32), F.lit(0)).otherwise(E.code(x, d(0), EBG)).cast("long").alias("code"), F.when(_anchor(32), x).alias("raw"))


@query("quantize_by_level", f"SELECT i0, i1, {sql_code('0e0', 'eb', 32768)} AS code FROM (SELECT *, CASE WHEN i0 % 2 = 0 AND i1 % 2 = 0 THEN {EBG / 2!r}e0 ELSE {EBG!r}e0 END AS eb FROM {sql_grid()})")
def quantize_by_level(spark, sf_dir):
    """Coarse cells under half the bound of the others."""
    eb = F.when((F.col("i0") % 2 == 0) & (F.col("i1") % 2 == 0), d(EBG / 2)).otherwise(d(EBG))
    return grid(spark, sf_dir).withColumn("eb", eb).select("i0", "i1", E.code(F.col("x"), d(0), F.col("eb")).alias("code"))


@query("quantize_relaxed", f"SELECT i0, key, {sql_code('7e0', 0.1, 32768, 1.1)} AS code FROM {PRICES}")
def quantize_relaxed(spark, sf_dir):
    """Errors of up to 1.1 times the bound are let through."""
    return price_series(spark, sf_dir).select("i0", "key", E.code(F.col("x"), d(7), 0.1, slack=1.1).alias("code"))


@query("batch_relative_bounds", f"SELECT i0, i1, eb, {sql_code('0e0', 'eb', 32768)} AS code FROM (SELECT i0, i1, x, 0.0078125e0 * (max(x) OVER b - min(x) OVER b) AS eb FROM {sql_grid()} WINDOW b AS (PARTITION BY i0 // 16))")
def batch_relative_bounds(spark, sf_dir):
    """Batches of 16 frames, each under the bound that its own range gives."""
    g = grid(spark, sf_dir).withColumn("batch", F.floor(F.col("i0") / 16))
    r = g.groupBy("batch").agg((d(2.0**-7) * (F.max("x") - F.min("x"))).alias("eb"))
    return g.join(r, "batch").select("i0", "i1", "eb", E.code(F.col("x"), d(0), F.col("eb")).alias("code"))


# --- stencils ----------------------------------------------------------------------------------------------------
_FOUR = f"(SELECT key, i0, x, lag(x, 3) OVER w AS a, lag(x) OVER w AS b, lead(x) OVER w AS c, lead(x, 3) OVER w AS e FROM {EVENTS} WINDOW w AS (PARTITION BY key ORDER BY i0))"
_SL = lambda p, q: f"CASE WHEN ({p}) * ({q}) > 0 THEN 2e0 * ({p}) * ({q}) / (({p}) + ({q})) ELSE 0e0 END"


@query("interp_pchip", f"SELECT key, i0, round((b + c) / 2e0 + ({_SL('b - a', 'c - b')} - {_SL('c - b', 'e - c')}) / 8e0, 6) AS pred FROM {_FOUR} WHERE i0 % 2 = 1 AND a IS NOT NULL AND e IS NOT NULL")
def interp_pchip(spark, sf_dir):
    """Monotone cubic. With its correction left out it is the linear stencil."""
    w = Window.partitionBy("key").orderBy("i0")
    f = event_series(spark, sf_dir).select("key", "i0", F.lag("x", 3).over(w).alias("a"), F.lag("x").over(w).alias("b"), F.lead("x").over(w).alias("c"), F.lead("x", 3).over(w).alias("e"))
    f = f.where("i0 % 2 = 1 and a is not null and e is not null")
    return f.select("key", "i0", F.round(E.pchip(*[F.col(c) for c in "abce"]), 6).alias("pred"))


@query("cluster_cost", """SELECT event_type, cell, round(sum(n * cell * cell) OVER w - sum(n * cell) OVER w * (sum(n * cell) OVER w) / sum(n) OVER w, 4) AS cost FROM (SELECT event_type, floor(value)::DOUBLE AS cell, count(*)::DOUBLE AS n FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY cell)""")
def cluster_cost(spark, sf_dir):
    """Squared distance from their mean of all values up to a cell, by running sums over cells of width 1."""
    h = table(spark, sf_dir, "events").groupBy("event_type", F.floor("value").cast("double").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy("event_type").orderBy("cell")
    s = lambda c: F.sum(c).over(w)
    n, x, xx = s("n"), s(F.col("n") * F.col("cell")), s(F.col("n") * F.col("cell") * F.col("cell"))
    return h.select("event_type", "cell", F.round(xx - x * x / n, 4).alias("cost"))


@query("verify_safe", f"""SELECT key, max_err, CASE WHEN mse = 0 THEN 'inf' WHEN r = 0 THEN 'none' ELSE 'finite' END AS psnr_kind, CASE WHEN mse > 0 AND r > 0 THEN round(20e0 * log10(r) - 10e0 * log10(mse), 6) END AS psnr, CASE WHEN r > 0 THEN round(sqrt(mse) / r, 9) ELSE 0e0 END AS nrmse
 FROM (SELECT key, max(abs(q * 1e0 - x)) AS max_err, avg((q * 1e0 - x) * (q * 1e0 - x)) AS mse, max(x) - min(x) AS r FROM {sql_lattice(EVENTS, 0.5)} GROUP BY key)""")
def verify_safe(spark, sf_dir):
    """Distortion of each series, defined where it is constant or without error: no division by zero."""
    x = event_series(spark, sf_dir).withColumn("err", E.lattice(F.col("x"), 0.5) * d(1.0) - F.col("x"))
    a = x.groupBy("key").agg(F.max(F.abs("err")).alias("max_err"), F.avg(F.col("err") * F.col("err")).alias("mse"), (F.max("x") - F.min("x")).alias("r"))
    usable = (F.col("mse") > 0) & (F.col("r") > 0)
    kind = F.when(F.col("mse") == 0, "inf").when(F.col("r") == 0, "none").otherwise("finite")
    psnr = F.when(usable, F.round(d(20) * F.log10("r") - d(10) * F.log10("mse"), 6))
    return a.select("key", "max_err", kind.alias("psnr_kind"), psnr.alias("psnr"), F.coalesce(F.when(F.col("r") > 0, F.round(F.sqrt("mse") / F.col("r"), 9)), d(0)).alias("nrmse"))
