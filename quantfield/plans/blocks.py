"""Block operators: regression, choice of predictor, sampling, tuning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators.fields import event_series, grid, price_series
from ..operators.lorenzo import NOISE, encode, quantized
from .sqltext import EVENTS, PRICES, grid as sql_grid, lattice, lorenzo

QUERIES, ORACLES = {}, {}
EB, EDGE = 2.0**-7, 8


def _add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _blocked(spark, sf_dir):
    """Cells with block (b0, b1) and place in it (u, v)."""
    g = grid(spark, sf_dir)
    return g.select("slab", "i0", "i1", "x", F.floor(F.col("i0") / EDGE).cast("long").alias("b0"), F.floor(F.col("i1") / EDGE).cast("long").alias("b1"), (F.col("i0") % EDGE).alias("u"), (F.col("i1") % EDGE).alias("v"))


def _plane(cells):
    """Least squares on a full lattice: each slope is that of its own dimension."""
    return cells.groupBy("b0", "b1").agg(
        F.regr_slope("x", F.col("u").cast("double")).alias("cu"), F.regr_slope("x", F.col("v").cast("double")).alias("cv"),
        F.avg("x").alias("m"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.count(F.lit(1)).alias("n"),
    ).withColumn("c0", F.col("m") - F.coalesce("cu", E.d(0)) * F.col("mu") - F.coalesce("cv", E.d(0)) * F.col("mv"))


_B = f"(SELECT *, i0 // {EDGE} AS b0, i1 // {EDGE} AS b1, i0 % {EDGE} AS u, i1 % {EDGE} AS v FROM {sql_grid()})"
_P = f"(SELECT *, m - coalesce(cu, 0) * mu - coalesce(cv, 0) * mv AS c0 FROM (SELECT b0, b1, regr_slope(x, u) AS cu, regr_slope(x, v) AS cv, avg(x) AS m, avg(u) AS mu, avg(v) AS mv, count(*) AS n FROM {_B} GROUP BY ALL))"


def regression_block_coeffs(spark, sf_dir):
    return _plane(_blocked(spark, sf_dir)).select("b0", "b1", "n", *[F.round(c, 6).alias(c) for c in ("c0", "cu", "cv")])


_add("regression_block_coeffs", regression_block_coeffs, f"SELECT b0, b1, n, round(c0, 6) AS c0, round(cu, 6) AS cu, round(cv, 6) AS cv FROM {_P}")


def _fit(u="u", v="v"):
    return F.col("c0") + F.coalesce("cu", E.d(0)) * F.col(u) + F.coalesce("cv", E.d(0)) * F.col(v)


def regression_predict(spark, sf_dir):
    """Residual energy of each block's plane."""
    cells = _blocked(spark, sf_dir)
    r = F.col("x") - _fit()
    return cells.join(_plane(cells), ["b0", "b1"]).groupBy("b0", "b1").agg(F.round(F.sum(r * r), 6).alias("energy"))


_add("regression_predict", regression_predict, f"SELECT b0, b1, round(sum(pow(x - (c0 + coalesce(cu, 0) * u + coalesce(cv, 0) * v), 2)), 6) AS energy FROM {_B} JOIN {_P} USING (b0, b1) GROUP BY ALL")


def regression_coeff_codes(spark, sf_dir):
    """Coefficients, rounded to six places, on lattices of eb / 3 and eb / 3 / edge, less those of the block before."""
    p = _plane(_blocked(spark, sf_dir))
    w = Window.partitionBy("b1").orderBy("b0")
    out = p
    for c, eb in (("c0", EB / 3), ("cu", EB / 3 / EDGE), ("cv", EB / 3 / EDGE)):
        out = out.withColumn(f"q_{c}", E.lattice(F.round(F.coalesce(c, E.d(0)), 6), eb))
        out = out.withColumn(f"code_{c}", F.col(f"q_{c}") - F.coalesce(F.lag(f"q_{c}").over(w), F.lit(0)))
    return out.select("b0", "b1", "code_c0", "code_cu", "code_cv")


_Q = ", ".join(f"floor(round(coalesce({c}, 0), 6) / {2 * eb!r}e0 + 0.5e0)::BIGINT AS q_{c}".replace("e-05e0", "e-05").replace("e-06e0", "e-06") for c, eb in (("c0", EB / 3), ("cu", EB / 3 / EDGE), ("cv", EB / 3 / EDGE)))
_add("regression_coeff_codes", regression_coeff_codes, f"SELECT b0, b1, {', '.join(f'q_{c} - coalesce(lag(q_{c}) OVER (PARTITION BY b1 ORDER BY b0), 0) AS code_{c}' for c in ('c0', 'cu', 'cv'))} FROM (SELECT b0, b1, {_Q} FROM {_P})")


def _choice(spark, sf_dir):
    """b0, b1, predictor: the least mean error of Lorenzo 1, Lorenzo 2 and regression over the block's diagonals."""
    cells = _blocked(spark, sf_dir)
    q = quantized(grid(spark, sf_dir), EB)
    l1 = encode(q, ["slab"], ["i0", "i1"]).select("i0", "i1", F.abs(F.col("code") * E.d(2 * EB)).alias("e1"))
    l2 = encode(q, ["slab"], ["i0", "i1"], 2).select("i0", "i1", F.abs(F.col("code") * E.d(2 * EB)).alias("e2"))
    diagonal = cells.where((F.col("u") == F.col("v")) | (F.col("u") + F.col("v") == EDGE - 1))
    err = diagonal.join(_plane(cells), ["b0", "b1"]).join(l1, ["i0", "i1"]).join(l2, ["i0", "i1"])
    a = err.groupBy("b0", "b1").agg((F.avg("e1") + E.d(NOISE[1, 2] * EB)).alias("m1"), (F.avg("e2") + E.d(NOISE[2, 2] * EB)).alias("m2"), F.avg(F.abs(F.col("x") - _fit())).alias("m3"))
    m = [F.round(f"m{k}", 9) for k in (1, 2, 3)]
    best = F.when((m[0] <= m[1]) & (m[0] <= m[2]), "lorenzo1").when(m[1] <= m[2], "lorenzo2").otherwise("regression")
    return a.select("b0", "b1", best.alias("predictor"))


def _codes(order):
    return f"(SELECT i0, i1, abs(code * {2 * EB!r}e0) AS e{order} FROM {lorenzo(lattice(sql_grid(), EB), ['slab'], ['i0', 'i1'], order)})"


_CHOICE = f"""(SELECT b0, b1, CASE WHEN round(m1, 9) <= round(m2, 9) AND round(m1, 9) <= round(m3, 9) THEN 'lorenzo1' WHEN round(m2, 9) <= round(m3, 9) THEN 'lorenzo2' ELSE 'regression' END AS predictor FROM (
 SELECT b0, b1, avg(e1) + {NOISE[1, 2] * EB!r}e0 AS m1, avg(e2) + {NOISE[2, 2] * EB!r}e0 AS m2, avg(abs(x - (c0 + coalesce(cu, 0) * u + coalesce(cv, 0) * v))) AS m3
 FROM {_B} JOIN {_P} USING (b0, b1) JOIN {_codes(1)} USING (i0, i1) JOIN {_codes(2)} USING (i0, i1) WHERE u = v OR u + v = {EDGE - 1} GROUP BY ALL))"""
_add("composed_selection", _choice, f"SELECT * FROM {_CHOICE}")


def predictor_usage(spark, sf_dir):
    n = _choice(spark, sf_dir).groupBy("predictor").agg(F.count(F.lit(1)).alias("n"))  # three rows at most
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total"))), F.lit(True)).select("predictor", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_add("predictor_usage", predictor_usage, f"SELECT predictor, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM {_CHOICE}), 6) AS share FROM {_CHOICE} GROUP BY predictor")


def block_diagonal_sample(spark, sf_dir):
    return _blocked(spark, sf_dir).where((F.col("u") == F.col("v")) | (F.col("u") + F.col("v") == EDGE - 1)).select("i0", "i1", "x")


_add("block_diagonal_sample", block_diagonal_sample, f"SELECT i0, i1, x FROM {_B} WHERE u = v OR u + v = {EDGE - 1}")


def sample_blocks(spark, sf_dir):
    """Every tenth block of 16 cells of each series, and a cell more at its end; the sampling is the operator."""
    x = price_series(spark, sf_dir)
    block = F.floor(F.col("i0") / 16)
    inside = (block % 10 == 0) | ((F.col("i0") % 16 == 0) & (block % 10 == 1))
    return x.where(inside).select("key", "i0", "x")


_add("sample_blocks", sample_blocks, f"SELECT key, i0, x FROM {PRICES} WHERE (i0 // 16) % 10 = 0 OR (i0 % 16 = 0 AND (i0 // 16) % 10 = 1)")


def interval_capacity(spark, sf_dir):
    """The least power of two of intervals that holds 99.9 % of the residuals."""
    code = encode(quantized(price_series(spark, sf_dir), 8.0), ["key"], ["i0"]).select(F.abs("code").alias("c"))
    by = code.select(F.when(F.col("c") == 0, 0).otherwise(F.ceil(F.log2(F.col("c").cast("double") + 1))).cast("int").alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    run = by.withColumn("below", F.sum("n").over(Window.orderBy("bits"))).withColumn("total", F.sum("n").over(Window.partitionBy()))  # 64 rows at most
    return run.where("below >= 0.999e0 * total").agg(F.pow(E.d(2), F.min("bits") + 1).cast("long").alias("intervals"))


_add("interval_capacity", interval_capacity, f"""SELECT pow(2e0, min(bits) + 1)::BIGINT AS intervals FROM (SELECT bits, sum(n) OVER (ORDER BY bits) AS below, sum(n) OVER () AS total FROM (
 SELECT bits, count(*) AS n FROM (SELECT CASE WHEN code = 0 THEN 0 ELSE ceil(log2(abs(code) + 1e0))::INTEGER END AS bits FROM {lorenzo(lattice(PRICES, 8.0), ['key'], ['i0'])}) GROUP BY bits)) WHERE below >= 0.999e0 * total""")


def tune_choose_algorithm(spark, sf_dir):
    """Entropy of sampled residuals, bits a value, of each candidate; linear or cubic, whichever is
    better, and Lorenzo if it gains 10 % on both."""
    x = event_series(spark, sf_dir)
    w = Window.partitionBy("key").orderBy("i0")
    for name, k in (("a", -3), ("b", -1), ("c", 1), ("e", 3)):
        x = x.withColumn(name, F.lag("x", -k).over(w) if k < 0 else F.lead("x", k).over(w))
    x = x.where("a is not null and e is not null and i0 % 2 = 1")
    preds = {"linear": E.linear(F.col("b"), F.col("c")), "cubic": E.cubic(*(F.col(k) for k in "abce")), "lorenzo": F.col("b")}
    rows = x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), E.lattice(F.col("x") - p, 0.5).alias("code")) for k, p in preds.items()])).alias("r")).select("r.*")
    n = rows.groupBy("candidate", "code").agg(F.count(F.lit(1)).alias("n"))
    bits = n.groupBy("candidate").agg((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))
    weighted = bits.withColumn("weighted", F.col("bits") * F.when(F.col("candidate") == "lorenzo", 1.1).otherwise(1.0))
    return weighted.agg(F.min_by("candidate", "weighted").alias("chosen"), F.round(F.min("weighted"), 6).alias("cost"))


_L = f"(SELECT * FROM (SELECT *, lag(x, 3) OVER w AS a, lag(x, 1) OVER w AS b, lead(x, 1) OVER w AS c, lead(x, 3) OVER w AS e FROM {EVENTS} WINDOW w AS (PARTITION BY key ORDER BY i0)) WHERE a IS NOT NULL AND e IS NOT NULL AND i0 % 2 = 1)"
_RES = " UNION ALL ".join(f"SELECT '{k}' AS candidate, {f}e0 AS f, floor((x - ({p})) / 1e0 + 0.5e0)::BIGINT AS code FROM {_L}" for k, f, p in (("linear", "1.0", "(b + c) / 2e0"), ("cubic", "1.0", "(-1e0 * a + 9e0 * b + 9e0 * c + -1e0 * e) / 16e0"), ("lorenzo", "1.1", "b")))
_add("tune_choose_algorithm", tune_choose_algorithm, f"""SELECT min_by(candidate, w) AS chosen, round(min(w), 6) AS cost FROM (SELECT candidate, f * (log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS w FROM (SELECT candidate, f, code, count(*) AS n FROM ({_RES}) GROUP BY ALL) GROUP BY candidate, f)""")


def batch_method_select(spark, sf_dir):
    """For each batch of 10 frames, by the entropy of its codes: differences in time, in space, or levels."""
    q = quantized(grid(spark, sf_dir), EB).withColumn("batch", F.floor(F.col("i0") / 10).cast("long"))
    t, s = Window.partitionBy("batch", "i1").orderBy("i0"), Window.partitionBy("i0").orderBy("i1")
    back = lambda w: F.col("q") - F.coalesce(F.lag("q").over(w), F.lit(0))
    q = q.withColumn("levels", F.col("q")).withColumn("space", back(s)).withColumn("time", back(t))
    m = q.select("batch", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.col(k).alias("code")) for k in ("levels", "space", "time")])).alias("r"))
    n = m.select("batch", "r.*").groupBy("batch", "method", "code").agg(F.count(F.lit(1)).alias("n"))
    bits = n.groupBy("batch", "method").agg(F.round(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 9).alias("bits"))
    return bits.groupBy("batch").agg(F.min(F.struct("bits", "method")).alias("b")).select("batch", F.col("b.method").alias("method"), F.col("b.bits").alias("bits"))


_QB = f"(SELECT *, i0 // 10 AS batch FROM {lattice(sql_grid(), EB)})"
_M = f"SELECT batch, 'levels' AS method, q AS code FROM {_QB} UNION ALL SELECT batch, 'space', q - coalesce(lag(q) OVER (PARTITION BY i0 ORDER BY i1), 0) FROM {_QB} UNION ALL SELECT batch, 'time', q - coalesce(lag(q) OVER (PARTITION BY batch, i1 ORDER BY i0), 0) FROM {_QB}"
_add("batch_method_select", batch_method_select, f"SELECT batch, method, bits FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY bits, method) AS r FROM (SELECT batch, method, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS bits FROM (SELECT batch, method, code, count(*) AS n FROM ({_M}) GROUP BY ALL) GROUP BY ALL)) WHERE r = 1")
