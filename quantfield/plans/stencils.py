"""Lorenzo codes, interpolation stencils and time differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators.fields import event_series, grid, price_series, table
from ..operators.lorenzo import NOISE, decode, encode, quantized, restored
from .sqltext import EVENTS, PRICES, grid as sql_grid, lattice, lorenzo, undo

QUERIES, ORACLES = {}, {}
EBG = 2.0**-7


def _add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


SHAPES = {1: None, 2: (64,), 3: (8, 8), 4: (4, 4, 4)}


def _field(rank: int):
    """field(spark, sf_dir), its SQL, group, dims, eb."""
    if rank == 1:
        return event_series, EVENTS, ["key"], ["i0"], 0.5
    edges = SHAPES[rank]
    return (lambda s, p: grid(s, p, edges)), sql_grid(edges), ["slab"], [f"i{k}" for k in range(rank)], EBG


def _lorenzo(rank: int, order: int):
    field, src, group, dims, eb = _field(rank)
    ids = ", ".join([*group, *dims])
    codes = lorenzo(lattice(src, eb), group, dims, order)

    def enc(spark, sf_dir):
        return encode(quantized(field(spark, sf_dir), eb), group, dims, order).select(*group, *dims, "q", "code")

    def dec(spark, sf_dir):
        back = decode(encode(quantized(field(spark, sf_dir), eb), group, dims, order), group, dims, order)
        return back.select(*group, *dims, "code", "back", restored(eb).alias("value"))

    dec_sql = f"SELECT {ids}, code, back, back * {2 * eb!r}e0 AS value FROM {undo(codes, group, dims, order)}"
    return enc, f"SELECT {ids}, q, code FROM {codes}", dec, dec_sql


for _rank in (1, 2, 3, 4):
    _enc, _es, _dec, _ds = _lorenzo(_rank, 1)
    _add(f"lorenzo{_rank}d_encode", _enc, _es)
    _add(f"lorenzo{_rank}d_decode", _dec, _ds)
    _enc, _es, _dec, _ds = _lorenzo(_rank, 2)
    _add(f"lorenzo{_rank}d_second_order", _dec, _ds)


def lorenzo_noise_estimate(spark, sf_dir):
    """Mean prediction error of a block, with what quantization noise will add."""
    x = encode(quantized(grid(spark, sf_dir), EBG), ["slab"], ["i0", "i1"])
    err = F.abs(F.col("code") * E.d(2 * EBG)) + E.d(NOISE[1, 2] * EBG)
    return x.groupBy("slab", F.floor(F.col("i1") / 16).cast("long").alias("b1")).agg(F.round(F.avg(err), 9).alias("estimate"), F.count(F.lit(1)).alias("n"))


_add("lorenzo_noise_estimate", lorenzo_noise_estimate, f"SELECT slab, i1 // 16 AS b1, round(avg(abs(code * {2 * EBG!r}e0) + {NOISE[1, 2] * EBG!r}e0), 9) AS estimate, count(*) AS n FROM {lorenzo(lattice(sql_grid(), EBG), ['slab'], ['i0', 'i1'])} GROUP BY ALL")


def lorenzo1d_report(spark, sf_dir):
    """Encode, decode, and for each series: bound kept, PSNR, entropy of the codes, bits a value."""
    full = decode(encode(quantized(event_series(spark, sf_dir), 0.5), ["key"], ["i0"]), ["key"], ["i0"]).withColumn("value", restored(0.5))
    e = F.col("value") - F.col("x")
    # Distinct codes of a series are far fewer than its cells: sums over them give error and entropy alike.
    per = full.groupBy("key", "code").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(e)).alias("m"), F.sum(e * e).alias("s"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    a = per.groupBy("key").agg(F.sum("n").alias("cells"), F.max("m").alias("max_err"), F.sum("s").alias("s"), (F.max("hi") - F.min("lo")).alias("r"), F.sum(F.col("n") * F.log2("n")).alias("h"))
    psnr = F.when((F.col("s") > 0) & (F.col("r") > 0), E.d(20) * F.log10("r") - E.d(10) * F.log10(F.col("s") / F.col("cells")))
    return a.select("key", "cells", "max_err", F.round(psnr, 6).alias("psnr"), F.round(F.log2("cells") - F.col("h") / F.col("cells"), 6).alias("entropy_bits"))


_add("lorenzo1d_report", lorenzo1d_report, f"""
WITH t AS (SELECT * FROM {undo(lorenzo(lattice(EVENTS, 0.5), ['key'], ['i0']), ['key'], ['i0'])}),
p AS (SELECT key, code, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT key, sum(n * log2(n)) AS h FROM p GROUP BY key),
a AS (SELECT key, count(*) AS cells, max(abs(back * 1e0 - x)) AS max_err, sum((back * 1e0 - x) * (back * 1e0 - x)) AS s, max(x) - min(x) AS r FROM t GROUP BY key)
SELECT key, cells, max_err, CASE WHEN s > 0 AND r > 0 THEN round(20e0 * log10(r) - 10e0 * log10(s / cells), 6) END AS psnr, round(log2(cells) - h / cells, 6) AS entropy_bits FROM a JOIN h USING (key)""")


def _line(df, odd_only=True):
    w = Window.partitionBy("key").orderBy("i0")
    for name, k in (("z", -5), ("a", -3), ("b", -1), ("c", 1), ("e", 3)):
        df = df.withColumn(name, F.lag("x", -k).over(w) if k < 0 else F.lead("x", k).over(w))
    return df.where("i0 % 2 = 1") if odd_only else df


_LINE = f"(SELECT *, lag(x, 5) OVER w AS z, lag(x, 3) OVER w AS a, lag(x, 1) OVER w AS b, lead(x, 1) OVER w AS c, lead(x, 3) OVER w AS e FROM {EVENTS} WINDOW w AS (PARTITION BY key ORDER BY i0))"


def _pred(kind: str):
    z, a, b, c, e = (F.col(k) for k in "zabce")
    lin = F.when(c.isNotNull(), E.linear(b, c)).when(a.isNotNull(), E.extrapolated(a, b)).otherwise(b)
    if kind == "linear":
        return lin
    return (
        F.when(a.isNotNull() & c.isNotNull() & e.isNotNull(), E.cubic(a, b, c, e)).when(c.isNotNull() & e.isNotNull(), E.quad_first(b, c, e))
        .when(a.isNotNull() & c.isNotNull(), E.quad_last(a, b, c)).when(z.isNotNull() & a.isNotNull() & c.isNull(), E.quad_beyond(z, a, b)).otherwise(lin)
    )


_LIN = "CASE WHEN c IS NOT NULL THEN (b + c) / 2e0 WHEN a IS NOT NULL THEN -0.5e0 * a + 1.5e0 * b ELSE b END"
_CUB = f"""CASE WHEN a IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL THEN (-1e0 * a + 9e0 * b + 9e0 * c + -1e0 * e) / 16e0
 WHEN c IS NOT NULL AND e IS NOT NULL THEN (3e0 * b + 6e0 * c + -1e0 * e) / 8e0 WHEN a IS NOT NULL AND c IS NOT NULL THEN (-1e0 * a + 6e0 * b + 3e0 * c) / 8e0
 WHEN z IS NOT NULL AND a IS NOT NULL AND c IS NULL THEN (3e0 * z + -10e0 * a + 15e0 * b) / 8e0 ELSE {_LIN} END"""


def _interp(kind):
    def run(spark, sf_dir):
        return _line(event_series(spark, sf_dir)).select("key", "i0", F.round(F.col("x") - _pred(kind), 9).alias("residual"))

    return run


_add("interp_linear_level1", _interp("linear"), f"SELECT key, i0, round(x - {_LIN}, 9) AS residual FROM {_LINE} WHERE i0 % 2 = 1")
_add("interp_cubic_level1", _interp("cubic"), f"SELECT key, i0, round(x - {_CUB}, 9) AS residual FROM {_LINE} WHERE i0 % 2 = 1")


def interp_kernels_all(spark, sf_dir):
    """Mean absolute residual of every four-point stencil, for each series."""
    z, a, b, c, e = (F.col(k) for k in "zabce")
    kinds = {k: E.four_point(k, a, b, c, e) for k in E.FOUR_POINT} | {"cubic": E.cubic(a, b, c, e), "linear": E.linear(b, c), "akima": E.akima(a, b, c, e), "extrapolated": E.extrapolated(a, b), "quad_first": E.quad_first(b, c, e), "quad_last": E.quad_last(a, b, c)}
    inner = _line(event_series(spark, sf_dir)).where("a is not null and e is not null")
    return inner.groupBy("key").agg(*[F.round(F.avg(F.abs(F.col("x") - p)), 6).alias(k) for k, p in kinds.items()])


_FOUR = {k: "(" + " + ".join(f"{float(w)!r}e0 * {x}" for w, x in zip(ws, "abce")) + f") / {by}e0" for k, (ws, by) in E.FOUR_POINT.items()}
_T0, _T1 = "2e0 * b - a - c", "2e0 * c - b - e"
_SQLS = _FOUR | {
    "cubic": "(-1e0 * a + 9e0 * b + 9e0 * c + -1e0 * e) / 16e0", "linear": "(b + c) / 2e0",
    "akima": f"(b + c) / 2e0 + CASE WHEN abs({_T0}) + abs({_T1}) > 1e-9 THEN (({_T0}) * abs({_T1}) + ({_T1}) * abs({_T0})) / 8e0 / (abs({_T0}) + abs({_T1})) ELSE 0e0 END",
    "extrapolated": "-0.5e0 * a + 1.5e0 * b", "quad_first": "(3e0 * b + 6e0 * c + -1e0 * e) / 8e0", "quad_last": "(-1e0 * a + 6e0 * b + 3e0 * c) / 8e0",
}
_add("interp_kernels_all", interp_kernels_all, f"SELECT key, {', '.join(f'round(avg(abs(x - ({p}))), 6) AS {k}' for k, p in _SQLS.items())} FROM {_LINE} WHERE i0 % 2 = 1 AND a IS NOT NULL AND e IS NOT NULL GROUP BY key")


def anchor_grid(spark, sf_dir):
    return grid(spark, sf_dir).where("i0 % 32 = 0 and i1 % 32 = 0").select("i0", "i1", "x")


_add("anchor_grid", anchor_grid, f"SELECT i0, i1, x FROM {sql_grid()} WHERE i0 % 32 = 0 AND i1 % 32 = 0")


def level_error_bounds(spark, sf_dir):
    """Each cell's level (how often 2 divides its indices), and the bound of each level."""
    low = lambda c: F.when(F.col(c) == 0, 7).otherwise(F.least(F.lit(7), F.log2(F.col(c).bitwiseAND(-F.col(c)).cast("double")).cast("int")))
    g = grid(spark, sf_dir).withColumn("level", F.least(low("i0"), low("i1")) + 1)
    return g.groupBy("level").agg(F.count(F.lit(1)).alias("cells")).select(F.col("level").cast("int").alias("level"), "cells", F.round(E.d(EBG) / F.least(F.pow(E.d(1.25), F.col("level") - 1), E.d(2)), 12).alias("eb"))


_LOW = "CASE WHEN {0} = 0 THEN 7 ELSE least(7, floor(log2({0} & -{0}) + 1e-6)::INTEGER) END"
_add("level_error_bounds", level_error_bounds, f"SELECT level::INTEGER AS level, count(*) AS cells, round({EBG!r}e0 / least(pow(1.25e0, level - 1), 2e0), 12) AS eb FROM (SELECT least({_LOW.format('i0')}, {_LOW.format('i1')}) + 1 AS level FROM {sql_grid()}) GROUP BY level")

# --- time and molecules: vec_id is the frame, the position the atom -------------------------------------------

_Q2 = lattice(sql_grid(), EBG)


def _frames(spark, sf_dir):
    return quantized(grid(spark, sf_dir), EBG)


def time_delta_encode(spark, sf_dir):
    w = Window.partitionBy("slab", "i1").orderBy("i0")
    return _frames(spark, sf_dir).select("i0", "i1", (F.col("q") - F.coalesce(F.lag("q").over(w), F.lit(0))).alias("code"))


_add("time_delta_encode", time_delta_encode, f"SELECT i0, i1, q - coalesce(lag(q) OVER (PARTITION BY slab, i1 ORDER BY i0), 0) AS code FROM {_Q2}")


def time_delta_ref_frame(spark, sf_dir):
    """Differences in time of what is left after frame 0: its 64 values are one row, read apart."""
    first = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.posexplode("embedding").alias("i1", "ref"))
    x = grid(spark, sf_dir).join(F.broadcast(first.select(F.col("i1").cast("long"), F.col("ref").cast("double").alias("ref"))), "i1").withColumn("q", E.lattice(F.col("x") - F.col("ref"), EBG))
    w = Window.partitionBy("slab", "i1").orderBy("i0")
    return x.select("i0", "i1", (F.col("q") - F.coalesce(F.lag("q").over(w), F.lit(0))).alias("code"))


_REF = f"(SELECT g.slab, g.i0, g.i1, g.x - r.x AS x FROM {sql_grid()} g JOIN {sql_grid()} r ON g.i1 = r.i1 AND r.i0 = 0)"
_add("time_delta_ref_frame", time_delta_ref_frame, f"SELECT i0, i1, q - coalesce(lag(q) OVER (PARTITION BY slab, i1 ORDER BY i0), 0) AS code FROM {lattice(_REF, EBG)}")


def md_delta_1d(spark, sf_dir):
    w = Window.partitionBy("i0").orderBy("i1")
    return _frames(spark, sf_dir).select("i0", "i1", (F.col("q") - F.coalesce(F.lag("q").over(w), F.lit(0))).alias("code"))


_add("md_delta_1d", md_delta_1d, f"SELECT i0, i1, q - coalesce(lag(q) OVER (PARTITION BY i0 ORDER BY i1), 0) AS code FROM {_Q2}")


def _atom(site: int = 3):
    """Place of an atom's reference in its frame, as an offset: the molecule's first atom, or the molecule before."""
    return F.greatest(F.lit(1), F.col("i1") % site)


def _with_reference(df):
    ref = df.select(F.col("slab").alias("rs"), F.col("i0").alias("r0"), F.col("i1").alias("r1"), F.col("q").alias("rq"))
    return df.join(ref, (F.col("rs") == F.col("slab")) & (F.col("r0") == F.col("i0")) & (F.col("r1") == F.col("i1") - _atom()), "left")


def md_site_reference_2d(spark, sf_dir):
    return _with_reference(_frames(spark, sf_dir)).select("i0", "i1", (F.col("q") - F.coalesce("rq", F.lit(0))).alias("code"))


_R = f"(SELECT a.*, coalesce(b.q, 0) AS rq FROM {_Q2} a LEFT JOIN {_Q2} b ON a.i0 = b.i0 AND b.i1 = a.i1 - greatest(1, a.i1 % 3))"
_add("md_site_reference_2d", md_site_reference_2d, f"SELECT i0, i1, q - rq AS code FROM {_R}")


def md_time_atom_3d(spark, sf_dir):
    """Lorenzo over time and reference atom: t + a - ta."""
    x = _with_reference(_frames(spark, sf_dir)).withColumn("d", F.col("q") - F.coalesce("rq", F.lit(0)))
    w = Window.partitionBy("slab", "i1").orderBy("i0")
    return x.select("i0", "i1", (F.col("d") - F.coalesce(F.lag("d").over(w), F.lit(0))).alias("code"))


_add("md_time_atom_3d", md_time_atom_3d, f"SELECT i0, i1, (q - rq) - coalesce(lag(q - rq) OVER (PARTITION BY slab, i1 ORDER BY i0), 0) AS code FROM {_R}")


def md_site_detect(spark, sf_dir):
    """Modal gap between jumps of over half a value, in each of the first 100 frames."""
    x = grid(spark, sf_dir).where("i0 < 100")
    w = Window.partitionBy("i0").orderBy("i1")
    jump = x.withColumn("p", F.lag("x").over(w)).where("p is not null and x <> 0 and abs((x - p) / x) > 0.5e0")
    gap = jump.withColumn("gap", F.col("i1") - F.lag("i1").over(w)).where("gap is not null")
    n = gap.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    return n.select("gap", "n", F.col("gap").between(3, 10).alias("usable"))


_add("md_site_detect", md_site_detect, f"""SELECT gap, count(*) AS n, gap BETWEEN 3 AND 10 AS usable FROM (
 SELECT i1 - lag(i1) OVER (PARTITION BY i0 ORDER BY i1) AS gap FROM (
  SELECT *, lag(x) OVER (PARTITION BY i0 ORDER BY i1) AS p FROM {sql_grid()} WHERE i0 < 100) WHERE p IS NOT NULL AND x <> 0 AND abs((x - p) / x) > 0.5e0) WHERE gap IS NOT NULL GROUP BY gap""")


def fill_start(cells):
    """first_fill, frames of cells (i0, i1, x): the frames at the end, but the first, whose cells all equal the first cell of the last."""
    fill = cells.agg(F.max_by("x", F.struct("i0", -F.col("i1"))).alias("fill"))  # one row
    other = cells.join(F.broadcast(fill), F.lit(True)).withColumn("other", ~F.col("x").eqNullSafe(F.col("fill")))
    return other.agg(F.greatest(F.coalesce(F.max(F.when(F.col("other"), F.col("i0"))) + 1, F.lit(1)), F.lit(1)).alias("first_fill"), F.countDistinct("i0").alias("frames"))


def fill_frame_detect(spark, sf_dir):
    """Where the fill frames of a field begin that from frame 100 on has the value of its first cell there."""
    g = grid(spark, sf_dir)
    return fill_start(g.withColumn("x", F.when(F.col("i0") >= 100, F.lit(0.25)).otherwise(F.col("x"))))


_add("fill_frame_detect", fill_frame_detect, f"""WITH f AS (SELECT i0, i1, CASE WHEN i0 >= 100 THEN 0.25e0 ELSE x END AS x FROM {sql_grid()}),
 v AS (SELECT x AS fill FROM f ORDER BY i0 DESC, i1 LIMIT 1), c AS (SELECT i0, bool_and(x = fill) AS alike FROM f, v GROUP BY i0)
 SELECT greatest(1, coalesce(max(i0) FILTER (WHERE NOT alike) + 1, 1)) AS first_fill, count(*) AS frames FROM c""")


def level_quantize_vq(spark, sf_dir):
    """Levels of equal spacing, differences of neighbouring levels, and what is left within a level."""
    x = price_series(spark, sf_dir).withColumn("level", E.level_of(F.col("x"), 1000.0, 512.0))
    w = Window.partitionBy("key").orderBy("i0")
    rest = E.lattice(F.col("x") - (F.col("level") * E.d(512) + E.d(1000)), 1.0)
    return x.select("key", "i0", "level", (F.col("level") - F.coalesce(F.lag("level").over(w), F.lit(0))).alias("step"), rest.alias("code"))


_LV = f"(SELECT *, floor((x - 1000e0) / 512e0 + 0.5e0)::BIGINT AS level FROM {PRICES})"
_add("level_quantize_vq", level_quantize_vq, f"SELECT key, i0, level, level - coalesce(lag(level) OVER (PARTITION BY key ORDER BY i0), 0) AS step, floor((x - (level * 512e0 + 1000e0)) / 2e0 + 0.5e0)::BIGINT AS code FROM {_LV}")


def level_quantize_vqt(spark, sf_dir):
    """Levels in the first frame of each slab; later frames differ from the frame before."""
    x = grid(spark, sf_dir).withColumn("level", E.level_of(F.col("x"), 0.0, 0.125)).withColumn("q", E.lattice(F.col("x"), EBG))
    w = Window.partitionBy("slab", "i1").orderBy("i0")
    return x.withColumn("before", F.lag("q").over(w)).select("i0", "i1", F.when(F.col("before").isNull(), F.col("level")).alias("level"), (F.col("q") - F.coalesce("before", F.col("level") * 8)).alias("code"))


_add("level_quantize_vqt", level_quantize_vqt, f"SELECT i0, i1, CASE WHEN before IS NULL THEN level END AS level, q - coalesce(before, level * 8) AS code FROM (SELECT *, lag(q) OVER (PARTITION BY slab, i1 ORDER BY i0) AS before, floor(x / 0.125e0 + 0.5e0)::BIGINT AS level FROM {_Q2})")
