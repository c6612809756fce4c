"""Frames and sites read again from their differences, runs and ranges coded and decoded, interpolation over several dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.expressions import d
from ..operators import codecs, interpolate_nd, rangecoder
from ..operators.fields import event_series, grid
from ..operators.lorenzo import encode, quantized
from . import coding, stencils
from .sqltext import EVENTS, grid as sql_grid, lattice, lorenzo

QUERIES, ORACLES = {}, {}
EBG = 2.0**-7
_Q2 = f"SELECT i0, i1, q FROM {lattice(sql_grid(), EBG)}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _slabs(codes):
    return codes.withColumn("slab", F.floor(F.col("i0") / 128))


def _over_time(codes, column: str):
    w = Window.partitionBy("slab", "i1").orderBy("i0").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(column).over(w)


def sites_decoded(codes, column: str):
    """q of molecules of three sites: a molecule's first atom follows the last of the one before, which follows the first
    atom of its own; so first atoms are running sums over molecules, and the others differ from them."""
    w = Window.partitionBy("i0").orderBy("i1")
    step = F.when(F.col("i1") % 3 == 0, F.col(column) + F.coalesce(F.lag(column).over(w), F.lit(0))).otherwise(F.lit(0))
    out = codes.withColumn("step", step).withColumn("first", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("q", F.col("first") + F.when(F.col("i1") % 3 == 0, F.lit(0)).otherwise(F.col(column)))


@query("time_delta_decode", _Q2)
def time_delta_decode(spark, sf_dir):
    c = _slabs(stencils.time_delta_encode(spark, sf_dir))
    return c.select("i0", "i1", _over_time(c, "code").alias("q"))


@query("md_delta_decode", _Q2)
def md_delta_decode(spark, sf_dir):
    w = Window.partitionBy("i0").orderBy("i1").rowsBetween(Window.unboundedPreceding, 0)
    return stencils.md_delta_1d(spark, sf_dir).select("i0", "i1", F.sum("code").over(w).alias("q"))


@query("md_site_decode", _Q2)
def md_site_decode(spark, sf_dir):
    return sites_decoded(stencils.md_site_reference_2d(spark, sf_dir), "code").select("i0", "i1", "q")


@query("md_time_atom_decode", _Q2)
def md_time_atom_decode(spark, sf_dir):
    c = _slabs(stencils.md_time_atom_3d(spark, sf_dir))
    return sites_decoded(c.withColumn("d", _over_time(c, "code")), "d").select("i0", "i1", "q")


@query("level_gate", f"SELECT slab, count(DISTINCT level) AS levels, count(*) AS atoms, count(DISTINCT level) <= 0.25e0 * count(*) AS usable FROM (SELECT slab, floor(x / 0.125e0 + 0.5e0)::BIGINT AS level FROM {sql_grid()} WHERE i0 % 128 = 0) GROUP BY slab")
def level_gate(spark, sf_dir):
    """Levels are used where the first frame of a slab has at most one for four atoms."""
    x = grid(spark, sf_dir).where("i0 % 128 = 0").select("slab", E.level_of(F.col("x"), 0.0, 0.125).alias("level"))
    a = x.groupBy("slab").agg(F.countDistinct("level").alias("levels"), F.count(F.lit(1)).alias("atoms"))
    return a.withColumn("usable", F.col("levels") <= d(0.25) * F.col("atoms"))


@query("rle_roundtrip", f"SELECT key, i0, q FROM {lattice(EVENTS, 64.0)}")
def rle_roundtrip(spark, sf_dir):
    """Runs (symbol, length) back to cells: a run begins where those before it end."""
    r = coding.rle_runs(spark, sf_dir)
    w = Window.partitionBy("key").orderBy("run")
    r = r.withColumn("start", F.sum("n").over(w) - F.col("n"))
    return r.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i0"), F.col("symbol").alias("q"))


@query("range_coder_roundtrip", f"SELECT key, i0, code FROM {lorenzo(lattice(EVENTS, 0.5), ['key'], ['i0'])}")
def range_coder_roundtrip(spark, sf_dir):
    """Codes of each chunk to bytes in one job, from bytes alone to cells in the next."""
    cells = encode(quantized(event_series(spark, sf_dir), 0.5), ["key"], ["i0"])
    packed = codecs.chunks(cells, "code")
    key = dict(packed.dtypes)["key"]

    def to_bytes(batches):
        for b in batches:
            data = [rangecoder.pack(np.array(c, np.int64)) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["key", "chunk", "data"])

    def to_codes(batches):
        for b in batches:
            codes = [rangecoder.unpack(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.list_(pa.int64()))], names=["key", "chunk", "codes"])

    stored = packed.mapInArrow(to_bytes, f"key {key}, chunk long, data binary")
    got = stored.mapInArrow(to_codes, f"key {key}, chunk long, codes array<long>")
    return got.select("key", "chunk", F.posexplode("codes").alias("p", "code")).select("key", (F.col("chunk") * codecs.CHUNK + F.col("p")).alias("i0"), "code")


#: Cells of a chunk in the closed loop, which is one fold.
LOOP = 128
_STEP = (
    "WITH RECURSIVE c AS (SELECT key, i0 // {n} AS chunk, i0 % {n} AS p, x FROM {src}), "
    "r AS (SELECT key, chunk, p, {code0} AS code, x, 0e0 AS pred FROM c WHERE p = 0 UNION ALL "
    "SELECT key, chunk, p, {code} AS code, x, pred FROM (SELECT c.key, c.chunk, c.p, c.x, CASE WHEN r.code <> 0 THEN r.pred + 2e0 * 0.3e0 * (r.code - 32768) ELSE r.x END AS pred FROM r JOIN c ON c.key = r.key AND c.chunk = r.chunk AND c.p = r.p + 1)) "
    "SELECT key, chunk * {n} + p AS i0, code FROM r"
)


def _loop_sql() -> str:
    from .sqltext import code

    return _STEP.format(n=LOOP, src=EVENTS, code0=code("0e0", 0.3, 32768), code=code("pred", 0.3, 32768))


@query("lorenzo1d_closed_loop", _loop_sql())
def lorenzo1d_closed_loop(spark, sf_dir):
    """Each cell predicted from what the one before is read back as: a fold over each chunk, in the JVM."""
    x = event_series(spark, sf_dir).withColumn("chunk", F.floor(F.col("i0") / LOOP).cast("long"))
    packed = x.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("i0", "x"))).alias("s"))
    start = F.struct(d(0).alias("last"), F.array().cast("array<bigint>").alias("codes"))

    def step(acc, cell):
        c = E.code(cell["x"], acc["last"], 0.3)
        return F.struct(E.recovered(c, acc["last"], cell["x"], 0.3).alias("last"), F.concat(acc["codes"], F.array(c)).alias("codes"))

    done = packed.select("key", "chunk", F.aggregate("s", start, step)["codes"].alias("codes"))
    return done.select("key", "chunk", F.posexplode("codes").alias("p", "code")).select("key", (F.col("chunk") * LOOP + F.col("p")).alias("i0"), "code")


def _nd(edges: tuple[int, ...], direction: int, cubic: bool):
    dims = [f"i{k}" for k in range(len(edges) + 1)]

    def run(spark, sf_dir):
        got = interpolate_nd.roundtrip(grid(spark, sf_dir, edges), "slab", dims, EBG, direction, cubic)
        return got.select("slab", *dims, "x", "code", (F.abs(F.col("back") - F.col("x")) <= EBG).alias("within"))

    return run


QUERIES["interp2d_roundtrip"] = _nd((64,), 0, True)
QUERIES["interp3d_roundtrip"] = _nd((8, 8), 5, True)
QUERIES["interp4d_roundtrip"] = _nd((4, 4, 4), 0, False)
