"""Symbol statistics, entropy coders, containers and round trips."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.config import Config
from ..operators import codecs, levels, store
from ..operators.fields import event_series, price_series, table
from ..operators.lorenzo import encode, quantized
from .sqltext import EVENTS, PRICES, lattice, lorenzo

QUERIES, ORACLES = {}, {}


def _add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _codes(spark, sf_dir, eb=0.5):
    return encode(quantized(event_series(spark, sf_dir), eb), ["key"], ["i0"])


_C = lorenzo(lattice(EVENTS, 0.5), ["key"], ["i0"])
_H = f"(SELECT code AS symbol, count(*) AS n FROM {_C} GROUP BY code)"


def code_histogram(spark, sf_dir):
    return codecs.histogram(_codes(spark, sf_dir), "code")


_add("code_histogram", code_histogram, f"SELECT symbol, n FROM {_H}")


def code_entropy(spark, sf_dir):
    h = codecs.histogram(_codes(spark, sf_dir), "code")
    return h.agg(F.sum("n").alias("n"), F.round(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("entropy_bits"))


_add("code_entropy", code_entropy, f"SELECT sum(n)::BIGINT AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits FROM {_H}")


def arith_model(spark, sf_dir):
    """The interval of each symbol. The histogram has at most twice the radius of rows, so one task orders it."""
    h = codecs.histogram(_codes(spark, sf_dir), "code")
    w = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("symbol", (F.sum("n").over(w) - F.col("n")).alias("low"), F.sum("n").over(w).alias("high"))


_add("arith_model", arith_model, f"SELECT symbol, (sum(n) OVER (ORDER BY symbol) - n)::BIGINT AS low, (sum(n) OVER (ORDER BY symbol))::BIGINT AS high FROM {_H}")


def rle_runs(spark, sf_dir):
    """Runs of equal lattice values: a run is known by the number of changes before it."""
    q = quantized(event_series(spark, sf_dir), 64.0)
    w = Window.partitionBy("key").orderBy("i0")
    q = q.withColumn("new", F.when(F.col("q") == F.lag("q").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return q.groupBy("key", "run").agg(F.min("q").alias("symbol"), F.count(F.lit(1)).alias("n"))


_add("rle_runs", rle_runs, f"SELECT key, run::BIGINT AS run, min(q) AS symbol, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY i0) AS run FROM (SELECT *, CASE WHEN q = lag(q) OVER (PARTITION BY key ORDER BY i0) THEN 0 ELSE 1 END AS new FROM {lattice(EVENTS, 64.0)})) GROUP BY ALL")


def huffman_code_lengths(spark, sf_dir):
    h = codecs.histogram(_codes(spark, sf_dir), "code").collect()  # distinct symbols
    lengths = codecs.code_lengths({r.symbol: r.n for r in h})
    return spark.createDataFrame([(r.symbol, r.n, lengths[r.symbol]) for r in h], "symbol long, n long, bits int")


_add("huffman_code_lengths", huffman_code_lengths)


def huffman_roundtrip(spark, sf_dir):
    """Codes after Huffman packing, container and back: the same as before, cell by cell."""
    cells = _codes(spark, sf_dir)
    stored, bits = codecs.encode_containers(codecs.chunks(cells, "code"), codecs.histogram(cells, "code"), Config().to_json())
    return codecs.decode_containers(stored, bits).select("key", F.col("i0").cast("long").alias("i0"), "code")


_add("huffman_roundtrip", huffman_roundtrip, f"SELECT key, i0, code FROM {_C}")


def container_sizes(spark, sf_dir):
    """Bytes and compression ratio of each series' containers."""
    cells = encode(quantized(price_series(spark, sf_dir), 1.0), ["key"], ["i0"])
    stored, _ = codecs.encode_containers(codecs.chunks(cells, "code"), codecs.histogram(cells, "code"), Config(abs_bound=1.0).to_json())
    return stored.groupBy("key").agg(F.sum("cells").alias("cells"), F.sum(F.length("data")).alias("bytes"), F.round(F.sum("cells") * 8 / F.sum(F.length("data")), 4).alias("ratio"))


_add("container_sizes", container_sizes)


def interp_roundtrip(spark, sf_dir):
    """Interpolation with feedback, chunk by chunk; what is read back from the codes stays within the bound."""
    x = event_series(spark, sf_dir).withColumn("chunk", F.floor(F.col("i0") / codecs.CHUNK).cast("long"))
    packed = x.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("i0", "x"))).alias("s")).select("key", "chunk", F.col("s.x").alias("xs"))

    def run(batches):
        for b in batches:
            for key, chunk, xs in zip(*(c.to_pylist() for c in b.columns)):
                codes, _ = codecs.interpolate(np.array(xs, np.float64), 0.5)
                back = codecs.uninterpolate(codes, np.where(codes == 0, np.array(xs, np.float64), 0), 0.5)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(xs), pa.int64()), pa.array(chunk * codecs.CHUNK + np.arange(len(xs)), pa.int64()), pa.array(xs, pa.float64()), pa.array(codes, pa.int64()), pa.array(back, pa.float64())], names=["key", "i0", "x", "code", "back"])

    got = packed.mapInArrow(run, "key long, i0 long, x double, code long, back double")
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("cells"), (F.max(F.abs(F.col("back") - F.col("x"))) <= 0.5).alias("within"))


_add("interp_roundtrip", interp_roundtrip, "SELECT user_id AS key, count(*) AS cells, true AS within FROM events GROUP BY user_id")


def truncate_bytes(spark, sf_dir):
    """The upper two bytes of each 32-bit value of a vector, and the largest error that this makes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array([0.0 if y is None else y for y in v or ()], "<f4")
                y = (x.view("<u4") & np.uint32(0xFFFF0000)).view("<f4")
                out.append((float(np.abs(x - y).max(initial=0)), 2 * len(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int64())], names=["vec_id", "max_err", "bytes"])

    return e.mapInArrow(run, "vec_id long, max_err double, bytes long").select("vec_id", (F.col("max_err") < 2.0**-7).alias("small"), "bytes")


_add("truncate_bytes", truncate_bytes, "SELECT vec_id, true AS small, 2 * len(embedding) AS bytes FROM embeddings")


def lossless_fallback(spark, sf_dir):
    """For each vector the smaller of its lattice codes and its raw bytes, both compressed."""
    e = table(spark, sf_dir, "embeddings").where(F.forall("embedding", lambda x: x.isNotNull())).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") / (2 * 2.0**-12) + 0.5).cast("long")).alias("q"), F.col("embedding").cast("array<float>").alias("x"))

    def run(batches):
        for b in batches:
            lossy = [len(zlib.compress(np.array(q, "<i8").tobytes(), 3)) for q in b.column(1).to_pylist()]
            raw = [len(zlib.compress(np.array(x, "<f4").tobytes(), 3)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.minimum(lossy, raw), pa.int64()), pa.array(["lossless" if r <= c else "lossy" for r, c in zip(raw, lossy)])], names=["vec_id", "bytes", "kept"])

    return e.mapInArrow(run, "vec_id long, bytes long, kept string")


_add("lossless_fallback", lossless_fallback)


def quantile_levels(spark, sf_dir):
    """Equal levels fitted to the histogram of a field: cells of width 1, their quantiles at nine places."""
    x = table(spark, sf_dir, "events").select(F.floor("value").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("cell")  # the histogram's cells are bounded by the range of values
    run = x.withColumn("below", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    level = F.least(F.lit(8), F.floor(9 * (F.col("below") - F.col("n") / 2) / F.col("total")))
    c = run.groupBy(level.alias("level")).agg((F.sum(F.col("cell") * F.col("n")) / F.sum("n")).alias("centre"))
    return c.agg(F.round(F.regr_slope("centre", F.col("level").cast("double")), 6).alias("step"), F.round(F.regr_intercept("centre", F.col("level").cast("double")), 6).alias("start"))


_add("quantile_levels", quantile_levels, """SELECT round(regr_slope(centre, level), 6) AS step, round(regr_intercept(centre, level), 6) AS start FROM (
 SELECT least(8, floor(9 * (below - n / 2e0) / total)) AS level, sum(cell * n) / sum(n) AS centre FROM (
  SELECT cell, n, sum(n) OVER (ORDER BY cell) AS below, sum(n) OVER () AS total FROM (SELECT floor(value)::BIGINT AS cell, count(*) AS n FROM events GROUP BY 1)) GROUP BY 1)""")


def kmeans1d_levels(spark, sf_dir):
    """k, cost and centres of the best clusterings of a field's values into 1 to 9 levels: exact on a histogram of at most 512 cells."""
    x, n = levels.bounded_histogram(table(spark, sf_dir, "events"), "value")
    found = levels.optimal_levels(x, n, 9) if len(x) else []
    return spark.createDataFrame([(k + 1, cost, centres.tolist()) for k, (centres, cost) in enumerate(found)], "k int, cost double, centres array<double>")


_add("kmeans1d_levels", kmeans1d_levels)


def level_lookup(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", E.level_of(F.col("value"), 0.0, 16.0).alias("level"))
    return x.withColumn("centre", F.col("level") * E.d(16))


_add("level_lookup", level_lookup, "SELECT event_id, floor(value / 16e0 + 0.5e0)::BIGINT AS level, floor(value / 16e0 + 0.5e0)::BIGINT * 16e0 AS centre FROM events")


def _stored(spark, sf_dir, algorithm, bound):
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stored-{uuid.uuid4().hex}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{shared.rstrip('/')}/{path.rpartition('/')[2]}" if shared else path
    cells = price_series(spark, sf_dir)
    store.compress(cells, Config(abs_bound=bound, algorithm=algorithm), path)
    return cells, store.decompress(spark, path)


def container_roundtrip(spark, sf_dir):
    """A field written as chunks and read again, by each algorithm: cells, and whether all are within the bound."""
    out = None
    for algorithm in ("NOPRED", "LORENZO_REG", "INTERP", "INTERP_LORENZO"):
        cells, got = _stored(spark, sf_dir, algorithm, 1.0)
        # Chunks take a small part of their cells' bytes, so their size on disk would let the cells be gathered and sent to every task.
        both = cells.select("key", "i0", F.col("x").alias("was")).join(got.hint("merge"), ["key", "i0"])
        now = both.groupBy("key").agg(F.lit(algorithm).alias("algorithm"), F.count(F.lit(1)).alias("cells"), (F.max(F.abs(F.col("x") - F.col("was"))) <= 1.0).alias("within"))
        out = now if out is None else out.unionByName(now)
    return out


_add("container_roundtrip", container_roundtrip, "SELECT l_suppkey AS key, algorithm, count(*) AS cells, true AS within FROM lineitem, (SELECT unnest(['NOPRED', 'LORENZO_REG', 'INTERP', 'INTERP_LORENZO']) AS algorithm) GROUP BY ALL")


def zstd_roundtrip(spark, sf_dir):
    """A field kept bit by bit under zstd, read again."""
    return _stored(spark, sf_dir, "LOSSLESS", 0.0)[1]


_add("zstd_roundtrip", zstd_roundtrip, f"SELECT key, i0, x FROM {PRICES}")
