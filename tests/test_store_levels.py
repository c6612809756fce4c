"""Fields stored and read again; exact k-means; hand-computed values of stencils and rules."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfield.functions import expressions as E
from quantfield.functions.config import Config
from quantfield.operators import levels, store
from quantfield.plans.stencils import fill_start


@pytest.mark.parametrize("algorithm", sorted(store.CHOICES))
def test_stored_fields(spark, tmp_path, algorithm):
    r = np.random.default_rng(1)
    x = [float(v) for v in np.cumsum(r.normal(size=400))] + [None, float("nan"), float("inf"), -float("inf"), 1e300, 0.0, -0.0, None]
    rows = [("a", k, v) for k, v in enumerate(x)] + [("b", 20_000, 1.5), (None, 3, 2.5)]
    df = spark.createDataFrame(rows, "key string, i0 long, x double")
    store.compress(df, Config(abs_bound=0.01, algorithm=algorithm), f"file://{tmp_path}/x")
    got = {(g.key, g.i0): g.x for g in store.decompress(spark, f"file://{tmp_path}/x").collect()}
    assert len(got) == len(rows)
    for key, i0, v in rows:
        w = got[key, i0]
        assert (w is None) == (v is None)
        if v is not None and np.isfinite(v):
            assert abs(w - v) <= 0.01 if algorithm != "LOSSLESS" else np.array(w).tobytes() == np.array(v).tobytes()
        elif v is not None:
            assert np.isnan(w) and np.isnan(v) or w == v
    store.compress(df.limit(0), Config(algorithm=algorithm), f"file://{tmp_path}/none")
    assert store.decompress(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        store.chunk_cells(b"QFLD" + bytes(80))


def test_exact_levels(spark):
    r = np.random.default_rng(2)
    for _ in range(20):
        x, n = np.sort(r.normal(size=9)), r.integers(1, 6, 9).astype(float)
        for k, (centres, cost) in enumerate(levels.optimal_levels(x, n, 4), 1):
            best = min(sum(float((n[a:z] * (x[a:z] - np.average(x[a:z], weights=n[a:z])) ** 2).sum()) for a, z in itertools.pairwise([0, *cuts, 9])) for cuts in itertools.combinations(range(1, 9), k - 1))
            assert cost == pytest.approx(best, abs=1e-9) and len(centres) == k and (np.diff(centres) > 0).all()
    assert len(levels.bounded_histogram(spark.createDataFrame([(None,), (float("nan"),)], "x double"), "x")[0]) == 0
    assert [a.tolist() for a in levels.bounded_histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x")] == [[2.0], [3.0]]


def test_akima(spark):
    rows = [(0.0, 1.0, 1.0, 0.0), (0.0, 1.0, 3.0, 4.5), (4.5, 3.0, 1.0, 0.0), (1.0, 2.0, 3.0, 4.0)]
    got = [r.p for r in spark.createDataFrame(rows, "a double, b double, c double, e double").select(E.akima(*(F.col(k) for k in "abce")).alias("p")).collect()]
    assert got[0] == 1.125 and got[1] == got[2] and got[3] == 2.5


def test_fill_frames(spark):
    def of(frames):
        cells = spark.createDataFrame([(i, j, float(v)) for i, f in enumerate(frames) for j, v in enumerate(f)], "i0 long, i1 long, x double")
        return fill_start(cells).first().first_fill

    assert of([[1, 2], [3, 3], [5, 5], [5, 5]]) == 2  # a constant frame of another value is none
    assert of([[5, 5], [5, 5]]) == 1 and of([[1, 1], [1, 2]]) == 2


def test_stored_fields_are_joined_by_shuffle(spark):
    """A folder of chunks is far smaller than its cells, so its size is no reason to send them to every task."""
    from quantfield.plans.coding import container_roundtrip

    plan = container_roundtrip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "BroadcastHashJoin" not in plan
