"""Small functions: codecs, settings, quantizer edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantfield.functions import expressions as E
from quantfield.functions.config import Config, normal_dims
from quantfield.operators import codecs
from quantfield.operators.lorenzo import decode, encode, quantized, restored


@given(st.lists(st.integers(-5, 40), max_size=300))
@settings(max_examples=40, deadline=None)
def test_huffman_and_container(values):
    counts = {v: values.count(v) for v in set(values)}
    bits = codecs.canonical(codecs.code_lengths(counts))
    x = np.array(values, np.int64)
    assert codecs.huffman_unpack(codecs.huffman_pack(x, bits), len(x), bits) == values if values else True
    back, config = codecs.opened(codecs.container(x, bits, Config().to_json()), bits)
    assert back.tolist() == values and config["mode"] == "ABS"


def test_huffman_near_entropy():
    counts = {i % 100: 10 for i in range(1000)}
    lengths = codecs.code_lengths(counts)
    assert 6.6 <= sum(lengths.values()) / 100 <= 6.8
    assert sum(2.0**-n for n in lengths.values()) == 1


@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.just(float("nan")), st.just(float("inf"))), max_size=200), st.sampled_from([0.5, 1e-3, 12.1973]))
@settings(max_examples=60, deadline=None)
def test_interpolation_bound(values, eb):
    x = np.array(values, np.float64)
    codes, back = codecs.interpolate(x, eb)
    ok = np.isfinite(x)
    assert len(codes) == len(x) and (np.abs(back[ok] - x[ok]) <= eb).all()
    assert np.array_equal(back[~ok], x[~ok], equal_nan=True)


def test_config_round_trips():
    c = Config(dims=[1, 20, 30], mode="REL", rel_bound=1e-3)
    assert c.dims == [20, 30] and c.block == 16
    assert Config.from_json(c.to_json()) == c and Config.from_ini(c.to_ini()) == c
    with pytest.raises(ValueError):
        Config(mode="NONE")
    with pytest.raises(ValueError):
        Config.from_ini("[field]\ncolour = 1\n")
    with pytest.raises(ValueError):
        normal_dims([2] * 5)


def test_quantizer_edges(spark):
    eb = 12.1973
    rows = [(float(v),) for v in (100.11212, 10.723, -10.723, 0.0, math.nan, math.inf, -math.inf, 1e300, eb, 3 * eb)]
    df = spark.createDataFrame(rows, "x double").withColumn("code", E.code(F.col("x"), E.d(0), eb))
    df = df.withColumn("back", E.recovered(F.col("code"), E.d(0), F.col("x"), eb))
    for r in df.collect():
        if math.isfinite(r.x):
            assert abs(r.back - r.x) <= eb
        else:
            assert r.code == 0


def test_lorenzo_keeps_bound_with_odd_values(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 1.5, math.nan, -7.25, math.inf, 1e300, 3.0, None, 2.0])]
    df = spark.createDataFrame(rows, "key string, i0 long, x double")
    for order in (1, 2):
        full = decode(encode(quantized(df, 0.25), ["key"], ["i0"], order), ["key"], ["i0"], order).withColumn("v", restored(0.25))
        for r in full.collect():
            if r.x is None:
                continue
            assert (math.isnan(r.x) and math.isnan(r.v)) or r.v == r.x or abs(r.v - r.x) <= 0.25
    assert encode(quantized(df.limit(0), 0.25), ["key"], ["i0"]).count() == 0


def test_empty_and_single_fields(spark):
    from quantfield.operators.codecs import chunks, decode_containers, encode_containers, histogram

    for rows in ([], [(1, 0, 5)]):
        cells = spark.createDataFrame(rows, "key long, i0 long, code long")
        stored, bits = encode_containers(chunks(cells, "code"), histogram(cells, "code"), Config().to_json())
        assert [tuple(r) for r in decode_containers(stored, bits).collect()] == rows
