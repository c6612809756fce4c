import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfield.functions.expressions import d
from quantfield.sources.raw import TYPES, field_blocks, read_raw, write_text
from quantfield.streaming.batches import start


@pytest.mark.parametrize("dtype", sorted(TYPES))
def test_raw_round_trip(spark, tmp_path, dtype):
    x = np.arange(100).astype(dtype)
    x.astype(x.dtype.newbyteorder("<")).tofile(tmp_path / "a.dat")
    df = read_raw(spark, str(tmp_path / "a.dat"), dtype, 100)
    assert [float(r.x) for r in df.orderBy("i0").collect()] == x.astype(float).tolist()
    assert read_raw(spark, str(tmp_path / "a.dat"), dtype, start=90).count() == 10
    if dtype != "uint64":
        assert field_blocks(df, dtype).first().data == (tmp_path / "a.dat").read_bytes()
    with pytest.raises(Exception, match="bytes"):
        read_raw(spark, str(tmp_path / "a.dat"), dtype, 99).count()


def test_text(spark, tmp_path):
    np.arange(5, dtype="<i4").tofile(tmp_path / "a.dat")
    write_text(read_raw(spark, str(tmp_path / "a.dat"), "int32"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["0", "1", "2", "3", "4"]


def test_batches_carry_the_last_frame(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 4)).cumsum(0)
    rows = [("f", t, e, float(x[t, e])) for t in range(9) for e in range(4)]
    schema = "field string, frame long, element long, x double"
    for k in range(3):
        spark.createDataFrame(rows[k * 12 : k * 12 + 12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 0.125).awaitTermination(120)
    codes = spark.read.parquet(str(tmp_path / "out/codes"))
    from pyspark.sql import Window

    w = Window.partitionBy("element").orderBy("frame")
    back = {(r.frame, r.element): r.v for r in codes.withColumn("v", F.sum("code").over(w) * d(0.25)).collect()}
    assert len(back) == 36 and all(abs(back[t, e] - x[t, e]) <= 0.125 for t in range(9) for e in range(4))
