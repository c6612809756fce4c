"""Raw little-endian arrays and containers as tables.

Files are read by Spark's binaryFile source, so any store that Spark reaches will do. Large arrays are written
as many part files of one field each; a part is a slab of its field."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: numpy types by name, and what Spark holds them in (unsigned ones in the next wider type).
TYPES = {"float32": "float", "float64": "double", "int8": "byte", "uint8": "short", "int16": "short", "uint16": "int", "int32": "int", "uint32": "long", "int64": "long", "uint64": "decimal(20,0)"}


def read_raw(spark: SparkSession, path: str, dtype: str, n: int | None = None, start: int = 0) -> DataFrame:
    """field (the path), i0, x: values of each file from `start` on. A file that does not hold n values, if given, is an error."""
    size = np.dtype(dtype).itemsize
    kind = TYPES[dtype]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(raw) % size or (n is not None and len(raw) != n * size):
                    raise ValueError(f"{name} has {len(raw)} bytes, not {n if n is not None else 'a whole number of'} values of {size}")
                x = np.frombuffer(raw, np.dtype(dtype).newbyteorder("<"))[start:]
                for i in range(0, len(x), 1 << 16):
                    part = x[i : i + (1 << 16)]
                    values = pa.array([int(v) for v in part], pa.decimal128(20, 0)) if dtype == "uint64" else pa.array(part.astype(part.dtype.newbyteorder("="))).cast(_ARROW[kind])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(start + i, start + i + len(part)), pa.int64()), values], names=["field", "i0", "x"])

    return files.mapInArrow(run, f"field string, i0 long, x {kind}")


_ARROW = {"float": pa.float32(), "double": pa.float64(), "byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64()}


def field_blocks(cells: DataFrame, dtype: str, slab: int = 1 << 20) -> DataFrame:
    """field, slab, data: little-endian bytes of slabs of a field, in order; ready to be written as Parquet."""
    c = cells.withColumn("slab", F.floor(F.col("i0") / slab).cast("long"))
    packed = c.groupBy("field", "slab").agg(F.sort_array(F.collect_list(F.struct("i0", "x"))).alias("s")).select("field", "slab", F.col("s.x").alias("xs"))

    def run(batches):
        for b in batches:
            data = [np.array(x, np.dtype(dtype).newbyteorder("<")).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["field", "slab", "data"])

    return packed.mapInArrow(run, "field string, slab long, data binary")


def write_text(cells: DataFrame, path: str) -> None:
    """One value a line, in order of i0, in part files that follow each other."""
    cells.orderBy("field", "i0").select(F.col("x").cast("string")).write.mode("overwrite").text(path)


def write_containers(stored: DataFrame, path: str, config: str) -> None:
    """Containers as Parquet; settings beside them, as one row."""
    stored.write.mode("overwrite").parquet(f"{path}/chunks")
    stored.sparkSession.createDataFrame([(config,)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
