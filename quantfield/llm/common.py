"""Shared plumbing: the shared scratch folder, materialised tables, Arrow settings."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII separators; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows come to Python in batches of at most so many, and about so many bytes.
BATCH_ROWS, ARROW_BYTES = 500, 16 << 20


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches, which hold whole texts, by rows and bytes. A row is never cut, so the longest one is the least bound."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What is kept in this worker process between tasks: how to let go of it, by the name of the work it is for.
_KEPT: dict[str, Callable[[], None]] = {}
_work = [""]


def keeps(work: str, forget: Callable[[], None]) -> None:
    _KEPT[work] = forget


def working(work: str) -> None:
    """Where a task begins. Worker processes outlive stages: what they keep for other work goes, and freed memory back to the system."""
    if _work[0] != work:
        _work[0] = work
        for other, forget in _KEPT.items():
            if other != work:
                forget()
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and all runs in one process (tests), a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quantfield-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go at the end of the query that made them, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation. Its shuffle
    files, which nothing reads again, are let go of at once."""
    spark = df.sparkSession
    path, before = path or new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows no model here learns from: crc32 of the id's text leaves remainder 1 by 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(True))
