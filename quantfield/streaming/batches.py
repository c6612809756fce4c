"""Trajectories that arrive in batches of frames: each micro-batch is quantized against the frame before it.

The state between batches is the last frame's lattice values for each field and element, one row each, kept by Spark
in a state table under the stream's own folder; a batch reads the version before it and writes the next, so a
repeated batch after a failure gives the same codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import lattice


def encode_batch(frames: DataFrame, state: DataFrame | None, eb: float) -> tuple[DataFrame, DataFrame]:
    """frames: field, frame, element, x. Codes of this batch, and the state after it."""
    q = frames.withColumn("q", lattice(F.col("x"), eb))
    w = Window.partitionBy("field", "element").orderBy("frame")
    prev = F.lag("q").over(w)
    if state is not None:
        q = q.join(state.select("field", "element", F.col("q").alias("last")), ["field", "element"], "left")
    else:
        q = q.withColumn("last", F.lit(None).cast("long"))
    codes = q.withColumn("code", F.col("q") - F.coalesce(prev, F.col("last"), F.lit(0)))
    after = q.groupBy("field", "element").agg(F.max_by("q", "frame").alias("q"))
    if state is not None:
        after = after.unionByName(state.join(after, ["field", "element"], "left_anti").select("field", "element", "q"))
    return codes.select("field", "frame", "element", "code"), after


def start(stream: DataFrame, out: str, checkpoint: str, eb: float):
    """Run the stream; codes under out/codes, state under out/state, a folder for each batch."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        state = spark.read.parquet(f"{out}/state/batch={number - 1}") if number else None
        codes, after = encode_batch(batch, state, eb)
        codes.write.mode("overwrite").parquet(f"{out}/codes/batch={number}")
        after.write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
