"""Packing documents into windows of at most `capacity` tokens by minimum bin slack.

A document's ids are cut into full windows and one remainder. What remains to place is a multiset of
lengths below the capacity, so a histogram of at most capacity - 1 counts stands for any corpus: the
plan is made from it alone. Each window takes the longest length left, then the multiset of remaining
lengths whose sum comes closest to the capacity (subset sums as bits of one integer, counts found by
going back through them), and the same window is repeated as often as the counts allow, so at most a
few thousand distinct windows arise. A piece finds its place by its rank among the pieces of its length.

Defined results: a null text is an empty one: its document is the end id alone. Rows with one doc_id
are packed each by itself. An empty table gives no pieces. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import configure, materialize, table
from .encoders import encoder

CAPACITY = 2048
PIECES = "part int, doc_id long, start long, length int, doc_tokens long, local_rank long, ids binary"


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is at most room and closest to it; larger lengths first."""
    usable = [n for n in sorted(counts, reverse=True) if n <= room and counts[n]]
    reach, steps, mask = 1, [], (2 << room) - 1
    for n in usable:
        steps.append(reach)
        left, part = min(counts[n], room // n), 1
        while left:
            take = min(part, left)
            reach |= reach << (n * take) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, before in zip(reversed(usable[: len(steps)]), reversed(steps)):
        k = 0
        while not before >> at & 1:
            at -= n
            k += 1
        if k:
            used[n] = k
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: uses in one window}), until no length is left."""
    left, plan = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = closest_fill(left, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        repeats = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * repeats
            if not left[n]:
                del left[n]
        plan.append((repeats, used))
    return plan


def cut_pieces(docs: DataFrame, tokenizer: str, style: str = "words", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """PIECES: full windows and remainders with their ids (little-endian unsigned 32-bit); local_rank counts
    the pieces of one length that this task has cut before."""

    def run(batches):
        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer, style), np.zeros(capacity + 1, np.int64)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, raw in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist())):
                ids = np.append(np.frombuffer(raw, enc.dtype).astype("<u4"), np.uint32(end_id))
                for at in range(0, len(ids), capacity):
                    x = ids[at : at + capacity]
                    for c, v in zip(cols, (part, doc_id, at, len(x), len(ids), int(seen[len(x)]), x.tobytes())):
                        c.append(v)
                    seen[len(x)] += 1
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "doc_id", "start", "length", "doc_tokens", "local_rank", "ids"])

    configure(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def place(pieces: DataFrame, carry: dict[str, Column], capacity: int = CAPACITY) -> DataFrame:
    """Each piece's doc_id, start, length, doc_tokens, the carried columns, sequence_id and offset.

    pieces: a written table of PIECES. Only what `carry` makes of ids moves with the pieces."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_task = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    # At most `capacity` rows, whatever the corpus.
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, taken, base = [], dict.fromkeys(counts, 0), 0
    for repeats, used in plan_windows(counts, capacity):
        at = 0
        for n in sorted(used, reverse=True):
            rows.append((n, taken[n], taken[n] + used[n] * repeats, used[n], base, at))
            taken[n] += used[n] * repeats
            at += n * used[n]
        base += repeats
    plan = spark.createDataFrame(rows, "length int, low long, high long, uses long, base long, at long")
    slim = pieces.select("part", "doc_id", "start", "length", "doc_tokens", "local_rank", *[c.alias(k) for k, c in carry.items()])
    ranked = slim.join(by_task.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    # The plan has at most some thousand rows: its size depends on the capacity alone.
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= low and rank < high")
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), *carry, "doc_tokens",
        F.expr("base + (rank - low) div uses").alias("sequence_id"),
        F.expr("at + (rank - low) % uses * length").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, style: str = "words", end_id: int = 1, capacity: int = CAPACITY, carry: dict[str, Column] | None = None) -> DataFrame:
    """Pieces of all documents with their places. carry: what to keep of a piece's ids; the ids by default."""
    pieces = materialize(cut_pieces(docs, tokenizer, style, end_id, capacity), "pieces")
    return place(pieces, carry if carry is not None else {"ids": F.col("ids")}, capacity)


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, n_tokens, padded_length, ids: the windows themselves, from pieces that carry ids.
    A window is padded to the capacity, except where its tokens are a power of two in number."""
    joined = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    power = F.expr("n_tokens > 0 and (n_tokens & (n_tokens - 1)) = 0")
    return joined.select("sequence_id", "n_tokens", F.when(power, F.col("n_tokens")).otherwise(F.lit(capacity)).alias("padded_length"), ids.alias("ids"))


@lru_cache(maxsize=1)
def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_digest(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, word_vocabulary(), carry={"ids_crc32": F.crc32("ids")})


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"))
