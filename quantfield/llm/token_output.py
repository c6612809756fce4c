"""Token ids on disk: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

Format, one Parquet data set of blocks. A block holds the ids of consecutive documents (ascending
doc_id, nulls first) as ranks: rank 0 is the id most frequent in the corpus. Four ranks share one
control byte (two bits each: bytes of the rank less 1, first rank in the low bits); `data` is the
ranks' little-endian bytes without leading zeros. Columns: shard (ascending in doc_id), block
(ascending in the shard), shard_start (ids in the shard before the block), doc_ids, lengths,
control, data. A second data set, `ranks`, maps rank to id; it has at most a vocabulary's rows.

Defined results: a null text is an empty one, and its document holds the end id alone. Rows with one
doc_id stay rows of their own, next to each other. An empty table gives no blocks. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, materialize, new_path, partitions, table
from .encoders import encoder

#: Ids in a block, about; a longer document gets a block of its own.
BLOCK_IDS = 1 << 19

BLOCKS = "shard int, block int, shard_start long, doc_ids array<long>, lengths array<long>, control binary, data binary"
_CODES = np.arange(256, dtype=np.uint8)
#: Control byte -> bytes of each of its four ranks.
LENGTHS = np.stack([(_CODES >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.int64)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks (unsigned 32-bit)."""
    ranks = ranks.astype("<u4", copy=False)
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two[: len(ranks)] = size
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenize(docs: DataFrame, tokenizer: str, style: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, or 16-bit where the vocabulary allows: width bytes)."""

    def run(batches):
        enc = encoder(tokenizer, style)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            ids = [x + end for x in enc.ids(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "width", "ids"])

    configure(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, width int, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n: over all documents; each task sends what it has counted, at most a vocabulary's rows."""

    def run(batches):
        n = np.zeros(0, np.int64)
        for b in batches:
            for width, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(got) > len(n):
                    n = np.concatenate([n, np.zeros(len(got) - len(n), np.int64)])
                n[: len(got)] += got
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n[i], pa.int64())], names=["id", "n"])

    return tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, style: str = "spaces", end_id: int = 2) -> None:
    """Write documents' ids under path (blocks/ and ranks/), in ascending doc_id order."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, style, end_id), "tokens")
    # At most a vocabulary's rows: 2 ** 16 or so, whatever the corpus.
    counts = sorted(id_counts(tokens).collect(), key=lambda r: (-r.n, r.id))
    ids = np.array([r.id for r in counts], np.uint32)
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    spark.createDataFrame([(k, int(r.id), int(r.n)) for k, r in enumerate(counts)], "rank long, id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        shard, block, start, held, rank_of = TaskContext.get().partitionId(), 0, 0, [], ranks.value

        def flush():
            got = np.concatenate([x for _, x in held])
            control, data = pack_ranks(got)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "shard_start": start, "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held], "control": control, "data": data}], schema=SCHEMA), len(got)

        size = 0
        for b in batches:
            for doc_id, width, ids in zip(*(c.to_pylist() for c in b.columns)):
                held.append((doc_id, rank_of[np.frombuffer(ids, f"<u{width}")]))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    out, n = flush()
                    yield out
                    block, start, size, held = block + 1, start + n, 0, []
        if held:
            yield flush()[0]

    ordered = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")


SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    table_of = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()  # at most a vocabulary's rows
    # One row for each shard, that is for each task that wrote.
    totals = sorted(blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect())
    base = dict(zip((r.shard for r in totals), np.concatenate([[0], np.cumsum([r.n for r in totals])]).tolist()))
    shared = spark.sparkContext.broadcast((table_of["id"].to_numpy().astype("<u4"), base))

    def run(batches):
        id_of, starts = shared.value
        for b in batches:
            for r in b.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                ids = id_of[unpack_ranks(r["control"], r["data"], int(lengths.sum()))]
                end = np.cumsum(lengths)
                first = starts[r["shard"]] + r["shard_start"]
                out = [ids[e - n : e].tobytes() for e, n in zip(end.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(first + end - lengths, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"])

    return blocks.select("shard", "shard_start", "lengths", "doc_ids", "control", "data").mapInArrow(run, "doc_id long, start long, ids binary")


@lru_cache(maxsize=1)
def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, byte_vocabulary())
    got = read_token_files(spark, path)
    return got.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def id_bytes_crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
