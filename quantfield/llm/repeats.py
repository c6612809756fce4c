"""Repeated passages: every byte under a `width`-byte string that starts anywhere else too is removed.

Spark finds where such strings can lie; index families of suffix arrays decide. 32-byte grams are hashed
at every place, and the smallest hash under each window of `width` bytes is the window's anchor: equal
windows have equal anchors. Consecutive windows with one anchor place are a run, known by its anchor's
hash and the hash of its bytes (its context). Then
  - runs whose anchor occurs once are done: no window of theirs occurs twice;
  - runs whose context occurs twice or more are repeated whole;
  - all other runs send one copy of their context's bytes to the task of their anchor. There every batch of
    contexts gets a suffix array (window starts in order of the bytes that follow), is merge-scanned against the levels
    that exist for matches of `width` bytes or more, byte by byte, and enters the family as a new level; levels of
    like size are merged, so sizes grow geometrically;
  - anchors with more than HOT_CONTEXTS different contexts (the edge of a passage that very many documents
    share) would make one task long: their windows are counted one by one, by fingerprint, with
    partial sums in each task.
Hashes of contexts have 64 bits beside their anchor's 64, fingerprints of windows 128.

Defined results: a null text is an empty one; texts under `width` bytes lose nothing. Rows that agree in
doc_id and text repeat each other like any others. An empty table gives no rows. `remove_repeats` keeps
columns besides text as they are, and adds only the names it is given.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import configure, materialize, partitions, table, working

WIDTH, GRAM = 200, 32
#: Contexts of one anchor that one task compares; anchors with more are counted window by window.
HOT_CONTEXTS = 4_096
#: Bytes of contexts that get a suffix array together, and that one task compares.
BATCH_BYTES, TASK_BYTES = 1 << 21, 1 << 25
#: Bytes scanned at a time; places in a slice fit the low bits of a hash.
SLICE, PLACE_BITS = 1 << 18, 20
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def window_hashes(raw: np.ndarray, width: int, seed: np.uint64) -> np.ndarray:
    """A hash of raw[i:i+width] for each i: hashes of 1, 2, 4, ... bytes, joined pairwise."""
    with np.errstate(over="ignore"):
        part, size, out, done = (raw.astype(np.uint64) + np.uint64(1)) * seed, 1, None, 0
        k, left = seed | np.uint64(1), width
        while True:
            if left & 1:
                n = len(raw) - done - size + 1
                out = part[:n] if out is None else out[:n] * (k ^ np.uint64(0x5851F42D4C957F2C)) + part[done : done + n]
                done += size
            left >>= 1
            if not left:
                return _mix(out)
            k = k * np.uint64(0x2545F4914F6CDD1D)
            part = part[: len(part) - size] * k + part[size:]
            if size == 4:
                part ^= part >> np.uint64(29)
            size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """text number, first and last window start, anchor hash of each run in texts of one slice."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(texts), np.uint8)
    gram = window_hashes(raw, GRAM, _SEEDS[0])
    low = sliding_min((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), width - GRAM + 1)
    cut = np.empty(len(low), bool)
    cut[0] = True
    np.not_equal(low[1:], low[:-1], out=cut[1:])
    past = begin + sizes - width + 1
    cut[begin] = True
    cut[past[past < len(low)]] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(low)) - 1
    own = np.searchsorted(begin, first, "right") - 1
    ok = first < past[own]
    first, last, own = first[ok], last[ok], own[ok]
    return own, first - begin[own], last - begin[own], gram[(low[first] & _PLACE).astype(np.int64)]


def slices(texts: list[bytes], width: int = WIDTH):
    """Lists of (text number, offset, bytes) of about SLICE bytes; long texts in slices that overlap by width - 1."""
    part, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), SLICE):
            x = t[at : at + SLICE + width - 1]
            if len(x) < width:
                continue
            part.append((k, at, x))
            size += len(x)
            if size >= SLICE:
                yield part
                part, size = [], 0
    if part:
        yield part


def run_rows(keyed: DataFrame, width: int) -> DataFrame:
    """keyed: d1, d2, text. A row for each run: anchor, context, times, d1, d2, first, last (window starts)."""

    def run(batches):
        working("repeats")
        from xxhash import xxh3_64_intdigest as digest

        for b in batches:
            d1, d2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = [(t or "").encode() for t in b.column(2).to_pylist()]
            for part in slices(texts, width):
                own, first, last, anchor = runs_of([x for _, _, x in part], width)
                data = [x for _, _, x in part]
                context = np.fromiter((digest(data[o][i : j + width]) for o, i, j in zip(own.tolist(), first.tolist(), last.tolist())), np.uint64, len(own))
                # Runs that equal the one before (a text that repeats itself at once) become one row.
                head = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])))
                tail = np.append(head[1:], len(own)) - 1
                own, anchor, context, first, last, times = own[head], anchor[head], context[head], first[head], last[tail], tail - head + 1
                row, at = np.array([k for k, _, _ in part])[own], np.array([a for _, a, _ in part])[own]
                cols = anchor.view(np.int64), context.view(np.int64), times, d1[row], d2[row], (first + at).astype(np.int32), (last + at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "context", "times", "d1", "d2", "first", "last"])

    return keyed.mapInArrow(run, "anchor long, context long, times long, d1 long, d2 int, first int, last int")


def context_rows(texts: DataFrame, width: int) -> DataFrame:
    """texts: text, runs (anchor, whole, hot, first, last), d1, d2. A row with its bytes for each run, or for
    each window of a hot anchor's run its fingerprint (key, key2) in place of bytes."""

    def run(batches):
        working("repeats")
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for text, runs, d1, d2 in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                for r in runs:
                    part = raw[r["first"] : r["last"] + width]
                    if r["hot"]:
                        x = np.frombuffer(part, np.uint8)
                        keys = [window_hashes(x, width, s).view(np.int64).tolist() for s in _SEEDS]
                        n = len(keys[0])
                        rows = (keys[0], keys[1], [r["whole"]] * n, [d1] * n, [d2] * n, range(r["first"], r["last"] + 1), range(r["first"], r["last"] + 1), [None] * n)
                    else:
                        rows = ([r["anchor"]], [0], [r["whole"]], [d1], [d2], [r["first"]], [r["last"]], [part])
                    for c, v in zip(out, rows):
                        c.extend(v)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "key2", "whole", "d1", "d2", "first", "last", "bytes"])

    return texts.select("text", "runs", "d1", "d2").mapInArrow(run, "key long, key2 long, whole boolean, d1 long, d2 int, first int, last int, bytes binary")


def words(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that sort like them."""
    return np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))[at].astype(np.uint64)


def suffix_order(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `at` in order of their first `width` bytes (places in `at`), and whether each shares all
    of them with the one before. Ranks of 8 bytes, then 16, 32, ... by pairs; the last pair overlaps."""
    size, rank = 8, np.unique(words(raw, np.arange(len(raw) - 7)), return_inverse=True)[1]
    while size * 2 <= width:
        rank = np.unique(rank[:-size] * len(raw) + rank[size:], return_inverse=True)[1]
        size *= 2
    key = rank[at] * len(raw) + rank[at + width - size]
    order = np.argsort(key, kind="stable")
    return order, np.append(False, key[order[1:]] == key[order[:-1]])


class Level:
    """A suffix array of bytes: places of suffixes in order, one of those that share `width` bytes; the first eight
    bytes of each; and each one's place in the family's flags."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, entry: np.ndarray, width: int):
        self.raw, self.at, self.entry, self.width = raw, at, entry, width
        self.first = words(raw, at)

    def bisect(self, low: np.ndarray, high: np.ndarray, asked: np.ndarray, offset: int, past: bool) -> np.ndarray:
        """Where in its range of suffixes each word stands, by the word at offset: before equal ones, or past them."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            w, q = words(self.raw, self.at[mid] + offset), asked[open_]
            up = w <= q if past else w < q
            low[open_] = np.where(up, mid + 1, low[open_])
            high[open_] = np.where(up, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        return low

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Where each suffix of other stands among these, and whether the one there shares `width` bytes with it. The
        ranges that share a prefix shrink by eight bytes a step; suffixes leave when theirs is empty."""
        low, high = np.searchsorted(self.first, other.first, "left"), np.searchsorted(self.first, other.first, "right")
        live = np.flatnonzero(low < high)
        for offset in [*range(8, self.width - 8, 8), self.width - 8]:
            q = words(other.raw, other.at[live] + offset)
            low[live] = self.bisect(low[live], high[live], q, offset, False)
            high[live] = self.bisect(low[live], high[live], q, offset, True)
            live = live[low[live] < high[live]]
        same = np.zeros(len(low), bool)
        same[live] = True
        return low, same

    def merged(self, other: Level) -> Level:
        """One level of both, with one suffix of equal ones: they are known to be repeated."""
        low, same = self.scan(other)
        low = low[~same]
        at = np.insert(self.at, low, other.at[~same] + len(self.raw))
        return Level(np.concatenate([self.raw, other.raw]), at, np.insert(self.entry, low, other.entry[~same]), self.width)


class IndexFamily:
    """Levels of geometrically growing size; hit says of each suffix added whether its first `width` bytes are repeated."""

    def __init__(self, width: int):
        self.levels: list[Level] = []
        self.hit, self.width = np.zeros(0, bool), width

    def add(self, raw: np.ndarray, at: np.ndarray) -> None:
        """raw: the bytes of a batch; at: the suffixes that count, each with `width` bytes at least."""
        if not len(at):
            return
        start = len(self.hit)
        self.hit = np.concatenate([self.hit, np.zeros(len(at), bool)])
        order, same = suffix_order(raw, at, self.width)
        self.hit[start + order[same | np.append(same[1:], False)]] = True
        order = order[~same]
        new = Level(raw, at[order], start + order, self.width)
        for level in self.levels:
            place, equal = level.scan(new)
            self.hit[new.entry[equal]] = True
            self.hit[level.entry[place[equal]]] = True
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2].at) <= 2 * len(self.levels[-1].at):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)


def compare_contexts(contexts: DataFrame, width: int) -> DataFrame:
    """d1, d2, first, last (bytes, end excluded): the repeated stretches of the contexts of each task."""

    def run(batches):
        working("repeats")
        family, owners, starts, held, size = IndexFamily(width), [], [], [], 0

        def add():
            raw = np.frombuffer(b"".join(held), np.uint8)
            sizes = np.array([len(p) for p in held])
            begin, n = np.cumsum(sizes) - sizes, sizes - width + 1
            family.add(raw, np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            starts.append(n)

        for b in batches:
            parts = b.column(6).to_pylist()
            if not parts:
                continue
            owners.append([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)])
            held += parts
            size += sum(map(len, parts))
            if size >= BATCH_BYTES:
                add()
                held, size = [], 0
        if held:
            add()
        if not owners:
            return
        whole, d1, d2, first = (np.concatenate(x) for x in zip(*owners))
        n = np.concatenate(starts)
        begin = np.cumsum(n) - n
        hit = family.hit.astype(np.int8)
        edge = np.diff(hit, prepend=0)
        edge[begin] = hit[begin]
        up = np.flatnonzero(edge == 1)
        closing = np.zeros(len(hit) + 1, bool)
        closing[1:] = hit == 1
        ends = np.diff(hit, append=0) == -1
        ends[begin + n - 1] |= hit[begin + n - 1] == 1
        down = np.flatnonzero(ends)
        own = np.searchsorted(begin, up, "right") - 1
        keep = ~whole[own]
        own, up, down = own[keep], up[keep], down[keep]
        a, z = first[own] + up - begin[own], first[own] + down - begin[own] + width
        for i in range(0, len(own), 10_000):
            j = slice(i, i + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1[own[j]], d2[own[j]], a[j].astype(np.int32), z[j].astype(np.int32))], names=["d1", "d2", "first", "last"])

    return contexts.select("key", "whole", "d1", "d2", "first", "last", "bytes").mapInArrow(run, "d1 long, d2 int, first int, last int")


def repeated_stretches(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """d1, d2, spans: for each text with repeated bytes, stretches (first, last), not merged yet."""
    spark = keyed.sparkSession
    runs = materialize(run_rows(keyed, width), "runs")
    often = runs.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("context").alias("a"), F.max("context").alias("z")).where("n > 1").select("anchor", (F.col("a") != F.col("z")).alias("mixed"))
    shared = materialize(runs.join(often, "anchor"), "shared-runs")
    mixed = shared.where("mixed")
    who = F.xxhash64("d1", "d2", "first")
    contexts = materialize(mixed.groupBy("anchor", "context").agg(F.sum("times").alias("n"), *[F.min_by(c, who).alias(c) for c in ("d1", "d2", "first", "last")]), "contexts")
    several = contexts.where("n > 1").select("anchor", "context")
    marks = shared.where("not mixed").unionByName(mixed.join(several, ["anchor", "context"], "left_semi").withColumn("mixed", F.lit(True)))
    marks = marks.select("d1", "d2", "first", (F.col("last") + width).alias("last"))

    crowd = contexts.groupBy("anchor").agg((F.count(F.lit(1)) > HOT_CONTEXTS).alias("hot"))
    by_text = contexts.join(crowd, "anchor").groupBy("d1", "d2").agg(F.collect_list(F.struct("anchor", (F.col("n") > 1).alias("whole"), "hot", "first", "last")).alias("runs"))
    rows = materialize(context_rows(keyed.join(by_text, ["d1", "d2"]), width), "context-rows")
    windows = rows.where("bytes is null")
    twice = windows.groupBy("key", "key2").agg(F.sum(F.when(F.col("whole"), 2).otherwise(1)).alias("w")).where("w > 1").select("key", "key2")
    marks = marks.unionByName(windows.where("not whole").join(twice, ["key", "key2"]).select("d1", "d2", "first", (F.col("last") + width).alias("last")))
    cold = rows.where("bytes is not null")
    # A task holds the bytes of its contexts: about TASK_BYTES, whatever the corpus.
    total = cold.agg(F.sum(F.length("bytes").cast("long"))).first()[0] or 0
    cold = cold.repartition(max(partitions(spark), -(-total // TASK_BYTES)), "key")
    marks = marks.unionByName(compare_contexts(cold, width))
    return marks.groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def with_keys(docs: DataFrame) -> DataFrame:
    """Two hashes of doc_id and text, 96 bits, stand for a row; rows that agree in both are alike."""
    return docs.withColumn("d1", F.xxhash64("doc_id", "text")).withColumn("d2", F.hash("doc_id", "text"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, as_text: bool = False) -> DataFrame:
    """doc_id, text, rest (the other columns, as a struct), spans (removed bytes, merged), kept (the bytes that remain).
    as_text: doc_id, text (what remains; a character that lost a byte is gone), rest."""
    configure(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    keyed = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest")))
    spans = repeated_stretches(keyed.select("d1", "d2", "text"), width)

    def run(batches):
        working("repeats")
        for b in batches:
            kept, merged = [], []
            for text, raw_spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                raw, at, parts = (text or "").encode(), 0, []
                m = merge_spans([(s["first"], s["last"]) for s in raw_spans or ()])
                for a, z in m:
                    parts.append(raw[at:a])
                    at = z
                left = b"".join([*parts, raw[at:]])
                kept.append(left if not as_text else None if text is None else left.decode(errors="ignore"))
                merged.append([{"first": a, "last": z} for a, z in m])
            if as_text:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), b.column("rest")], names=["doc_id", "text", "rest"])
            else:
                spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("rest"), pa.array(merged, spans_type), pa.array(kept, pa.binary())], names=["doc_id", "text", "rest", "spans", "kept"])

    joined = keyed.join(spans, ["d1", "d2"], "left").select("doc_id", "text", "rest", "spans")
    schema = joined.select("doc_id", "text", "rest").schema
    return joined.mapInArrow(run, schema if as_text else StructType([*schema, *StructType.fromDDL("spans array<struct<first:int,last:int>>, kept binary")]))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated bytes gone from text, and n_chars (if there) counted anew. A text that lost all is empty."""
    out = remove_repeats(docs, width, as_text=True)
    cols = {c: F.col("rest")[c].cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[cols.get(c, F.col(c)).alias(c) for c in docs.columns])


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return got.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, for tests: all strings in one dictionary."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - width + 1):
            seen[r[i : i + width]] = seen.get(r[i : i + width], 0) + 1
    out = []
    for r in raws:
        m = merge_spans([(i, i + width) for i in range(len(r) - width + 1) if seen[r[i : i + width]] > 1])
        gone = {i for a, z in m for i in range(a, z)}
        out.append((len(r), len(gone), len(m), hashlib.sha256(bytes(x for i, x in enumerate(r) if i not in gone)).hexdigest()))
    return out
