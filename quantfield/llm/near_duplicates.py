"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Its sketch has one register
for each of BUCKETS buckets: the smallest hash in the bucket, kept as its number of leading zeros and the
MANTISSA bits after the first one. Empty buckets borrow the register of another bucket, the first filled one in
an order of all buckets that each has of its own, so that short documents have full sketches whose registers
spread over all their filled buckets. Bands of ROWS registers, hashed, are the keys of candidate groups. Pairs
whose sizes alone keep them under the threshold are dropped. Sets of at most SMALL shingles go along whole and
are compared in the group exactly. For other pairs the share of equal registers, corrected for registers that
collide by chance, estimates the Jaccard similarity; those whose estimate is under the threshold by more than
MARGIN are dropped. All the rest is confirmed on full sets.

Documents with equal sets are one candidate. Groups are cut into blocks of about BLOCK members, and blocks
compared pairwise in numpy, so no task holds a group whole. A first round confirms only a forest that
joins the components in each pair of blocks, highest estimates first; a second compares what is left between
components. There sets of at most WHOLE shingles come along whole, so that their links are counted exactly and
again a forest of them is enough; only pairs with a larger set are still chosen by their estimate.
A pair counts in the first band that both share, so groups of several bands give it once.
Links within a component add nothing to it, so the components are those of all candidate pairs.

Defined results: a null text or one without words has an empty set and no links. Texts with fewer words
than a shingle are one shingle, all their words. Rows with one doc_id are one node, which is in every
component that one of them reaches; each row keeps its own set size. A null doc_id links with nothing. An
empty table gives no rows. Columns besides doc_id and text are ignored here and kept by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, keeps, materialize, partitions, table, working
from .components import components

SHINGLE, PERCENT = 5, 85
BUCKETS, ROWS, MANTISSA = 256, 5, 10
#: Bands use the first BANDS * ROWS registers, estimates all.
BANDS = 25
#: Pairs with a set of under 0.85 * SMALL shingles never come to an estimate.
SMALL = 75
#: How far under the threshold an estimate may be: 4.2 standard deviations of the estimate there, which were 0.020 to
#: 0.026 in simulations with sets of 66 to 5000 shingles (borrowed registers make it more than sqrt(0.85 * 0.15 / 256)).
MARGIN = 0.11
#: In the second round sets of at most this many shingles (8 bytes each) come along whole. Their pairs are left uncounted
#: only where the estimate is further than WIDE under the threshold, about ten standard deviations.
WHOLE, WIDE = 1024, 0.25
BLOCK = 1024
#: Words whose hashes a worker remembers; beyond it begins anew.
WORDS_KEPT = 200_000
_BITS = BUCKETS.bit_length() - 1
_RNG = np.random.default_rng(20240229)
_WORD_KEYS = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
#: For each bucket (rows), the turn at which it asks each other one.
_TURN = _RNG.random((BUCKETS, BUCKETS)).argsort(1).astype(np.uint8)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        v = self[word] = xxh3_64_intdigest(word)
        return v


_words = WordHashes()
keeps("near duplicates", _words.clear)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes in order. bytes.lower() changes A-Z alone; bytes.split() cuts at the six separators."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    if len(_words) > WORDS_KEPT:
        _words.clear()
    n, k = max(1, len(w) - SHINGLE + 1), min(len(w), SHINGLE)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = (out ^ h[j : j + n]) * _WORD_KEYS[j]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def registers(s: np.ndarray) -> np.ndarray:
    """BUCKETS registers: leading zeros of a bucket's smallest hash in the high bits, MANTISSA bits below."""
    bucket = (s % np.uint64(BUCKETS)).astype(np.int64)
    low = np.full(BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, bucket, s >> np.uint64(_BITS))
    full = np.zeros(BUCKETS, bool)
    full[bucket] = True
    low &= np.uint64((1 << (64 - _BITS)) - 1)
    # The leading one's place from the exponent of the nearest double below.
    top = np.maximum(low, np.uint64(1))
    size = np.frexp((top >> np.uint64(5)).astype(np.float64))[1].astype(np.int64) + 5
    zeros = 64 - _BITS - size
    shift = np.maximum(size - 1 - MANTISSA, 0).astype(np.uint64)
    reg = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | ((low >> shift) & np.uint64((1 << MANTISSA) - 1))
    reg = reg.astype("<u2")
    if not full.all():
        empty, filled = np.flatnonzero(~full), np.flatnonzero(full)
        reg[empty] = reg[filled[_TURN[np.ix_(empty, filled)].argmin(1)]]
    return reg


#: Chance that registers of unrelated sets agree: same leading zeros (1/3 in all) and same mantissa.
COLLISION = 1 / 3 / 2**MANTISSA


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less those that collide by chance."""
    return np.clip((equal / BUCKETS - COLLISION) / (1 - COLLISION), 0, 1)


def band_keys(reg: np.ndarray) -> list[int]:
    from xxhash import xxh3_64_intdigest

    raw = reg.tobytes()
    step = 2 * ROWS
    return [xxh3_64_intdigest(raw[i * step : (i + 1) * step], seed=i) - 2**63 for i in range(BANDS)]


def sketches(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, text_key. n_shingles, set1, set2 (128 bits of the set), registers, bands, small (the set, if it is) of each row."""

    def run(batches):
        from xxhash import xxh3_128_digest

        working("near duplicates")
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                s = shingle_set(text)
                reg = registers(s) if len(s) else None
                d = np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64)
                for c, v in zip(cols, (len(s), int(d[0]), int(d[1]), reg.tobytes() if len(s) else None, band_keys(reg) if len(s) else None, s.tobytes() if 0 < len(s) <= SMALL else None)):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "text_key", "n_shingles", "set1", "set2", "registers", "bands", "small"])

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set1 long, set2 long, registers binary, bands array<long>, small binary")


def block_pairs(members: DataFrame) -> DataFrame:
    """members: key, band, size, rep, component, n_shingles, registers, small. band, and left and right: members of two blocks of a key, or of one twice."""
    blocks = members.withColumn("of", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rep"), "of"))
    blocks = blocks.groupBy("key", "band", "of", "block").agg(F.collect_list(F.struct("rep", "component", "n_shingles", "registers", "small")).alias("left"))
    alone = blocks.where("of = 1").select("band", "left", F.col("left").alias("right"), F.lit(True).alias("same"))
    several = blocks.where("of > 1").select("key", "band", "block", "left")
    paired = several.join(several.select("key", F.col("block").alias("block2"), F.col("left").alias("right")), "key").where("block <= block2")
    return alone.unionByName(paired.select("band", "left", "right", (F.col("block") == F.col("block2")).alias("same")))


def band_marks(reg: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each row of registers."""
    x = reg[:, : BANDS * ROWS].reshape(len(reg), BANDS, ROWS).astype(np.uint64)
    out = np.zeros((len(reg), BANDS), np.uint64)
    for k in range(ROWS):
        out = (out ^ x[:, :, k]) * _WORD_KEYS[k]
        out ^= out >> np.uint64(29)
    return out


class Overlaps:
    """Shingles that a left set shares with some of the right ones, where both come whole."""

    def __init__(self, left: list[bytes | None], right: list[bytes | None]):
        raw = [x or b"" for x in (*left, *right)]
        known, ids = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        self.mark = np.zeros(len(known), bool)
        self.sets = np.split(ids, np.cumsum([len(x) // 8 for x in raw])[:-1])
        self.first = len(left)

    def __call__(self, j: int, to: np.ndarray) -> np.ndarray:
        self.mark[self.sets[j]] = True
        others = [self.sets[self.first + k] for k in to.tolist()]
        ends = np.cumsum([len(x) for x in others])
        found = np.append(0, np.cumsum(self.mark[np.concatenate(others)]))[ends]
        self.mark[self.sets[j]] = False
        return np.diff(found, prepend=0)


def candidate_pairs(pairs: DataFrame, every: bool) -> DataFrame:
    """a, b (a < b): pairs of different components that reach the threshold, or whose estimate is near it or over it where a set does
    not come whole. A forest that joins the components of each pair of blocks; every: a forest of the links that are sure, and all
    of the others. A pair counts in the first band that both share."""
    limit = WHOLE if every else SMALL

    def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
        head: dict[int, int] = {}

        def find(x: int) -> int:
            while head.setdefault(x, x) != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        kept = []
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = find(x), find(y)
            if x != y:
                head[max(x, y)] = min(x, y)
                kept.append(k)
        return kept

    def run(batches):
        working("near duplicates")
        for batch in batches:
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    s = batch.column(c + 1)[k].values
                    sides.append((s.field("rep").to_numpy(), s.field("component").to_numpy(), s.field("n_shingles").to_numpy(), np.frombuffer(b"".join(s.field("registers").to_pylist()), "<u2").reshape(-1, BUCKETS), s.field("small").to_pylist()))
                (ra, ca, na, xa, sa), (rb, cb, nb, xb, sb) = sides
                shared = Overlaps(sa, sb)
                band, same, found = batch.column(0)[k].as_py(), batch.column(3)[k].as_py(), []
                ma, mb = band_marks(xa), band_marks(xb)
                for j in range(len(ra)):
                    new = (cb != ca[j]) & (rb > ra[j] if same else rb != ra[j])
                    if band:
                        new &= ~(mb[:, :band] == ma[j, :band]).any(1)
                    to = np.flatnonzero(new & (100 * np.minimum(nb, na[j]) >= PERCENT * np.maximum(nb, na[j])))
                    e, near = np.zeros(len(to)), np.zeros(len(to), bool)
                    exact = (nb[to] <= limit) & (na[j] <= limit)
                    guess = ~exact | (np.maximum(nb[to], na[j]) > SMALL)
                    if guess.any():
                        e[guess] = estimate((xb[to[guess]] == xa[j]).sum(1))
                        near[guess] = e[guess] >= PERCENT / 100 - MARGIN
                    count = np.flatnonzero(exact & (~guess | (e >= PERCENT / 100 - WIDE)))
                    near[exact] = False
                    if len(count):
                        both = shared(j, to[count])
                        union = na[j] + nb[to[count]] - both
                        e[count], near[count] = both / union, 100 * both >= PERCENT * union
                    to, e, exact = to[near], e[near], exact[near]
                    found.append((np.full(len(to), ra[j]), rb[to], e, np.full(len(to), ca[j]), cb[to], exact))
                a, b, e, c, d, sure = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((b, a, -e))
                if every:
                    order, rest = order[sure[order]], order[~sure[order]]
                    order = np.concatenate([order[forest(c[order], d[order])], rest])
                else:
                    order = order[forest(c[order], d[order])]
                a, b = a[order], b[order]
                out_a.append(np.minimum(a, b))
                out_b.append(np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (out_a, out_b)], names=["a", "b"])

    return pairs.repartition(partitions(pairs.sparkSession)).mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= PERCENT * union, on full sets. texts: rep, text."""

    def run(batches):
        working("near duplicates")
        last, of_last = None, None
        for batch in batches:
            keep = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, tx, ty in zip(a, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x != last:
                    last, of_last = x, shingle_set(tx)
                other = shingle_set(ty)
                both = np.intersect1d(of_last, other, assume_unique=True).size
                keep.append(100 * both >= PERCENT * (len(of_last) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v)[np.array(keep, bool)], pa.int64()) for v in (a, b)], names=["a", "b"])

    got = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    got = got.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return got.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, for each row of docs."""
    configure(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    rows = materialize(sketches(docs).withColumn("node", F.xxhash64("set1", "set2")), "sketches")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    # Registers and bands are the same in all rows of a set: those of the row chosen stand for it.
    row = F.struct("doc_id", "text_key", "n_shingles", "registers", "bands", "small")
    member = known.groupBy(F.col("node").alias("rep")).agg(F.min_by(row, F.struct("doc_id", "text_key")).alias("row"))
    member = materialize(member.select("rep", "row.*"), "sets")
    bands = member.select("rep", F.posexplode("bands").alias("band", "key"))
    groups = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    grouped = materialize(bands.join(groups, "key"), "groups")
    sketch = member.select("rep", "n_shingles", "registers", "small")
    texts = confirmable(docs, member, grouped)

    def labelled(label: DataFrame, whole: bool) -> DataFrame:
        """Members of the keys that several components still share. whole: with all sets of at most WHOLE shingles."""
        m = grouped.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_keys = m.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        m = m.join(open_keys, "key")
        if not whole:
            return m.join(sketch, "rep")
        m = materialize(m, "open")
        sets = whole_sets(texts.join(m.select("rep").distinct(), "rep", "left_semi"))
        return m.join(sketch.drop("small"), "rep").join(sets, "rep", "left")

    alone = docs.sparkSession.createDataFrame([], "node long, component long")
    first = materialize(candidate_pairs(block_pairs(labelled(alone, False)), False), "pairs")
    links = materialize(confirmed(first, texts), "links")
    label = materialize(components(links), "labels")
    rest = candidate_pairs(block_pairs(labelled(label, True)), True)
    more = materialize(confirmed(rest.join(first, ["a", "b"], "left_anti"), texts), "links")

    # A doc_id with several texts joins their sets.
    spread = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    spread = known.join(spread, "doc_id").select("a", F.col("node").alias("b"))
    label = components(links.unionByName(more).unionByName(spread))
    placed = materialize(rows.select("doc_id", "n_shingles", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    heads = placed.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("head"))
    linked = placed.where("n_shingles > 0 and doc_id is not null").join(heads, "component")
    alone = placed.where("not (n_shingles > 0 and doc_id is not null)").withColumn("head", F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", F.col("head").alias("component_id")).unionByName(alone.select("doc_id", "n_shingles", F.col("head").alias("component_id")))


def whole_sets(texts: DataFrame) -> DataFrame:
    """texts: rep, text. rep, small: the sets of at most WHOLE shingles."""

    def run(batches):
        working("near duplicates")
        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() if len(s) <= WHOLE else None for s in sets], pa.binary())], names=["rep", "small"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, small binary")


def confirmable(docs: DataFrame, member: DataFrame, grouped: DataFrame) -> DataFrame:
    """rep, text: one text of each set that shares a key with another."""
    wanted = member.join(grouped.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_key")
    return materialize(docs.join(wanted, ["doc_id", "text_key"]).select("rep", "text"), "texts")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: one for each, and every row without a doc_id. Of several rows
    with one doc_id the one whose text has the smallest hash stays; rows of one text are ordered by the hash of all columns."""
    heads = near_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    first = F.min_by(F.struct(*cols), F.struct(F.xxhash64("text"), F.xxhash64(*hashable)))
    kept = docs.join(heads, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), on sets of words themselves; for tests."""
    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    head = {d: d for d, _ in rows}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    where: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= PERCENT * (len(s) + len(sets[j]) - n):
                a, b = find(rows[i][0]), find(rows[j][0])
                head[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for (d, _), s in zip(rows, sets)}
