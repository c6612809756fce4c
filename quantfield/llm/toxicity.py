"""Toxicity: character n-gram embeddings, averaged over words and texts, into a linear softmax.

A word's vector is the mean of the embeddings of its n-grams (hashed to a fixed number of buckets), a
text's the mean of its words'; both embeddings and softmax are trained together on the driver, in numpy,
from a bounded sample of labelled rows. Misspelt or inflected words share n-grams with words seen.

Only labels whose doc_id is not held out are learnt from. The sample: each label's ids are dealt by hash
into SAMPLE_ROWS / 2 places, and one id is taken of each place, so it holds at most SAMPLE_ROWS rows.

Defined results: null and empty texts get the score of a text without words (the softmax of its bias, 0.5 or
less). Documents with contradictory labels count as toxic. Without labels of both kinds every score is 0.
Rows are scored one by one: repeated rows and ids do not matter. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, held_out, table

SAMPLE_ROWS = 3000
BUCKETS, WIDTH, SIZES = 1 << 17, 8, (3, 4, 5)
STEPS, RATE, DECAY, GAIN, SURE = 60, 0.02, 1e-4, 100.0, 3.0
THRESHOLD, LONG = 0.7, 64


def grams(word: str) -> Iterator[int]:
    """Buckets of a word's n-grams, one by one: a word can be a whole text."""
    w = f"<{word}>"
    yield zlib.crc32(w.encode()) % BUCKETS
    for n in SIZES:
        for i in range(len(w) - n + 1):
            yield zlib.crc32(w[i : i + n].encode()) % BUCKETS


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, and the share of the text that each has."""
    count: dict[str, int] = {}
    for w in words(text):
        count[w] = count.get(w, 0) + 1
    ids, share, total = [np.zeros(0, np.int64)], [np.zeros(0)], max(1, sum(count.values()))
    for w, n in count.items():
        g = np.fromiter(grams(w), np.int64)
        ids.append(g)
        share.append(np.full(len(g), n / len(g) / total))
    u, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(share), len(u)).astype(np.float32)


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Each bucket's logit (its embedding times the softmax's difference of classes), and the bias.

    Embeddings begin along the softmax's direction, at the log odds ratio of texts with the n-gram, less SURE standard
    errors: so all n-grams of a word that tells share its weight. N-grams that are left with none stay at zero, for most are
    in a few texts by chance (trained freely, or let in by their gradient, they cost accuracy: see README). Embeddings and softmax are then trained together; a bucket whose
    logit passes zero stops there."""
    bags = [bag(t) for t in texts]
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return np.zeros(BUCKETS), -np.inf
    col, val = np.concatenate([b[0] for b in bags]), GAIN * np.concatenate([b[1] for b in bags]).astype(np.float64)
    row = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    with_1, with_0 = (np.bincount(col, x[row], BUCKETS) + 0.5 for x in (y, 1 - y))
    cells = with_1, y.sum() - with_1 + 1, with_0, (1 - y).sum() - with_0 + 1
    odds = np.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    odds = np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * np.sqrt(sum(1 / c for c in cells)))
    held = odds[col] != 0
    used, col = np.unique(col[held], return_inverse=True)
    val, row = val[held], row[held]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    soft, bias = np.random.default_rng(7).normal(0, 1, (WIDTH, 2)), np.array([1.0, -1.0])
    across = soft[:, 1] - soft[:, 0]
    embed = odds[used][:, None] * across / (across @ across)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (embed, soft, bias)]
    for step in range(1, STEPS + 1):
        across = soft[:, 1] - soft[:, 0]
        logit = embed @ across
        z = np.bincount(row, val * logit[col], len(bags)) + bias[1] - bias[0]
        r = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(col, val * r[row], len(used))
        of_mean = embed.T @ g
        g[logit == 0] = 0
        grads = g[:, None] * across + DECAY * embed, np.stack([-of_mean, of_mean], 1) + DECAY * soft, np.array([-r.sum(), r.sum()])
        for x, d, m in zip((embed, soft, bias), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.99 * m[1] + 0.01 * d * d
            x -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        turned = (embed @ (soft[:, 1] - soft[:, 0])) * logit < 0  # past zero: it stops there
        embed[turned] = moments[0][0][turned] = 0
    out = np.zeros(BUCKETS)
    out[used] = GAIN * embed @ (soft[:, 1] - soft[:, 0])
    return out, float(bias[1] - bias[0])


class WordLogits(dict):
    """A word's mean logit, remembered unless the word is over LONG characters."""

    def __init__(self, logits: np.ndarray):
        super().__init__()
        self.logits = logits.tolist()

    def __missing__(self, word: str) -> float:
        n = 1 + sum(max(0, len(word) + 3 - k) for k in SIZES)
        v = sum(map(self.logits.__getitem__, grams(word))) / n
        if len(word) <= LONG:
            self[word] = v
        return v


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most SAMPLE_ROWS labelled texts: of rows with one doc_id the smallest text."""
    y = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ROWS // 2))
    chosen = y.groupBy("toxic", place.alias("place")).agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("doc_id")).where("toxic in (0, 1)")
    # At most SAMPLE_ROWS ids, so a broadcast; documents are not shuffled.
    got = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").where("text is not null")
    one = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(r.text, r.toxic) for r in sorted(one.collect())]


def score(docs: DataFrame, logits: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score."""
    model = docs.sparkSession.sparkContext.broadcast((logits, bias))  # BUCKETS numbers
    configure(docs.sparkSession)

    def run(batches):
        logits, bias = model.value
        known = WordLogits(logits)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                w = words(text)
                z = bias + (sum(map(known.__getitem__, w)) / len(w) if w else min(0.0, -bias))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
                if len(known) > 400_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = training_rows(docs, labels)
    got = score(docs, *train([t for t, _ in rows], [y for _, y in rows]))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
