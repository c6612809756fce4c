"""Language by cross-parsing: each language's labelled text becomes a suffix automaton, a text is cut into
the longest phrases that occur in it, and the language that needs the fewest, normalised, wins.

An automaton walks on while the phrase goes on; where it cannot, the phrase ends and the next begins with
the symbol at hand. With that step built into its table, cutting is one lookup for each symbol, done for
all languages and many stretches of text at a time. Symbols are the UTF-8 bytes of lower-case letters, so letters
of any script stay apart; any run of others is one blank. Texts are walked in stretches of STRETCH symbols, and phrases end with the stretch.

Sample, for each language: documents that are not held out, dealt by the hash of their text into PLACES
places, one of each, SAMPLE_SYMBOLS symbols of them together: the same share of each text, where short ones leave
theirs to the others. Normalised: phrases * log2(size of the
sample) / symbols, bits for each symbol. The score is 1 less the ratio of the best to the next
best, halved from 1 where there is no other language.

Defined results: `und`, score 0, for null texts and those without a letter; also where nothing could be
learnt. Ties go to the language first in code-point order. Repeated rows and ids do not matter. Columns
besides doc_id, text and (for learning) lang are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, held_out, table

PLACES, SAMPLE_SYMBOLS, STRETCH = 48, 24_000, 1024
#: Blank, the lower-case ASCII letters, the bytes of other letters from 0x80 to 0xF4.
SYMBOLS = 1 + 26 + 117


def letter_table() -> np.ndarray:
    """Code point -> whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def byte_table() -> np.ndarray:
    """Byte of a letter -> symbol."""
    out = np.zeros(256, np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[0x80:0xF5] = np.arange(27, SYMBOLS)
    return out


def as_symbols(text: str, letters: np.ndarray) -> np.ndarray:
    """letters: letter_table()."""
    low = text.lower()
    c = code_points(low)
    width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    s = np.where(np.repeat(letters[c], width), byte_table()[np.frombuffer(low.encode("utf-8", "replace"), np.uint8)], 0).astype(np.uint8)
    keep = np.append(True, (s[1:] != 0) | (s[:-1] != 0)) if len(s) else np.zeros(0, bool)
    return s[keep]


def equal_share(sizes: list[int], total: int) -> int:
    """The most that can be taken of each, or all of it where it has less, without passing the total."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= n
    return total


def automaton(s: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of s: states x symbols, 0 where there is none (the start is 0)."""
    link, length, steps, last = [-1], [0], [{}], 0
    for c in s:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        steps.append({})
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = cur
            p = link[p]
        if p != -1:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                steps.append(dict(steps[q]))
                while p != -1 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    out = np.zeros((len(steps), size), np.int64)
    for k, d in enumerate(steps):
        for c, to in d.items():
            out[k, c] = to
    return out


def cutting_table(steps: np.ndarray) -> np.ndarray:
    """(next state * size) * 4 + phrases that end before or with the symbol, for each state and symbol."""
    size = steps.shape[1]
    start = steps[0]
    fresh = np.where(start > 0, start * size * 4, 1)  # a symbol the sample lacks is a phrase of its own
    ended = np.where(start > 0, fresh + 1, 2)
    out = np.where(steps > 0, steps * size * 4, ended[None])
    out[0] = fresh
    return out.reshape(-1)


class Model:
    """langs, and the cutting tables of all languages in one array."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(k for k, v in samples.items() if v)
        table, parts, self.base, self.cost, at = letter_table(), [], [], [], 0
        for lang in self.langs:
            texts = [np.append(as_symbols(t, table), 0) for t in samples[lang]]
            share = equal_share([len(t) for t in texts], SAMPLE_SYMBOLS)
            for t in texts:
                t[min(share, len(t)) - 1] = 0  # a text that is cut ends with a blank too
            s = np.concatenate([t[:share] for t in texts]).tolist()
            part = cutting_table(automaton(s, SYMBOLS))
            parts.append(part)
            self.base.append(at)
            self.cost.append(float(np.log2(max(2, len(s)))))
            at += len(part)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.flat = flat.astype(np.int32) if flat.max(initial=0) < 2**31 else flat


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    own, begin, size = [], [], []
    at = 0
    for k, t in enumerate(texts):
        for i in range(0, len(t), STRETCH):
            own.append(k)
            begin.append(at + i)
            size.append(min(STRETCH, len(t) - i))
        at += len(t)
    if not own:
        return out
    own, begin, size = np.array(own), np.array(begin), np.array(size)
    order = np.argsort(-size, kind="stable")
    own, begin, size = own[order], begin[order], size[order]
    everything = np.concatenate(texts).astype(np.int32)
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # stretches longer than each step
    for k, base in enumerate(model.base):
        table = model.flat[base : base + (model.base[k + 1] if k + 1 < len(model.base) else len(model.flat)) - base]
        state, ended = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
        for step, m in enumerate(active.tolist()):
            v = table[state[:m] + everything[begin[:m] + step]]
            ended[:m] += v & 3
            state[:m] = v >> 2
        ended += state > 0
        out[:, k] = np.bincount(own, ended, len(texts))
    return out


def samples(docs: DataFrame) -> dict[str, list[str]]:
    """At most PLACES texts for each language."""
    known = docs.where("text is not null and lang is not null").where(~held_out())
    one = known.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(PLACES)).alias("place"), F.xxhash64("text", F.lit(1)).alias("turn"))
    got = one.groupBy("lang", "place").agg(F.min_by("text", "turn").alias("text")).orderBy("lang", "place").collect()
    out: dict[str, list[str]] = {}
    for r in got:
        out.setdefault(r.lang, []).append(r.text)
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded table for each language
    configure(docs.sparkSession)

    def run(batches):
        model = shared.value
        table = letter_table()
        for b in batches:
            syms = [as_symbols(t or "", table) for t in b.column(1).to_pylist()]
            n = phrases(model, syms)
            bits = n * np.array(model.cost)[None] / np.maximum([[len(s)] for s in syms], 1)
            lang, score = [], []
            for s, h in zip(syms, bits):
                if not len(h) or not s.any():
                    lang.append("und")
                    score.append(0.0)
                    continue
                best = int(h.argmin())
                rest = np.delete(h, best)
                lang.append(model.langs[best])
                score.append(float(1 - h[best] / rest.min()) if len(rest) else 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    got = predict(docs, Model(samples(docs)))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
