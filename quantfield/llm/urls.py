"""URLs judged by rules and, where no rule fits, by a ratio of character language models.

Two smoothed Markov models of variable order, one of URLs a rule allows and one of those a rule blocks, count
each character with its 0 to ORDER characters before it. A character's probability begins uniform and is blended,
order by order, with what was counted after the longer context, weighted by how often the context was seen
(Witten-Bell); contexts not seen leave it as it is, so the order varies from place to place. Scores are the
difference of both models' log likelihoods per character; URLs at or over a threshold are allowed. Of the URLs
that a rule decides, five of sixteen (by their md5) are held out of the counts, and the threshold is
calibrated on them: of their scores, taken by cells of a fixed width, the one with the least sum of both kinds'
error rates (ties: nearest to 0); 0 where a kind has none of them.

Counts are exact, over all other URLs that a rule decides. A context, or a context and a character, is one whole number,
so nothing shares a count. The table of counts stays in Spark and grows with the corpus: URLs are dealt to blocks of about
BLOCK_CHARS characters, each block asks once for each number that its URLs hold, counts are joined to these
questions, and the block's URLs are scored behind its answers in one stream. A URL is read after its `//`, with its
parameters, A-Z lower-cased in the host; any sign that is not ASCII is read as `?`, the start as a sign of its own.

Defined results: a null URL or one without `://` has empty host and path and no rule, and is scored by what it is (an
empty one scores 0). Where rules decide no URL of a kind, the method allows. Rows are judged one by
one: repeated rows count as often as they are there. An empty table gives no rows. Columns besides page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import configure, materialize, partitions, table

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
ORDER, ALPHABET, CELL = 5, 128, 0.02
#: Characters of the URLs of a block, and characters read together (a longer URL is read in parts).
BLOCK_CHARS, PART_CHARS = 1 << 16, 1 << 17
#: URLs whose md5 begins with a lesser digit, 5 of 16, are held out.
HELD = "5"
START = b"\x01" * ORDER
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, by_rule (allow, block or null)."""
    host, path = parts(F.col("url"))
    d = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = by = F.lit(None).cast("string")
    for r, v in sorted(RULES, key=lambda x: len(x[0])):  # longer rules are asked first
        h, _, p = r.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit("/" + p))
        rule, by = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(by)
    return d.withColumn("rule", rule).withColumn("by_rule", by)


def model_text(url: Column) -> Column:
    """What the models read of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    body = F.when(F.length(rest) > 0, rest).otherwise(url)
    host = F.regexp_extract(body, r"^[^/?#]*", 0)
    text = F.concat(F.translate(host, UPPER, LOWER), F.substring(body, F.length(host) + 1, F.length(body)))
    return F.coalesce(F.regexp_replace(text, r"[^\x00-\x7F]", "?"), F.lit(""))


def parts_of(texts: list[str]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Lists of (text number, the ORDER characters before, characters) of about PART_CHARS characters."""
    part, size = [], 0
    for k, t in enumerate(texts):
        raw = START + t.encode()
        for at in range(ORDER, len(raw), PART_CHARS):
            part.append((k, raw[at - ORDER : at], raw[at : at + PART_CHARS]))
            size += len(part[-1][2])
            if size >= PART_CHARS:
                yield part
                part, size = [], 0
    if part:
        yield part


def numbers(part: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The text number of each character; and of each order (rows 0 to ORDER) its context, then (rows after) context and character,
    as whole numbers: seven bits for a character, the order and what it is below."""
    c = np.frombuffer(b"".join(x for _, before, body in part for x in (before, body)), np.uint8).astype(np.int64)
    sizes = np.array([len(body) for _, _, body in part])
    own = np.repeat(np.arange(len(part)), sizes)
    at = np.arange(len(own)) + ORDER * (own + 1)
    context = [np.zeros(len(own), np.int64)]
    for k in range(1, ORDER + 1):
        context.append(context[-1] | c[at - k] << (7 * k))
    out = np.array([*context, *(x | c[at] for x in context)]) << 4
    out |= np.array([2 * k + what for what in (0, 1) for k in range(ORDER + 1)])[:, None]
    return np.array([k for k, _, _ in part])[own], out


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """block, and its rows in the batch."""
    block = batch.column("block").to_numpy()
    cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    for a, z in zip(cut, cut[1:]):
        if z > a:
            yield int(block[a]), batch.slice(a, z - a)


def questions(urls: DataFrame) -> DataFrame:
    """block, id, block_n, allow_n: each number that a block's URLs hold, and how often those learnt from hold it.
    urls: block, chars, learn (null, 0 block, 1 allow)."""

    def run(batches):
        now, ids, n = None, np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        held: list[tuple[np.ndarray, int | None]] = []
        size = 0

        def merged():
            u, place = np.unique(np.concatenate([ids, *(x for x, _ in held)]), return_inverse=True)
            out = np.zeros((2, len(u)), np.int64)
            for kind in (0, 1):
                out[kind] += np.bincount(place[: len(ids)], n[kind], len(u)).astype(np.int64)
                learnt = [np.full(len(x), k == kind) for x, k in held]
                if learnt:
                    out[kind] += np.bincount(place[len(ids) :][np.concatenate(learnt)], minlength=len(u))
            return u, out

        def rows():
            for i in range(0, len(ids), 50_000):
                j = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[j]), now)), pa.array(ids[j]), pa.array(n[0, j]), pa.array(n[1, j])], names=["block", "id", "block_n", "allow_n"])

        for batch in batches:
            for block, b in runs(batch):
                if block != now:
                    ids, n = merged()
                    yield from rows()
                    now, ids, n, held, size = block, np.zeros(0, np.int64), np.zeros((2, 0), np.int64), [], 0
                kinds, chars = b.column("learn").to_pylist(), b.column("chars").to_pylist()
                for kind in set(kinds):
                    for part in parts_of([t for t, k in zip(chars, kinds) if k == kind]):
                        held.append((numbers(part)[1].ravel(), kind))
                        size += len(held[-1][0])
                        if size > 3 << 20:
                            ids, n = merged()
                            held, size = [], 0
        ids, n = merged()
        yield from rows()

    ordered = urls.repartition(partitions(urls.sparkSession), "block").sortWithinPartitions("block")
    return ordered.select("block", "chars", "learn").mapInArrow(run, "block long, id long, block_n long, allow_n long")


class Answers:
    """Counts of a block's numbers, sorted; scores texts by them."""

    def __init__(self, rows: list[pa.RecordBatch]):
        ids, *n = (np.concatenate([b.column(c).to_numpy() for b in rows]) if rows else np.zeros(0, np.int64) for c in ("id", "block_n", "allow_n"))
        order = np.argsort(ids)
        # One number more than there are: what is not found has its count, 0.
        self.ids = np.append(ids[order], np.iinfo(np.int64).max)
        self.n = [np.append(x[order], 0).astype(np.float64) for x in n]

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts))
        for part in parts_of(texts):
            own, ids = numbers(part)
            at = np.searchsorted(self.ids, ids)
            at[self.ids[at] != ids] = len(self.ids) - 1
            log = []
            for n in self.n:
                p = np.full(len(own), 1 / ALPHABET)
                for k in range(ORDER + 1):
                    seen, here = n[at[k]], n[at[ORDER + 1 + k]]
                    p = np.where(seen > 0, (here + ORDER * p) / (seen + ORDER), p)
                log.append(np.log(p))
            total += np.bincount(own, log[1] - log[0], len(texts))
        return total / np.maximum([len(t) for t in texts], 1)


def scored(urls: DataFrame) -> DataFrame:
    """urls (block, chars, learn and others) and score."""
    spark = urls.sparkSession
    asked = materialize(questions(urls), "url-questions")
    known = asked.groupBy("id").agg(F.sum("block_n").alias("block_n"), F.sum("allow_n").alias("allow_n")).where("block_n + allow_n > 0")
    answers = asked.select("block", "id").join(known, "id")
    none = {f.name: F.lit(None).cast(f.dataType) for f in urls.schema if f.name != "block"}
    stream = answers.select("block", F.lit(0).alias("turn"), "id", "block_n", "allow_n", *[c.alias(k) for k, c in none.items()])
    stream = stream.unionByName(urls.select("*", F.lit(1).alias("turn"), *[F.lit(None).cast("long").alias(k) for k in ("id", "block_n", "allow_n")]))
    names = urls.columns

    def run(batches):
        now, rows, answers = None, [], None
        for batch in batches:
            for block, b in runs(batch):
                if block != now:
                    now, rows, answers = block, [], None
                split = int((b.column("turn").to_numpy() == 0).sum())
                if split:
                    rows.append(b.slice(0, split).select(["id", "block_n", "allow_n"]))
                if split < b.num_rows:
                    answers = answers or Answers(rows)
                    u = b.slice(split)
                    yield pa.RecordBatch.from_arrays([*(u.column(c) for c in names), pa.array(answers.scores(u.column("chars").to_pylist()))], names=[*names, "score"])

    ordered = stream.repartition(partitions(spark), "block").sortWithinPartitions("block", "turn")
    return ordered.mapInArrow(run, StructType([*urls.schema, StructField("score", DoubleType())]))


def threshold(cells: list[tuple[int, int, int]]) -> float:
    """cells: (cell, kind, n). The edge of cells with the least sum of error rates; ties nearest to 0, then below."""
    total = [sum(n for _, k, n in cells if k == kind) for kind in (0, 1)]
    if not all(total):
        return 0.0
    edges = sorted({c for c, _, _ in cells} | {0})
    loss = [sum(n for c, k, n in cells if k == 0 and c >= e) * total[1] + sum(n for c, k, n in cells if k == 1 and c < e) * total[0] for e in edges]
    return min(zip(loss, map(abs, edges), edges))[2] * CELL


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule fits)."""
    spark = pages.sparkSession
    configure(spark)
    d = ruled(pages).withColumn("chars", model_text(F.col("url")))
    held = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1) < HELD
    d = d.withColumn("held", held).withColumn("learn", F.when(~held & F.col("by_rule").isNotNull(), (F.col("by_rule") == "allow").cast("int")))
    d = materialize(d.drop("url"), "ruled")
    found = d.agg(F.sum(F.length("chars").cast("long")).alias("chars"), *[F.count(F.when(F.col("by_rule") == k, 1)).alias(k) for k in ("allow", "block")]).first()
    blocks = max(1, -(-(found.chars or 0) // BLOCK_CHARS))
    done = materialize(scored(d.withColumn("block", F.pmod(F.xxhash64("page_id", "chars"), F.lit(blocks)))), "scored")
    # A row for each cell and kind: scores are logarithms of counts, so there are some thousand at most.
    cells = done.where("held and by_rule is not null").groupBy(F.floor(F.col("score") / CELL).alias("cell"), (F.col("by_rule") == "allow").cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit = threshold([(r["cell"], r["kind"], r["n"]) for r in cells]) if found.allow and found.block else -float("inf")
    by_method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return done.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("score")).alias("score"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    longest = sorted(RULES, key=lambda x: -len(x[0]))
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    pick = lambda at: " ".join(f"WHEN {fits(x[0])} THEN '{x[at]}'" for x in longest)
    orders = ", ".join(f"max(CASE WHEN k = {k} THEN coalesce({t}.{c}, 0) END)::DOUBLE AS {c}_{t}{k}" for k in range(ORDER + 1) for t in "sh" for c in "ab")
    steps = "orders"
    for k in range(ORDER + 1):
        before = (lambda c: f"p_{c}") if k else (lambda c: f"1e0 / {ALPHABET}")
        step = lambda c: f"CASE WHEN {c}_s{k} > 0 THEN ({c}_h{k} + {ORDER} * {before(c)}) / ({c}_s{k} + {ORDER}) ELSE {before(c)} END AS p_{c}"  # noqa: E731, B023
        steps = f"(SELECT * {'EXCLUDE (p_a, p_b)' if k else ''}, {step('a')}, {step('b')} FROM {steps})"
    count = lambda x: f"SELECT k, {x}, count(*) FILTER (WHERE learn = 'allow') AS a, count(*) FILTER (WHERE learn = 'block') AS b FROM g WHERE learn IS NOT NULL GROUP BY ALL"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
v AS (
  SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         CASE WHEN length(rest) > 0 THEN rest ELSE url END AS body, substr(md5(coalesce(url, '')), 1, 1) < '{HELD}' AS held FROM u),
w AS (SELECT *, CASE {pick(0)} END AS rule, CASE {pick(1)} END AS by_rule, regexp_extract(body, '^[^/?#]*') AS head FROM v),
t AS (
  SELECT *, CASE WHEN NOT held THEN by_rule END AS learn,
         coalesce(regexp_replace(translate(head, '{UPPER}', '{LOWER}') || substr(body, length(head) + 1), '[^\x00-\x7F]', '?', 'g'), '') AS chars FROM w),
e AS (SELECT rid, learn, repeat(chr(1), {ORDER}) || chars AS padded, unnest(range(1, length(chars) + 1)) AS i FROM t WHERE chars <> ''),
g AS (SELECT rid, i, k, learn, substr(padded, i + {ORDER} - k, k) AS context, substr(padded, i + {ORDER} - k, k + 1) AS whole FROM e, (SELECT unnest(range({ORDER + 1})) AS k)),
s AS ({count("context")}), h AS ({count("whole")}),
orders AS (SELECT rid, i, {orders} FROM g LEFT JOIN s USING (k, context) LEFT JOIN h USING (k, whole) GROUP BY rid, i),
scores AS (SELECT rid, sum(ln(p_a) - ln(p_b)) / count(*) AS score FROM {steps} GROUP BY rid),
z AS (SELECT t.*, coalesce(score, 0) AS score, floor(coalesce(score, 0) / {CELL}e0) AS cell FROM t LEFT JOIN scores USING (rid)),
n AS (SELECT count(*) FILTER (WHERE held AND by_rule = 'allow') AS na, count(*) FILTER (WHERE held AND by_rule = 'block') AS nb,
             count(*) FILTER (WHERE by_rule = 'allow') > 0 AND count(*) FILTER (WHERE by_rule = 'block') > 0 AS both_kinds FROM z),
edges AS (SELECT DISTINCT cell AS edge FROM z WHERE held AND by_rule IS NOT NULL UNION SELECT 0),
losses AS (SELECT edge, count(*) FILTER (WHERE held AND by_rule = 'block' AND cell >= edge) * max(na) + count(*) FILTER (WHERE held AND by_rule = 'allow' AND cell < edge) * max(nb) AS loss FROM edges, z, n GROUP BY edge),
best AS (SELECT CASE WHEN na > 0 AND nb > 0 THEN (SELECT edge FROM losses ORDER BY loss, abs(edge), edge LIMIT 1) ELSE 0 END * {CELL}e0 AS lowest, both_kinds FROM n)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN NOT both_kinds OR score >= lowest THEN 'allow' ELSE 'block' END) AS verdict FROM z, best
"""


OP10_SQL = _sql()
