"""Quality rules whose cutoffs come with a guarantee; DataFrame functions alone.

Rules reject a text whose feature is over a cutoff: share of symbols, of repeated lines, of words in repeated
three-word windows, of capitals and exclamation marks, and letters for a word. Strata are languages. For each
stratum and rule a grid of cutoffs is tested on the labelled good documents that pass the base rules: of n such
documents k would be rejected, and a cutoff is allowed if P(X <= k) <= DELTA / tests for X binomial(n, ALPHA)
- then its true rate of false rejection is under ALPHA, by the exact (Clopper-Pearson) bound, and with the
correction (Bonferroni: all strata, rules and cutoffs tested) all that are allowed are so together, with
confidence 1 - DELTA. The smallest allowed cutoff is used; where none is allowed the rule rejects nothing.

Defined results: a null text has no words and fails the base rules. A null language is a stratum of its own.
Contradictory labels of a doc_id count as bad. Rows are judged one by one: repeated rows and ids do not matter.
An empty table gives no rows. Other columns are kept by `keep_good` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Limit of false rejection for each rule, and of the chance that any allowed cutoff breaks it.
ALPHA, DELTA = 0.01, 0.05
#: Cutoffs tested for each rule.
GRID = {
    "symbols": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3],
    "lines": [0.01, 0.02, 0.05, 0.1, 0.2],
    "repeats": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "capitals": [0.05, 0.1, 0.2, 0.3, 0.5],
    "length": [7.0, 8.0, 10.0, 12.0, 15.0],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with struct __q: COUNTS, n_capitals. One pass: arrays of a text's words, its three-word windows in
    order of their hashes (equal windows are neighbours), and the places of those that have an equal."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__w", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    n = F.size("__w")
    w = F.col("__w")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn("__l", lines)
    d = d.withColumn("__t", F.when(n >= 3, F.zip_with(F.slice(w, 1, n - 2), F.arrays_zip(F.slice(w, 2, n - 2).alias("b"), F.slice(w, 3, n - 2).alias("c")), lambda a, x: F.xxhash64(a, x["b"], x["c"]))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("__s", F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    s = F.col("__s")
    again = F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    d = d.withColumn("__p", F.sort_array(again))
    covered = F.aggregate("__p", F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")), lambda a: a["n"])
    q = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ!", ""))).cast("long").alias("n_capitals"),
    )
    return d.withColumn("__q", q).drop("__w", "__l", "__t", "__s", "__p")


def base_failed(q: str) -> Column:
    return (F.col(f"{q}n_words") < MIN_WORDS) | (100 * F.col(f"{q}n_repeat_words") > MOST_REPEATED * F.col(f"{q}n_words"))


def features(q: str) -> dict[str, Column]:
    """Of texts that pass the base rules, so with words."""
    share = lambda a, b: F.try_divide(F.col(q + a).cast("double"), F.col(q + b).cast("double"))
    return {
        "symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "n_words"), "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"), "length": share("word_chars", "n_words"),
    }


def binomial_at_most(k: Column, n: Column) -> Column:
    """P(X <= k), X binomial(n, ALPHA), for k <= n * ALPHA (else 1: never small). Terms by their logarithms."""
    from math import log

    first = n * F.lit(log(1 - ALPHA))
    step = lambda i: F.log((n - i) / (i + 1)) + F.lit(log(ALPHA / (1 - ALPHA)))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] + step(i)).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k > n * ALPHA, F.lit(1.0)).otherwise(total)


def cutoffs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, and a cutoff (or null) for each rule. rows: doc_id, stratum, COUNTS and n_capitals.

    Good documents are only counted, by stratum; rows of a stratum never meet in one place."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = rows.join(good, "doc_id", "left_semi").where(~base_failed(""))
    over = [F.sum(F.when(f > c, 1).otherwise(0)).alias(f"{rule}_{i}") for rule, f in features("").items() for i, c in enumerate(GRID[rule])]
    seen = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over)
    tests = seen.select(F.explode(F.array(*[
        F.struct("stratum", "n", F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_{i}").alias("k"))
        for rule, grid in GRID.items() for i, c in enumerate(grid)
    ])).alias("t")).select("t.*")
    m = tests.agg(F.count(F.lit(1)).alias("m"))
    allowed = tests.join(F.broadcast(m), F.lit(True)).where(binomial_at_most(F.col("k"), F.col("n")) <= F.lit(DELTA) / F.col("m"))
    return allowed.groupBy("stratum").pivot("rule", list(GRID)).agg(F.min("cutoff"))


def stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def verdict(q: str) -> Column:
    rejects = [F.coalesce(f > F.col(f"__cut.{rule}"), F.lit(False)) for rule, f in features(q).items()]
    any_rule = rejects[0]
    for r in rejects[1:]:
        any_rule = any_rule | r
    return ~base_failed(q) & ~any_rule


def judged(rows: DataFrame, cuts: DataFrame, q: str) -> DataFrame:
    """rows (with stratum) and __kept."""
    c = cuts.select(F.col("stratum").alias("__stratum"), F.struct(*GRID).alias("__cut"))
    return rows.join(c, F.col("stratum") == F.col("__stratum"), "left").withColumn("__kept", verdict(q))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass; docs' columns. Measures are written with their rows, and read for both uses."""
    seen = materialize(measured(docs).withColumn("__stratum_of", stratum()), "measured")
    cuts = materialize(cutoffs(seen.select("doc_id", F.col("__stratum_of").alias("stratum"), "__q.*"), labels), "cutoffs")
    c = cuts.select(F.col("stratum").alias("__stratum"), F.struct(*GRID).alias("__cut"))
    kept = seen.join(c, F.col("__stratum_of") == F.col("__stratum"), "left").where(verdict("__q."))
    return kept.select(*[F.col(f"`{x}`") for x in docs.columns])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = materialize(measured(docs).select("doc_id", stratum().alias("stratum"), "__q.*"), "measures")
    cuts = materialize(cutoffs(rows, table(spark, sf_dir, "labels")), "cutoffs")
    return judged(rows, cuts, "").select("doc_id", *COUNTS, base_failed("").alias("base_failed"), F.col("__kept").alias("kept"))


def _sql() -> str:
    feats = {
        "symbols": "n_symbols::DOUBLE / word_chars", "lines": "n_dup_lines::DOUBLE / n_words", "repeats": "n_repeat_words::DOUBLE / n_words",
        "capitals": "n_capitals::DOUBLE / word_chars", "length": "word_chars::DOUBLE / n_words",
    }
    grid = ", ".join(f"('{r}', {float(c)!r}e0)" for r, g in GRID.items() for c in g)
    value = " ".join(f"WHEN '{r}' THEN {f}" for r, f in feats.items())
    rejects = " OR ".join(f"coalesce({f} > (SELECT min(cutoff) FROM allowed a WHERE a.stratum = f.stratum AND a.rule = '{r}'), false)" for r, f in feats.items())
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
tri AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM again, (SELECT unnest(range(3)) AS j)) GROUP BY doc_id),
f AS (
  SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(regexp_replace(text, '[A-Z!]', '', 'g')))::BIGINT AS n_capitals
  FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, cutoff) AS (VALUES {grid}),
tests AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE CASE rule {value} END > cutoff) AS k
  FROM b JOIN good USING (doc_id), grid WHERE NOT base_failed GROUP BY stratum, rule, cutoff),
allowed AS (
  SELECT stratum, rule, cutoff FROM tests WHERE CASE WHEN k > n * {ALPHA}e0 THEN false ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) + i * ln({ALPHA}e0) + (n - i) * ln(1 - {ALPHA}e0)))) <= {DELTA}e0 / (SELECT count(*) FROM tests) END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejects}) AS kept FROM b f
"""


OP8_SQL = _sql()
