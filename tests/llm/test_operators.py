"""The corpus operators against brute force, and on odd rows: nulls, empty and long texts, repeated rows,
empty tables, extra columns with names that the operators use."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfield.llm import language, mixing, near_duplicates, packing, quality, repeats, token_output, top_k, toxicity, urls
from quantfield.llm.components import components
from quantfield.llm.encoders import PieceEncoder
from quantfield.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    r = random.Random(5)
    words = ["ab", "cde", "Fgh", "é", "ijk,", "lm.", "nopq", "日本"]
    long = " ".join(r.choice(words) for _ in range(60_000))
    plain = " ".join(r.choice(words) + str(i) for i in range(80))
    return [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "  \n\t ", "en", "b", 5), (4, "one", "de", "b", 3), (5, plain, "en", "a", 1),
        (6, plain, "en", "a", 1), (6, plain, "en", "a", 1), (7, plain.upper(), "en", None, 1), (8, long, "fr", "a", 1), (None, plain, None, "c", None),
        (9, plain + " tail", "en", "a", 2), (10, "ab " * 300, "en", "d", 900), (11, "x" * 5000, "en", "d", 5000), (12, "<|endoftext|> hi\x1fthere  two\n\n\nlines", "en", "e", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), COLUMNS)
    for c in ("score", "rank", "size", "target", "component_id", "spans", "d1", "n_words", "q", "text_key", "part"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 1), (None, 0, 1), (8, None, None), (8, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = c.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    got = QUERIES[name](spark, SMALL).toPandas()[cols].sort_values(cols).reset_index(drop=True)
    want = want[cols].sort_values(cols).reset_index(drop=True)
    assert len(got) == len(want) and ((got == want) | (got.isna() & want.isna())).all().all()


def test_pieces_as_whole_texts(docs):
    texts = [t or "" for _, t, *_ in odd_rows()] + [r.text for r in docs.limit(60).collect()] + ["a  b", " a \n b", "a\n \nb", "a \n \n b ", "don't  I'LL", "a b", "ﬁ ΑΣ"]
    for path, style in ((token_output.byte_vocabulary(), "spaces"), (packing.word_vocabulary(), "words")):
        e = PieceEncoder(path, style)
        want = [np.array(x.ids, e.dtype).tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
        assert e.ids(texts) == want and e.ids(texts) == want


def test_pieces_learned_in_groups():
    """New words go many at a time through the library, and cut tails leave every id as it is."""
    words = ["w" + "".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(2000)]
    text = " ".join(w + ("", ",", "!!", ".\n", "~")[k % 5] for k, w in enumerate(words)) + " İ. क़, a\nb, É; é̸! Y̱, ~"
    for path, style in ((token_output.byte_vocabulary(), "spaces"), (packing.word_vocabulary(), "words")):
        e, sent = PieceEncoder(path, style), []
        want, raw = e._raw([text])[0].tobytes(), e._raw
        e._raw = lambda texts, raw=raw, sent=sent: sent.extend(texts) or raw(texts)
        assert e.ids([text]) == [want]
        assert len(sent) < 0.3 * len(words)


def test_ranks_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (2 ** r.uniform(0, 32, n)).astype(np.uint32)
        assert np.array_equal(token_output.unpack_ranks(*token_output.pack_ranks(x), n), x)


def test_token_files(spark, odd, tmp_path):
    for df in (odd, odd.limit(0)):
        path = f"file://{tmp_path}/{df.count()}"
        token_output.write_token_files(df, path, token_output.byte_vocabulary())
        got = token_output.read_token_files(spark, path).orderBy("start").collect()
        e = PieceEncoder(token_output.byte_vocabulary(), "spaces").tok
        rows = sorted(df.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0))
        at = 0
        assert len(got) == len(rows)
        for g, x in zip(got, rows):
            ids = e.encode(x.text or "", add_special_tokens=False).ids + [2]
            assert (g.doc_id, g.start, np.frombuffer(g.ids, "<u4").tolist()) == (x.doc_id, at, ids)
            at += len(ids)


def test_packing(spark, odd, docs):
    tok = PieceEncoder(packing.word_vocabulary(), "words").tok
    for df in (odd, docs, odd.limit(0)):
        got = packing.pack_documents(df, packing.word_vocabulary()).collect()
        places = sorted((p.sequence_id, p.offset, p.length) for p in got)
        for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
            assert (o2 == o + n and o2 < 2048) if s2 == s else (s2 == s + 1 and o2 == 0)
        if got:
            assert max(o + n for _, o, n in places) <= 2048
        have = sorted((-1 if p.doc_id is None else p.doc_id, p.start, p.ids) for p in got)
        want = []
        for r in df.collect():
            ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(-1 if r.doc_id is None else r.doc_id, a, ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
        assert [(d, bytes(i)) for d, _, i in have] == [(d, i) for d, _, i in sorted(want)]
    total = sum(p.length for p in packing.pack_documents(docs, packing.word_vocabulary(), carry={}).collect())
    n = 1 + max(p.sequence_id for p in packing.pack_documents(docs, packing.word_vocabulary(), carry={}).collect())
    assert n * 2048 - total < 2 * 2048  # only the last windows have room


def test_closest_fill():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(0, 80)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = packing.closest_fill(counts, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in used.items())


def test_sequences(docs):
    seq = packing.sequences(packing.pack_documents(docs, packing.word_vocabulary())).collect()
    assert all(len(s.ids) == 4 * s.n_tokens and s.padded_length in (2048, s.n_tokens) for s in seq)


def test_mixing(spark, odd, docs):
    for df in (odd, docs):
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns
        size = lambda t: len((t or "").encode().split())
        whole, taken = {}, {}
        for r in df.collect():
            whole[r.source] = whole.get(r.source, 0) + size(r.text)
        for r in mixed.collect():
            taken[r.source] = taken.get(r.source, 0) + size(r.text)
        target = {r.source: r.target for r in mixing.rates(mixing.sizes(df)).collect()}
        assert set(target) == set(whole)
        assert all(t <= 2 * whole[s] + 1e-6 for s, t in target.items()) and sum(target.values()) == pytest.approx(1.5 * sum(whole.values()))
        if df is docs:
            assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.05)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_repeats_as_brute_force(spark, odd, docs):
    rows = [(r.doc_id, r.text) for r in docs.limit(80).collect()] + [(r[0], r[1][:20_000] if r[1] else r[1]) for r in odd_rows()]
    rows += [(1000 + k, "pre%d " % k + "Shared passage of words, é. " * 9 + "post%d" % k * 50) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(repeats.brute_force([t for _, t in rows]))
    got = repeats.remove_repeats(df).collect()
    have = sorted((len((r.text or "").encode()), sum(s["last"] - s["first"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == want
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.count() == odd.count()
    assert repeats.without_repeats(odd.limit(0)).count() == 0


def test_repeats_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 3)
    r = random.Random(2)
    noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(400))
    passage = noise()[:260]
    texts = [noise() + passage + noise() for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((len(x.text), sum(s["last"] - s["first"] for s in x.spans), len(x.spans)) for x in repeats.remove_repeats(df).collect())
    assert got == sorted(b[:3] for b in repeats.brute_force(texts))


@pytest.mark.parametrize("width", [8, 20, 200])
def test_index_family(width):
    r = np.random.default_rng(0)
    pool = [r.integers(0, 3, 400).astype(np.uint8) for _ in range(6)]
    f, every = repeats.IndexFamily(width), []
    for _ in range(40):
        texts = [pool[r.integers(6)][a : a + width + r.integers(0, 60)] for a in r.integers(0, 400 - width, r.integers(0, 6))]
        texts += [r.integers(0, 256, width + 3).astype(np.uint8)]
        texts = [t for t in texts if len(t) >= width]
        raw, at, begin = np.concatenate(texts), [], 0
        for t in texts:
            at += range(begin, begin + len(t) - width + 1)
            begin += len(t)
        every += [raw[i : i + width].tobytes() for i in at]
        f.add(raw, np.array(at))
    n = {x: every.count(x) for x in set(every)}
    assert f.hit.tolist() == [n[x] > 1 for x in every] and len(f.levels) < 12
    for level in f.levels:
        inside = [level.raw[i : i + width].tobytes() for i in level.at]
        assert inside == sorted(set(inside))


def test_near_duplicates_as_brute_force(spark, odd, docs):
    r = random.Random(4)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    base = [f"w{r.randint(0, 500)}" for _ in range(150)]
    for k in range(60):  # a group whose copies differ by one to six words
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(150)] = f"x{r.randint(0, 9999)}"
        rows.append((10_000 + k, " ".join(w)))
    want = near_duplicates.brute_force(rows)
    got = near_duplicates.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "10", "11", "12", "None"])
    assert near_duplicates.near_components(odd.limit(0)).count() == 0


def test_near_duplicates_of_short_texts(spark):
    r, rows = random.Random(12), []
    for k in range(1500):  # one word more at the end: 10 to 25 words, similarities from 6 / 7 to 21 / 22
        w = [f"w{k}_{r.randint(0, 10**6)}" for _ in range(r.randint(10, 24))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, f"x{r.randint(0, 10**6)}"]))]
    want = near_duplicates.brute_force(rows)
    assert all(want[2 * k + 1][1] == 2 * k for k in range(1500))
    got = near_duplicates.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_small_sets_in_groups():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 30))).astype(np.uint64) for _ in range(20)]
    raw = [None if k % 5 == 2 else s.tobytes() for k, s in enumerate(sets)]
    shared, every = near_duplicates.Overlaps(raw[:8], raw[8:]), np.arange(12)
    for j in range(8):
        want = [0 if raw[j] is None or raw[8 + k] is None else len(np.intersect1d(sets[j], sets[8 + k])) for k in range(12)]
        assert shared(j, every).tolist() == want


def test_components(spark):
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100 + r.randint(0, 30), 100 + r.randint(0, 30)) for _ in range(25)] + [(7, 7)]
    head = {x: x for e in edges for x in e}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_quality(spark, odd, labels):
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert 10 not in {r.doc_id for r in kept.collect()} and {5, 6, 7, 9} <= {r.doc_id for r in kept.collect()}
    assert quality.keep_good(odd.limit(0), labels.limit(0)).count() == 0
    p = spark.createDataFrame([(0, 500), (3, 900), (9, 900), (20, 900)], "k long, n long").select("k", "n", quality.binomial_at_most(F.col("k"), F.col("n")).alias("p")).collect()
    from math import comb

    for r in p:
        exact = sum(comb(r.n, i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact if r.k <= r.n * quality.ALPHA else 1.0, rel=1e-9)


def test_toxicity(spark, odd, labels):
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.classify(odd.limit(0), labels.limit(0)).count() == 0
    p = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{p}/labels.parquet").collect()}
    held = [r for r in toxicity.op1_toxicity(spark, p).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_toxicity_of_long_words():
    fill = "abcdefghij" * 10
    texts = [f"{fill}{'vile' if k % 2 else 'kind'}{k}" for k in range(200)]  # one word each, alike in its first 100 characters
    known = toxicity.WordLogits(toxicity.train(texts, [k % 2 for k in range(200)])[0])
    assert known[fill + "vile7"] > known[fill + "kind7"] and not known.keys()
    assert np.isclose(known["vile"], np.mean([known.logits[g] for g in toxicity.grams("vile")]))
    assert np.isclose(toxicity.bag(f"{fill}x {fill}y")[1].sum(), 1)


def test_toxicity_trains_jointly():
    r = random.Random(9)
    filler = ["".join(r.choice("aeioutnrs") for _ in range(r.randint(2, 8))) for _ in range(800)]
    vile = ["wretchling", "grobnard", "skulmurk", "vexhound"]
    rows = []
    for k in range(600):
        w = [r.choice(filler) for _ in range(60)]
        if k % 2:
            w[r.randrange(60)] = vile[k // 2 % 4]
        rows.append((" ".join(w), k % 2))
    logits, bias = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    known = toxicity.WordLogits(logits)
    score = lambda t: bias + sum(known[w] for w in toxicity.words(t)) / len(toxicity.words(t))
    plain = [" ".join(r.choice(filler) for _ in range(60)) for _ in range(200)]
    assert sum(score(t) > 0 for t in plain) < 10
    for w in ("wretchlingz", "gr0bnard", "skulmurkk", "vexxhound"):  # never seen: they share n-grams with words seen
        assert sum(score(f"{t} {w}") > 0 for t in plain) > 150
    texts = [t for t, _ in rows[:5]] + [plain[0]]
    whole = []  # the mean over words of the mean over n-grams, written out
    for t in texts:
        per_word = []
        for w in t.lower().split():
            x = f"<{w}>"
            g = [x] + [x[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1)]
            per_word.append(np.mean([logits[zlib.crc32(p.encode()) % toxicity.BUCKETS] for p in g]))
        whole.append(bias + np.mean(per_word))
    assert np.allclose([score(t) for t in texts], whole)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a a"), (1, "a a"), (3, "x" * 200_000), (4, None)], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, y)
    assert len(rows) == len({t for t, _ in rows}) and ("a b", 1) not in rows


def test_language(spark, odd):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[3].score == 0
    assert language.identify(odd.limit(0)).count() == 0
    p = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{p}/documents.parquet").collect()}
    held = [r for r in language.op5_language(spark, p).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_language_of_large_alphabets():
    r = random.Random(2)
    scripts = {"ko": range(0xAC00, 0xAC00 + 900), "zh": range(0x4E00, 0x4E00 + 900)}
    words = {k: ["".join(chr(r.choice(c)) for _ in range(2)) for _ in range(900)] for k, c in scripts.items()}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    model = language.Model({k: [text(k, 2000), text(k, 50)] for k in words})
    letters = language.letter_table()
    for k in words:
        n = language.phrases(model, [language.as_symbols(text(k, 40), letters) for _ in range(20)])
        own = model.langs.index(k)
        assert (2 * n[:, own] < n[:, 1 - own]).all()
    a = [language.as_symbols(x, letters).tolist() for x in ("Ab, \u4e00\U0001f600\ud800z", "ab \u4e01 z")]
    assert [len(x) for x in a] == [8, 8] and a[0] != a[1] and a[0][:3] == a[1][:3]


def test_language_takes_equal_shares():
    long, short = "abc " * 20_000, "xyz " * 50
    model = language.Model({"a": [long, short]})
    assert language.phrases(model, [language.as_symbols("xyz xyz xyz", language.letter_table())])[0, 0] == 1
    assert language.equal_share([5, 1, 9, 9], 20) == 7 and language.equal_share([2, 3], 20) == 20


def test_cutting_as_longest_match():
    sample, text = [1, 2, 3, 1, 2, 4, 2, 2], [1, 2, 4, 4, 2, 3, 1, 5, 5, 2, 2]
    table = language.cutting_table(language.automaton(sample, 6))
    state = ended = 0
    for c in text:
        v = int(table[state + c])
        ended, state = ended + (v & 3), v >> 2
    n, i, parts = len(text), 0, 0
    inside = {tuple(sample[a:b]) for a in range(len(sample)) for b in range(a + 1, len(sample) + 1)}
    while i < n:
        k = 1
        while i + k < n and tuple(text[i : i + k + 1]) in inside:
            k += 1
        parts, i = parts + 1, i + k
    assert ended + (state > 0) == parts


def test_top_k_odd_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(k, [float(x) for x in r.normal(size=4) * 10 ** r.uniform(-2, 3)]) for k in range(300)]
    rows += [(400, None), (420, []), (440, [1.0, None, 2.0, 3.0]), (460, [1.0, float("nan"), 0.0, 0.0]), (480, [float("inf"), 0.0, 0.0, 0.0]), (500, [1.0, 2.0]), (None, [1.0] * 4), (7, rows[7][1]), (520, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    v = {k: np.floor(64 * np.array(x)) for k, x in rows if k is not None and x and all(y is not None and np.isfinite(y) for y in x)}
    want = []
    for q in (k for k in v if k % 20 == 0):
        s = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:20]
        want += [(q, i + 1, c, -x) for i, (x, c) in enumerate(s)]
    assert sorted(map(tuple, top_k.top_k(df).collect())) == sorted(want)
    assert top_k.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_top_k_steep_queries(monkeypatch, dim):
    r, k, met = np.random.default_rng(11), 5, []
    at, sign = r.integers(0, dim, 400), r.choice([-1, 1], 400)
    c = r.normal(size=(400, dim)) * 4
    c[np.arange(400), at] = sign * r.uniform(95, 110, 400)  # one large coordinate of either sign
    c, ids = np.floor(c), np.arange(400)
    q = np.concatenate([c[:40], 64 * np.eye(dim), -64 * np.eye(dim)])
    q_ids, norms = np.append(np.arange(40), 1000 + np.arange(2 * dim)), lambda x: np.sqrt((x * x).sum(1))
    scores = (q @ c.T).astype(np.int64)
    want = [sorted((-s, i) for s, i in zip(row.tolist(), ids.tolist()) if i != q_id)[:k] for row, q_id in zip(scores, q_ids)]
    limit = np.array([-x[-1][0] for x in want], np.float64)
    real = top_k.exact_products
    monkeypatch.setattr(top_k, "exact_products", lambda a, b: met.append((len(a), len(b))) or real(a, b))
    got = set(zip(*(x.tolist() for x in top_k.search_block(q_ids, q, norms(q), limit, ids, c, norms(c), k))))
    assert got == {(int(q_id), i, -s) for q_id, x in zip(q_ids, want) for s, i in x}
    assert len(met) == len(q) and all(a == 1 and b < 400 for a, b in met)  # every query was steep


def test_search_in_blocks_of_many_lengths():
    r, k = np.random.default_rng(5), 3
    for trial in range(1000):
        dim, n = int(r.integers(1, 9)), int(r.integers(1, 60))
        c = np.floor(r.normal(size=(n, dim)) * 10 ** r.uniform(0, 2.5, (n, 1)))
        if trial % 3 == 0:
            c[np.arange(n), r.integers(0, dim, n)] = r.choice([-1, 1], n) * r.integers(200, 400, n)
        q, norms = np.concatenate([c[:5], np.zeros((1, dim))]), lambda x: np.sqrt((x * x).sum(1))
        q_ids, ids = np.append(np.arange(len(q) - 1), 1000), np.arange(n)
        scores = (q @ c.T).astype(np.int64)
        want = [sorted((-s, i) for s, i in zip(row.tolist(), ids.tolist()) if i != q_id)[:k] for row, q_id in zip(scores, q_ids)]
        limit = np.array([-x[-1][0] if len(x) == k else -np.inf for x in want], np.float64)
        got = sorted(zip(*(x.tolist() for x in top_k.search_block(q_ids, q, norms(q), limit, ids, c, norms(c), k))))
        assert got == sorted((int(q_id), i, -s) for q_id, x in zip(q_ids, want) for s, i in x)


def test_large_products():
    a, b = np.full((1, 64), 3.2e8), np.array([[3.2e8, -3.2e8] * 32, [3.2e8] * 64])
    assert top_k.exact_products(a, b).tolist() == [[0, 64 * 320_000_000**2]]
    with pytest.raises(OverflowError):
        top_k.exact_products(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))


def test_urls(spark):
    rows = [(1, "https://EXAMPLE.com/en/7x?q"), (2, "http://a.example.com/en/1"), (3, "x://notcom/en/"), (4, None), (5, "no scheme"), (6, "http://b.example.net/de/8#x"), (7, "http://b.net/de/1"), (8, "http://h?x=/p"), (9, "http://h/p\n/q#f"), (9, "http://h/p")]
    got = {(r.page_id, r.path): r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert (got[1, "/en/7x"].host, got[1, "/en/7x"].rule, got[1, "/en/7x"].verdict) == ("example.com", "example.com/en/7", "allow")
    assert (got[2, "/en/1"].rule, got[2, "/en/1"].verdict) == ("com/en/", "block")
    assert got[3, "/en/"].rule is None and got[4, ""].host == "" and got[5, ""].path == ""
    assert got[6, "/de/8"].verdict == "block" and got[7, "/de/1"].verdict == "allow"
    assert got[8, ""].host == "h" and (9, "/p\n/q") in got
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_larger_sets_are_counted_in_the_second_round(spark):
    """A star and a chain of variants of one text, of 300 shingles and of more than WHOLE: both rounds against brute force."""
    r = random.Random(12)
    rows = []
    for n in (300, near_duplicates.WHOLE + 200):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(1, n // 40)):
                w[r.randrange(n)] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = near_duplicates.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == near_duplicates.brute_force(rows)


def test_keep_one_of_rows_with_one_id(spark):
    rows = [(1, "b " * 30, 2), (1, "c " * 30, 1), (1, "b " * 30, 1), (2, None, None), (None, "b", 5), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head int")
    runs = {tuple(sorted(map(str, near_duplicates.keep_one(docs.repartition(n)).collect()))) for n in (1, 5)}
    assert len(runs) == 1 and len(runs.pop()) == 4


def test_workers_forget_other_work():
    from quantfield.llm import encoders, near_duplicates
    from quantfield.llm.common import working
    from quantfield.llm.packing import word_vocabulary

    one = encoders.encoder(word_vocabulary(), "words")
    assert encoders.encoder(word_vocabulary(), "words") is one
    working("near duplicates")
    near_duplicates.shingle_set("six words make two whole shingles")
    assert near_duplicates._words and encoders._encoder.cache_info().currsize == 0
    again = encoders.encoder(word_vocabulary(), "words")
    assert again is not one and not near_duplicates._words
    assert again.ids(["a b", None]) == one.ids(["a b", None])


def test_scratch_tables_keep_no_shuffle_files(spark):
    import time

    from quantfield.llm import common

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before = files()
    was = spark.conf.get(common.CLEANUP, None)
    got = common.materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert got.count() == 7 and spark.conf.get(common.CLEANUP, None) == was
