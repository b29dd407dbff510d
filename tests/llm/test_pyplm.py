"""op6: base figures against brute force; the model is a distribution and beats the base on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kontingent.llm import pyplm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), ""]


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    c = Counter(t for r in rows if not held[r["doc_id"]] for t in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in queries.op6_lm_score(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    gain = size = 0
    for r in rows:
        t, g = tokens(r["text"]), got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[x] > 0 for x in t), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        if g["held_out"]:
            gain += g["score"] - g["base_score"]
            size += g["n_tokens"]
    assert gain / size > 0.02


def test_blocks_do_not_matter_for_counts(spark):
    words = ["aa", "ab", "ba", "bb", "cc"]
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(words, 30))) for k in range(60)]
    # probe texts of one word each, after the start of a text: all words, an unknown one and the end
    probes = {1000 + k: w for k, w in enumerate([*words, "unknown"])}
    probes |= {2000: None, 2001: ""}
    docs = spark.createDataFrame(rows + list(probes.items()), "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    path = pyplm.shared_dir(spark) + "/probes"
    docs.write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    scores = []
    for size in (200, 1 << 20):
        got = {r["doc_id"]: r for r in pyplm.score_documents(docs, F.col("doc_id") < 1000, block_bytes=size, bucket_bytes=size).collect()}
        assert got[2000]["score"] == got[2001]["score"] and got[0]["train_tokens"] == 60 * 31
        assert got[0]["n_tokens"] == 31 and got[1005]["n_known"] == 1
        scores.append(got)
    for column in ("n_tokens", "n_known", "base_score"):
        assert {k: r[column] for k, r in scores[0].items()} == pytest.approx({k: r[column] for k, r in scores[1].items()})
    assert all(abs(scores[0][k]["score"] - scores[1][k]["score"]) < 0.05 * scores[0][k]["n_tokens"] for k in range(60))


def opened(counts, contexts, hot=None):
    """Pairs of a bucket from a matrix of counts (words x contexts)."""
    pairs = pyplm.Pairs.__new__(pyplm.Pairs)
    word, ctx = np.nonzero(counts)
    pairs.word, pairs.ctx, pairs.counts, pairs.n_words, pairs.contexts = word, ctx, counts[word, ctx], len(counts), np.array(contexts)
    pairs.hot = np.full(len(counts), -1) if hot is None else np.array(hot)
    return pairs


def numbers(pairs, state, **more):
    return {"vocabulary": float(pairs.n_words), "tables": float(state.tables.sum()), "seats": float(state.seats.sum()),
            "word": (0.7, 0.5), "root": (0.6, 2.0), "hot_customers": np.zeros(0), "hot_seats": np.zeros(0), **more}


def test_probabilities_of_each_context_sum_to_one():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.8, (40, 12))
    counts[:, 0] = 0  # a context never seen in training
    counts[:, 1:][counts[:, 1:].sum(1) == 0, 0] = 1
    every = counts + (counts == 0)  # pairs that occur in no training text stand in the bucket too, with no customers
    pairs = opened(every, range(12))
    pairs.counts = counts[pairs.word, pairs.ctx]
    state = pyplm.first_state(pairs)
    for k in range(4):
        totals = numbers(pairs, state)
        tables, customers = pairs.of_contexts(state.tables), pairs.of_contexts(pairs.counts)
        p = pyplm.pair_probability(pairs, state, totals, customers, tables)
        unknown = (0.5 + 0.7 * tables) * pyplm.word_probability(0, 0, totals) / (0.5 + customers)
        assert np.bincount(pairs.ctx, p) + unknown == pytest.approx(1)
        assert (p > 0).all()
        state = pyplm.sweep(pairs, state, totals, tables, np.random.default_rng(k))
        assert ((state.tables >= (pairs.counts > 0)) & (state.tables <= pairs.counts)).all()


def test_scores_against_a_brute_force_model():
    """One restaurant by enumeration: the chance of each word under all seatings of a tiny corpus."""
    d, strength, base = 0.5, 1.0, 0.25
    counts = (3, 1)
    rng = np.random.default_rng(4)
    # P(t) of each dish given the other's tables, by enumeration of both
    from itertools import product
    from math import prod

    def stirling(c, t):
        if c == t:
            return 1.0
        return 0.0 if t < 1 or t > c else stirling(c - 1, t - 1) + (c - 1 - t * d) * stirling(c - 1, t)

    joint = {}
    for t in product(*[range(1, c + 1) for c in counts]):
        n = sum(t)
        joint[t] = base**n * prod(strength + d * i for i in range(n)) * prod(stirling(c, k) for c, k in zip(counts, t))
    whole = sum(joint.values())
    expected = sum(v * t[0] for t, v in joint.items()) / whole
    t = [1, 1]
    seen = []
    for _ in range(6000):
        for k in (0, 1):
            t[k] = int(pyplm.seating.draw_tables(np.array([counts[k]]), np.array([base]), np.array([strength + d * t[1 - k]]), d, rng)[0])
        seen.append(t[0])
    assert np.mean(seen) == pytest.approx(expected, rel=0.02)


@pytest.mark.parametrize("d", [0.2, 0.5, 0.8, 0.95])
def test_seating_is_exact(d):
    """Means of drawn tables against the recursion of the Stirling numbers, below and beyond the table."""
    rng = np.random.default_rng(3)
    for c in (2, 9, 64, 65, 400):
        log = np.full(c + 2, -np.inf)
        log[0] = 0.0
        t = np.arange(1, c + 2)
        for k in range(c):
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.concatenate(([-np.inf], np.logaddexp(log[:-1], np.log(np.maximum(k - d * t, 0)) + log[1:])))
        t = np.arange(1, c + 1)
        for weight in (0.05, 1.0, 20.0, 500.0):
            for base in (1e-9, 0.05):  # at 1e-9 the conditional is weight ** t * S_d(c, t)
                room = weight / base
                p = log[1: c + 1] + t * np.log(base) + np.cumsum(np.log(room + d * np.arange(c)))
                p = np.exp(p - p.max())
                p /= p.sum()
                mean, dev = (p * t).sum(), np.sqrt((p * t**2).sum() - (p * t).sum() ** 2)
                got = pyplm.seating.draw_tables(np.full(4000, c), np.full(4000, base), np.full(4000, room), d, rng)
                assert abs(got.mean() - mean) < max(0.005 * mean, 4.5 * dev / 4000**0.5), (c, weight, base)
    none = pyplm.seating.draw_tables(np.array([0, 1, 0]), np.full(3, 0.1), np.full(3, 1.0), d, rng)
    assert none.tolist() == [0, 1, 0]


def test_large_dishes_take_a_window_only():
    got = pyplm.seating.draw_tables(np.array([10**9, 10**7]), np.array([1e-4, 0.05]), np.array([1e6, 1e5]), 0.8, np.random.default_rng(1))
    assert (got > 0).all() and (got <= [10**9, 10**7]).all()


def test_hot_words_are_dealt_over_buckets(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "true", "cast(text as binary)")
    hot = pyplm.hot_words(rows.rdd)
    assert hot[b""] == 0 and 1 < len(hot) <= pyplm.HOT + 1
    tok = pyplm.Tokens([b"a b a c a d", b"a", b""])
    for words in ({b"": 0}, {b"": 0, b"a": 1}):
        seen = np.concatenate([p for _, _, p in pyplm._by_bucket(tok, 7, words)])
        assert sorted(seen.tolist()) == list(range(len(tok.pair_word)))


def test_edges(spark):
    from pyspark.sql import functions as F

    rows = [(None, "a b"), (None, None), (1, "a " * 3000), (1, "a " * 3000), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pyplm.score_documents(docs, F.lit(True)).count() == 5
    assert pyplm.score_documents(docs, F.lit(False)).where("n_known = 0 and abs(score) < 1e-6").count() == 5
    assert pyplm.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_every_word_before_has_its_own_restaurant(spark):
    from pyspark.sql import functions as F

    # two words with different followers
    rows = [(k, "blahen rot " * 20 if k % 2 else "flehen blau " * 20) for k in range(40)] + [(1000, "blahen rot"), (1001, "blahen blau"), (1002, "flehen blau"), (1003, "flehen rot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (200, 1 << 20):
        got = {r["doc_id"]: r["score"] for r in pyplm.score_documents(docs, F.col("doc_id") < 1000, block_bytes=size, bucket_bytes=size).collect()}
        assert got[1000] - got[1001] > 1 and got[1002] - got[1003] > 1


def test_tokens_against_plain_loops():
    texts = [b"", b"A b\tA\x0bc \n", b" \r\n ", b"\xff\xfe b a\x00b", "Ä ä b".encode(), b"x" * 3000, b"a"]
    tok = pyplm.Tokens(texts)
    words, want, pairs = tok.words.to_pylist(), [], []
    for t in texts:
        some = [*t.lower().split(), b""]
        want += some
        pairs += list(zip(some, [b"", *some[:-1]]))
    assert [words[k] for k in tok.ids] == want and words[0] == b"" and len(set(words)) == len(words) == len(set(want))
    assert tok.starts.tolist() == [0, *np.cumsum([len(t.split()) + 1 for t in texts])[:-1].tolist()]
    name = dict(zip(words, (tok.home >> np.uint64(16)).tolist()))
    assert [(words[tok.pair_word[k]], tok.pair_context[k]) for k in tok.pair] == [(w, name[c]) for w, c in pairs]
    assert len(tok.pair_word) == len(set(pairs))
    # words of a bucket in lines, and back
    w = tok.words.take(list(range(len(words))))
    lines = pyplm.lines_of(w, [1, len(words) - 1])
    assert pyplm.array_of_lines(b"\n".join(lines)).to_pylist() == words and lines[0] == b""
    assert pyplm.hot_numbers(tok.words, tok.home, {b"": 0, b"b": 1, b"none": 2}).tolist() == [{b"": 0, b"b": 1}.get(x, -1) for x in words]


def test_distinct_numbers_as_numpy_finds_them():
    rng = np.random.default_rng(5)
    for keys in (rng.integers(0, 50, 400), rng.integers(0, 1 << 62, 400).repeat(2), np.zeros(0, np.int64), np.array([7])):
        values, at = pyplm.distinct(keys)
        assert values.tolist() == sorted(set(keys.tolist())) and values[at].tolist() == keys.tolist()


def test_tokens_take_no_python_step_a_token():
    """Numbering the tokens and pairs of a block costs a few times what splitting it does (8 times with a dictionary)."""
    import time

    rng = np.random.default_rng(6)
    known = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 7)) for _ in range(60_000)]
    texts = [" ".join(known[k] for k in (60_000 * rng.random(300) ** 3).astype(int)).encode() for _ in range(1000)]

    def least(run):
        out = []
        for _ in range(4):
            began = time.process_time()
            run()
            out.append(time.process_time() - began)
        return min(out)

    assert least(lambda: pyplm.Tokens(texts)) < 5 * least(lambda: [t.lower().split() for t in texts])
