"""op11: features, scores and the draw against plain loops."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from kontingent.llm import queries, resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, buckets=10_000):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i: i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, items, percent=5, least=20, buckets=10_000):
    """{row number: (doc_id, n_features, weight, score, rank)} of rows (doc_id, text)."""
    own = [plain_features(t, buckets) for _, t in docs]
    s, t = sum((f for _, f in own), Counter()), sum((plain_features(x, buckets)[1] for x in items), Counter())
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (_, f) in zip(docs, own):
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in f.items())
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((k for k, (n, _) in enumerate(own) if n >= least), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        rows[k][4] = rank
    return rows


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_features_against_crc32(monkeypatch):
    rng = np.random.default_rng(2)
    bits = ["a", "B", "Z9", "é", "日本", " ", "  ", ".", "\n", "-", "[", "`", "{", "@", "/", ":", "long" * 30, "x" * 70]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(300)] + ["", "one", "one two", "é" * 500 + " y", "w" * 49, "w" * 48, "w" * 47]
    raw = [t.encode() for t in texts]
    for limit in (1 << 20, 50, 7):
        monkeypatch.setattr(rs, "LONG", limit)
        words, found = np.zeros(len(raw), int), [Counter() for _ in raw]
        for places, n, whose, bucket in rs.features(raw):
            np.add.at(words, places, n)
            for k, b in zip(whose.tolist(), bucket.tolist()):
                found[k][b] += 1
        for k, t in enumerate(texts):
            assert (words[k], found[k]) == plain_features(t), (limit, t)


def test_tournament_merges_in_order():
    rng = np.random.default_rng(3)
    for _ in range(50):
        blocks = [sorted(((int(x),) for x in rng.integers(0, 30, rng.integers(0, 9))), reverse=False) for _ in range(rng.integers(0, 20))]
        tree, out = rs.Tournament(), []
        for b in sorted((b for b in blocks if b)):
            while tree.least < b[0]:
                out.append(tree.pop())
            tree.push(b, list(b))
        while tree.least != rs.Tournament.END:
            out.append(tree.pop())
        assert out == sorted(x for b in blocks for x in b)


@pytest.mark.parametrize("rows,block,run", [(1 << 12, 2048, 1 << 18), (20, 3, 16)])
def test_against_plain_loops(spark, monkeypatch, rows, block, run):
    """Ties, repeated rows, null ids and texts, clashing columns; one range, and many ranges of many small runs."""
    monkeypatch.setattr(rs, "RANGE_ROWS", rows)
    monkeypatch.setattr(rs, "BLOCK", block)
    monkeypatch.setattr(rs, "RUN_ROWS", run)
    rng = np.random.default_rng(7)
    text = lambda: " ".join(rng.choice(["alpha", "Beta", "gamma", "Dé", "e1", "zeta", "eta"], rng.integers(0, 60)))
    docs = [(k if rng.random() > 0.02 else None, text() if rng.random() > 0.03 else None) for k in range(600)]
    docs += docs[:40] + [(docs[50][0], docs[51][1])] + [(7, "alpha " * 30)] * 50
    items = [text() for _ in range(15)] + [None, ""]
    d = spark.createDataFrame([(*x, 0, 0.5, "s") for x in docs], "doc_id long, text string, rank int, score double, scores string").repartition(6)
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    for percent in (5, 40, 100):
        assert ordered(rs.resample(d, b, percent).collect()) == ordered(plain(docs, items, percent))


def test_no_rows_and_long_texts(spark):
    d = spark.createDataFrame([(1, "a b " * 400_000), (2, "a " * 19), (3, "q" * 3_000_000 + " r")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b a b")], "item_id long, text string")
    want = plain([tuple(r) for r in d.collect()], ["b a b"], 100)
    assert ordered(rs.resample(d, b, 100).collect()) == ordered(want)
    assert ordered(rs.resample(d, b.limit(0), 100).collect()) == ordered(plain([tuple(r) for r in d.collect()], [], 100))
    assert rs.resample(d.limit(0), b).count() == 0


def test_query(spark, sf_dir):
    got = queries.QUERIES["op11_resample"](spark, sf_dir).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ordered(got) == ordered(plain(docs, items))
