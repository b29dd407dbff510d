"""op9 against brute force, with groups that the first check leaves open."""

import random
import re

import numpy as np

from kontingent.llm import setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return sorted(((rows[k][0], len(sets[k]), least.get(top(k))) for k in range(len(rows))), key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(4)
    out = setjoin.join_documents(docs, **how).collect()
    groups = {}
    for r in out:  # every component has one leading (id, text)
        if r["n_shingles"]:
            groups.setdefault(r["component_id"], set()).add((r["doc_id"], r["text_hash"]) if r["leads"] else None)
    ids = [r[0] for r in rows]
    assert len(set(ids)) < len(ids) or all(len(g - {None}) == 1 for g in groups.values())
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def test_near_copies(spark, sf_dir):
    rng = random.Random(5)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    base = [f"w{k}" for k in range(150)]
    rows += [(1000 + k, edited(rng, base, k % 5)) for k in range(90)]
    chain = list(base[:120])
    for k in range(25):  # each close to the one before only
        chain[4 * k] = f"c{k}"
        rows.append((2000 - k, " ".join(chain)))
    for size in (2, 9, 10, 12, 19, 21, 33):
        rows += [(3000 + 10 * size + k, edited(rng, base[:size], min(k, 2) if k % 2 else 0)) for k in range(6)]
    expected = brute(rows)
    assert run(spark, rows, block=16) == expected
    assert run(spark, rows, block=16, few=0) == expected  # all groups in blocks


def test_edges(spark):
    rows = [(None, "a b c d"), (None, None), (3, ""), (4, "  "), (5, "A b"), (6, "a  B"), (7, "a b c d"), (7, "other words stand here"), (8, "other words stand here"), (9, "Ä b"), (10, "ä b"), (11, "x " * 3000), (12, "x x x x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 100, 700, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
            assert setjoin.apart(setjoin.sketch(a), setjoin.sketch(b)) <= len(np.setxor1d(a, b))
    many = np.arange(4000, dtype=np.uint64)  # all in one range: counts stand as 255
    assert setjoin.apart(setjoin.sketch(many), setjoin.sketch(many[:2000])) <= 2000
