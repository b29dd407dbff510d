"""op7 against a brute-force version, over many small blocks."""

import hashlib
import re

import numpy as np

from kontingent.llm import substring
from kontingent.llm.common import Words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    key = [-(1 << 63) if i is None else i for i, _ in rows]
    least = {}
    for k, ws in enumerate(words):
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i: i + size])
            least[w] = min(least.get(w, key[k]), key[k])
    out = []
    for k, ws in enumerate(words):
        gone = set()
        for i in range(len(ws) - size + 1):
            if least[tuple(ws[i: i + size])] < key[k]:
                gone |= set(range(i, i + size))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((rows[k][0], len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, block int").repartition(5)
    return sorted((tuple(r) for r in substring.deduplicate(docs, **how).collect()), key=str)


def test_blocks_agree_with_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, block_bytes=20_000) == brute(rows, 13)


def test_edges(spark):
    rng = np.random.default_rng(3)
    few = [" ".join(rng.choice(["a", "bb", "ccc", "\x00", "é"], 40)) for _ in range(30)]
    rows = [(None, "x y z x y z"), (None, None), (3, ""), (4, "a " * 5000), (2, "a " * 300), (4, "x y z x y z"), (5, "x  y\tz\nx y  z"), (6, " " * 50)]
    rows += [(10 + k, t) for k, t in enumerate(few)]
    for size in (3, 13):
        assert run(spark, rows, size=size, block_bytes=500) == brute(rows, size)
    assert run(spark, [(1, "a")], size=13) == brute([(1, "a")], 13)
    assert run(spark, [], size=13) == []


def test_collision_is_taken_apart(monkeypatch):
    monkeypatch.setattr(substring, "ROLL", np.uint64(0))  # only the last word counts in the hash
    w = Words([b"a b c", b"z y c", b"a b c"])
    got = substring.smallest_documents(w, w.first_word, np.array([9, 3, 7]), 3)
    assert got.tolist() == [7, 3, 7]
