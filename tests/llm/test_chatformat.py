"""op13: formatted conversations are read back as they were."""

import hashlib
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from kontingent.llm import chatformat as cf
from kontingent.llm import queries

BITS = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|", "|>", "<", "|", "\\", "\\\\", "\\|", "<\\|", "\n", "é", "word", "$1", "\\E", "\\Q", " "]


def conversations(seed, n=40, most=30):
    rng = np.random.default_rng(seed)
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(BITS, rng.integers(0, 7)))
    rows = []
    for c in range(n):
        for _ in range(rng.integers(1, most)):
            turn = None if rng.random() < 0.05 else int(rng.integers(0, most))
            rows.append((None if c == 3 else c, turn, rng.choice(["user", "assistant", "assistant", "system", None, "a\nb<|im_sep|>"]), text()))
        rows.append(rows[-1])  # a repeated row
    return [(a, b, None if r is None else str(r), t) for a, b, r, t in rows]


def ordered(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def written(turns):
    """The template by plain loops."""
    safe = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
    blocks = [(r, [safe(t) for _, t in g]) for r, g in groupby(turns, key=lambda x: x[0])]
    return "".join(f"<|im_start|>{safe(r)}<|im_sep|>" + "<|im_next|>".join(ts) + "<|im_end|>" for r, ts in blocks)


def test_against_plain_loops(spark):
    rows = conversations(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, segments int, blocks string")
    want = ordered(rows)
    for piece in (256, 4, 1):
        out = cf.format_conversations(df, piece=piece).withColumn("formatted", cf.formatted_text())
        got = out.select("conv_id", "formatted", cf.read_turns(F.col("formatted")).alias("turns"), cf.read_loss().alias("loss"), "segments").collect()
        assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
        for r in got:
            turns = want[r["conv_id"]]
            assert r["formatted"] == written(turns)
            assert [tuple(t) for t in r["turns"]] == turns
            assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
            assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
            assert sum(s["loss"] for s in r["segments"]) == sum(role == "assistant" for role, _ in turns)


def test_long_conversation_and_texts_and_none(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"t{k}<|") for k in range(3000)] + [(2, 0, "assistant", "ab<|" * 500_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in cf.format_conversations(df).select("conv_id", cf.read_turns(cf.formatted_text()).alias("t"), F.sha2(cf.read_loss(), 256).alias("h")).collect()}
    assert [tuple(t) for t in out[1]["t"]] == [r[2:] for r in rows[:-1]]
    assert out[2]["h"] == hashlib.sha256(rows[-1][3].encode()).hexdigest()
    assert cf.format_conversations(df.limit(0)).count() == 0
    assert cf.format_conversations(df.where("conv_id = 1").select(F.col("conv_id").alias("k"), F.col("turn").alias("n"), F.col("role").alias("who"), F.col("text").alias("said")), "k", turn="n", role="who", text="said").count() == 1


def test_query_has_the_added_conversation_and_no_python(spark, sf_dir):
    df = queries.QUERIES["op13_chat_format"](spark, sf_dir)
    row = df.where("conv_id = -1").first()
    said = queries.PROBE
    turns = f"user\n{said}\nassistant\n{said}\n"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(said))
    assert row["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert df.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert "Python" not in df._jdf.queryExecution().toString()
