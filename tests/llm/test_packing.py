"""op2: round trip against the tokenizers library, and the packing itself."""

import struct
import zlib

import numpy as np
import pytest

from kontingent.llm import packing, queries


def reference_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, texts, room=1024):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); texts: doc_id -> text, ids distinct."""
    ids = dict(zip(texts, reference_ids([t or "" for t in texts.values()])))
    pieces, bins = {}, {}
    for doc, piece, start, length, crc, seq, off in rows:
        own = ids[doc][start: start + length]
        assert len(own) == length and zlib.crc32(struct.pack(f"<{length}I", *own)) == crc
        pieces.setdefault(doc, []).append((piece, start, length))
        bins.setdefault(seq, []).append((off, length))
    assert set(pieces) == set(texts)
    for doc, got in pieces.items():
        got.sort()
        assert [p for p, _, _ in got] == list(range(len(got)))
        at = 0
        for k, (_, start, length) in enumerate(got):
            assert start == at and (length == room or k == 0) and length <= room
            at += length
        assert at == len(ids[doc]) and len(got) == -(-at // room)
    for got in bins.values():
        at = 0
        for off, length in sorted(got):
            assert off == at
            at += length
        assert at <= room
    return len(bins), sum(map(len, ids.values()))


def test_query_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    bins, tokens = check([tuple(r) for r in queries.op2_pack(spark, sf_dir).collect()], texts)
    assert bins <= 1.01 * -(-tokens // 1024) + 1


def test_edges(spark):
    texts = {1: None, 2: "", 3: "a  b \n c\n\n d", 4: " x" * 3000, 5: "same", 6: "same", 7: "z" * 5000, 8: "<|endoftext|> it's fine  　 ok "}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, bin int").repartition(3)
    check([tuple(r) for r in packing.pack(docs, *queries.tokenizer_files()).collect()], texts)
    assert packing.pack(docs.limit(0), *queries.tokenizer_files()).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c")], "doc_id long, text string")
    assert packing.pack(docs, *queries.tokenizer_files()).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_best_fit(seed):
    sizes = np.random.default_rng(seed).integers(1, 1025, 500)
    bins, offs, fills = packing.best_fit(sizes, 1024)
    assert fills.max() <= 1024 and fills.sum() == sizes.sum() and (fills <= 512).sum() <= 1
    assert len(set(zip(bins.tolist(), offs.tolist()))) == len(sizes)


def test_merge_rounds_join_small_bins(spark):
    docs = spark.createDataFrame([(k, "word " * 40) for k in range(400)], "doc_id long, text string").repartition(40)
    rows = [tuple(r) for r in packing.pack(docs, *queries.tokenizer_files()).collect()]
    assert check(rows, {k: "word " * 40 for k in range(400)})[0] <= 18
    rows = [tuple(r) for r in packing.pack(docs, *queries.tokenizer_files(), node_items=30).collect()]
    assert check(rows, {k: "word " * 40 for k in range(400)})[0] <= 26


def test_tree_of_many_nodes_is_nearly_as_full_as_one(spark):
    sizes = np.random.default_rng(8).integers(3, 900, 1500)
    docs = spark.createDataFrame([(k, "word " * int(n)) for k, n in enumerate(sizes)], "doc_id long, text string").repartition(12)
    used = []
    for nodes in (100_000, 150):
        got = packing.pack(docs, *queries.tokenizer_files(), node_items=nodes)
        used.append(got.select("sequence_id").distinct().count())
        least = -(-got.groupBy().sum("length").first()[0] // 1024)
    assert used[0] <= 1.03 * least and used[1] <= 1.01 * used[0], (used, least)


def test_added_token_anywhere(spark):
    """The vocabulary's added token at the start, the middle, the end, repeated, beside spaces, and cut short."""
    mark = "<|endoftext|>"
    texts = [mark, mark * 3, f"{mark} hi", f"hi{mark}", f"hi {mark}", f"a {mark} b", f"a{mark}\n b", f"  {mark}  ", "<|endoftext|", "<|endoftext |>", f"<{mark}>", f"x {mark}{mark} y" * 300, f"<|endof{mark}text|>", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check([tuple(r) for r in packing.pack(docs, *queries.tokenizer_files()).collect()], dict(enumerate(texts)))
    assert packing.tokenizer(*queries.tokenizer_files()).encode(f"{mark} hi") == np.array([50256, 23105], "<u4").tobytes()
