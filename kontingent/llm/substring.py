"""Exact substring deduplication by super-k-mer partitioning.

A window is ``size`` consecutive words of one document.  Its minimiser is its
greatest word key (length first, then hash), so rare long words win and buckets
stay even.  Consecutive windows with the same minimiser form a super-k-mer,
which travels as one packed string to the minimiser's bucket; equal windows have
equal minimisers and therefore meet there.  The bucket sorts the windows of its
strings, compares neighbours word by word, and names the smallest document of
each window.

Documents are dealt into blocks of a bounded size by a hash of their id.  A block sends each distinct
super-k-mer once, with the smallest of its documents that has it, however many
copies it holds, so a passage that a third of all documents share reaches its
bucket once per block.  A bucket answers a block only about super-k-mers with a
window that also starts in a smaller document elsewhere.  The block then judges
its documents: a word goes if it is covered by a window that also starts in a
document with a smaller id.

Hashes are 64 bits of the words' bytes and only order and group; equality of
windows is decided on the words.  Edge cases: a null text has no words; fewer
words than a window lose nothing; documents with a null id sort before all
others, and rows with equal ids are one document to each other, so neither
removes the other's words; a text longer than a block is in a block by itself or
with others, whole; an empty table gives an empty result; columns other than id
and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_texts, blocks_of

#: Bytes of text in a block; a worker needs about 30 times as much.
BLOCK_BYTES = 4 << 20
_NULL_ID = -(1 << 63)
#: Multiplier of the hash over a window's word hashes.
ROLL = np.uint64(0xD1342543DE82EF95)


def sliding(values: np.ndarray, size: int, op) -> np.ndarray:
    """op over each run of ``size`` values, by doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    width, acc = 1, values
    while width * 2 <= size:
        acc = op(acc[:-width], acc[width:])
        width *= 2
    return op(acc[:n], acc[size - width: size - width + n])


class SuperKmers:
    """The super-k-mers of some documents: their word ranges and minimisers.

    first, stop: range of words; doc: index of the document; least: minimiser.
    """

    def __init__(self, words: Words, size: int):
        self.size = size
        length = np.minimum(words.end - words.start, 255).astype(np.uint64)
        key = (length << np.uint64(56)) | (words.hash >> np.uint64(8))
        least = sliding(key, size, np.maximum)
        whole = words.doc[: len(least)] == words.doc[size - 1:] if len(least) else np.zeros(0, bool)
        at = np.flatnonzero(whole)  # windows inside one document
        if not len(at):
            self.first = self.stop = self.doc = np.zeros(0, np.int64)
            self.least = np.zeros(0, np.uint64)
            return
        new = np.concatenate(([True], (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])))
        begin = np.flatnonzero(new)
        self.first = at[begin]
        self.stop = at[np.append(begin[1:], len(at)) - 1] + size
        self.doc = words.doc[self.first]
        self.least = least[self.first]


def _parse(t: pa.Table) -> tuple[np.ndarray, Words]:
    """Document ids (null: smallest) and words of a block, its rows in a fixed order."""
    rows = sorted(zip((_NULL_ID if x is None else x for x in t["id"].to_pylist()), arrow_texts(t["text"].combine_chunks())))
    return np.array([i for i, _ in rows], np.int64), Words([x for _, x in rows])


def _distinct(words: Words, kmers: SuperKmers, ids: np.ndarray, n_buckets: int):
    """Distinct packed strings of a block by bucket: for each occurrence its string's number, and
    bucket -> (numbers, strings); owner: smallest document id of each string."""
    seen: dict[bytes, int] = {}
    raw, start, end = words.raw, words.start, words.end
    number = np.empty(len(kmers.first), np.int64)
    strings: list[bytes] = []
    lo, hi = start[kmers.first].tolist(), (end[kmers.stop - 1] if len(kmers.stop) else kmers.stop).tolist()
    for k, (a, b) in enumerate(zip(lo, hi)):
        s = raw[a:b]
        n = seen.get(s)
        if n is None:
            n = seen[s] = len(strings)
            strings.append(s)
        number[k] = n
    owner = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(owner, number, ids[kmers.doc])
    bucket = np.empty(len(strings), np.int64)
    bucket[number] = (kmers.least % np.uint64(n_buckets)).astype(np.int64)
    return number, strings, owner, bucket


def _send(t: pa.Table, size: int, n_buckets: int) -> pa.Table:
    """A block's distinct super-k-mers, one row per bucket: packed strings and their owners."""
    ids, words = _parse(t)
    kmers = SuperKmers(words, size)
    _, strings, owner, bucket = _distinct(words, kmers, ids, n_buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    press = zstandard.ZstdCompressor(level=1)
    out = {"block": [], "bucket": [], "numbers": [], "owners": [], "packed": []}
    for own in np.split(order, cuts) if len(order) else ():
        out["block"].append(t["block"][0].as_py())
        out["bucket"].append(int(bucket[own[0]]))
        out["numbers"].append(press.compress(np.diff(own, prepend=0).astype(np.int32).tobytes()))
        out["owners"].append(press.compress(owner[own].tobytes()))
        out["packed"].append(press.compress(b"\n".join([b" ".join(strings[k].split()) for k in own.tolist()])))
    return pa.table(out, schema=pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("owners", pa.binary()), ("packed", pa.binary())]))


def _unpress(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def smallest_documents(words: Words, at: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For windows starting at words ``at`` with documents ``owner``: the smallest document of the equal windows.

    Windows are sorted by a hash of their words' hashes; neighbours of one hash
    are compared word by word, and a group that a collision mixes is taken apart.
    """
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = h * ROLL + words.hash[at + j]
    order = np.lexsort((owner, h))
    h, at, own = h[order], at[order], owner[order]
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    lo, hi, raw = words.start[at].tolist(), words.end[at + size - 1].tolist(), words.raw
    clash = np.array([raw[lo[k]: hi[k]] != raw[lo[k - 1]: hi[k - 1]] for k in same.tolist()], bool)
    begin = np.ones(len(at), bool)
    begin[same] = False
    group = np.flatnonzero(begin)
    least = np.repeat(own[group], np.diff(np.append(group, len(at))))  # sorted by owner inside a hash
    for g in np.unique(np.searchsorted(group, same[clash], side="right") - 1).tolist() if clash.any() else ():
        u, v = int(group[g]), int(group[g + 1]) if g + 1 < len(group) else len(at)
        exact: dict[bytes, int] = {}
        texts = [raw[lo[k]: hi[k]] for k in range(u, v)]
        for s, o in zip(texts, own[u:v].tolist()):
            exact[s] = min(exact.get(s, o), o)
        least[u:v] = [exact[s] for s in texts]
    out = np.empty_like(least)
    out[order] = least
    return out


def _answer(t: pa.Table, size: int) -> pa.Table:
    """A bucket's answers: for super-k-mers with a window that starts in a smaller document than the block knows."""
    packed, lens, owners, row = [], [], [], []
    for k, (p, o) in enumerate(zip(t["packed"].to_pylist(), t["owners"].to_pylist())):
        strings = _unpress(p).split(b"\n")
        packed += strings
        owners.append(np.frombuffer(_unpress(o), np.int64))
        row.append(np.full(len(strings), k))
    owner, row = np.concatenate(owners), np.concatenate(row)
    words = Words(packed)
    n_win = words.n_words - size + 1
    which = np.repeat(np.arange(len(packed)), n_win)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    at = words.first_word[which] + place
    least = smallest_documents(words, at, owner[which], size)
    news = np.unique(which[least < owner[which]])
    press = zstandard.ZstdCompressor(level=1)
    out = {"block": [], "numbers": [], "least": []}
    first = np.cumsum(n_win) - n_win
    begin = np.searchsorted(row, np.arange(t.num_rows + 1))
    blocks = t["block"].to_pylist()
    for k, nums in enumerate(t["numbers"].to_pylist()):
        mine = news[np.searchsorted(news, begin[k]): np.searchsorted(news, begin[k + 1])]
        if len(mine):
            number = np.cumsum(np.frombuffer(_unpress(nums), np.int32))
            out["block"].append(blocks[k])
            out["numbers"].append(press.compress(number[mine - begin[k]].astype(np.int32).tobytes()))
            out["least"].append(press.compress(np.concatenate([least[first[m]: first[m] + n_win[m]] for m in mine.tolist()]).tobytes()))
    return pa.table(out, schema=pa.schema([("block", pa.int32()), ("numbers", pa.binary()), ("least", pa.binary())]))


def removed_words(words: Words, kmers: SuperKmers, ids: np.ndarray, number, owner, told: dict[int, np.ndarray]) -> np.ndarray:
    """Mask of words covered by a window that also starts in a smaller document."""
    size = kmers.size
    n_win = kmers.stop - kmers.first - size + 1
    at = np.repeat(kmers.first, n_win) + np.arange(int(n_win.sum())) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    least = np.repeat(owner[number], n_win)
    if told:
        begin = np.cumsum(n_win) - n_win
        for k in np.flatnonzero(np.isin(number, np.fromiter(told, np.int64, len(told)))).tolist():
            least[begin[k]: begin[k] + n_win[k]] = told[int(number[k])]
    # windows of this block that stand in different super-k-mers meet only in the bucket, which answers if one is smaller
    gone = at[least < ids[words.doc[at]]]
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _judge(docs: pa.Table, answers: pa.Table, size: int, n_buckets: int, keep_text: bool) -> pa.Table:
    ids, words = _parse(docs)
    kmers = SuperKmers(words, size)
    number, _, owner, _ = _distinct(words, kmers, ids, n_buckets)
    length = np.zeros(len(owner), np.int64)
    length[number] = kmers.stop - kmers.first - size + 1
    told: dict[int, np.ndarray] = {}
    for nums, least in zip(answers["numbers"].to_pylist(), answers["least"].to_pylist()):
        nums, least = np.frombuffer(_unpress(nums), np.int32), np.frombuffer(_unpress(least), np.int64)
        told |= dict(zip(nums.tolist(), np.split(least, np.cumsum(length[nums])[:-1])))
    gone = removed_words(words, kmers, ids, number, owner, told)
    ends = np.append(words.first_word, len(words.start))
    n_gone = np.diff(np.concatenate(([0], np.cumsum(gone)))[ends])
    digest, texts = [], []
    for d in range(len(ids)):
        lo, hi = int(ends[d]), int(ends[d + 1])
        own = words.raw[words.start[lo]: words.end[hi - 1]].split() if hi > lo else []
        if n_gone[d]:
            own = [w for w, g in zip(own, gone[lo:hi].tolist()) if not g]
        text = b" ".join(own)
        digest.append(hashlib.sha256(text).hexdigest())
        if keep_text:
            texts.append(text)
    out = {"doc_id": pa.array([None if x == _NULL_ID else x for x in ids.tolist()], pa.int64()), "n_words": pa.array(words.n_words.astype(np.int64)), "n_removed": pa.array(n_gone.astype(np.int64)), "kept_sha256": digest}
    if keep_text:
        out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.table(out)


def deduplicate(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and with
    ``keep_text`` also kept_text."""
    n = blocks_of(docs, block_bytes, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(n)).cast("int"))
    sent = rows.groupBy("block").applyInArrow(
        lambda t: _send(t, size, n), "block int, bucket int, numbers binary, owners binary, packed binary")
    answers = sent.groupBy("bucket").applyInArrow(lambda t: _answer(t, size), "block int, numbers binary, least binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda a, b: _judge(a, b, size, n, keep_text), schema)
