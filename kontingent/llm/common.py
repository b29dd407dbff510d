"""Helpers shared by the operators: shared storage, block sizing, byte-level words."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import drop, materialise, shared_dir

__all__ = ["Words", "arrow_texts", "ascii_lower", "block_rows", "blocks_of", "by_block", "chunks", "drop", "give_back", "materialise", "mix64", "shared_dir", "slices", "text_bytes", "word_hashes"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that separate words, as a Java/RE2 class body.
SPACES = r"\x20\x09-\x0D"


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of all texts: one cheap aggregate that sizes the blocks."""
    return df.agg(F.sum(F.octet_length(col)).alias("b")).first()["b"] or 0


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    return F.translate(c, UPPER, LOWER)


def blocks_of(df: DataFrame, target: int = 4 << 20, col: str = "text") -> int:
    """How many blocks of about ``target`` bytes of text the table makes."""
    return max(1, -(-text_bytes(df, col) // target))


def by_block(rows: DataFrame, n: int) -> DataFrame:
    """(block, docs) of rows (id long, flag boolean, text): dealt to n blocks by a hash of the id.

    A task packs what it has of a block, compressed, so that texts are shuffled small.
    """
    import pyarrow as pa

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            t = pa.Table.from_batches([b])
            block = t["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1)).tolist() if len(order) else [0]
            ids, flags, texts = t["id"].to_pylist(), t["flag"].to_pylist(), arrow_texts(t["text"].combine_chunks())
            order = order.tolist()
            parts = [order[u:v] for u, v in zip(cuts[:-1], cuts[1:])]
            blobs = [press.compress(pickle.dumps([(ids[k], flags[k], texts[k]) for k in part])) for part in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(block[p[0]]) for p in parts], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "docs"])

    dealt = rows.select("id", "flag", "text", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(n)).cast("int").alias("block"))
    return dealt.mapInArrow(pack, "block int, docs binary")


def block_rows(docs: list[bytes]) -> list[tuple]:
    """(id, flag, text) of a block from its packed parts, in a fixed order (null ids first)."""
    rows = [r for x in docs for r in pickle.loads(zstandard.ZstdDecompressor().decompress(x))]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))


_WS = b"\t\n\v\f\r "
_IN_WORD = bytes(k not in _WS for k in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each word's bytes; raw: the bytes of all words, size: of each, none empty."""
    if not len(size):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(size.max()), _BASE))
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    terms = (raw.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix64(np.add.reduceat(terms, at) + size.astype(np.uint64))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts, as offsets into one buffer.

    buf: the texts' bytes, joined by a line feed; start, end: of each word;
    doc: index of each word's text; hash: 64 bits of each word's bytes.
    """

    def __init__(self, texts: list[bytes], hashed: bool = True):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = b"\n".join(texts)
        self.buf = np.frombuffer(self.raw, np.uint8)
        word = np.frombuffer(self.raw.translate(_IN_WORD), bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        first = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(texts)]
        self.first_word = np.searchsorted(self.start, first)
        self.n_words = np.diff(np.append(self.first_word, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.hash = self._hash(word) if hashed else None

    def bytes_of_words(self) -> np.ndarray:
        """The bytes of all words, one after the other."""
        return np.frombuffer(self.raw.translate(None, _WS), np.uint8)

    def _hash(self, word: np.ndarray) -> np.ndarray:
        return word_hashes(self.buf[word], self.end - self.start)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, beside those at work."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """Runs of texts of at most ``limit`` bytes together (a longer text alone): what ``Words`` holds at once."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > limit:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of at most so many rows, so that little of a batch is held as Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def arrow_texts(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes; a null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
