"""Best-fit packing by hierarchical residual packing.

Each task tokenises its documents, cuts those longer than a sequence, and packs
what is left best-fit, largest first.  Nearly full bins are final.  Underfull
bins become items themselves: a tree of merge rounds deals them to nodes of a
bounded number of items, each of which packs best-fit again.  Only (bin, size)
rows travel in these rounds, never tokens.

After a best-fit round at most one bin of a node is at most half full, and two
bins over half full never fit together.  That one bin is dissolved into its
items again, so that the next level can fill gaps with each of them.  The rounds
end when one node has seen all items or no two bins went together any more.

Edge cases: a null or empty text is one piece that holds only the end token; a
text longer than a sequence is cut, its first piece taking the rest of the
division; pieces of equal size (ties) are packed in the order of their rows;
repeated rows and null ids are packed like any other; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Items that one merge node packs at most, on average; some 100 bytes each.
NODE_ITEMS = 100_000
#: Word encodings that a Python worker remembers; some 250 bytes each.
CACHE = 300_000
_GAP = re.compile(r" (?=\S)")


class Tokenizer:
    """Byte-level BPE ids as little-endian uint32 bytes.

    A pre-token never reaches over a space that a visible character follows, so
    a text is cut there and frequent words are encoded only once.  Where a text
    holds an added token (text -> id), that is its id, and the parts beside it are
    texts of their own.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def encode(self, text: str) -> bytes:
        if self.marks is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.marks.split(text))

    def _plain(self, text: str) -> bytes:
        known, out = self.known, []
        first, *rest = _GAP.split(text)
        if first:
            out.append(self._fresh(first))
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self._fresh(" " + word)
                if len(word) <= 40:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def _fresh(self, text: str) -> bytes:
        return np.array(self.enc.encode_ordinary(text), "<u4").tobytes()


_TOKENIZERS: dict[tuple, Tokenizer] = {}


def tokenizer(path: str, pattern: str, added: dict[str, int] | None = None) -> Tokenizer:
    key = path, pattern, tuple(sorted((added or {}).items()))
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(path, pattern, added)
    return _TOKENIZERS[key]


def best_fit(sizes, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, largest first: each item's bin and offset, and each bin's fill.

    Open bins are stacked by free space; a bit set of the spaces in use finds
    the tightest fit in constant time.
    """
    sizes = np.asarray(sizes, np.int64)
    bins, offs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    fills: list[int] = []
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = used >> size << size
        if fits:
            space = (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                used ^= 1 << space
        else:
            b, space = len(fills), room
            fills.append(0)
        bins[i], offs[i] = b, fills[b]
        fills[b] += size
        if space > size:
            free[space - size].append(b)
            used |= 1 << (space - size)
    return bins, offs, np.array(fills, np.int64)


def dissolved(sizes, bins, offs, fills, room: int):
    """The same packing, but a bin at most half full is split into one bin per item."""
    small = np.flatnonzero(fills[bins] * 2 <= room) if len(bins) else bins
    bins, offs = bins.copy(), offs.copy()
    bins[small], offs[small] = len(fills) + np.arange(len(small)), 0
    return bins, offs, np.concatenate([fills, np.asarray(sizes, np.int64)[small]])


_PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def local_pieces(docs: DataFrame, path: str, pattern: str, added: dict[str, int] | None = None, room: int = 1024, end_id: int = 2, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Pieces of all documents, packed within each task: bin, offset in it, and the bin's fill."""
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        tok = tokenizer(path, pattern, added)
        base = TaskContext.get().partitionId() << 36
        ids, piece, start, length, crc = [], [], [], [], []
        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                body = memoryview(tok.encode(t or "") + end)
                n = len(body) // 4
                at, k = 0, 0
                while at < n:
                    size = ((n - 1) % room) + 1 if at == 0 else room
                    ids.append(d), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(body[4 * at: 4 * (at + size)]))
                    at, k = at + size, k + 1
        bins, offs, fills = dissolved(length, *best_fit(length, room), room)
        cols = [pa.array(ids, id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(bins + base), pa.array(offs), pa.array(fills[bins] if len(bins) else bins)]
        whole = pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _PIECES.format(kind))


def merge_round(items: DataFrame, nodes: int, room: int, last: bool) -> DataFrame:
    """One level of the tree: (bin, fill, members, offsets), each node's bins packed best-fit.

    Unless it is the last level, a bin at most half full is dissolved.
    """

    def node(t: pa.Table) -> pa.Table:
        sizes = t["fill"].to_numpy()
        bins, offs, fills = best_fit(sizes, room)
        if not last:
            bins, offs, fills = dissolved(sizes, bins, offs, fills, room)
        members, inner, name = t["members"].to_pylist(), t["offsets"].to_pylist(), t["bin"].to_pylist()
        out_m, out_o, out_b = [[] for _ in fills], [[] for _ in fills], [None] * len(fills)
        for i, (b, o) in enumerate(zip(bins.tolist(), offs.tolist())):
            out_m[b] += members[i]
            out_o[b] += [x + o for x in inner[i]]
            out_b[b] = name[i] if out_b[b] is None else min(out_b[b], name[i])
        full = [k for k, m in enumerate(out_m) if m]
        out_m, out_o, out_b, fills = [out_m[k] for k in full], [out_o[k] for k in full], [out_b[k] for k in full], fills[full]
        return pa.table({"bin": pa.array(out_b, pa.int64()), "fill": pa.array(fills), "members": pa.array(out_m, pa.list_(pa.int64())),
                         "offsets": pa.array(out_o, pa.list_(pa.int64()))})

    dealt = items.withColumn("node", F.pmod(F.xxhash64("bin"), F.lit(nodes)))
    return dealt.groupBy("node").applyInArrow(node, "bin long, fill long, members array<long>, offsets array<long>")


def pack(docs: DataFrame, path: str, pattern: str, added: dict[str, int] | None = None, room: int = 1024, end_id: int = 2, near_full: float = 0.99, doc_id: str = "doc_id",
         text: str = "text", node_items: int = NODE_ITEMS) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    path, pattern: rank file and split pattern of the vocabulary; added: its added tokens, text -> id.
    """
    pieces = materialise(local_pieces(docs, path, pattern, added, room, end_id, doc_id, text))
    full = int(room * near_full)
    items = pieces.where((F.col("offset") == 0) & (F.col("fill") < full)).select(
        "bin", "fill", F.array("bin").alias("members"), F.array(F.lit(0).cast("long")).alias("offsets"))
    moved, left, last = None, items.count(), False
    while left > 1:
        nodes = -(-left // node_items)
        last = last or nodes == 1
        packed = materialise(merge_round(items, nodes, room, last))
        done = packed.where((F.col("fill") >= full) & (F.size("members") > 1))
        items = packed.where(F.col("fill") < full)
        now = items.count()
        moved = done if moved is None else moved.union(done)
        if last:
            break
        left, last = now, now == left
    merged = items.where(F.size("members") > 1)
    moved = merged if moved is None else moved.union(merged)
    places = moved.select(F.col("bin").alias("sequence"), F.explode(F.arrays_zip("members", "offsets")).alias("m")).select(
        "sequence", F.col("m.members").alias("bin"), F.col("m.offsets").alias("shift"))
    return pieces.join(places, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))).alias("offset"))
