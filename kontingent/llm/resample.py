"""Importance resampling towards a target distribution.

Features are all runs of 1 to 3 consecutive words of a text, hashed to buckets.
Two arrays count the buckets of the corpus and of the target; the logarithm of
their smoothed ratio is a bucket's gain; a document's weight is the sum of the
gains of its features, read from the array.  With Gumbel noise from a hash of its
id added, the documents of the greatest scores are a sample without replacement
in which weights are logarithms of importance.

The draw is exact.  Scored documents are written once; a table of at most
``RANGES`` ranges of scores, each with its exact number of eligible rows, tells
which ranges the draw can reach.  Only their rows move: every task sorts what it
has of them into runs, cut into blocks; a range's blocks, ordered by their first
row, are merged by a k-way tournament tree that a block enters when the front
reaches its first row, so a task holds open blocks, not runs.  The merge ranks
rows from the number of rows in the ranges above and stops ranking at the draw
count; what it does not draw keeps a null rank.

Counts and scores are computed with numpy from bytes: the crc of a run of words
follows from the crcs of its words (crc32 is linear), so each word is hashed once.
Texts longer than ``LONG`` bytes are read in pieces that carry the last two words.

Edge cases: a null or empty text has no features and weight 0; a null id is hashed
as the empty string and comes after all others at equal scores; equal ids with equal
texts (repeated rows, ties) have equal scores and are drawn one by one, with ranks of
their own; without a target all weights come from the corpus alone; an empty table
gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, chunks, drop, materialise, slices

#: Buckets of features, words of the longest run, least words of an eligible document.
BUCKETS, RUN, LEAST = 10_000, 3, 20
SEED = 42
#: Ranges of scores at most, rows of a block, rows of a sorted run at most.
RANGES, BLOCK, RUN_ROWS = 1024, 2048, 1 << 18
#: Rows that a range should have at least.
RANGE_ROWS = 1 << 12
#: Bytes of a text, and of all texts together, that are looked at at once.
LONG = 1 << 20
#: Words longer than this are hashed one by one.
BY_STEPS = 48

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


# crc32 by linearity ------------------------------------------------------------------------

def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _byte_table()
_ONES, _SPACE = np.uint32(0xFFFFFFFF), _STEP[32]


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map given by what it makes of each byte (4 x 256), of many registers."""
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


class Shifts:
    """What zero bytes do to a crc register: ``of(n)`` as tables, kept for lengths met before."""

    def __init__(self, most: int = 4096):
        unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        self.powers = [(unit >> np.uint32(8)) ^ _STEP[unit & 255]]
        self.unit, self.most, self.known = unit, most, {}

    def of(self, n: int) -> np.ndarray:
        if n not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            x, k = self.unit, 0
            while n >> k:
                if len(self.powers) <= k:
                    self.powers.append(_through(self.powers[-1], self.powers[-1]))
                if n >> k & 1:
                    x = _through(self.powers[k], x)
                k += 1
            self.known[n] = x
        return self.known[n]

    def table(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables of all distinct lengths, place of each length among them)."""
        some, place = np.unique(lengths, return_inverse=True)
        return np.stack([self.of(int(n)) for n in some]), place


def _word_registers(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each word's register, begun at 0."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    n_long = int(np.searchsorted(-size[order], -BY_STEPS))
    for k in order[:n_long]:
        word = buf[start[k]: start[k] + size[k]].tobytes()
        # begun at 0: what zlib makes of it with an initial value that undoes its own
        out[k] = zlib.crc32(word, 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[n_long:]
    at, left, x = start[order], size[order], np.zeros(len(order), np.uint32)
    n = len(order)
    for j in range(int(left[0]) if n else 0):
        n = int(np.searchsorted(-left[:n], -j))  # words longer than j
        x[:n] = (x[:n] >> np.uint32(8)) ^ _STEP[(x[:n] ^ buf[at[:n] + j]) & np.uint32(255)]
    out[order] = x
    return out


def pieces(text: bytes):
    """(bytes, words carried over) of a text in parts cut between words, each with the last two words before it in front."""
    if len(text) <= LONG:
        yield text, 0
        return
    at, carry = 0, b""
    while at < len(text):
        end = min(len(text), at + LONG)
        while end < len(text) and _IS_WORD[_FOLD[text[end]]]:
            end += 1
        part = carry + b" " + text[at:end]
        yield part, len(_spans(np.frombuffer(carry, np.uint8))[0])
        buf = np.frombuffer(part, np.uint8)
        start, stop = _spans(buf)
        carry = b" ".join(part[u:v] for u, v in zip(start[-(RUN - 1):], stop[-(RUN - 1):]))
        at = end


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    word = _IS_WORD[_FOLD[buf]]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def features(texts: list[bytes], buckets: int = BUCKETS, shifts: Shifts | None = None):
    """For runs of texts: (first text's place, words of each text, place of each feature's text, bucket of each feature).

    A long text comes in several parts, under the same place.
    """
    shifts = shifts or Shifts()
    parts = ((k, p, c) for k, t in enumerate(texts) for p, c in pieces(t))
    some, size = [], 0
    for x in parts:
        if some and size + len(x[1]) > LONG:
            yield _features(some, buckets, shifts)
            some, size = [], 0
        some.append(x)
        size += len(x[1])
    if some:
        yield _features(some, buckets, shifts)


def _features(parts, buckets: int, shifts: Shifts):
    """(places, words, feature places, feature buckets) of parts (place, bytes, words carried over)."""
    places = np.array([p[0] for p in parts])
    buf = _FOLD[np.frombuffer(b" ".join(p[1] for p in parts), np.uint8)]
    start, end = _spans(buf)
    size = end - start
    if not len(size):
        return places, np.zeros(len(places), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum([0] + [len(p[1]) + 1 for p in parts])[:-1]
    # words of each part, and each word's number within its part
    begin = np.searchsorted(start, first)
    n = np.diff(np.append(begin, len(start)))
    part = np.repeat(np.arange(len(parts)), n)
    number = np.arange(len(start)) - np.repeat(begin, n)
    own = number >= np.array([p[2] for p in parts])[part]  # carried words end no feature
    x = _word_registers(buf, start, size)
    tables, place = shifts.table(size)
    at_start, after_space = _through_each(tables, np.full(len(tables), _ONES)), _through_each(tables, np.full(len(tables), _SPACE))
    run = at_start[place] ^ x  # registers of runs that end with each word, longer by a word each round
    follow = after_space[place] ^ x
    further, where = shifts.table(size + 1)
    out, whose = [], []
    for k in range(RUN):
        ends = np.flatnonzero(own & (number >= k))
        out.append((run[ends] ^ _ONES) % np.uint32(buckets))
        whose.append(places[part[ends]])
        if k + 1 < RUN:
            before = np.concatenate(([np.uint32(0)], run[:-1]))
            run = _moved(further, where, before) ^ follow
    words = np.bincount(part[own], minlength=len(parts))
    return places, words, np.concatenate(whose), np.concatenate(out).astype(np.int64)


def _moved(tables: np.ndarray, place: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each register through the map of its own place."""
    return tables[place, 0, x & 255] ^ tables[place, 1, x >> 8 & 255] ^ tables[place, 2, x >> 16 & 255] ^ tables[place, 3, x >> 24]


def _through_each(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _moved(tables, np.arange(len(tables)), x)


# counts, gains, scores ------------------------------------------------------------------------

def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: each task adds up an array, the sums of ``buckets`` numbers come to the driver."""
    import pyarrow as pa

    def run(batches):
        sums, shifts = np.zeros(buckets, np.int64), Shifts()
        for b in slices(batches):
            for some in chunks(arrow_texts(b.column(0)), LONG):
                for *_, found in features(some, buckets, shifts):
                    sums += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """floor(1000 x Gumbel noise) from the first 8 hexadecimal digits of a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), all long, of every document."""
    import pyarrow as pa

    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches):
        shifts = Shifts()
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), arrow_texts(b.column(1))
            words, found, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for places, n, whose, bucket in features(texts, len(gain), shifts):
                np.add.at(words, places, n)
                lo, hi = int(places[0]), int(places[-1]) + 1
                found[lo:hi] += np.bincount(whose - lo, minlength=hi - lo)
                sums = np.zeros(hi - lo, np.int64)
                np.add.at(sums, whose - lo, gain[bucket])
                weight[lo:hi] += sums
            score = weight + np.fromiter((noise(i, seed) for i in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x) for x in (words, found, weight, score))], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


# the draw ------------------------------------------------------------------------------------

class Tournament:
    """Blocks of sorted rows merged by a tree of matches: ``push`` enters a block, ``pop`` takes the least row of all.

    A block is a list of keys and a list of rows.  The tree holds in each node the winner of the match below, so a pop
    replays the matches of one leaf's path; it grows by doubling, and leaves of finished blocks are used again.
    """

    END = (math.inf,)

    def __init__(self):
        self.size, self.free = 1, [0]
        self.tree = [0, 0]
        self.keys, self.at, self.blocks = [self.END], [0], [None]

    def _play(self, leaf: int) -> None:
        node = (leaf + self.size) // 2
        while node:
            a, b = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = a if self.keys[a] <= self.keys[b] else b
            node //= 2

    def _grow(self) -> None:
        self.free += range(self.size, 2 * self.size)
        for x, none in ((self.keys, self.END), (self.at, 0), (self.blocks, None)):
            x += [none] * self.size
        self.size *= 2
        self.tree = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = a if self.keys[a] <= self.keys[b] else b

    def push(self, keys: list[tuple], rows: list) -> None:
        if not keys:
            return
        if not self.free:
            self._grow()
        leaf = self.free.pop()
        self.keys[leaf], self.at[leaf], self.blocks[leaf] = keys[0], 0, (keys, rows)
        self._play(leaf)

    @property
    def least(self) -> tuple:
        """The key of the next row; END without rows."""
        return self.keys[self.tree[1]]

    def pop(self):
        leaf = self.tree[1]
        keys, rows = self.blocks[leaf]
        k = self.at[leaf]
        if k + 1 < len(keys):
            self.at[leaf], self.keys[leaf] = k + 1, keys[k + 1]
        else:
            self.keys[leaf], self.blocks[leaf] = self.END, None
            self.free.append(leaf)
        self._play(leaf)
        return rows[k]


def _key(score: int, doc_id) -> tuple:
    """Order of the draw: greater scores first, then lesser ids, null ids last."""
    return -score, doc_id is None, doc_id or 0


_BLOCK = "range int, head long, tail boolean, id long, ids array<long>, features array<long>, weights array<long>, scores array<long>"


def _runs(rows: DataFrame) -> DataFrame:
    """Blocks (_BLOCK) of the sorted runs that each task makes of its rows (range, doc_id, n_features, weight, score)."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    names = ["range", "head", "tail", "id", "ids", "features", "weights", "scores"]

    def run(batches):
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, RUN_ROWS):
                held.append(b.slice(lo, RUN_ROWS))
                n += held[-1].num_rows
                if n >= RUN_ROWS:
                    yield from blocks(held)
                    held, n = [], 0
        if n:
            yield from blocks(held)

    def blocks(held):
        t = pa.Table.from_batches(held).combine_chunks()
        none = t["doc_id"].is_null().to_numpy(zero_copy_only=False)
        ids, score, part = t["doc_id"].fill_null(0).to_numpy(), t["score"].to_numpy(), t["range"].to_numpy()
        order = np.lexsort((ids, none, -score, part))
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        places = [order[v: min(v + BLOCK, hi)] for u, hi in zip(cuts, np.append(cuts[1:], len(order))) for v in range(u, hi, BLOCK)]
        for at in range(0, len(places), 64):
            some = places[at: at + 64]
            take = lambda c: [t[c].take(pa.array(p)).to_pylist() for p in some]
            cols = [[int(part[p[0]]) for p in some], [-int(score[p[0]]) for p in some], [bool(none[p[0]]) for p in some], [int(ids[p[0]]) for p in some],
                    *map(take, ("doc_id", "n_features", "weight", "score"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return rows.mapInArrow(run, _BLOCK)


def _merged(blocks: DataFrame, above: dict[int, int], count: int) -> DataFrame:
    """Ranked rows of all ranges; ``above``: eligible rows before each range.  Blocks of a range must be together, by first row."""
    import pyarrow as pa

    out = "doc_id long, n_features long, weight long, score long, rank long"
    names = [c.split()[0] for c in out.split(", ")]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def run(batches):
        now, tree, rank, rows = None, Tournament(), 0, []

        def emit(row):
            nonlocal rank
            rank += 1
            rows.append((*row, rank if rank <= count else None))

        for b in slices(batches, 64):
            heads = [c.to_pylist() for c in b.columns]
            for part, head, tail, first, ids, feats, weights, found in zip(*heads):
                if part != now:
                    while tree.least != Tournament.END:
                        emit(tree.pop())
                    now, rank = part, above[part]
                while tree.least < (head, tail, first):
                    emit(tree.pop())
                tree.push([_key(s, i) for s, i in zip(found, ids)], list(zip(ids, feats, weights, found)))
                if len(rows) >= 10_000:
                    yield packed(rows)
                    rows = []
        while tree.least != Tournament.END:
            emit(tree.pop())
            if len(rows) >= 10_000:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)

    return blocks.mapInArrow(run, out)


def draw(scored: DataFrame, percent: int = 5, least: int = LEAST) -> DataFrame:
    """Every row of a stored table of ``scores`` as (doc_id, n_features, weight, score, rank): of the N rows with at least
    ``least`` words the floor(percent N / 100) first are ranked 1, 2, 3...; the rank of all others is null."""
    spark = scored.sparkSession
    columns = ["doc_id", "n_features", "weight", "score"]
    eligible = scored.where(F.col("n_words") >= least)
    total = eligible.count()
    count = percent * total // 100
    unranked = lambda df: df.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not count:
        return unranked(scored)
    n = max(1, min(RANGES, total // RANGE_ROWS))
    marks = [k / n for k in range(1, n)]
    bounds = sorted(set(eligible.approxQuantile("score", marks, 1 / (4 * n)) if marks else []), reverse=True)
    bounds = [int(b) for b in bounds]
    # range k: scores of at least bounds[k] and less than bounds[k - 1]; the last one has no lower bound
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    ranged = eligible.withColumn("range", F.size(F.filter(cuts, lambda b: b > F.col("score"))))
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}  # at most RANGES rows
    above, before = {}, 0
    for k in sorted(sizes):
        if before >= count:
            break
        above[k], before = before, before + sizes[k]
    reached = F.lit(True) if len(above) == len(sizes) else F.col("score") >= bounds[max(above)]
    blocks = _runs(ranged.where(reached).select("range", *columns))
    merged = _merged(blocks.repartition(min(len(above), 4 * spark.sparkContext.defaultParallelism) if len(above) > 1 else 1, "range").sortWithinPartitions("range", "head", "tail", "id"), above, count)
    rest = scored.where(~((F.coalesce(F.col("n_words"), F.lit(0)) >= least) & reached))
    return merged.union(unranked(rest))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Scores and ranks of all documents (doc_id, text), drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    return draw(materialise(scores(docs, gain, seed=seed)), percent, least)
