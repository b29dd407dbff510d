"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word is a context with a restaurant of its own (and so is the start of a
text); all of them share one parent, the restaurant of words without context,
whose base is uniform over the vocabulary and one unknown word.  Customers of a
context's restaurant are the training tokens after it, its dishes the words;
each table sends one customer to the parent.  A Gibbs sweep draws the tables of
every dish from their exact conditional given the tables of all other dishes
before the sweep and the parent's predictive probabilities (``seating``), then
those of the parent.  After each sweep the discount and the strength of either
level are drawn on a grid around their last values, in proportion to the
likelihood of all seatings.  After ``BURN_IN`` sweeps the predictive
probabilities of ``SAMPLES`` sweeps are averaged.

Data flow: a partition of the table is read in blocks of a bounded size.  A
block's distinct (word, context) pairs with their training counts go to the
words' buckets, so a frequent word reaches its bucket once per block; a task
sends all its blocks' pairs for a bucket in one piece.  A bucket holds the
counts and tables of its words' pairs and stays where it is; per sweep only sums
travel.  The sums of a context's restaurant are spread over the buckets: a
bucket posts its part for each of its contexts to the context's shard, and the
shard posts the sum back to the buckets that have the context.  A bucket then
answers each block with one log-probability per pair the block has, and the
task that reads the block's partition again adds them up.  No text is shuffled.
All documents are counted; restaurants grow with the vocabulary, and what is
gathered with the corpus.

Hot words: the pairs of words that have over 1 / ``HOT`` of the tokens in the
first ``PROBED`` bytes of a partition, and of the end token, are dealt over all
buckets by their context; the parent's numbers for these (at most ``HOT`` per
partition probed, and in all at most ``HOT``) pass through the driver with the
other totals.  Which words are hot decides only where their pairs lie.

A context is named by 48 bits of its word's hash: two words share a restaurant
with a chance of 2 ** -48.  Log-probabilities of pairs are sent as 32-bit floats.

The table must give its rows in the same order when a partition is read again,
as stored tables do; a block whose texts differ on second reading is an error.

Edge cases: a null or empty text is the end token alone; unknown words share the
unknown word's probability; without training documents every token is the
unknown word, of probability one; an empty table gives an empty result; a text
longer than a block is a block of its own; rows are scored one by one, so
repeated rows and null ids need no care (a null id counts as the empty text for
the split); other columns of the table are not looked at.
"""

from __future__ import annotations

import gc
import pickle
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ComputationError
from . import seating
from .common import Words, give_back, mix64, shared_dir, text_bytes, word_hashes

BURN_IN, SAMPLES = 2, 2
#: Bytes of text in a block, and behind a bucket's pairs.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
#: Buckets in a task, which opens one at a time.
TOGETHER = 4
#: Bytes of pairs that a task holds before it sends them.
HELD = 8 << 20
HOT, PROBED = 500, 1 << 20
END = b""  # no word is empty
#: Steps around the last discount, and factors of the last strength, among which new ones are drawn.
D_STEPS = np.array([-0.12, -0.05, -0.02, 0.0, 0.02, 0.05, 0.12])
S_STEPS = np.array([0.5, 0.75, 1.0, 1.33, 2.0])
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _press(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpress(x: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def _planes(x: np.ndarray) -> bytes:
    """The lower 48 bits of each number, byte by byte."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    planes = np.frombuffer(x, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<i8").ravel()


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them."""
    kind = next(k for k in ("u1", "<u2", "<u4", "<i8") if not len(x) or x.max() <= np.iinfo(k).max)
    return kind[-2:].encode() + x.astype(kind).tobytes()


def _from_ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x[2:], x[:2].decode()).astype(np.int64)


def _press_ints(x: np.ndarray) -> bytes:
    return _press(_ints(x))


def _unpress_ints(x: bytes) -> np.ndarray:
    return _from_ints(_unpress(x))


def array_of(raw: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """An Arrow array of words of these sizes; raw: their bytes, one after the other."""
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])


def array_of_lines(x: bytes) -> pa.LargeBinaryArray:
    """The same of words with a line feed between them."""
    buf = np.frombuffer(x, np.uint8)
    cuts = np.flatnonzero(np.concatenate(([10], buf, [10])) == 10)
    return array_of(buf[buf != 10], np.diff(cuts) - 1)


def _buffers(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, where each begins, and the end)."""
    cuts = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[: cuts[-1]], cuts


def lines_of(words: pa.LargeBinaryArray, sizes: list[int]) -> list[bytes]:
    """Runs of so many words, with a line feed between the words of a run."""
    raw, cuts = _buffers(words)
    every = np.insert(raw, cuts[1:], 10).tobytes()
    first = (cuts + np.arange(len(cuts)))[np.cumsum([0, *sizes])].tolist()
    return [every[a: b - 1] for a, b in zip(first, first[1:])]


def homes_of(words: pa.LargeBinaryArray) -> np.ndarray:
    """64 bits of each word, 0 of the end token and of no other."""
    raw, cuts = _buffers(words)
    size = np.diff(cuts)
    out = np.zeros(len(words), np.uint64)
    out[size > 0] = np.maximum(word_hashes(raw, size[size > 0]), np.uint64(1 << 16))
    return out


def numbered(words: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """(number of each word, the distinct words, their 64 bits): in order of these bits, and of the bytes where they are equal,
    so that the order is the same in blocks and buckets."""
    pool = pa.system_memory_pool()  # whose freed memory can be given back
    coded = pc.dictionary_encode(words, memory_pool=pool)
    homes = homes_of(coded.dictionary)
    order = np.argsort(homes)
    if (np.diff(homes[order]) == 0).any():
        some = coded.dictionary.to_pylist()
        order = np.array(sorted(range(len(some)), key=lambda k: (int(homes[k]), some[k])), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], pc.take(coded.dictionary, pa.array(order), memory_pool=pool), homes[order]


def hot_numbers(words: pa.LargeBinaryArray, homes: np.ndarray, hot: dict[bytes, int]) -> np.ndarray:
    """The number of each word that is hot, else -1; words in order, with their 64 bits."""
    out = np.full(len(words), -1)
    bits = homes_of(pa.array(list(hot), pa.large_binary()))
    for (w, k), a, b in zip(hot.items(), np.searchsorted(homes, bits).tolist(), np.searchsorted(homes, bits, "right").tolist()):
        for at in range(a, b):
            if words[at].as_py() == w:
                out[at] = k
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct non-negative numbers in order, and the place of each among them; numbers are sorted together with their
    places where both fit one number, which takes no indirect sort."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - bits):
        values, at = np.unique(keys, return_inverse=True)
        return values, at.ravel()
    both = np.sort(keys << bits | np.arange(len(keys)))
    values = both >> bits
    new = _changes(values)
    at = np.empty(len(keys), np.int64)
    at[both & (1 << bits) - 1] = np.cumsum(new) - 1
    return values[new], at


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class Tokens:
    """Tokens of some texts: words lower-cased in A-Z, then an end token.

    words: distinct words (an Arrow array), in order; home: 64 bits of each; ids: of each token; pair_word, pair_context: distinct pairs of a
    word and the context before it, in order; pair: index of each token's pair; starts: first token of each text.
    """

    def __init__(self, texts: list[bytes]):
        w = Words([t.lower() for t in texts], hashed=False)
        size = np.insert(w.end - w.start, np.cumsum(w.n_words), 0)  # after the words of each text the end token, which is first in order
        ids, words, self.home = numbered(array_of(w.bytes_of_words(), size))
        self.words, self.ids = words, ids
        self.starts = np.cumsum(w.n_words + 1) - w.n_words - 1
        before = np.empty(len(ids), np.int64)
        before[1:] = self.ids[:-1]
        before[self.starts] = 0  # the start of a text; the end token itself is no context
        pairs, self.pair = distinct(self.ids * len(words) + before)
        name = (self.home >> np.uint64(16)).astype(np.int64)  # in the order of the words, too
        self.pair_word, self.pair_context = pairs // len(words), name[pairs % len(words)]
        if ((np.diff(self.pair_context) == 0) & (np.diff(self.pair_word) == 0)).any():  # two words of one name are one context
            pairs, at = np.unique(np.stack([self.pair_word, self.pair_context], 1), axis=0, return_inverse=True)
            self.pair_word, self.pair_context, self.pair = pairs[:, 0], pairs[:, 1], at.ravel()[self.pair]

    def mark(self) -> int:
        """32 bits of the pairs, to tell whether a block is read again as it was."""
        return zlib.crc32(self.pair_context.tobytes(), zlib.crc32(self.home[self.pair_word].tobytes()))


def _by_bucket(tok: Tokens, n: int, hot: dict[bytes, int]):
    """(bucket, indexes of the block's words there, indexes of their pairs), all in order."""
    spread = (hot_numbers(tok.words, tok.home, hot) >= 0)[tok.pair_word]
    place = mix64(tok.home + _SALT[0])[tok.pair_word] + np.where(spread, mix64(tok.pair_context.astype(np.uint64) + _SALT[1]), np.uint64(0))
    bucket = (place % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        p = order[lo:hi]
        word = tok.pair_word[p]
        yield int(bucket[p[0]]), word[_changes(word)], p


def blocks_of_partition(rows, block_bytes: int):
    """Blocks of rows (id, flag, text), a longer text alone, in the order of the partition."""
    some, size = [], 0
    for i, flag, text in rows:
        text = bytes(text or b"")
        if some and size + len(text) > block_bytes:
            yield some
            some, size = [], 0
        some.append((i, flag, text))
        size += len(text)
    if some:
        yield some


def hot_words(table: RDD) -> dict[bytes, int]:
    """The end token and words with a large share of the tokens at the beginning of some partition, numbered."""

    def often(rows):
        seen: dict[bytes, int] = {}
        size = 0
        for _, _, text in rows:
            for w in bytes(text or b"").lower().split():
                seen[w] = seen.get(w, 0) + 1
            size += len(text or b"")
            if size >= PROBED:
                break
        least = sum(seen.values()) / HOT
        return [(w, k) for w, k in seen.items() if k >= least]

    best = table.mapPartitions(often).reduceByKey(lambda a, b: a + b).takeOrdered(HOT, key=lambda x: (-x[1], x[0]))
    return {w: k for k, w in enumerate([END, *[w for w, _ in best]])}


def _send(part: int, blocks, n: int, hot: dict[bytes, int]):
    """(bucket, pressed pieces) of the pairs of a partition's blocks."""
    held: dict[int, list] = {}
    size = 0
    for number, rows in enumerate(blocks):
        tok = Tokens([x for _, _, x in rows])
        train = np.repeat(np.array([r[1] for r in rows], bool), np.diff(np.append(tok.starts, len(tok.ids))))
        seen = np.bincount(tok.pair[train], minlength=len(tok.pair_word))
        block = number << 32 | tok.mark()
        dealt = list(_by_bucket(tok, n, hot))
        lines = lines_of(pc.take(tok.words, pa.array(np.concatenate([w for _, w, _ in dealt])), memory_pool=pa.system_memory_pool()), [len(w) for _, w, _ in dealt])
        for (bucket, _, p), said in zip(dealt, lines):
            sizes = np.diff(np.flatnonzero(_changes(tok.pair_word[p])), append=len(p))
            piece = (block, said, _ints(sizes), _planes(tok.pair_context[p]), _ints(seen[p]))
            held.setdefault(bucket, []).append(piece)
            size += sum(map(len, piece[1:]))
        if size >= HELD:
            yield from ((b, (part, _press(pickle.dumps(x)))) for b, x in held.items())
            held, size = {}, 0
    yield from ((b, (part, _press(pickle.dumps(x)))) for b, x in held.items())
    tok = train = seen = dealt = lines = held = None
    give_back()


def _gather(rows, hot: dict[bytes, int]) -> list[tuple[int, dict]]:
    """(bucket, its pairs and where each block's pairs are among them) of a partition's (bucket, pieces)."""
    parts: dict[int, list] = {}
    for bucket, (part, x) in rows:
        parts.setdefault(bucket, []).extend(((part, p[0]), *p[1:]) for p in pickle.loads(_unpress(x)))
    out = []
    for bucket, some in parts.items():
        some.sort(key=lambda x: x[0])
        number, words, homes = numbered(array_of_lines(b"\n".join([x[1] for x in some])))
        word = np.repeat(number, np.concatenate([_from_ints(x[2]) for x in some]))
        contexts, ctx = distinct(np.concatenate([_from_planes(x[3]) for x in some]))
        pairs, at = distinct(word * len(contexts) + ctx)
        total = np.bincount(at, np.concatenate([_from_ints(x[4]) for x in some]), len(pairs)).astype(np.int64)
        where = np.split(at, np.cumsum([int(_from_ints(x[2]).sum()) for x in some])[:-1])  # increasing in each block, as both are sorted
        out.append((bucket, {
            "blocks": [x[0] for x in some], "where": [_press_ints(np.diff(x, prepend=0)) for x in where],
            "sizes": _press_ints(np.bincount(pairs // len(contexts), minlength=len(words))), "ctx": _press_ints(pairs % len(contexts)),
            "counts": _press_ints(total), "contexts": _press(_planes(contexts)), "hot": _press_ints(hot_numbers(words, homes, hot) + 1)}))
    return out


class Pairs:
    """A bucket's pairs, opened: word, ctx: of each pair, as numbers in the bucket; contexts: the names of the contexts,
    sorted; hot: number of each hot word, else -1."""

    def __init__(self, row: dict):
        sizes = _unpress_ints(row["sizes"])
        self.n_words = len(sizes)
        self.word, self.ctx, self.counts = np.repeat(np.arange(len(sizes)), sizes), _unpress_ints(row["ctx"]), _unpress_ints(row["counts"])
        self.contexts = _from_planes(_unpress(row["contexts"]))
        self.hot = _unpress_ints(row["hot"]) - 1

    def of_words(self, x: np.ndarray) -> np.ndarray:
        """Sums over each word's pairs."""
        return np.bincount(self.word, x, self.n_words).astype(np.int64)

    def of_contexts(self, x: np.ndarray) -> np.ndarray:
        """Sums over each context's pairs."""
        return np.bincount(self.ctx, x, len(self.contexts)).astype(np.int64)


class State:
    """Tables of a bucket's pairs, and of its words in the parent (of hot words zero: the driver has them)."""

    def __init__(self, tables: np.ndarray, seats: np.ndarray):
        self.tables, self.seats = tables, seats

    def pressed(self) -> tuple:
        return _press_ints(self.tables), _press_ints(self.seats)

    @classmethod
    def opened(cls, x: tuple) -> "State":
        return cls(*map(_unpress_ints, x))


def parent_probability(pairs: Pairs, state: State, totals: dict) -> np.ndarray:
    """The parent's predictive probability of each word of a bucket."""
    customers, seats = pairs.of_words(state.tables), state.seats.astype(np.float64)
    some = pairs.hot >= 0
    customers[some], seats[some] = totals["hot_customers"][pairs.hot[some]], totals["hot_seats"][pairs.hot[some]]
    return word_probability(customers, seats, totals)


def word_probability(customers, seats, totals: dict):
    """The parent's predictive probability of words with these customers and tables; zeros: an unknown word."""
    d, strength = totals["root"]
    base = 1.0 / (totals["vocabulary"] + 1)
    return (customers - d * seats + (strength + d * totals["seats"]) * base) / (strength + totals["tables"])


def pair_probability(pairs: Pairs, state: State, totals: dict, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Predictive probability of each pair; customers, tables: sums of the restaurant of each context."""
    d, strength = totals["word"]
    parent = parent_probability(pairs, state, totals)[pairs.word]
    return (pairs.counts - d * state.tables + (strength + d * tables[pairs.ctx]) * parent) / (strength + customers[pairs.ctx])


def first_state(pairs: Pairs) -> State:
    """Every dish has one table in every restaurant that serves it."""
    tables = np.minimum(pairs.counts, 1)
    return State(tables, np.where(pairs.hot < 0, np.minimum(pairs.of_words(tables), 1), 0))


def sweep(pairs: Pairs, state: State, totals: dict, tables: np.ndarray, rng) -> State:
    """The state after drawing all tables anew; tables: sums of the restaurant of each context before."""
    d, strength = totals["word"]
    room = strength + d * np.maximum(tables[pairs.ctx] - state.tables, 0)
    new = seating.draw_tables(pairs.counts, parent_probability(pairs, state, totals)[pairs.word], room, d, rng)
    d, strength = totals["root"]
    customers = np.where(pairs.hot < 0, pairs.of_words(new), 0)
    room = strength + d * np.maximum(totals["seats"] - state.seats, 0)
    return State(new, seating.draw_tables(customers, np.full(pairs.n_words, 1 / (totals["vocabulary"] + 1)), room, d, rng))


def _whole(rdd: RDD) -> RDD:
    """Each partition as one list, in batches of one: such can be zipped without another Python process."""

    def run(rows):
        yield list(rows)
        give_back()

    return rdd.mapPartitions(run)._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _beside(first: RDD, *others: RDD) -> RDD:
    """Whole partitions of equally dealt (key, value) side by side, a tuple of lists per partition; nothing is shuffled."""
    out, n = first, len(others)
    for other in others:
        out = out.zip(other)

    def flat(x):
        for _ in range(n):
            x, last = x
            yield last
        yield x

    return out.map(lambda x: tuple(flat(x))[::-1])


def _keep(rdd: RDD) -> RDD:
    return _whole(rdd).persist(StorageLevel.DISK_ONLY)


def _cuts(contexts: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's contexts begin among sorted contexts; shards are ranges of names."""
    return np.searchsorted((contexts >> 16) * shards >> 32, np.arange(shards + 1))


def _post(bucket: int, contexts: np.ndarray, values: np.ndarray, shards: int, pack):
    cuts = _cuts(contexts, shards)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, (bucket, _press(pack(values[cuts[k]: cuts[k + 1]])))


def _shard(rows) -> list[tuple[int, dict]]:
    """(shard, for each bucket where its contexts are among the shard's) of a partition's posted names."""
    parts: dict[int, list] = {}
    for shard, part in rows:
        parts.setdefault(shard, []).append(part)
    out = []
    for shard, some in parts.items():
        names = [_from_planes(_unpress(x)) for _, x in some]
        every, at = distinct(np.concatenate(names))
        cuts = np.cumsum([len(x) for x in names])[:-1]
        out.append((shard, {"size": len(every), "at": {b: _press_ints(np.diff(x, prepend=0)) for (b, _), x in zip(some, np.split(at, cuts))}}))
    return out


def _added(homes: list, posted: list) -> list[tuple[int, dict, np.ndarray]]:
    """(shard, home, sums of its contexts) of a partition of shards and what was posted to them."""
    sums = {k: np.zeros(row["size"], np.int64) for k, row in homes}
    at = {k: row["at"] for k, row in homes}
    for shard, (bucket, x) in posted:
        sums[shard][np.cumsum(_unpress_ints(at[shard][bucket]))] += _unpress_ints(x)
    return [(k, row, sums[k]) for k, row in homes]


def _replies(both) -> list[tuple]:
    """(bucket, (shard, sums of its contexts)) of a partition of shards and what was posted to them."""
    return [(b, (k, _press_ints(x[np.cumsum(_unpress_ints(at))]))) for k, row, x in _added(*both) for b, at in row["at"].items()]


def _sums_of(posted) -> dict[int, np.ndarray]:
    """The sums of each bucket's contexts, in the order of the contexts."""
    parts: dict[int, list] = {}
    for bucket, part in posted:
        parts.setdefault(bucket, []).append(part)
    return {b: np.concatenate([_unpress_ints(x) for _, x in sorted(some)]) for b, some in parts.items()}


def log_rooms(tables, customers, discounts, strengths) -> np.ndarray:
    """For each discount and strength the sum over restaurants of log [strength (strength + d) ...] / [strength (strength + 1) ...],
    a factor per table and per customer."""
    t, n_t = np.unique(np.asarray(tables), return_counts=True)
    c, n_c = np.unique(np.asarray(customers), return_counts=True)
    g = lambda x: seating.lgamma(np.asarray(x, np.float64))
    down = [(n_c * (g(s + c) - g(s))).sum() for s in strengths]
    return np.array([[(n_t * (t * np.log(d) + g(s / d + t) - g(s / d))).sum() - x for s, x in zip(strengths, down)] for d in discounts])


def _discounts(d: float) -> np.ndarray:
    return np.unique(np.round(np.clip(d + D_STEPS, 0.02, 0.95), 4))


def _likelihood_of_tables(counts: np.ndarray, tables: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """Sum over dishes of log S_d(customers, tables) for each discount."""
    some = counts > 1
    key, n = np.unique(counts[some] << 31 | tables[some], return_counts=True)
    return np.array([(n * seating.log_stirling(key >> 31, key & (1 << 31) - 1, float(d))).sum() for d in discounts])


def _pick(likelihood: np.ndarray, rng) -> tuple:
    p = np.exp(likelihood - likelihood.max())
    return np.unravel_index(rng.choice(p.size, p=(p / p.sum()).ravel()), p.shape)


def totals_of(buckets: RDD, state: RDD, last: dict | None, n_hot: int, rng) -> dict:
    """Totals over all buckets: a few scalars and the numbers of hot words; seats of hot words and the parent's discount and
    strength are drawn anew."""
    grids = [] if last is None else [_discounts(last["word"][0]), _discounts(last["root"][0])]

    def run(both):
        out, states = [np.zeros(9), np.zeros(n_hot), np.zeros(n_hot), *[np.zeros(len(g)) for g in grids]], dict(both[1])
        for bucket, row in both[0]:
            pairs, s = Pairs(row), State.opened(states[bucket])
            customers, known, own = pairs.of_words(s.tables), pairs.of_words(pairs.counts), pairs.hot < 0
            top = customers[own]
            out[0] += [pairs.counts.sum(), (known[own] > 0).sum(), s.seats.sum(), s.tables.sum(), (pairs.counts > 0).sum(),
                       *[(x == k).sum() for x in (pairs.counts, top) for k in (1, 2)]]
            np.add.at(out[1], pairs.hot[~own], known[~own])
            np.add.at(out[2], pairs.hot[~own], customers[~own])
            if grids:
                out[3] += _likelihood_of_tables(pairs.counts, s.tables, grids[0])
                out[4] += _likelihood_of_tables(top, s.seats[own], grids[1])
        give_back()
        return out

    # a few hundred numbers per partition, added up in a tree
    x = _beside(buckets, state).map(run).treeReduce(lambda a, b: [u + v for u, v in zip(a, b)])
    tokens, vocabulary, seats, tables, _, one, two, r_one, r_two = x[0]
    hot_known, hot_customers = x[1], x[2].astype(np.int64)
    guess = lambda a, b: float(np.clip((a + 1) / (a + 2 * b + 2), 0.1, 0.9))
    out = {"tokens": tokens, "vocabulary": vocabulary + (hot_known > 0).sum(), "tables": tables, "hot_customers": hot_customers, "hot_known": hot_known}
    if last is None:
        out["hot_seats"] = np.minimum(hot_customers, 1)
        out |= {"word": (guess(one, two), 1.0), "root": (guess(r_one, r_two), 1.0)}
    else:
        d, strength = last["root"]
        rooms = strength + d * np.maximum(last["seats"] - last["hot_seats"], 0)
        out["hot_seats"] = seating.draw_tables(hot_customers, np.full(n_hot, 1 / (last["vocabulary"] + 1)), rooms, d, rng)
        all_seats = seats + out["hot_seats"].sum()
        strengths = np.clip(strength * S_STEPS, 1e-2, 1e6)
        tabled = x[4] + _likelihood_of_tables(hot_customers, out["hot_seats"], grids[1])
        chance = log_rooms([all_seats], [tables], grids[1], strengths) + tabled[:, None]
        i, j = _pick(chance, rng)
        out |= {"word": last["word"], "root": (float(grids[1][i]), float(strengths[j])), "tabled": x[3], "grid": grids[0]}
    out["seats"] = seats + out["hot_seats"].sum()
    return out


def _answers(bucket: int, row: dict, customers: np.ndarray, samples: list[tuple]) -> list[tuple]:
    """(partition, (block, bucket, pressed log10 probabilities of its pairs averaged over the samples, training counts of its
    words)) of a bucket's blocks."""
    pairs = Pairs(row)
    prob = sum(pair_probability(pairs, state, totals, customers, tables) for state, totals, tables in samples)
    logp = np.log10(prob / len(samples)).astype("<f4")
    known = pairs.of_words(pairs.counts)
    some = pairs.hot >= 0
    known[some] = samples[0][1]["hot_known"][pairs.hot[some]]
    out: dict[int, list] = {}
    for (part, block), x in zip(row["blocks"], row["where"]):
        at = np.cumsum(_unpress_ints(x))
        word = pairs.word[at]
        out.setdefault(part, []).append((block, logp[at].tobytes(), _ints(known[word[_changes(word)]])))
    return [(part, (bucket, _press(pickle.dumps(x)))) for part, x in out.items()]


def answers_of(table: RDD, spark, n: int, hot: dict[bytes, int], block_bytes: int, seed: int) -> tuple[RDD, int, int]:
    """The buckets' answers, dealt to the partitions of the blocks; the training tokens and the vocabulary."""
    parts = table.getNumPartitions()
    sent = table.mapPartitionsWithIndex(lambda k, rows: _send(k, blocks_of_partition(rows, block_bytes), n, hot))
    tasks = max(1, n // TOGETHER)
    buckets = _whole(sent.partitionBy(tasks, int).mapPartitions(lambda rows: _gather(rows, hot)))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    buckets.checkpoint()  # safe against lost executors, and lets go of the blocks' shuffle
    spark.sparkContext.runJob(buckets, lambda rows: [], [])  # checkpoints follow a job: after one of no partitions they are the first to compute
    buckets = RDD(buckets._jrdd, spark.sparkContext, buckets._jrdd_deserializer)
    del sent
    gc.collect()
    time.sleep(2.5)  # references to the JVM's objects are given up by a thread that looks once a second
    for _ in range(2):  # Spark's cleaner lets go of the shuffle once the references held here are known to be gone
        spark._jvm.System.gc()
        time.sleep(0.5)
    shards = max(1, n // 4)

    def names(x):
        contexts = _from_planes(_unpress(x[1]["contexts"]))
        yield from _post(x[0], contexts, contexts, shards, _planes)

    homes = _keep(buckets.flatMap(lambda rows: (y for x in rows for y in names(x))).partitionBy(shards, int).mapPartitions(_shard))

    def posted(state: RDD, customers: bool = False) -> RDD:
        """What the buckets post to the shards: their part of each context's tables, or of its customers."""

        def run(both):
            states = dict(both[1])
            for bucket, row in both[0]:
                pairs = Pairs(row)
                x = pairs.counts if customers else _unpress_ints(states[bucket][0])
                yield from _post(bucket, pairs.contexts, pairs.of_contexts(x), shards, _ints)

        return _whole(_beside(buckets, state).flatMap(run).partitionBy(shards, int))

    def stepped(state: RDD, sums: RDD, totals: dict, k: int) -> RDD:
        def run(three):
            states, tables = dict(three[1]), _sums_of(three[2])
            for bucket, row in three[0]:
                new = sweep(Pairs(row), State.opened(states[bucket]), totals, tables[bucket], np.random.default_rng([seed, k, bucket]))
                yield bucket, new.pressed()

        return _keep(_beside(buckets, state, sums).flatMap(run))

    def rooms(both) -> np.ndarray:
        """Likelihood of the restaurants of a partition of shards, by discount and strength."""
        out = np.zeros((len(grid), len(strengths)))
        for (_, _, c), (_, _, t) in zip(_added(both[0], both[1]), _added(both[0], both[2])):
            out += log_rooms(t[c > 0], c[c > 0], grid, strengths)
        return out

    state = _keep(buckets.flatMap(lambda rows: [(b, first_state(Pairs(row)).pressed()) for b, row in rows]))
    counted = posted(state, True)
    customers = _whole(_beside(homes, counted).flatMap(_replies).partitionBy(tasks, int))
    rng = np.random.default_rng([seed, 1 << 20])
    samples, totals = [], None
    for k in range(1 + BURN_IN + SAMPLES):
        totals = totals_of(buckets, state, totals, len(hot), rng)
        to_shards = posted(state)
        if "grid" in totals:
            grid, strengths = totals["grid"], np.clip(totals["word"][1] * S_STEPS, 1e-2, 1e6)
            chance = _beside(homes, counted, to_shards).map(rooms).treeReduce(lambda a, b: a + b) + totals["tabled"][:, None]
            i, j = _pick(chance, rng)
            totals["word"] = (float(grid[i]), float(strengths[j]))
        sums = _whole(_beside(homes, to_shards).flatMap(_replies).partitionBy(tasks, int))
        if k > BURN_IN:
            samples.append((state, totals, sums))
        if k < BURN_IN + SAMPLES:
            state = stepped(state, sums, totals, k)
    kept = [t for _, t, _ in samples]

    def run(sides):
        seated, tables = [dict(x) for x in sides[2::2]], [_sums_of(x) for x in sides[3::2]]
        counts = _sums_of(sides[1])
        for bucket, row in sides[0]:
            yield from _answers(bucket, row, counts[bucket], [(State.opened(s[bucket]), t, x[bucket]) for s, t, x in zip(seated, kept, tables)])

    told = _beside(buckets, customers, *[x for s, _, t in samples for x in (s, t)]).flatMap(run)
    return told.partitionBy(parts, int), int(totals["tokens"]), int(totals["vocabulary"])  # parts or more partitions


def _score(blocks, answers, n: int, hot: dict[bytes, int], tokens: int, vocabulary: int):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of the rows of a partition's blocks."""
    told: dict[tuple, tuple] = {}
    for _, (bucket, x) in answers:
        told |= {(block, bucket): (p, k) for block, p, k in pickle.loads(_unpress(x))}
    for number, rows in enumerate(blocks):
        tok = Tokens([x for _, _, x in rows])
        logp, known = np.zeros(len(tok.pair_word)), np.zeros(len(tok.words), np.int64)
        block = number << 32 | tok.mark()
        for bucket, w, p in _by_bucket(tok, n, hot):
            if (block, bucket) not in told:
                raise ComputationError("the table gave other rows when it was read again: store it before scoring")
            x, k = told.pop((block, bucket))
            logp[p], known[w] = np.frombuffer(x, "<f4"), _from_ints(k)
        base = np.log10((known + 1) / (tokens + vocabulary + 1))
        ends = np.append(tok.starts, len(tok.ids))
        add = lambda x: np.add.reduceat(x, tok.starts).tolist()
        yield from zip([r[0] for r in rows], [not r[1] for r in rows], np.diff(ends).tolist(), add((known[tok.ids] > 0).astype(np.int64)),
                       [tokens] * len(rows), add(base[tok.ids]), add(logp[tok.pair]))
    tok = logp = known = base = told = None
    give_back()


def score_documents(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, seed: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score.

    train: boolean column, the rows to learn from.  Perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    held = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("flag"), F.col(text).cast("binary").alias("text")).rdd
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not held.getNumPartitions():
        return spark.createDataFrame([], schema)
    n = max(1, -(-text_bytes(docs, text) // bucket_bytes))
    hot = hot_words(held)
    answers, tokens, vocabulary = answers_of(held, spark, n, hot, block_bytes, seed)
    more = answers.getNumPartitions() - held.getNumPartitions()
    same = held.union(spark.sparkContext.parallelize([], more)) if more > 0 else held
    blocks = _whole(same.mapPartitions(lambda rows: (_press(pickle.dumps(x)) for x in blocks_of_partition(rows, block_bytes))))
    scored = _beside(blocks, _whole(answers)).flatMap(lambda x: _score((pickle.loads(_unpress(y)) for y in x[0]), x[1], n, hot, tokens, vocabulary))
    return spark.createDataFrame(scored, schema, verifySchema=False)
