"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its word n-grams (64-bit hashes of their words).  Sets
of a similarity of at least t differ in at most k elements, with k from the
size of the larger one.  Sizes are cut into bands in which sizes differ by at
most t; similar sets lie in one band or in neighbouring ones, so each set signs
for its own band and the next.  For a band the hash domain is cut into parts of
two pieces each, K = k + 1 + e pieces in all; every choice of one piece of a
part is a signature.  Two similar sets differ in at most k pieces, so they agree
on at least 1 + e.  Pieces with fewer than m elements say little and would join
unrelated sets, so a set with at most e such pieces does not sign them: one of
the pieces it agrees on is then another.  A set with more of them signs them all.

Equal sets are one class, so copies never meet as pairs, and a task sends a
class's signatures once.  Signatures travel with 64 bits of the set; candidates
then stand for all classes of that name, each of which has a number of its own
(``node``), so classes that share a name are told apart before anything is linked.
Groups of at most ``SMALL`` classes with a common signature give all their pairs
as candidates; in a larger group each class is paired with the least one only.
A candidate whose sketches (counts of the elements by ranges of their hash)
differ by more than the threshold allows cannot be a link and goes before any
set is fetched; the others are checked exactly.  Larger groups that still hold
classes of different components are then checked completely: groups that share classes are
checked together where that is less work, their classes are dealt into blocks of
about ``BLOCK``, two blocks meet in a task, which intersects their sets as a
matrix product and emits at most one link per class.  Sketches meet first, in
blocks of ``WIDE`` blocks.  Where they leave at most ``FEW`` possible links per
class between components, these go as pairs, and a pair that many groups share is
checked once; otherwise they name the classes of each block that have a possible
partner, and only their sets travel.  So no link between components is lost and
no task or table holds all pairs of a group.

Edge cases: null or empty texts have an empty set and link to nothing; fewer
words than n make one element of all words; equal rows fall into one class; a
null id never becomes a component id unless its component has no other; rows of
equal id but different texts are classes of their own; of equal least ids (ties)
the least hash of the text leads; texts are taken whole, a long one in a chunk
of its own; an empty table gives an empty result; columns other than id and text
are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_texts, chunks, drop, materialise, mix64, slices
from .components import components

#: Up to so many classes with a common signature are paired completely.
SMALL = 12
#: Classes in a block of a larger group.
BLOCK = 512
#: Blocks whose sketches are compared in one task, on either side.
WIDE = 8
#: Possible links per class up to which sketches name pairs instead of blocks.
FEW = 8
#: Parts into which the rows of one cluster of groups are dealt.
SALTS = 64
#: Signatures that a task holds at once, and that one bucket gets on average.
HELD = 600_000
#: Expected elements in a range of a sketch.
SKETCHED = 2
#: log2 of the bits of the filter on the rows whose texts are fetched: at most 2^17 words are broadcast.
FILTER = 23
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(maxsize=None)
def bands(percent: int, upto: int = 1 << 40) -> tuple[int, ...]:
    """Largest size of each band."""
    tops, low = [], 1
    while low <= upto:
        tops.append(low * 100 // percent)
        low = tops[-1] + 1
    return tuple(tops)


@lru_cache(maxsize=4096)
def plan_of(band: int, percent: int):
    """(piece edges, keys, e, m) of a band's instance; None where only equal sets are similar.

    e is the least number that exceeds the expected number of pieces with fewer than m elements by
    2.5 deviations, for the smallest sets that sign here; m is 2, or 1, or 0 (all pieces sign).
    """
    tops = bands(percent)
    k = 2 * (100 - percent) * tops[band] // (100 + percent)
    if k == 0:
        return None
    least = tops[band - 2] + 1 if band > 1 else 1
    spare, m = 0, 0
    for weak in (2, 1):
        fits = [e for e in range(1, k + 2) if _enough(e, (k + 2 + e) // 2 * 2, least, weak)]
        if fits:
            spare, m = fits[0], weak
            break
    pieces = (k + 2 + spare) // 2 * 2  # parts of two
    edges = np.array([(i << 64) // pieces for i in range(1, pieces)], np.uint64)
    keys = mix64(np.arange(pieces, dtype=np.uint64) + np.uint64((band + 1) << 32))
    return edges, keys, pieces - 1 - k, m


def _enough(spare: int, pieces: int, size: int, weak: int) -> bool:
    rate = size / pieces
    p = np.exp(-rate) * (1 + rate * (weak > 1))
    return spare >= pieces * p + 2.5 * np.sqrt(pieces * p * (1 - p))


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a sorted array of distinct hashes."""
    band = int(np.searchsorted(np.array(bands(percent)), len(elements)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(elements))))
    out = []
    for j in (band, band + 1):
        plan = plan_of(j, percent)
        if plan is None:
            continue
        edges, keys, spare, m = plan
        at = np.concatenate(([0], np.searchsorted(elements, edges), [len(elements)]))
        sig = mix64(np.diff(sums[at]) * _MUL[3] + keys)
        strong = np.diff(at) >= m
        out.append(sig[strong] if len(strong) - strong.sum() <= spare else sig)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _element_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, A-Z lower-cased."""
    w = Words([t.lower() for t in texts])
    grams = np.zeros(max(0, len(w.start) - n + 1), np.uint64)
    for j in range(n):
        grams = grams * _MUL[0] + w.hash[j: j + len(grams)]
    grams = mix64(grams)
    out = []
    for first, size in zip(w.first_word.tolist(), w.n_words.tolist()):
        if size >= n:
            out.append(np.unique(grams[first: first + size - n + 1]))
        elif size:
            h = np.full(1, size, np.uint64)
            for j in range(size):
                h = h * _MUL[1] + w.hash[first + j]
            out.append(mix64(h + _MUL[2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_key(e: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return (int(mix64(e + _MUL[1]).sum(dtype=np.uint64).view(np.int64)), int(mix64(e * _MUL[2] + _MUL[1]).sum(dtype=np.uint64).view(np.int64)))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, k1, k2, sketch, th) of each row of (id, text, th): size, 128 bits and sketch of its set, hash of its text."""

    def run(batches):
        for b in slices(batches):
            sizes, keys, sketches = [], [], []
            for some in chunks(arrow_texts(b.column(1))):  # sets are dropped as soon as they are described
                for e in _element_sets(some, n):
                    sizes.append(len(e)), keys.append(_set_key(e)), sketches.append(sketch(e).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array([k for k, _ in keys], pa.int64()),
                 pa.array([k for _, k in keys], pa.int64()), pa.array(sketches, pa.binary()), b.column(2)],
                names=["id", "n", "k1", "k2", "sketch", "th"])

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, sketch binary, th long")


def sketch(e: np.ndarray) -> np.ndarray:
    """Elements in each of equally wide ranges of the hash, a power of two many; counts above 255 stand as 255."""
    bits = max(0, (len(e) // SKETCHED).bit_length() - 1)
    place = e >> np.uint64(64 - bits) if bits else np.zeros(len(e), np.uint64)
    return np.minimum(np.bincount(place.astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """At most the number of elements by which two sets differ, from their sketches."""
    few = min(len(x), len(y))
    x, y = (s.reshape(few, -1).sum(1, dtype=np.int64) for s in (x, y))
    return int(np.abs(x - y).sum())


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes, from pairs of names, whose sketches do not rule out a link."""

    def run(batches):
        for b in batches:
            na, nb, sa, sb = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = [apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (100 + percent) <= (u + v) * (100 - percent)
                    for u, v, x, y in zip(na, nb, sa, sb)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (classes.select(F.col("name").alias(c), F.col("node").alias("v" + c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c)) for c in "ab")
    # sizes too far apart are no link and need no sketch
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.select("va", "vb", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _within(sig: np.ndarray, n_buckets: int) -> np.ndarray:
    """The signature's bucket above 32 bits of it: buckets have about HELD signatures, so by chance few agree in one,
    and what that adds to the candidates the checks remove."""
    return (sig % np.uint64(n_buckets)) << np.uint64(32) | sig >> np.uint64(32)


def _send_chunk(sig: np.ndarray, node: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """One row per bucket: each class's signatures, classes in order.  A signature of more than SMALL
    classes of this chunk goes as its least class, a count, and the pairs of that class with the others."""
    sig = _within(sig, n_buckets)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])  # copies of a set count once
    sig, node = sig[new], node[new]
    first = _starts(sig)
    count = np.diff(np.append(first, len(sig)))
    big = np.repeat(count > SMALL, count)
    head = np.zeros(len(sig), bool)
    head[first] = True
    least = np.repeat(node[first], count)
    weight = np.where(big, np.repeat(count, count), 1)
    bucket = (sig >> np.uint64(32)).astype(np.int64)
    rows = []
    for own, second in ((head | ~big, weight), (big & ~head, least)):
        at = np.flatnonzero(own)
        at = at[np.lexsort((node[at], bucket[at]))]
        cuts = np.append(_starts(bucket[at]), len(at)).tolist()
        for u, v in zip(cuts[:-1], cuts[1:]):
            w = at[u:v]
            runs = _starts(node[w])
            signed = second is weight
            extra = second[w] if not signed or big[w].any() else second[:0]
            rows.append((int(bucket[w[0]]), sig[w].astype(np.uint32).tobytes() if signed else None, node[w][runs].tobytes(),
                         np.diff(np.append(runs, len(w))).astype(np.int32).tobytes(), extra.tobytes()))
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                                      names=["bucket", "sigs", "nodes", "runs", "second"])


def signed(elements: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, name of each one's class) of some sets; the name is the first half of the set's key."""
    sigs = [signatures(e, percent) for e in elements if len(e)]
    nodes = [_set_key(e)[0] for e in elements if len(e)]
    sizes = [len(s) for s in sigs]
    return np.concatenate([np.zeros(0, np.uint64), *sigs]), np.repeat(np.array(nodes, np.int64), sizes)


def candidates(docs: DataFrame, n: int, percent: int, n_buckets: int) -> DataFrame:
    """Rows (kind, a, b): pairs a < b of groups of at most SMALL classes (kind 0), of each class of a larger
    group with another of it (1), and the signatures of larger groups (2: a the signature, b null)."""

    def send(batches):
        sig, node, held = [], [], 0
        for b in slices(batches):
            for some in chunks(arrow_texts(b.column(1))):
                s, m = signed(_element_sets(some, n), percent)
                sig.append(s), node.append(m)
                held += len(s)
                if held >= HELD:
                    yield _send_chunk(np.concatenate(sig), np.concatenate(node), n_buckets)
                    sig, node, held = [], [], 0
        if held:
            yield _send_chunk(np.concatenate(sig), np.concatenate(node), n_buckets)

    def meet(t: pa.Table) -> pa.Table:
        pieces: list[list] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        pairs, small = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        top = np.uint64(t["bucket"][0].as_py() << 32)
        for s, m, r, x in zip(*[t[c].to_pylist() for c in ("sigs", "nodes", "runs", "second")]):
            node = np.repeat(np.frombuffer(m, np.int64), np.frombuffer(r, np.int32))
            x = np.frombuffer(x, np.int64)
            if s is None:
                pairs.append(np.stack([x, node], 1))
            else:
                for to, part in zip(pieces, (np.frombuffer(s, np.uint32) | top, node, x if len(x) else np.ones(len(node), np.int64))):
                    to.append(part)
        sig, node, count = map(np.concatenate, pieces)
        order = np.lexsort((-count, node, sig))
        sig, node, count = sig[order], node[order], count[order]
        once = np.ones(len(sig), bool)  # a class that several tasks have counts once
        once[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, count = sig[once], node[once], count[once]
        first = _starts(sig)
        size = np.diff(np.append(first, len(sig)))
        total = np.add.reduceat(count, first) if len(first) else first
        large = np.repeat(total > SMALL, size)
        least = np.repeat(node[first], size)
        pairs.append(np.stack([least, node], 1)[large])
        for d in range(1, SMALL):
            i = np.flatnonzero((sig[d:] == sig[:-d]) & ~large[d:]) if d < len(sig) else first[:0]
            small.append(np.stack([node[i], node[i + d]], 1))
        big = sig[first][total > SMALL].view(np.int64)
        few, many = (np.unique(np.sort(p[p[:, 0] != p[:, 1]], 1), axis=0) for p in (np.concatenate(small), np.concatenate(pairs)))
        return pa.table({"kind": pa.array(np.repeat([0, 1, 2], [len(few), len(many), len(big)]), pa.int32()),
                         "a": np.concatenate([few[:, 0], many[:, 0], big]), "b": pa.concat_arrays([pa.array(few[:, 1]), pa.array(many[:, 1]), pa.nulls(len(big), pa.int64())])})

    sent = docs.mapInArrow(send, "bucket int, sigs binary, nodes binary, runs binary, second binary")
    return sent.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long").distinct()


def split_by_bits(docs: DataFrame, need: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose (id, th) sets a bit that a row of ``need`` sets, and all others, so that only the first need a shuffle.

    The filter is 2^FILTER bits in words of 64; with far more rows in ``need`` than bits all rows are among the first.
    """
    place = F.pmod(F.xxhash64("id", "th"), F.lit(1 << FILTER))
    at = {"word": F.shiftright(place, 6), "bit": F.pmod(place, F.lit(64)).cast("int")}
    words = need.withColumns(at).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    marked = docs.withColumns(at).join(F.broadcast(words), "word", "left").withColumn("hit", F.expr("coalesce(getbit(bits, bit) = 1, false)"))
    return tuple(marked.where(c).drop("word", "bit", "bits", "hit") for c in ("hit", "not hit"))


def class_sets(docs: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """(node, elements, checked, grouped) of the classes in ``need`` (id, th, node, k1, k2, checked, grouped), from a document of each."""

    def run(batches):
        for b in slices(batches):
            at, want = 0, list(zip(*[b.column(k).to_pylist() for k in range(5)]))
            for some in chunks(arrow_texts(b.column(5))):
                own = [(w, e.view(np.int64)) for w, e in zip(want[at: at + len(some)], _element_sets(some, n)) if _set_key(e) == w[1:3]]
                at += len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w[0] for w, _ in own], pa.int64()), pa.array([e for _, e in own], pa.list_(pa.int64())),
                     pa.array([w[3] for w, _ in own], pa.bool_()), pa.array([w[4] for w, _ in own], pa.bool_())],
                    names=["node", "elements", "checked", "grouped"])

    docs, need = (t.withColumn("id", F.coalesce("id", F.lit(0))) for t in (docs, need))
    texts = split_by_bits(docs, need)[0].groupBy("id", "th").agg(F.first("text").alias("text"))  # repeated rows go before the shuffle
    found = texts.join(need, ["id", "th"]).select("node", "k1", "k2", "checked", "grouped", "text")
    return found.mapInArrow(run, "node long, elements array<long>, checked boolean, grouped boolean")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose similarity is at least the threshold, by exact intersection."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    inter = both.select("a", "b", F.size(F.array_intersect("ea", "eb")).cast("long").alias("i"), (F.size("ea") + F.size("eb")).cast("long").alias("t"))
    return inter.where(F.col("i") * 100 >= F.lit(percent) * (F.col("t") - F.col("i"))).select("a", "b")


def _check_block(t: pa.Table, percent: int) -> pa.Table:
    """Links between different components among the classes of two blocks: a spanning forest."""
    node, root = t["node"].to_numpy(), t["root"].to_numpy()
    col = t["elements"].combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    flat, size = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    _, code, n_with = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(node)), size)
    common = n_with[code] > 1  # an element of one set is in no intersection
    used, code = np.unique(code[common], return_inverse=True)
    row = row[common]
    inter = np.zeros((len(node), len(node)), np.float32)
    for lo in range(0, len(used), 4096):
        part = (code >= lo) & (code < lo + 4096)
        x = np.zeros((len(node), min(4096, len(used) - lo)), np.float32)
        x[row[part], code[part] - lo] = 1
        inter += x @ x.T
    inter = np.rint(inter).astype(np.int64)
    close = inter * 100 >= percent * (size[:, None] + size[None, :] - inter)
    a, b = np.nonzero(np.triu(close, 1) & (root[:, None] != root[None, :]))
    up = {int(r): int(r) for r in root}

    def top(r):
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        u, v = top(int(root[i])), top(int(root[j]))
        if u != v:
            up[max(u, v)] = min(u, v)
            out.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})


def _possible(t: pa.Table, percent: int, few: int) -> pa.Table:
    """Possible links between components among the classes of two wide blocks: pairs (node, other) if they are at most ``few``
    per class, else (group, p, q, node, root, as_one) of each class that has one, by the blocks of the two."""
    t = t.combine_chunks()
    node, root, mine, size = (t[c].to_numpy() for c in ("node", "root", "mine", "n"))
    wide = mine // WIDE
    low, high = t["wp"][0].as_py(), t["wq"][0].as_py()
    raw = [np.frombuffer(x, np.uint8) for x in t["sketch"].to_pylist()]
    length = np.array([len(x) for x in raw])
    found = [np.zeros((0, 2), np.int64)]  # (place of a class, block of its partner)
    pairs, room = [np.zeros((0, 2), np.int64)], [few * len(node)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        ranges = min(length[a[0]], length[b[0]])
        x, y = (np.stack([raw[k].reshape(ranges, -1).sum(1, dtype=np.int16) for k in side]) for side in (a, b))
        step = max(1, (1 << 21) // (len(b) * int(ranges)))
        for lo in range(0, len(a), step):
            some = a[lo: lo + step]
            far = np.abs(x[lo: lo + step, None] - y[None]).sum(2, dtype=np.int64)
            ok = (far * (100 + percent) <= (size[some][:, None] + size[b]) * (100 - percent)) & (root[some][:, None] != root[b])
            i, j = np.nonzero(ok)
            room[0] -= len(i)
            if room[0] >= 0:
                pairs.append(np.stack([some[i], b[j]], 1))
            both = np.concatenate([np.stack([some[i], mine[b[j]]], 1), np.stack([b[j], mine[some[i]]], 1)])
            found.append(np.unique(both, axis=0))

    for less in np.unique(length).tolist():
        for more in [m for m in np.unique(length).tolist() if less <= m <= less * 200 // percent]:  # others differ too much in size
            for left, right in ((less, more), (more, less)):
                a, b = np.flatnonzero((length == left) & (wide == low)), np.flatnonzero((length == right) & (wide == high))
                if len(a) and len(b):
                    compare(a, b)
                if less == more or low == high:
                    break
    if room[0] >= 0:
        ends = np.unique(np.sort(node[np.concatenate(pairs)], axis=1), axis=0)
        nothing = lambda kind: pa.nulls(len(ends), kind)
        return pa.table({"group": nothing(pa.int64()), "p": nothing(pa.int32()), "q": nothing(pa.int32()), "node": ends[:, 0],
                         "root": nothing(pa.int64()), "as_one": nothing(pa.bool_()), "other": ends[:, 1]})
    hits = np.unique(np.concatenate(found), axis=0)
    at, other = hits[:, 0], hits[:, 1]
    return pa.table({"group": t["group"].take(pa.array(at)), "p": pa.array(np.minimum(mine[at], other), pa.int32()),
                     "q": pa.array(np.maximum(mine[at], other), pa.int32()), "node": pa.array(node[at]), "root": pa.array(root[at]),
                     "as_one": t["as_one"].take(pa.array(at)), "other": pa.nulls(len(at), pa.int64())})


def _with_cluster(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``rows`` joined to the one row of their cluster, which SALTS tasks share."""
    some = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", "sig"), F.lit(SALTS)).cast("int")).join(some, ["cluster", "salt"]).drop("salt")


def large_group_links(large: DataFrame, roots: DataFrame, sets: DataFrame, classes: DataFrame, percent: int, n_buckets: int, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Links inside groups of more than SMALL classes that the first check left in several components."""

    def sign(batches):
        for b in slices(batches):
            col = b.column(1)
            sigs = [signatures(e.values.to_numpy(zero_copy_only=False).view(np.uint64), percent) for e in col]
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sigs])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_within(np.concatenate([np.zeros(0, np.uint64), *sigs]), n_buckets).view(np.int64))], names=["node", "sig"])

    members = sets.mapInArrow(sign, "node long, sig long").join(large.select(F.col("a").alias("sig")), "sig")
    members = members.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    signed_ = members = materialise(members)
    open_ = members.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("node").alias("first"), F.count("*").alias("c")).where("r0 < r1")
    members = materialise(members.join(open_.select("sig", "first", "c"), "sig"))
    # clusters of groups that share classes; a cluster is checked as one group where its square is less than its groups' squares
    named = components(members.select(F.col("node").alias("a"), F.col("first").alias("b")))
    cluster = named.select("node", F.col("root").alias("cluster"))
    squares = members.select("sig", "first", "c").distinct().join(cluster.withColumnRenamed("node", "first"), "first")
    squares = squares.groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("apart"))
    whole = cluster.groupBy("cluster").agg(F.count("*").alias("size")).join(squares, "cluster").withColumn("as_one", F.col("size") * F.col("size") <= F.col("apart"))
    grouped = _with_cluster(members.join(cluster, "node"), whole).select(
        F.when(F.col("as_one"), F.col("cluster")).otherwise(F.col("sig")).alias("group"), "as_one", "node", "root",
        F.ceil(F.when(F.col("as_one"), F.col("size")).otherwise(F.col("c")) / block).cast("int").alias("nb")).distinct()
    dealt = grouped.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("wide", F.floor(F.col("mine") / WIDE).cast("int"))
    dealt = dealt.join(classes.select("node", "n", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("nb") - 1) / WIDE).cast("int"))))
    dealt = dealt.select("group", "as_one", F.least("wide", "other").alias("wp"), F.greatest("wide", "other").alias("wq"), "mine", "node", "root", "n", "sketch")
    keys = ("group", "as_one", "wp", "wq")  # little data and much work: not for AQE to coalesce
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    dealt = dealt.groupBy(*keys).applyInArrow(lambda t: _possible(t, percent, few), "group long, p int, q int, node long, root long, as_one boolean, other long")
    dealt = materialise(dealt.distinct())
    drop(signed_)
    pairs = linked(dealt.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), sets, percent)
    out = materialise(pairs.union(dealt.where("other is null").join(sets, "node").groupBy("group", "as_one", "p", "q").applyInArrow(lambda t: _check_block(t, percent), "a long, b long")).distinct())
    drop(members, named, dealt)
    return out


def join_documents(docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least id that links reach, its own included), text_hash (64 bits of
    the text) and leads: whether the row has the least (id, text_hash) of its component, null ids last."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    told = materialise(describe(rows, n))
    classes = told.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct(F.isnull("id").alias("unnamed"), "id", "th")).alias("least"), F.min("sketch").alias("sketch"))
    classes = materialise(classes.select("k1", "k2", "n", "least", "least.id", "least.th", "sketch", F.col("k1").alias("name"), F.monotonically_increasing_id().alias("node")))
    total = told.agg(F.sum("n").alias("s")).first()["s"] or 0
    total = total * 4 * (100 - percent) // (100 + percent)  # about so many signatures
    n_buckets = max(1, -(-total // HELD))
    found = materialise(candidates(rows, n, percent, n_buckets))
    large = materialise(found.where("kind = 2").select("a").distinct())
    pairs = materialise(plausible(found.where("kind < 2").select("a", "b").distinct(), classes, percent))
    checked = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(True).alias("checked"), F.lit(False).alias("grouped"))
    grouped = found.where("kind = 1").select(F.explode(F.array("a", "b")).alias("name")).distinct().join(classes.select("name", "node"), "name")
    need = checked.union(grouped.select("node", F.lit(False), F.lit(True))).groupBy("node").agg(F.max("checked").alias("checked"), F.max("grouped").alias("grouped"))
    need = materialise(classes.select("id", "th", "node", "k1", "k2").join(need, "node"))
    drop(found)
    sets = materialise(class_sets(rows, need, n))
    links = materialise(linked(pairs, sets.where("checked"), percent))
    roots = components(links)
    if large.limit(1).count():
        more = materialise(links.union(large_group_links(large, roots, sets.where("grouped"), classes, percent, n_buckets, block, few)))
        drop(roots)
        roots = components(more)
        drop(more)
    drop(large, pairs, need, sets, links)
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(least, "root").select("k1", "k2", "n", "first")
    out = told.join(named, ["k1", "k2", "n"], "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        F.col("th").alias("text_hash"), (alone | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))).alias("leads"))
