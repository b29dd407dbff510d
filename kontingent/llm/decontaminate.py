"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items build one suffix automaton.  Documents
stream through it word by word; the state tells the longest suffix that occurs
in some item.  Where that length reaches the window, the window's words are hit
and the state names the items.  Items shorter than a window count as a whole.

The automaton is broadcast, so its size is bounded: items are dealt into parts
of about ``PART_BYTES`` of text.  With more than one part, each is built,
broadcast, used in one pass over the documents and let go before the next, the
pass adding to the row's spans and being written.  So the driver holds one
automaton at a time.  Nothing is shuffled and no row needs a key.

Edge cases: a null text has no words; a null item id counts as the empty
string; repeated items are folded; an item without words never occurs; an
empty item table hits nothing, an empty document table gives none back;
columns with the names of outputs are replaced.  Documents are scanned one by
one and whole, however long, so repeated documents need no care; items that
share windows (ties) are all named.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialise, slices

#: Text of the items in one automaton; about 40 times as much memory in a worker.
PART_BYTES = 4 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: ASCII letters, digits and everything beyond ASCII."""
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton over several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self._name_windows(coded)

    def _new(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of p's longest string followed by w, cut out of q if q is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _name_windows(self, coded) -> None:
        n, size = len(self.link), self.window
        order = sorted(range(n), key=self.length.__getitem__)
        self.home = [-1] * n  # the state that holds the last `window` words
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.items: dict[int, set[str]] = {}
        for v in order[1:]:
            if self.length[v] >= size:
                self.home[v] = v if self.length[self.link[v]] < size else self.home[self.link[v]]
        for name, ids in coded:
            v = 0
            for i, w in enumerate(ids):
                v = self.next[v][w]  # follows this item's own prefix, so the length is i + 1
                if i + 1 >= size:
                    self.items.setdefault(self.home[v], set()).add(name)
            if len(ids) < size:
                self.short.setdefault(v, []).append((len(ids), name))
        self.has_short = [False] * n
        for v in order[1:]:
            self.has_short[v] = v in self.short or self.has_short[self.link[v]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans [first, end) in words, and the items found."""
        spans: list[list[int]] = []
        found: set[str] = set()
        step, link, length, has_short, size = self.next, self.link, self.length, self.has_short, self.window
        v = have = 0
        for i, w in enumerate(map(self.vocab.get, words)):
            if w is None:
                v = have = 0
                continue
            to = step[v].get(w)
            while to is None and v:
                v = link[v]
                have = length[v]
                to = step[v].get(w)
            if to is None:
                continue
            v = to
            have += 1
            if have >= size or has_short[v]:
                start = i + 1
                if have >= size:
                    start = i + 1 - size
                    found |= self.items[self.home[v]]
                u = v
                while u > 0 and has_short[u]:
                    for n, name in self.short.get(u, ()):
                        if n <= have:
                            found.add(name)
                            start = min(start, i + 1 - n)
                    u = link[u]
                if start <= i:
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_MADE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_start", T.ArrayType(T.LongType())),
    T.StructField("hit_end", T.ArrayType(T.LongType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])
_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]


def item_parts(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """Distinct (id, text) of the items, and into how many parts of about PART_BYTES they are dealt."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return rows, max(1, -(-size // PART_BYTES))


def automaton_of(rows: DataFrame, parts: int, k: int, window: int) -> Automaton:
    """The automaton of one part; its text, about PART_BYTES, is all that reaches the driver."""
    got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
    return Automaton([(r["id"], words_of(r["text"].encode())) for r in got], window)


def scan(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with n_words, hit_start/hit_end (merged word spans) and hit_items (sorted ids).

    The text is dropped unless ``keep_text``.
    """
    made = [f.name for f in _MADE]
    rows, parts = item_parts(items)
    kept = [c for c in docs.columns if c not in made]
    df = docs.select(*kept)
    for k in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(automaton_of(rows, parts, k, window))
        outs = [c for c in kept if c != text or keep_text or k + 1 < parts]
        fields = [df.schema[c] for c in outs] + list(_MADE)

        def run(batches, shared=shared, outs=outs, first=k == 0):
            for b in slices(batches):
                texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                rows = []
                for i, t in enumerate(texts):
                    words = words_of(t or b"")
                    spans, found = shared.value.scan(words)
                    if not first:
                        old = [b.column(b.schema.get_field_index(c))[i].as_py() for c in made[1:]]
                        spans = merge_spans([*spans, *zip(old[0], old[1])])
                        found |= set(old[2])
                    rows.append((len(words), [a for a, _ in spans], [e for _, e in spans], sorted(found)))
                cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(_ARROW)]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in outs] + cols, names=[*outs, *made])

        new = df.mapInArrow(run, T.StructType(fields))
        if parts > 1:
            new = materialise(new)
            drop(df)
            shared.unpersist()
        df = new
    return df


def cut_spans(text: bytes, spans) -> bytes:
    """``text`` without the words of the spans; what separates kept words stays."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done: at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 0, max_coverage: float = 0.5,
                  text: str = "text") -> DataFrame:
    """Documents without the hit spans longer than ``max_span`` words.

    A document of whose words more than ``max_coverage`` are hit is dropped as a whole; documents without hits come back
    unchanged.  Where a cut brings words together that make a window of an item, that goes too, until none is left; the
    coverage is that of the text as it came.
    """
    rows, parts = item_parts(items)
    if parts > 1:
        return _in_passes(docs, items, window, max_span, max_coverage, text)
    shared = docs.sparkSession.sparkContext.broadcast(automaton_of(rows, 1, 0, window))

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index(text)
            keep, new = [], []
            for t in b.column(at).cast(pa.binary()).to_pylist():
                words = words_of(t or b"")
                spans, _ = shared.value.scan(words)
                keep.append(sum(e - s for s, e in spans) <= len(words) * max_coverage)
                while keep[-1] and any(e - s > max_span for s, e in spans):
                    t = cut_spans(t, [(s, e) for s, e in spans if e - s > max_span])
                    spans, _ = shared.value.scan(words_of(t))
                new.append(t)
            cols = [pa.array(new, pa.binary()).cast(c.type) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _in_passes(docs: DataFrame, items: DataFrame, window: int, max_span: int, max_coverage: float, text: str) -> DataFrame:
    """The same with several automata: documents that a pass cut go through another one, until none is cut."""
    kept, out, todo = docs.columns, None, docs
    while True:
        hits = scan(todo, items, window, text, keep_text=True)
        if todo is docs:
            covered = F.aggregate(F.zip_with("hit_end", "hit_start", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
            hits = hits.where(covered <= F.col("n_words") * F.lit(max_coverage))
        schema = T.StructType([*[hits.schema[c] for c in kept], T.StructField("_cut", T.BooleanType())])

        def cut(batches):
            for b in slices(batches):
                at = b.schema.get_field_index
                spans = [[(s, e) for s, e in zip(x, y) if e - s > max_span] for x, y in zip(b.column(at("hit_start")).to_pylist(), b.column(at("hit_end")).to_pylist())]
                new = [cut_spans(t, own) if own else t for t, own in zip(b.column(at(text)).cast(pa.binary()).to_pylist(), spans)]
                col = pa.array(new, pa.binary()).cast(b.column(at(text)).type)
                yield pa.RecordBatch.from_arrays([*[col if c == text else b.column(at(c)) for c in kept], pa.array([bool(x) for x in spans], pa.bool_())], names=[*kept, "_cut"])

        done = materialise(hits.mapInArrow(cut, schema))
        part = done.where("not _cut").select(*kept)
        out = part if out is None else out.union(part)
        todo = done.where("_cut").select(*kept)
        if not todo.limit(1).count():
            return out
