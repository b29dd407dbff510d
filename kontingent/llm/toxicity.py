"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its four- and
five-letter beginnings (so inflected forms share what their stem learns).
Filters of several widths slide over the words, ReLU and max pooling keep each
filter's strongest place in the whole text, and a logistic layer scores it.
Platt scaling on rows kept out of the training makes the score a probability;
on the same rows a threshold per language is calibrated for precision.

Labels, language, source and id are never inputs of the score; the language
only picks the threshold of ``rejected``.

Training takes every labelled row and its whole text (of documents of one id
the least text).  Four fifths of the rows are dealt to shards of about
``SHARD_ROWS`` by a hash of their id; in a round a task trains on its shard from
the weights so far, then the shards' weights are averaged, an embedding over
the shards that changed it.  The other fifth calibrates: the logistic fit is
Newton steps on sums that Spark makes, the thresholds come from counts.  Only
weights, sums and counts reach the driver.  Scoring reads every text whole: a batch's
distinct words are convolved by table lookups, one per filter position.

Edge cases: a null or empty text scores like a text of padding only; texts are
scored whole however long, one that exceeds a piece alone; rows are scored one
by one, so repeated rows, null ids and ties need no care; without labelled rows
of both kinds every score is the base rate (0 without any label); an empty table
gives an empty result; columns with the names of outputs are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialise, slices

#: Rows and bytes of text of a shard, about; rounds if there are several.
SHARD_ROWS, SHARD_BYTES, ROUNDS = 6000, 32 << 20, 2
#: Labels that are sent to every executor; more are joined by a shuffle.
MOST_SENT = 4_000_000
#: Embeddings of a part that is averaged by itself.
PART = 1 << 10
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
BATCH, RATE, START = 64, 0.02, 0.01
#: Rows seen in training, all epochs together, and bounds of the epochs.
SEEN, EPOCHS = 48_000, (4, 80)
#: Precision at which a language's threshold is set on the rows kept out.
PRECISION = 0.98
_SPLIT = re.compile(r"[^\w]+")


def word_features(word: str) -> tuple[int, int, int]:
    """Buckets of a word and of its beginnings; bucket 0 is padding."""
    return tuple(1 + zlib.crc32(f"{k}:{s}".encode()) % (BUCKETS - 1) for k, s in enumerate((word, word[:4], word[:5])))


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words (row 0: padding), the words' numbers in all texts, and lengths.

    Every text is padded to the widest filter.
    """
    known: dict[str, int] = {"": 0}
    ids: list[int] = []
    sizes = []
    pad = max(WIDTHS) - 1
    for t in texts:
        before = len(ids)
        for w in _SPLIT.split(t.lower()):
            if w:
                ids.append(known.setdefault(w, len(known)))
        ids += [0] * max(pad, pad + 1 - (len(ids) - before))
        sizes.append(len(ids) - before)
    feats = np.array([(0, 0, 0), *map(word_features, list(known)[1:])], np.int32).reshape(-1, 3)
    return feats, np.array(ids, np.int64), np.array(sizes, np.int64)


@dataclass
class Net:
    emb: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 11) -> "Net":
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, START, (BUCKETS, DIM)).astype(np.float32)
        emb[0] = 0
        filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        return cls(emb, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)

    def pooled(self, words: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest filter outputs of each text; words: a vector per distinct word."""
        pools = []
        n = len(ids)
        for f in self.filters:
            width = len(f)
            acc = (words @ f[0])[ids]
            for j in range(1, width):
                acc[: n - j] += (words @ f[j])[ids[j:]]
            pools.append(np.maximum.reduceat(self._inside(acc, starts, n, width), starts, axis=0))
        return np.maximum(np.concatenate(pools, 1) + self.bias, 0)

    @staticmethod
    def _inside(acc, starts, n, width):
        """Places whose window would reach into the next text count as nothing."""
        ends = np.append(starts[1:], n)
        for j in range(1, width):
            acc[ends - j] = -np.inf
        return acc

    def logits(self, feats: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.cumsum(sizes) - sizes
        return self.pooled(self.emb[feats].sum(1), ids, starts) @ self.out + self.out_bias

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(texts) + b, -30, 30)))

    def raw(self, texts: list[str]) -> np.ndarray:
        """Logits of texts, before the calibration."""
        out, lo = [], 0
        while lo < len(texts):  # pieces of bounded size, texts whole
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 400_000):
                size += len(texts[hi])
                hi += 1
            out.append(self.logits(*word_numbers(texts[lo:hi])))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Progress:
    """A net in training: what the steps remember of the gradients before."""

    net: Net
    moment: list[np.ndarray]
    square: list[np.ndarray]
    emb_sq: np.ndarray
    step: int = 0

    @classmethod
    def fresh(cls, seed: int) -> "Progress":
        net = Net.fresh(seed)
        zeros = lambda: [np.zeros_like(p) for p in (*net.filters, net.bias, net.out, np.zeros(1, np.float32))]
        return cls(net, zeros(), zeros(), np.full(BUCKETS, 1e-6, np.float32))

    def dense(self) -> list[np.ndarray]:
        return [*self.net.filters, self.net.bias, self.net.out, np.array([self.net.out_bias], np.float32)]

    def flat(self) -> np.ndarray:
        """All but the embeddings as one vector."""
        return np.concatenate([p.ravel() for p in (*self.dense(), *self.moment, *self.square, np.array([self.step]))]).astype(np.float64)

    def set_flat(self, v: np.ndarray) -> None:
        for p in (*self.net.filters, self.net.bias, self.net.out):
            p[...], v = v[: p.size].reshape(p.shape), v[p.size:]
        self.net.out_bias, v = float(v[0]), v[1:]
        for p in (*self.moment, *self.square):
            p[...], v = v[: p.size].reshape(p.shape), v[p.size:]
        self.step = max(1, round(float(v[0])))


def train(opt: Progress, texts: list[np.ndarray], y: np.ndarray, positive: float, epochs: int, rng) -> None:
    """Epochs of steps on some texts (n x 3 buckets of a text's words); positive: weight of a row of label 1."""
    net, dense = opt.net, opt.dense()
    weight = np.where(y > 0, positive, 1.0)
    for _ in range(epochs):
        mixed = rng.permutation(len(texts))
        for lo in range(0, len(mixed), BATCH):
            pick = mixed[lo: lo + BATCH]
            feats = np.concatenate([texts[k] for k in pick])
            sizes = np.array([len(texts[k]) for k in pick])
            starts = np.cumsum(sizes) - sizes
            vec = net.emb[feats].sum(1)
            n = len(vec)
            best, value = [], []
            for f in net.filters:
                acc = vec @ f[0]
                for j in range(1, len(f)):
                    acc[: n - j] += vec[j:] @ f[j]
                acc = net._inside(acc, starts, n, len(f))
                top = np.maximum.reduceat(acc, starts, axis=0)
                hit = acc == np.repeat(top, sizes, axis=0)
                place = np.where(hit, np.arange(n)[:, None], n)
                best.append(np.minimum.reduceat(place, starts, axis=0))
                value.append(top)
            pre = np.concatenate(value, 1) + net.bias
            act = np.maximum(pre, 0)
            z = act @ net.out + dense[-1][0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            err = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g_out, g_b = act.T @ err, err.sum()
            g_act = err[:, None] * net.out * (pre > 0)
            g_filters, emb_at, emb_g = [], [], []
            for k, f in enumerate(net.filters):
                g = g_act[:, k * FILTERS: (k + 1) * FILTERS]
                gf = np.zeros_like(f)
                for j in range(len(f)):
                    at = best[k] + j
                    gf[j] = np.einsum("df,dfe->ef", g, vec[at])
                    emb_at.append(at.ravel())
                    emb_g.append((g[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                g_filters.append(gf)
            opt.step += 1
            grads = [*g_filters, g_act.sum(0), g_out, np.array([g_b], np.float32)]
            for q, (param, grad) in enumerate(zip(dense, grads)):
                opt.moment[q] = 0.9 * opt.moment[q] + 0.1 * grad
                opt.square[q] = 0.99 * opt.square[q] + 0.01 * grad**2
                param -= (RATE / 4 * (opt.moment[q] / (1 - 0.9**opt.step)) / (np.sqrt(opt.square[q] / (1 - 0.99**opt.step)) + 1e-7)).astype(np.float32)
            at, grad = np.concatenate(emb_at), np.concatenate(emb_g)
            live = np.abs(grad).max(1) > 0
            buckets = feats[at[live]].ravel()
            grad = np.repeat(grad[live], 3, axis=0)
            used, where = np.unique(buckets, return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, where, grad)
            opt.emb_sq[used] += (total**2).mean(1)
            net.emb[used] -= RATE * 2 * total / np.sqrt(opt.emb_sq[used])[:, None]
            net.emb[0] = 0
            net.out_bias = float(dense[-1][0])


def _round(texts: list[str], y: np.ndarray, opt: Progress, shard: int, positive: float, epochs: int, seed: list[int]) -> list[tuple]:
    """(part, shard, numbers, values) of what training on a shard has changed; part -1: all but the embeddings."""
    feats, ids, sizes = word_numbers(texts)
    before, squared = opt.net.emb.copy(), opt.emb_sq.copy()
    train(opt, [feats[i] for i in np.split(ids, np.cumsum(sizes)[:-1])], y, positive, epochs, np.random.default_rng(seed))
    out = [(-1, shard, b"", opt.flat().tobytes())]
    changed = np.flatnonzero(opt.emb_sq != squared)
    delta = np.concatenate([opt.net.emb - before, (opt.emb_sq - squared)[:, None]], 1)
    for part in np.unique(changed // PART).tolist():
        own = changed[changed // PART == part]
        out.append((part, shard, own.astype("<i4").tobytes(), delta[own].astype("<f4").tobytes()))
    return out


def _trainer(shared, positive: float, epochs: int, seed: list[int]):
    def run(pdf):
        import copy

        import pandas as pd

        pdf = pdf.sort_values(["h", "y", "text"])
        shard = int(pdf["shard"].iloc[0])
        opt = copy.deepcopy(shared.value)  # the worker's next shard starts from the same weights
        return pd.DataFrame(_round(pdf["text"].tolist(), pdf["y"].to_numpy(np.float64), opt, shard, positive, epochs, [*seed, shard]), columns=["part", "shard", "at", "value"])

    return run


def _averaged(pdf):
    """A part's changes averaged over the shards that have made one, in the order of the shards."""
    pdf = pdf.sort_values("shard")
    part = int(pdf["part"].iloc[0])
    if part < 0:
        pdf = pdf.iloc[:1].assign(value=[np.mean([np.frombuffer(v) for v in pdf["value"]], axis=0).tobytes()])
    else:
        total, n = np.zeros((PART, DIM + 1)), np.zeros(PART)
        for at, v in zip(pdf["at"], pdf["value"]):
            own = np.frombuffer(at, "<i4") - part * PART
            total[own] += np.frombuffer(v, "<f4").reshape(-1, DIM + 1)
            n[own] += 1
        some = np.flatnonzero(n)
        pdf = pdf.iloc[:1].assign(at=[(some + part * PART).astype("<i4").tobytes()], value=[(total[some] / n[some, None]).astype("<f4").tobytes()])
    return pdf[["part", "shard", "at", "value"]]


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, label: str) -> DataFrame:
    """(h, y, text, lang, held) of every labelled row; held: kept out of the training."""
    lab = labels.select(F.col(doc_id).alias("_id"), (F.col(label) > 0).cast("int").alias("y")).where("_id is not null and y is not null").distinct()
    if lab.limit(MOST_SENT + 1).count() <= MOST_SENT:  # so that only labelled texts are shuffled
        lab = F.broadcast(lab)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang")).join(lab, "_id")
    rows = rows.groupBy("_id", "y").agg(F.min(F.struct("text", "lang")).alias("r"))
    return rows.select(F.xxhash64("_id").alias("h"), "y", "r.text", "r.lang", (F.pmod(F.xxhash64("_id", F.lit("held")), F.lit(5)) == 0).alias("held"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
        seed: int = 11, precision: float = PRECISION, shard_rows: int = SHARD_ROWS) -> Net:
    """A net trained and calibrated on all labelled rows."""
    rows = materialise(labelled(docs, labels, doc_id, text, lang, label))
    told = {(r["held"], r["y"]): (r["n"], r["b"]) for r in rows.groupBy("held", "y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
    count = lambda y, *held: sum(told.get((h, y), (0, 0))[0] for h in held)
    n = [count(y, False, True) for y in (0, 1)]
    opt = Progress.fresh(seed)
    if not n[0] or not n[1]:
        drop(rows)
        opt.net.constant = float(n[1] > 0)
        return opt.net
    # where one part lacks a kind of rows, all rows serve for both
    apart = all(count(y, h) for y in (0, 1) for h in (False, True))
    fitted, held = (rows.where("not held"), rows.where("held")) if apart else (rows, rows)
    none, some = (count(y, False) for y in (0, 1)) if apart else n
    shards = max(1, -(-(none + some) // shard_rows), -(-sum(b for _, b in told.values()) // SHARD_BYTES))
    positive = min(20.0, none / max(1, some))
    rounds = ROUNDS if shards > 1 else 1
    epochs = -(-int(np.clip(SEEN / (none + some), *EPOCHS)) // rounds)
    dealt = fitted.select(F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "h", "y", "text")
    schema = "part int, shard int, at binary, value binary"
    for k in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(opt)

        run = _trainer(shared, positive, epochs, [seed, k])
        for r in dealt.groupBy("shard").applyInPandas(run, schema).groupBy("part").applyInPandas(_averaged, schema).collect():  # a net's size
            if r["part"] < 0:
                opt.set_flat(np.frombuffer(bytes(r["value"])))
            else:
                own, delta = np.frombuffer(bytes(r["at"]), "<i4"), np.frombuffer(bytes(r["value"]), "<f4").reshape(-1, DIM + 1)
                opt.net.emb[own] += delta[:, :DIM]
                opt.emb_sq[own] += delta[:, DIM]
        opt.net.emb[0] = 0
        shared.unpersist()
    _calibrate(opt.net, held, precision)
    drop(rows)
    return opt.net


def _calibrate(net: Net, held: DataFrame, precision: float) -> None:
    """Scale and thresholds of a net from all rows kept out."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in slices(batches):
            z = shared.value.raw(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.float64)), b.column(1), b.column(2)], names=["z", "y", "lang"])

    told = materialise(held.select("text", F.col("y").cast("int").alias("y"), "lang").mapInArrow(run, "z double, y int, lang string"))
    net.scale = _platt(told)
    a, b = net.scale
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * a + b))))
    cuts = np.linspace(0.35, 0.8, 46).tolist()
    each = told.select(score.alias("s"), "y", F.explode(F.array_distinct(F.array(F.lit(""), F.col("lang")))).alias("lang"))
    counts = [f(F.col("s") >= c).alias(f"{name}{k}") for k, c in enumerate(cuts) for name, f in (("n", F.count_if), ("p", lambda at: F.count_if(at & (F.col("y") > 0))))]
    for r in each.groupBy("lang").agg(F.sum("y").alias("pos"), *counts).collect():  # a row per language
        good = [c for k, c in enumerate(cuts) if r[f"n{k}"] and r[f"p{k}"] >= precision * r[f"n{k}"]]
        # the lowest cut that reaches the precision; 0.5 without positives
        net.thresholds[r["lang"]] = 0.5 if not r["pos"] else good[0] if good else 0.8
    drop(told)


def _platt(told: DataFrame) -> tuple[float, float]:
    """Slope (kept positive) and shift of the logistic fit of y on z, by damped Newton steps on sums over all rows."""
    a, b = 1.0, 0.0
    n, pos = told.agg(F.count("*"), F.sum("y")).first()
    t = F.when(F.col("y") > 0, F.lit((pos + 1) / (pos + 2))).otherwise(F.lit(1 / (n - pos + 2)))
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * a + b))))
        some = told.select("z", (p - t).alias("e"), F.greatest(p * (1 - p), F.lit(1e-9)).alias("w"))
        g1, g0, h11, h10, h00 = some.agg(F.sum(F.col("e") * F.col("z")), F.sum("e"), F.sum(F.col("w") * F.col("z") * F.col("z")), F.sum(F.col("w") * F.col("z")), F.sum("w")).first()
        step = np.linalg.solve(np.array([[h11 + 1e-3 + 1e-6, h10], [h10, h00 + 2e-6]]), np.array([g1 + 1e-3 * (a - 1), g0]))
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = max(1e-3, a - float(step[0])), b - float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def score(docs: DataFrame, net: Net, text: str = "text", lang: str = "lang", keep_text: bool = False) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (score >= 0.5) and rejected (score >= its language's threshold)."""
    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in made}
    kept = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index
            s = shared.value.score([t or "" for t in b.column(at(text)).to_pylist()])
            langs = b.column(at(lang)).to_pylist() if at(lang) >= 0 else [""] * len(s)
            cut = shared.value.thresholds
            rejected = [bool(x >= cut.get(g or "", cut.get("", 0.5))) for x, g in zip(s.tolist(), langs)]
            yield pa.RecordBatch.from_arrays(
                [b.column(at(c)) for c in kept] + [pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32)), pa.array(rejected, pa.bool_())],
                names=[*kept, *[f.name for f in made]])

    cols = dict.fromkeys([*kept, text, *([lang] if lang in docs.columns else [])])
    return docs.select(*cols).mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + made))
