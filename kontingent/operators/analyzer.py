"""The analyzer of one data set: entropies, model statistics, fits.

Entropies of margins are the only data a decomposable model needs.  They are
cached by variable mask; many are computed together, each margin from the smallest at hand (``rollup``),
or, where the data set has at most ``LOCAL_STATES`` observed states, in numpy on
the driver (the size is counted before anything is brought over).
"""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import algebra
from ..algebra import Model, bits, size
from ..errors import ComputationError, ValidationError
from ..functions import special
from ..graph import junction_forest
from ..progress import Event
from ..schema import PROB_MIN, Schema
from . import fit as fitting
from . import inference, rollup
from . import table as tables
from .table import VALUE

#: Data sets with at most so many observed states may be evaluated on the driver.
LOCAL_STATES = 200_000
#: Tables of at most so many possible states are fetched without counting them first, and kept as a table of their own.
SMALL = 10_000


#: Models with loops from which on they are fitted side by side on the executors.
TOGETHER = 4


def dense_entropy(q: np.ndarray) -> float:
    """Entropy in bits of a dense table of probabilities."""
    q = q[q > PROB_MIN]
    return float(-(q * np.log2(q)).sum())


@dataclass(frozen=True)
class Compat:
    """How inexact conventions are resolved; the defaults are exact.

    entropy_mode: "junction_tree", or "pairwise" (all pairwise overlaps subtracted).
    df_mode: "exact" or "pairwise".  sparse: unobserved factors count as 1 in products.
    """

    entropy_mode: str = "junction_tree"
    df_mode: str = "exact"
    sparse: bool = False

    @classmethod
    def reference(cls) -> "Compat":
        """Conventions of the published tool."""
        return cls("pairwise", "pairwise", True)


@dataclass(frozen=True)
class FitResult:
    model: str
    h: float
    t: float
    df: int
    ddf: int
    lr: float
    p2: float
    alpha: float
    beta: float
    aic: float
    bic: float
    cond_h: float
    cond_dh: float
    percent_dh: float
    coverage: float
    has_loops: bool
    method: str


@dataclass
class CacheStats:
    hits: int = 0
    misses: int = 0

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


@dataclass
class Profile:
    """Operations by name: how often, and how many seconds."""

    enabled: bool = False
    counts: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)

    def record(self, name: str, took: float) -> None:
        if self.enabled:
            self.counts[name] = self.counts.get(name, 0) + 1
            self.seconds[name] = self.seconds.get(name, 0.0) + took

    def to_dict(self) -> dict:
        return {n: {"count": self.counts[n], "seconds": self.seconds[n]} for n in sorted(self.counts)}


class Analyzer:
    """Statistics of models over a contingency table (see ``operators.table``)."""

    def __init__(self, t: DataFrame, schema: Schema, compat: Compat = Compat(), local_states: int = LOCAL_STATES):
        self.schema = schema.require_valid()
        self.table = t.select(*schema.columns, VALUE)
        self.spark: SparkSession = t.sparkSession
        self.compat, self.local_states = compat, local_states
        self._h: dict[int, float] = {0: 0.0}
        self.cache, self.profile = CacheStats(), Profile()
        #: Gets events of batches and fits; what it raises ends the work.
        self.tell = lambda event: None
        self._fits: dict[tuple[int, ...], tuple[float, str]] = {}

    @classmethod
    def of_rows(cls, raw: DataFrame, schema: Schema, **how) -> "Analyzer":
        """From raw label rows: encoded and aggregated."""
        return cls(tables.encode(raw, schema), schema, **how)

    # the data -----------------------------------------------------------------

    def release(self) -> None:
        """Let go of the cached table; statistics computed so far stay."""
        self.table.unpersist()

    def __enter__(self) -> "Analyzer":
        return self

    def __exit__(self, *_) -> None:
        self.release()

    @cached_property
    def summary(self) -> tuple[float, int]:
        """Sum of counts and number of observed states, of the aggregated table.

        A table that cannot have more than ``SMALL`` states is fetched in one job and takes the source's place for the jobs
        to come; a larger one is cached.
        """
        cells = self.schema.cells()
        if cells <= min(self.local_states, SMALL):
            p = self.table.where(F.col(VALUE) > 0).limit(cells + 1).toPandas()
            if len(p) <= cells:  # more rows: states are listed twice
                if not len(p):
                    raise ValidationError("the data set has no counts")
                codes, counts = p[self.schema.columns].to_numpy(np.int64), p[VALUE].to_numpy(np.float64)
                self.__dict__["local"] = codes, counts
                rows = [(*c, v) for c, v in zip(codes.tolist(), counts.tolist())]
                self.table = self.spark.createDataFrame(rows, ", ".join(f"{c} int" for c in self.schema.columns) + f", {VALUE} double")
                return float(counts.sum()), len(p)
        self.table = self.table.cache()
        row = self.table.where(F.col(VALUE) > 0).agg(F.sum(VALUE).alias("n"), F.count("*").alias("s")).first()
        n = float(row["n"] or 0.0)
        if n <= 0:
            raise ValidationError("the data set has no counts")
        return n, int(row["s"])

    @property
    def n(self) -> float:
        return self.summary[0]

    @property
    def states(self) -> int:
        return self.summary[1]

    @property
    def is_local(self) -> bool:
        return self.states <= self.local_states

    @cached_property
    def local(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, counts) on the driver, only for tables within the bound."""
        if not self.is_local:
            raise ComputationError("the table is too large for the driver")
        p = self.table.where(F.col(VALUE) > 0).toPandas()
        return p[self.schema.columns].to_numpy(np.int64), p[VALUE].to_numpy(np.float64)

    @cached_property
    def probabilities(self) -> DataFrame:
        return tables.normalize(self.table, self.n)

    def dense(self) -> np.ndarray:
        """Probabilities as an array with one axis per variable, for small state spaces."""
        if self.schema.cells() > fitting.MAX_DENSE:
            raise ComputationError(f"{self.schema.cells()} states are more than {fitting.MAX_DENSE}")
        out = np.zeros([v.cardinality for v in self.schema])
        codes, counts = self.local
        np.add.at(out, tuple(codes.T), counts / self.n)
        return out

    # entropies ----------------------------------------------------------------

    def entropies(self, masks) -> dict[int, float]:
        """Entropy of each margin; the unknown ones are computed together."""
        masks = list(dict.fromkeys(masks))
        new = [m for m in masks if m not in self._h]
        self.cache.hits += len(masks) - len(new)
        self.cache.misses += len(new)
        if new:
            began = time.perf_counter()
            if self.is_local:
                for m in new:
                    self._h[m] = self._local_entropy(m)
            else:
                margins = rollup.Rollup(self.table, self.schema, new, self.states)
                self._h |= {r["mask"]: r["entropy"] for r in margins.entropies().collect()}  # one number per margin
                margins.release()
            self.profile.record("entropies", time.perf_counter() - began)
            self.tell(Event("model_batch", {"margins": len(new), "known": len(self._h)}))
        return {m: self._h[m] for m in masks}

    def _local_entropy(self, mask: int) -> float:
        codes, counts = self.local
        key = np.zeros(len(counts), np.int64)
        for k in bits(mask):
            key = key * self.schema[k].cardinality + codes[:, k]
        cells = self.schema.cells(mask)
        if cells <= 4 * len(counts) + 1024:
            c = np.bincount(key, counts, cells)
        else:
            c = np.bincount(np.unique(key, return_inverse=True)[1], counts)
        c = c[c > 0]
        return float(math.log2(self.n) - (c * np.log2(c)).sum() / self.n)

    def entropy(self, mask: int) -> float:
        return self.entropies([mask])[mask]

    def mutual_information(self, i: int, j: int) -> float:
        a, b = 1 << i, 1 << j
        h = self.entropies([a, b, a | b])
        return max(0.0, h[a] + h[b] - h[a | b])

    def all_mutual_information(self) -> list[tuple[int, int, float]]:
        """(i, j, bits) of all pairs, largest first, ties by place."""
        k = len(self.schema)
        self.entropies([1 << i for i in range(k)] + [1 << i | 1 << j for i, j in combinations(range(k), 2)])
        return sorted(((i, j, self.mutual_information(i, j)) for i, j in combinations(range(k), 2)), key=lambda e: (-e[2], e[0], e[1]))

    # models -------------------------------------------------------------------

    def model(self, m: Model | str) -> Model:
        return algebra.parse_model(self.schema, m) if isinstance(m, str) else m

    def needed_masks(self, m: Model) -> list[int]:
        """Margins whose entropies give the model's entropy; none for models with loops."""
        if m.has_loops:
            return []
        if self.compat.entropy_mode == "pairwise":
            return [*m.relations, *(a & b for a, b in combinations(m.relations, 2) if a & b)]
        forest = junction_forest(m.relations)
        return [*forest.cliques, *(s for s in forest.separators if s)]

    def prefetch(self, models) -> None:
        """Margins of all these models in as few jobs as there are batches, and the fits of those with loops in one job."""
        self.entropies([x for m in models for x in self.needed_masks(m)] + [self.schema.full])
        self._fit_loops([m for m in dict.fromkeys(models) if m.has_loops and m.relations not in self._fits])

    def _fit_loops(self, models: list[Model]) -> None:
        """Fits of models with loops side by side on the executors, over the broadcast dense table (at most MAX_DENSE states);
        fewer than ``TOGETHER`` models, and larger tables, are fitted one by one when they are asked for."""
        if len(models) < TOGETHER or not self.is_local or self.schema.cells() > fitting.MAX_DENSE:
            return
        began = time.perf_counter()
        shared = self.spark.sparkContext.broadcast(self.dense())

        def run(batches):
            for b in batches:
                b["h"] = [dense_entropy(fitting.dense_ipf(shared.value, list(r))[0]) for r in b["relations"]]
                yield b[["place", "h"]]

        rows = self.spark.createDataFrame([(k, list(m.relations)) for k, m in enumerate(models)], "place int, relations array<long>")
        for r in rows.repartition(len(models), "place").mapInPandas(run, "place int, h double").collect():  # one number per model
            self._fits[models[r["place"]].relations] = r["h"], "ipf"
        shared.unpersist()
        self.profile.record("ipf", time.perf_counter() - began)
        self.tell(Event("ipf", {"models": len(models), "seconds": time.perf_counter() - began}))

    def h(self, m: Model | str) -> float:
        """Entropy of the fitted model, in bits."""
        m = self.model(m)
        own = self._fits.get(m.relations)
        if own:
            return own[0]
        if m.has_loops:
            h, method = self._loop_entropy(m)
        else:
            masks = self.needed_masks(m)
            e = self.entropies(masks)
            k = len(m.relations)
            h = sum(e[x] for x in masks[:k]) - sum(e[x] for x in masks[k:])
            h += tables.max_entropy(self.schema, m.uncovered)
            method = "saturated" if m.is_saturated else "independence" if m.is_independence else "decomposable"
        self._fits[m.relations] = h, method
        return h

    def _loop_entropy(self, m: Model) -> tuple[float, str]:
        began = time.perf_counter()
        sweep = lambda k, error: self.tell(Event("ipf_sweep", {"model": m.name, "iteration": k, "error": error}))
        if self.is_local and self.schema.cells() <= fitting.MAX_DENSE:
            q, info = fitting.dense_ipf(self.dense(), m.relations, on_sweep=sweep)
            h, how = dense_entropy(q), "ipf"
        else:
            fitted = inference.fit_cliques(self.probabilities, m, on_sweep=sweep)
            h, how, info = fitted.entropy(), "clique_ipf", fitted.info
            fitted.release()
        self.profile.record("ipf", time.perf_counter() - began)
        self.tell(Event("ipf", {"model": m.name, "iterations": info.iterations, "error": info.error, "converged": info.converged, "seconds": time.perf_counter() - began}))
        return h, how

    def df(self, m: Model | str) -> int:
        return algebra.model_df(self.model(m), self.compat.df_mode == "pairwise")

    def ddf(self, m: Model | str) -> int:
        return self.schema.cells() - 1 - self.df(m)

    def t(self, m: Model | str) -> float:
        """Entropy of the data less that of the model (never positive for a fitted model)."""
        return self.entropy(self.schema.full) - self.h(m)

    def lr(self, m: Model | str) -> float:
        return special.likelihood_ratio(self.n, self.h(m), self.entropy(self.schema.full))

    def aic(self, m: Model | str) -> float:
        return special.aic(self.lr(m), self.df(m))

    def bic(self, m: Model | str) -> float:
        return special.bic(self.lr(m), self.ddf(m), self.n)

    def cond_h(self, m: Model | str) -> float:
        """H(model) less that of the independent variables; 0 for a neutral system."""
        return self.h(m) - self.entropy(self.schema.independent) if self.schema.is_directed else 0.0

    def cond_dh(self, m: Model | str) -> float:
        return self.entropy(self.schema.dependent) - self.cond_h(m) if self.schema.is_directed else 0.0

    def coverage(self) -> float:
        return self.states / self.schema.cells()

    def incremental_alpha(self, m: Model | str, before: Model | str) -> float:
        """p-value of the step between two models."""
        gap = abs(self.df(m) - self.df(before))
        return special.chi2_sf(abs(self.lr(m) - self.lr(before)), gap) if gap else 1.0

    def statistic(self, m: Model, name: str) -> float:
        return float({"aic": self.aic, "bic": self.bic, "h": self.h, "lr": self.lr, "df": self.df, "ddf": self.ddf}[name](m))

    def evaluate(self, models, names=("h", "lr", "df", "ddf", "aic", "bic")) -> list[dict]:
        """The statistics of many models; margins are fetched together."""
        models = [self.model(m) for m in models]
        self.prefetch(models)
        return [{"model": m.name, "level": m.level, "has_loops": m.has_loops} | {k: self.statistic(m, k) for k in names} for m in models]

    def evaluate_frame(self, models, names=("h", "lr", "df", "ddf", "aic", "bic")) -> DataFrame:
        schema = "model string, level int, has_loops boolean, " + ", ".join(f"{k} double" for k in names)
        rows = [tuple(r.values()) for r in self.evaluate(models, names)]
        return self.spark.createDataFrame(rows, schema)

    # relations ----------------------------------------------------------------

    def relation_metrics(self, mask: int) -> dict:
        """h, t, df, lr and p2 of one margin against the product of its single margins, over its observed cells."""
        h = self.entropies([mask, *(1 << k for k in bits(mask))])
        t = sum(h[1 << k] for k in bits(mask)) - h[mask]
        names = self.schema.names(mask)
        own = tables.project(self.probabilities, self.schema, mask)
        for k in bits(mask):
            c = self.schema[k].abbrev
            single = tables.project(self.probabilities, self.schema, 1 << k)
            own = own.join(F.broadcast(single.withColumnRenamed(VALUE, f"_{c}")), c)
        e = F.lit(1.0)
        for c in names:
            e = e * F.col(f"_{c}")
        p2 = own.agg(F.sum((F.col(VALUE) - e) ** 2 / e).alias("p2")).first()["p2"] if size(mask) > 1 else 0.0
        df = self.schema.cells(mask) - 1 - sum(self.schema[k].cardinality - 1 for k in bits(mask)) if size(mask) > 1 else self.schema.cells(mask) - 1
        return {"relation": "".join(names), "h": h[mask], "t": t, "df": df, "lr": 2 * self.n * special.LN2 * t, "p2": self.n * (p2 or 0.0)}

    def model_relation_metrics(self, m: Model | str) -> list[dict]:
        return [self.relation_metrics(r) for r in self.model(m).relations]

    # fits ---------------------------------------------------------------------

    def fit_table(self, m: Model | str) -> DataFrame:
        """Fitted probabilities of every state with any."""
        m = self.model(m).completed()
        if m.is_saturated:
            return self.probabilities.where(F.col(VALUE) > PROB_MIN)
        if not m.has_loops:
            if self.schema.cells() > fitting.MAX_STATES and sum(not sep for sep in junction_forest(m.relations).separators) > 1:
                raise ComputationError(f"a product over {self.schema.cells()} states is beyond the limit")
            return fitting.fit_forest(self.probabilities, m, self.compat.sparse)
        if self.is_local and self.schema.cells() <= fitting.MAX_DENSE:
            q, _ = fitting.dense_ipf(self.dense(), m.relations)
            at = np.argwhere(q > PROB_MIN)
            rows = [(*map(int, c), float(q[tuple(c)])) for c in at]
            return self.spark.createDataFrame(rows, ", ".join(f"{c} int" for c in self.schema.columns) + f", {VALUE} double")
        return inference.fit_cliques(self.probabilities, m).joint()

    def residuals(self, m: Model | str) -> DataFrame:
        return tables.residuals(self.probabilities, self.fit_table(m), self.schema)

    def pearson(self, m: Model | str) -> float:
        return float(tables.pearson(self.probabilities, self.fit_table(m), self.schema, self.n).first()["p2"])

    def fit(self, m: Model | str, pearson: bool = True) -> FitResult:
        m = self.model(m)
        lr, df, ddf = self.lr(m), self.df(m), self.ddf(m)
        cond_dh = self.cond_dh(m)
        h_dv = self.entropy(self.schema.dependent) if self.schema.is_directed else 0.0
        return FitResult(
            model=m.name, h=self.h(m), t=self.t(m), df=df, ddf=ddf, lr=lr, p2=self.pearson(m) if pearson else float("nan"),
            alpha=special.chi2_sf(lr, ddf), beta=special.power(ddf, lr), aic=self.aic(m), bic=self.bic(m), cond_h=self.cond_h(m), cond_dh=cond_dh,
            percent_dh=100 * cond_dh / h_dv if h_dv > 0 else 0.0, coverage=self.coverage(), has_loops=m.has_loops, method=self._fits[m.relations][1])

    def fit_frame(self, m: Model | str, pearson: bool = True) -> DataFrame:
        """The statistics of one model as one row."""
        r = asdict(self.fit(m, pearson))
        kinds = {"model": "string", "df": "long", "ddf": "long", "has_loops": "boolean", "method": "string"}
        return self.spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in r))
