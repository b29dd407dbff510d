"""Fitting models: products, junction-tree joins, and iterative proportional fitting.

Three planes give the same table.  Decomposable models are one chain of joins
on separators.  Models with loops whose states fit into memory (at most
``MAX_DENSE``) are fitted on a dense numpy array on the driver.  Larger ones run
as DataFrame sweeps over the states that all relations' margins allow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..algebra import Model, bits
from ..errors import ComputationError, ConvergenceError
from ..graph import JunctionForest, junction_forest
from ..schema import PROB_MIN, Schema
from .storage import drop, materialise
from .table import VALUE, domain, normalize, project

#: States of a dense table on the driver: 8 bytes each, a few copies.
MAX_DENSE = 1 << 22
#: A margin of at most so many states may be broadcast.
MAX_BROADCAST = 100_000
#: States that a DataFrame fit may enumerate unless told otherwise.
MAX_STATES = 1 << 28


@dataclass(frozen=True)
class IPFConfig:
    max_iterations: int = 1000
    tolerance: float = 1e-7
    raise_on_failure: bool = False


@dataclass(frozen=True)
class CalibrationConfig:
    """normalize: margins are divided by the table's sum; check: values that are no finite, non-negative numbers are an error."""

    normalize: bool = False
    check: bool = False


@dataclass
class FitInfo:
    """How a fit was made."""

    method: str
    iterations: int = 0
    error: float = 0.0
    converged: bool = True


# Decomposable models as joins ---------------------------------------------------

def fit_independence(p: DataFrame, schema: Schema) -> DataFrame:
    """Product of the single margins of a probability table."""
    return fit_forest(p, Model(schema, [1 << k for k in range(len(schema))]))


def fit_forest(p: DataFrame, model: Model, sparse_compat: bool = False) -> DataFrame:
    """Product of clique margins over separator margins, joined in tree order.

    ``sparse_compat``: a separator-and-clique state that was not observed counts as factor 1 instead of 0.
    """
    schema, forest = model.schema, junction_forest(model.relations)
    out, have = None, 0
    for k in forest.pre_order():
        clique, sep = forest.cliques[k], forest.separators[k]
        m = project(p, schema, clique)
        if sep:
            own = project(p, schema, sep).withColumnRenamed(VALUE, "_s")
            m = m.join(own, schema.names(sep)).select(*schema.names(clique), (F.col(VALUE) / F.col("_s")).alias("_f"))
        else:
            m = m.withColumnRenamed(VALUE, "_f")
        if out is None:
            out = m.withColumnRenamed("_f", VALUE)
        elif sep and sparse_compat:
            grid = out
            for j in bits(clique & ~have):
                v = schema[j]
                grid = grid.crossJoin(p.sparkSession.range(v.cardinality).select(F.col("id").cast("int").alias(v.abbrev)))
            out = grid.join(m, schema.names(clique), "left").withColumn(VALUE, F.col(VALUE) * F.coalesce("_f", F.lit(1.0))).drop("_f")
        else:
            out = (out.join(m, schema.names(sep)) if sep else out.crossJoin(m)).withColumn(VALUE, F.col(VALUE) * F.col("_f")).drop("_f")
        have |= clique
    return out.where(F.col(VALUE) > PROB_MIN).select(*schema.names(have), VALUE)


def multiply(a: DataFrame, b: DataFrame, missing_is_one: bool = False) -> DataFrame:
    """Product of two potentials on their common variables (all pairs if there are none)."""
    shared = [c for c in a.columns if c in b.columns and c != VALUE]
    b = b.withColumnRenamed(VALUE, "_b")
    joined = a.join(b, shared, "left" if missing_is_one else "inner") if shared else a.crossJoin(b)
    factor = F.coalesce("_b", F.lit(1.0)) if missing_is_one else F.col("_b")
    return joined.withColumn(VALUE, F.col(VALUE) * factor).drop("_b")


def divide(a: DataFrame, b: DataFrame, least: float = 1e-15) -> DataFrame:
    """Quotient of two potentials; 0 where the divisor is (nearly) 0, unchanged where it is missing."""
    shared = [c for c in b.columns if c != VALUE]
    joined = a.join(b.withColumnRenamed(VALUE, "_b"), shared, "left")
    q = F.when(F.col("_b").isNull(), F.col(VALUE)).when(F.col("_b") > least, F.col(VALUE) / F.col("_b")).otherwise(F.lit(0.0))
    return joined.withColumn(VALUE, q).drop("_b")


@dataclass
class Calibrated:
    """A calibrated junction forest: every clique's and separator's margin of the fitted distribution."""

    schema: Schema
    forest: JunctionForest
    cliques: list[DataFrame]
    separators: dict[int, DataFrame]
    joint: DataFrame

    def marginal(self, mask: int) -> DataFrame:
        """Margin from the smallest clique that covers the variables, else from the joint table."""
        covering = [k for k, c in enumerate(self.forest.cliques) if mask & ~c == 0]
        source = self.cliques[min(covering, key=lambda k: self.schema.cells(self.forest.cliques[k]))] if covering else self.joint
        return project(source, self.schema, mask)


def calibrate(p: DataFrame, model: Model, config: CalibrationConfig = CalibrationConfig()) -> Calibrated:
    """Margins of the data agree between cliques already, so nothing is passed; ``inference.calibrate`` takes any potentials."""
    if config.check and p.where(F.isnan(VALUE) | (F.col(VALUE) < 0) | (F.col(VALUE) == float("inf")) | F.isnull(VALUE)).limit(1).count():
        raise ComputationError("the table holds values that are no finite, non-negative numbers")
    if config.normalize:
        p = normalize(p)
    schema, forest = model.schema, junction_forest(model.relations)
    return Calibrated(schema, forest, [project(p, schema, c) for c in forest.cliques],
                      {k: project(p, schema, s) for k, s in enumerate(forest.separators) if s}, fit_forest(p, model))


# Iterative proportional fitting -------------------------------------------------

def dense_ipf(p: np.ndarray, relations, config: IPFConfig = IPFConfig(), on_sweep=None) -> tuple[np.ndarray, FitInfo]:
    """Fit on a dense array whose axes are the variables; variables in no relation end up uniform.

    on_sweep: called with the number of each sweep and its error; what it raises ends the fit.
    """
    axes = [tuple(k for k in range(p.ndim) if not r >> k & 1) for r in relations]
    margins = [p.sum(axis=a, keepdims=True) for a in axes]
    q = np.full(p.shape, p.sum() / p.size)
    info = FitInfo("ipf", converged=False)
    before = np.inf
    for info.iterations in range(1, config.max_iterations + 1):
        for a, m in zip(axes, margins):
            have = q.sum(axis=a, keepdims=True)
            q = q * np.divide(m, have, out=np.zeros_like(m), where=have > 0)
        info.error = max(float(np.abs(q.sum(axis=a, keepdims=True) - m).max()) for a, m in zip(axes, margins))
        if on_sweep:
            on_sweep(info.iterations, info.error)
        if info.error < config.tolerance or abs(before - info.error) < config.tolerance * 0.1:
            info.converged = True
            break
        before = info.error
    if not info.converged and config.raise_on_failure:
        raise ConvergenceError("the fit did not converge", info.iterations, info.error)
    return q, info


def start_table(p: DataFrame, model: Model, max_states: int = MAX_STATES) -> DataFrame:
    """States that every relation's margin allows, of equal probability; variables in no relation run over all codes."""
    schema = model.schema
    if schema.cells() > max_states:
        raise ComputationError(f"{schema.cells()} states are more than the limit of {max_states}")
    out = domain(p.sparkSession, schema).drop("state")
    for r in model.relations:
        out = out.join(project(p, schema, r).where(F.col(VALUE) > 0).select(*schema.names(r)), schema.names(r), "left_semi")
    return out.withColumn(VALUE, F.lit(1.0 / schema.cells()))


def scale_by_margin(q: DataFrame, margin: DataFrame, names: list[str], small: bool = False) -> DataFrame:
    """One IPF step: q scaled so that its margin over ``names`` is the given one.  ``small``: the margin has few enough states to be broadcast."""
    have = q.groupBy(*names).agg(F.sum(VALUE).alias("_have"))
    factor = have.join(margin.withColumnRenamed(VALUE, "_want"), names, "left").select(
        *names, F.when(F.col("_have") > 0, F.coalesce("_want", F.lit(0.0)) / F.col("_have")).otherwise(F.lit(0.0)).alias("_f"))
    return q.join(F.broadcast(factor) if small else factor, names).withColumn(VALUE, F.col(VALUE) * F.col("_f")).drop("_f")


def _scale_in_window(q: DataFrame, margin: DataFrame, names: list[str]) -> DataFrame:
    """``scale_by_margin`` in a window: it reads q once, so steps follow each other in one plan, but shuffles all of it."""
    own = q.withColumn("_have", F.sum(VALUE).over(W.partitionBy(*names))).join(F.broadcast(margin.withColumnRenamed(VALUE, "_want")), names, "left")
    factor = F.when(F.col("_have") > 0, F.coalesce("_want", F.lit(0.0)) / F.col("_have")).otherwise(F.lit(0.0))
    return own.select(*[c for c in q.columns if c != VALUE], (F.col(VALUE) * factor).alias(VALUE))


def _sweep(q: DataFrame, margins, schema: Schema) -> DataFrame:
    """One step per margin; ``q`` is given up.

    A table of few states takes all steps in one plan and is written once.  A larger one is not shuffled where a margin's
    factors can be broadcast, but read twice a step, and so written after each.
    """
    if schema.cells() <= MAX_BROADCAST:
        new = q
        for names, m in margins:
            new = _scale_in_window(new, m, names)
        new = materialise(new.coalesce(1))
        drop(q)
        return new
    for names, m in margins:
        new = materialise(scale_by_margin(q, m, names, schema.cells(sum(1 << schema.columns.index(c) for c in names)) <= MAX_BROADCAST))
        drop(q)
        q = new
    return q


def frame_ipf(p: DataFrame, model: Model, config: IPFConfig = IPFConfig(), max_states: int = MAX_STATES) -> tuple[DataFrame, FitInfo]:
    """IPF as DataFrame sweeps; each sweep is written to the shared folder, so plans stay short and survive lost executors."""
    schema, p = model.schema, materialise(p)  # its source is read once
    q = start_table(p, model, max_states)
    margins = [(schema.names(r), materialise(project(p, schema, r))) for r in model.relations]
    info, before = FitInfo("ipf", converged=False), float("inf")
    for info.iterations in range(1, config.max_iterations + 1):
        q = _sweep(q, margins, schema)
        info.error = margin_error(q, margins)
        if info.error < config.tolerance or abs(before - info.error) < config.tolerance * 0.1:
            info.converged = True
            break
        before = info.error
    drop(p, *[m for _, m in margins])
    if not info.converged and config.raise_on_failure:
        raise ConvergenceError("the fit did not converge", info.iterations, info.error)
    return q.where(F.col(VALUE) > PROB_MIN), info


def margin_error(q: DataFrame, margins) -> float:
    """Largest difference between q's margins and the given ones."""
    gaps = None
    for names, m in margins:
        g = q.groupBy(*names).agg(F.sum(VALUE).alias("_q")).join(m, names, "full").select(
            F.abs(F.coalesce("_q", F.lit(0.0)) - F.coalesce(VALUE, F.lit(0.0))).alias("gap"))
        gaps = g if gaps is None else gaps.union(g)
    return float(gaps.agg(F.max("gap").alias("m")).first()["m"] or 0.0)


def fixed_sweeps(p: DataFrame, model: Model, sweeps: int) -> DataFrame:
    """A fixed number of IPF sweeps as DataFrames."""
    schema, p = model.schema, materialise(p)  # its source is read once
    q = start_table(p, model)
    margins = [(schema.names(r), materialise(project(p, schema, r))) for r in model.relations]
    for _ in range(sweeps):
        q = _sweep(q, margins, schema)
    if sweeps > 0:  # else the start is still to be read from them
        drop(p, *[m for _, m in margins])
    return q.select(*schema.columns, VALUE)
