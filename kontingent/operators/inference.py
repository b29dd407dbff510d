"""Inference on clique trees: messages, evidence, margins by elimination, and fits with loops on clique tables.

A distribution is held as the tables of a junction forest's cliques; the joint table is never made.  What is summed or
multiplied is a DataFrame over the variables of one clique or, in ``eliminate``, over the neighbours of one variable, so
cost follows the largest such table and not the product of all cardinalities.

* ``calibrate``: any potentials are multiplied into cliques; messages are collected to the root and distributed again.
* ``CliqueTree.given``: evidence, codes or weights, by the same two passes.
* ``CliqueTree.marginal``: any margin, by elimination along the smallest subtree that holds its variables.
* ``fit_cliques``: proportional fitting.  The relations are triangulated; separators that lie inside a relation cut the
  tree into blocks, each fitted alone; a block of one relation is that relation's margin.  In the others a walk along the
  tree scales every clique table by the margins of its relations and passes on what changed.

Each step's table is written to the shared folder, so plans stay short and survive lost executors.  Values that are no
finite, non-negative numbers raise ``ComputationError`` in the step that meets them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..algebra import Model, bits, is_subset, size
from ..errors import ComputationError, ConvergenceError
from ..graph import JunctionForest, blocks, clique_tree, elimination_order, junction_forest
from ..schema import PROB_MIN, Schema
from . import fit as fitting
from . import table as tables
from .storage import drop, materialise
from .table import VALUE, project

_UNSOUND = "no finite, non-negative number"
#: Factors over separate variables are multiplied state by state up to this many states.
MAX_PRODUCT = fitting.MAX_STATES


# Factors -----------------------------------------------------------------------------

def sound(c: Column) -> Column:
    """The value, or an error where it is null, NaN, infinite or negative."""
    bad = c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf"))
    return F.when(bad, F.raise_error(F.lit(_UNSOUND)).cast("double")).otherwise(c)


def store(df: DataFrame) -> DataFrame:
    """``materialise`` with a check of the values."""
    try:
        return materialise(df.withColumn(VALUE, sound(F.col(VALUE))))
    except PySparkException as e:
        if _UNSOUND in str(e):
            raise ComputationError(f"a table holds a value that is {_UNSOUND}") from e
        raise


def _with_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """A view of a stored table that ``drop`` deletes like the table."""
    new._stored_at = getattr(old, "_stored_at", None)
    return new


def scope(df: DataFrame, schema: Schema) -> int:
    """Mask of the variables that a factor has columns of."""
    return sum(1 << k for k, v in enumerate(schema) if v.abbrev in df.columns)


def product(factors: list[DataFrame], schema: Schema) -> DataFrame:
    """All factors multiplied: joined on their common variables, small scopes first, one connected to those before if there is any."""
    if not factors:
        raise ComputationError("a product needs a factor")
    left = sorted(factors, key=lambda f: (schema.cells(scope(f, schema)), scope(f, schema)))
    out = left.pop(0)
    have = scope(out, schema)
    while left:
        k = next((k for k, f in enumerate(left) if scope(f, schema) & have or not scope(f, schema)), 0)
        f = left.pop(k)
        more = scope(f, schema)
        if more and not more & have and schema.cells(have | more) > MAX_PRODUCT:
            raise ComputationError(f"a product over {schema.cells(have | more)} states is beyond the limit of {MAX_PRODUCT}")
        out, have = fitting.multiply(out, f), have | more
    return out.select(*schema.names(have), VALUE)


def eliminate(factors: list[DataFrame], schema: Schema, keep: int) -> DataFrame:
    """Product of the factors summed over all variables that are not kept, one variable at a time.

    Only factors that hold a variable are multiplied when it is summed out, in ``graph.elimination_order``.
    """
    pool = list(factors)
    for v in elimination_order([scope(f, schema) for f in pool], schema.cells, keep):
        own = [f for f in pool if scope(f, schema) >> v & 1]
        pool = [f for f in pool if not scope(f, schema) >> v & 1]
        joined = product(own, schema)
        pool.append(project(joined, schema, scope(joined, schema) & ~(1 << v)))
    return product(pool, schema)


def widest(scopes, schema: Schema, keep: int) -> int:
    """Variables of the largest product that ``eliminate`` makes of factors with these scopes."""
    pool, most = list(scopes), max(map(size, scopes), default=0)
    for v in elimination_order(pool, schema.cells, keep):
        union = 0
        for s in pool:
            union |= s if s >> v & 1 else 0
        most = max(most, size(union))
        pool = [s for s in pool if not s >> v & 1] + [union & ~(1 << v)]
    return most


# Trees -------------------------------------------------------------------------------

@dataclass
class CliqueTree:
    """Calibrated clique tables: neighbours agree on their separators.

    mass: what the potentials summed to before the tables were divided by it (the probability of the evidence, if the
    potentials were a distribution).  info: how the tables were fitted.
    """

    schema: Schema
    forest: JunctionForest
    tables: list[DataFrame]
    mass: float = 1.0
    info: fitting.FitInfo = field(default_factory=lambda: fitting.FitInfo("messages"))

    def separator(self, k: int) -> DataFrame:
        """Margin of a clique's separator from its parent."""
        return project(self.tables[k], self.schema, self.forest.separators[k] & scope(self.tables[k], self.schema))

    def conditionals(self, cliques=None, root: int | None = None) -> list[DataFrame]:
        """Factors whose product is the joint table: every clique's table, divided by its separator below a root.

        cliques: a subtree (a set that hangs together); root: the one that is not divided.
        """
        own = set(range(len(self.tables))) if cliques is None else set(cliques)
        out, seen = [], set()
        for first in ([root] if root is not None else []) + [k for k in self.forest.pre_order() if k in own]:
            stack = [] if first in seen else [(first, 0)]
            while stack:
                k, sep = stack.pop()
                if k in seen:
                    continue
                seen.add(k)
                t = self.tables[k]
                sep &= scope(t, self.schema)
                out.append(fitting.divide(t, project(t, self.schema, sep), PROB_MIN) if sep else t)
                stack += [(j, s) for j, s in self._near(k) if j in own and j not in seen]
        return out

    def _near(self, k: int) -> list[tuple[int, int]]:
        """(clique, separator) of the neighbours in the tree."""
        out = [(j, self.forest.separators[j]) for j in self.forest.children(k)]
        return out + ([(self.forest.parent[k], self.forest.separators[k])] if self.forest.parent[k] >= 0 and self.forest.separators[k] else [])

    def subtree(self, mask: int) -> list[int]:
        """The smallest subtrees that hold the variables: leaves that add none of them are cut off, again and again."""
        own = set(range(len(self.tables)))
        while True:
            for k in sorted(own, key=lambda k: -self.schema.cells(self.forest.cliques[k])):
                near = [(j, s) for j, s in self._near(k) if j in own]
                if len(near) <= 1 and len(own) > 1 and is_subset(self.forest.cliques[k] & mask, near[0][1] if near else 0):
                    own.discard(k)
                    break
            else:
                return sorted(own)

    def marginal(self, mask: int) -> DataFrame:
        """Any margin: from the smallest clique that covers it, else by elimination along the smallest subtree."""
        if mask & ~self.schema.full or not mask:
            raise ComputationError("a margin needs variables of the schema")
        covering = [k for k, t in enumerate(self.tables) if is_subset(mask, scope(t, self.schema))]
        if covering:
            return project(self.tables[min(covering, key=lambda k: self.schema.cells(self.forest.cliques[k]))], self.schema, mask)
        return eliminate(self.conditionals(self.subtree(mask)), self.schema, mask)

    def joint(self) -> DataFrame:
        """The table over all variables: only for those who want every state."""
        return product(self.conditionals(), self.schema).where(F.col(VALUE) > PROB_MIN)

    def entropy(self) -> float:
        """Bits: entropies of the cliques less those of the separators, in one job."""
        parts = [(1.0, t) for t in self.tables] + [(-1.0, self.separator(k)) for k, s in enumerate(self.forest.separators) if s & scope(self.tables[k], self.schema)]
        rows = None
        for sign, t in parts:
            r = t.where(F.col(VALUE) > PROB_MIN).agg(F.sum(-F.col(VALUE) * F.log2(VALUE)).alias("h")).select((F.lit(sign) * F.coalesce("h", F.lit(0.0))).alias("h"))
            rows = r if rows is None else rows.union(r)
        return float(rows.agg(F.sum("h").alias("h")).first()["h"])

    def given(self, weights: list[DataFrame] | None = None, **codes: int) -> "CliqueTree":
        """The distribution given evidence: ``codes`` by abbreviation, and ``weights``, tables over variables of one clique
        by which states are multiplied.  Variables with a code keep their column.  ``mass`` is the evidence's probability."""
        at = {}
        for name, code in codes.items():
            k = self.schema.find(name)
            if k < 0 or not 0 <= int(code) < self.schema[k].cardinality:
                raise ComputationError(f"{name}={code!r} is no state of the schema")
            at[self.schema[k].abbrev] = int(code)
        factors = []
        for f in self.conditionals():
            for name, code in at.items():
                if name in f.columns:
                    f = f.where(F.col(name) == code)
            factors.append(f)
        return calibrate(factors + list(weights or []), self.schema, self.forest)

    def release(self) -> None:
        """Delete the tables; nothing that reads them can be evaluated any more."""
        drop(*self.tables)


def of_model(p: DataFrame, model: Model) -> CliqueTree:
    """The fit of a decomposable model: its cliques' margins of the data agree already, so nothing is passed."""
    forest = junction_forest(model.relations)
    return CliqueTree(model.schema, forest, [project(p, model.schema, c) for c in forest.cliques], info=fitting.FitInfo("margins"))


def calibrate(factors: list[DataFrame], schema: Schema, forest: JunctionForest | None = None) -> CliqueTree:
    """The distribution proportional to a product of any factors, as clique tables.

    Each factor goes to the smallest clique that holds its variables.  Collecting, a clique multiplies its factors and its
    children's messages and sends the sum over what its parent lacks; distributing, it is scaled to what the parent has
    for the separator.  forest: cliques to use, by default the triangulated scopes.  An impossible product is an error.
    """
    scopes = [scope(f, schema) for f in factors]
    forest = forest or clique_tree([s for s in scopes if s], schema.cells)
    own: list[list[DataFrame]] = [[] for _ in forest.cliques]
    for s, f in zip(scopes, factors):
        fits = [k for k, c in enumerate(forest.cliques) if is_subset(s, c)]
        if not fits:
            raise ComputationError(f"no clique holds {''.join(schema.names(s))}")
        own[min(fits, key=lambda k: schema.cells(forest.cliques[k]))].append(f)
    held: dict[int, DataFrame] = {}
    sent: dict[int, DataFrame] = {}  # messages, summed up from stored tables where they are read
    mass = 1.0
    for k in forest.post_order():
        held[k] = store(product(own[k] + [sent[c] for c in forest.children(k) if c in sent], schema))
        common = scope(held[k], schema) & forest.separators[k]
        if forest.parent[k] >= 0 and common:
            sent[k] = project(held[k], schema, common)
    for k in forest.pre_order():
        before = held[k]
        if k in sent:
            up = held[forest.parent[k]]
            above = project(up, schema, forest.separators[k] & scope(up, schema))
            ratio = fitting.divide(above, sent[k], 0.0)
            held[k] = store(fitting.multiply(before, ratio).select(*schema.names(scope(before, schema) | scope(ratio, schema)), VALUE))
        else:
            part = tables.total(before)
            if not part > 0:
                raise ComputationError("the evidence, or the product, has no state left")
            mass *= part
            held[k] = store(before.withColumn(VALUE, F.col(VALUE) / F.lit(part)))
        drop(before)
    return CliqueTree(schema, forest, [held[k] for k in range(len(forest.cliques))], mass)


# Fits with loops on clique tables ----------------------------------------------------

_GAP = "_gap"


def _scaled(q: DataFrame, margin: DataFrame, names: list[str], small: bool, watch: bool = False) -> DataFrame:
    """One step: q's margin becomes the given one; what it missed before is kept in ``_gap`` if it is watched."""
    have = q.groupBy(*names).agg(F.sum(VALUE).alias("_have"))
    want = F.coalesce("_want", F.lit(0.0))
    factor = have.join(margin.withColumnRenamed(VALUE, "_want"), names, "left").select(
        *names, F.when(F.col("_have") > 0, want / F.col("_have")).otherwise(F.lit(0.0)).alias("_f"), F.abs(F.col("_have") - want).alias("_missed"))
    out = q.join(F.broadcast(factor) if small else factor, names)
    gap = F.greatest(_GAP, "_missed") if watch else F.col(_GAP)
    return out.select(*[c for c in q.columns if c not in (VALUE, _GAP)], (F.col(VALUE) * F.col("_f")).alias(VALUE), gap.alias(_GAP))


class _Block:
    """One block of cliques whose tables are scaled in turn."""

    def __init__(self, schema: Schema, forest: JunctionForest, own: list[int], generators: list[int], margins: dict[int, DataFrame]):
        self.schema, self.forest, self.own, self.margins = schema, forest, own, margins
        self.root = next(k for k in forest.pre_order() if k in own)
        self.at: dict[int, list[int]] = {k: [] for k in own}
        for g in generators:
            self.at[min((k for k in own if is_subset(g, forest.cliques[k])), key=lambda k: schema.cells(forest.cliques[k]))].append(g)
        # states that the margins allow, each as likely as any other, made to agree between the cliques
        support = lambda g: margins[g].where(F.col(VALUE) > 0).select(*schema.names(g), F.lit(1.0).alias(VALUE))
        factors = [support(g) for g in generators]
        for k in own:  # what the margins allow of parts of a clique keeps it small from the start
            parts = {g & forest.cliques[k] for g in generators} - {0}
            factors += [support_of(margins, g, schema) for g in parts if g not in generators and not any(g != h and is_subset(g, h) for h in parts)]
        self.tables = {k: _with_files(t.withColumn(_GAP, F.lit(0.0)), t) for k, t in zip(own, self._start(factors))}

    def _start(self, factors) -> list[DataFrame]:
        place = {k: j for j, k in enumerate(self.own)}
        parent = tuple(place.get(self.forest.parent[k], -1) for k in self.own)
        seps = tuple(self.forest.separators[k] if p >= 0 else 0 for k, p in zip(self.own, parent))
        return calibrate(factors, self.schema, JunctionForest(tuple(self.forest.cliques[k] for k in self.own), parent, seps)).tables

    def _small(self, mask: int) -> bool:
        return self.schema.cells(mask) <= fitting.MAX_BROADCAST

    def _put(self, k: int, new: DataFrame) -> None:
        old, self.tables[k] = self.tables[k], store(new)
        drop(old)

    def _agree(self, k: int, other: int, fresh: bool = False) -> DataFrame:
        """Clique k scaled to what its neighbour has for their separator."""
        sep = self.forest.cliques[k] & self.forest.cliques[other]
        q = self.tables[k].withColumn(_GAP, F.lit(0.0)) if fresh else self.tables[k]
        return _scaled(q, project(self.tables[other], self.schema, sep), self.schema.names(sep), self._small(sep))

    def sweep(self, k: int | None = None, above: int | None = None) -> None:
        """A walk from the root: down, a clique takes over its parent's changes and is scaled by its margins; up, the parent
        takes over the child's.  A clique is up to date whenever it is scaled."""
        k = self.root if k is None else k
        q = self.tables[k].withColumn(_GAP, F.lit(0.0)) if above is None else self._agree(k, above, fresh=True)
        for g in self.at[k]:
            q = _scaled(q, self.margins[g], self.schema.names(g), self._small(g), watch=True)
        self._put(k, q)
        for c in self.forest.children(k):
            if c in self.tables:
                self.sweep(c, k)
                self._put(k, self._agree(k, c))

    def gap(self) -> float:
        """The largest miss of any margin when it was scaled in the last sweep: one job over one column."""
        rows = None
        for t in self.tables.values():
            r = t.agg(F.max(_GAP).alias("gap"))
            rows = r if rows is None else rows.union(r)
        return float(rows.agg(F.max("gap").alias("gap")).first()["gap"] or 0.0)

    def settle(self) -> None:
        """Every clique takes over what came after its last visit."""
        for k in self.forest.pre_order():
            if k in self.tables and k != self.root:
                self._put(k, self._agree(k, self.forest.parent[k]))


def support_of(margins: dict[int, DataFrame], mask: int, schema: Schema) -> DataFrame:
    """States of a part of a margin that it allows, as a factor of ones."""
    whole = next(g for g in margins if is_subset(mask, g))
    return margins[whole].where(F.col(VALUE) > 0).select(*schema.names(mask)).distinct().withColumn(VALUE, F.lit(1.0))


def fit_cliques(p: DataFrame, model: Model, config: fitting.IPFConfig = fitting.IPFConfig(), on_sweep=None) -> CliqueTree:
    """The fit of any model to a probability table, as clique tables; variables in no relation are uniform.

    ``config.max_iterations`` sweeps at most in each block; the gap of a sweep is the largest miss of a margin when it was
    about to be scaled.  on_sweep: called with the number of each sweep and its gap; what it raises ends the fit.
    """
    schema = model.schema
    relations = list(model.relations)
    forest = clique_tree([*relations, *(1 << k for k in bits(model.uncovered))], schema.cells)
    info = fitting.FitInfo("clique_ipf")
    done: list[DataFrame | None] = [None] * len(forest.cliques)
    for own in blocks(forest, relations):
        cover = 0
        for k in own:
            cover |= forest.cliques[k]
        parts = {r & cover for r in relations} - {0}
        generators = sorted((g for g in parts if not any(g != h and is_subset(g, h) for h in parts)), key=bits)
        if not generators:  # a variable in no relation
            v = schema[bits(cover)[0]]
            done[own[0]] = p.sparkSession.range(v.cardinality).select(F.col("id").cast("int").alias(v.abbrev), F.lit(1.0 / v.cardinality).alias(VALUE))
            continue
        margins = {g: store(project(p, schema, g)) for g in generators}
        if len(own) == 1 and generators == [cover]:
            done[own[0]] = margins[cover]
            continue
        block, before = _Block(schema, forest, own, generators, margins), float("inf")
        for sweeps in range(1, config.max_iterations + 1):
            block.sweep()
            gap = block.gap()
            if on_sweep:
                on_sweep(sweeps, gap)
            converged = gap < config.tolerance or abs(before - gap) < config.tolerance * 0.1
            before = gap
            if converged:
                break
        info = fitting.FitInfo("clique_ipf", max(info.iterations, sweeps), max(info.error, gap), info.converged and converged)
        if not converged and config.raise_on_failure:
            raise ConvergenceError("the fit did not converge", sweeps, gap)
        block.settle()
        for k in own:
            done[k] = _with_files(block.tables[k].drop(_GAP), block.tables[k])
        drop(*margins.values())
    return CliqueTree(schema, forest, done, info=info)
