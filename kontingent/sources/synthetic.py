"""Synthetic categorical data: conditional tables along a graph, sampled by inverse distribution."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..algebra import Model, bits, parse_model
from ..errors import ModelError, ValidationError
from ..graph import junction_forest
from ..operators.storage import materialise
from ..schema import Schema, Variable


@dataclass
class GraphicalModel:
    """Parents of each variable, and its distribution for each state of the parents (uniform where none is set)."""

    schema: Schema
    parents: dict[int, tuple[int, ...]] = field(default_factory=dict)
    tables: dict[int, dict[tuple[int, ...], np.ndarray]] = field(default_factory=dict)

    def set_parents(self, k: int, parents) -> None:
        self.parents[k] = tuple(parents)
        self.order()

    def set_conditional(self, k: int, state, p) -> None:
        p = np.asarray(p, float)
        if len(p) != self.schema[k].cardinality or p.min() < 0 or p.sum() <= 0:
            raise ValidationError("a distribution needs one non-negative weight per state")
        self.tables.setdefault(k, {})[tuple(state)] = p / p.sum()

    def probability(self, k: int, code: int, state=()) -> float:
        own = self.tables.get(k, {}).get(tuple(state))
        return float(own[code]) if own is not None else 1.0 / self.schema[k].cardinality

    def order(self) -> list[int]:
        """Variables with parents first."""
        out: list[int] = []
        while len(out) < len(self.schema):
            ready = [k for k in range(len(self.schema)) if k not in out and all(p in out for p in self.parents.get(k, ()))]
            if not ready:
                raise ModelError("the parents form a cycle")
            out += ready
        return out


def uniform(number: Column, stream: str) -> Column:
    """A number in [0, 1) for each number of a stream: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{stream}:"), number.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sample(spark: SparkSession, g: GraphicalModel, n: int, seed: int = 0, aggregated: bool = True) -> DataFrame:
    """n samples (as counts, or row by row): one uniform number per variable, compared with the running sums.

    The numbers are hashes of the seed, the variable and the sample's number, so they do not depend on partitions.
    """
    df = spark.range(n)
    for k in g.order():
        v = g.schema[k]
        u, parents = F.col(f"_u{k}"), g.parents.get(k, ())
        df = df.withColumn(f"_u{k}", uniform(F.col("id"), f"{seed}:{k}"))

        def pick(p):
            out = F.lit(v.cardinality - 1)
            for code in reversed(range(v.cardinality - 1)):
                out = F.when(u < F.lit(float(np.cumsum(p)[code])), F.lit(code)).otherwise(out)
            return out

        code = pick(np.full(v.cardinality, 1.0 / v.cardinality))
        for state, p in g.tables.get(k, {}).items():
            here = F.lit(True)
            for q, s in zip(parents, state):
                here = here & (F.col(g.schema[q].abbrev) == s)
            code = F.when(here, pick(p)).otherwise(code)
        df = df.withColumn(v.abbrev, code.cast("int"))
    df = df.select(*g.schema.columns)
    return df.groupBy(*g.schema.columns).agg(F.count("*").cast("double").alias("value")) if aggregated else df


def sample_table(p: DataFrame, schema: Schema, n: int, seed: int = 0, aggregated: bool = True) -> DataFrame:
    """n samples of a table of probabilities (of counts: in proportion), in the order of its states.

    Running sums are taken in ranges of states and shifted by the ranges before; samples meet the states of their slice of
    the unit interval in an equi-join, so neither side is held whole by a task or broadcast.
    """
    dealt = materialise(p.where(F.col("value") > 0).repartitionByRange(*schema.columns).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("value").alias("s"), F.count("*").alias("k")).orderBy("_part").collect()
    if not sums:
        raise ValidationError("an empty table has no samples")
    whole, states = sum(r["s"] for r in sums), sum(r["k"] for r in sums)
    before, shifts = 0.0, []
    for r in sums:
        shifts += [F.lit(r["_part"]), F.lit(before)]
        before += r["s"]
    slices = max(1, min(states, 1 << 20))
    upper = (F.sum("value").over(W.partitionBy("_part").orderBy(*schema.columns)) + F.element_at(F.create_map(*shifts), F.col("_part"))) / F.lit(whole)
    own = dealt.withColumn("_hi", upper).withColumn("_lo", F.col("_hi") - F.col("value") / F.lit(whole))
    # a sample belongs to the first state whose sum exceeds it; the last state takes what rounding leaves
    slice_of = lambda c: F.least(F.greatest(F.floor(c * F.lit(slices)), F.lit(0)), F.lit(slices - 1))
    own = own.withColumn("_slice", F.explode(F.sequence(slice_of(F.col("_lo") - 1e-9), slice_of(F.col("_hi") + 1e-9)))).select(*schema.columns, "_hi", "_slice")
    u = p.sparkSession.range(n).withColumn("_u", uniform(F.col("id"), str(seed))).withColumn("_slice", slice_of(F.col("_u")))
    met = u.join(own, "_slice").where(F.col("_hi") > F.col("_u"))
    out = met.groupBy("id").agg(F.min(F.struct("_hi", *schema.columns)).alias("s")).select(*[F.col(f"s.{c}").alias(c) for c in schema.columns])
    return out.groupBy(*schema.columns).agg(F.count("*").cast("double").alias("value")) if aggregated else out


@dataclass
class TableModel:
    """A model that is its table of probabilities."""

    schema: Schema
    table: DataFrame

    def samples(self, n: int, seed: int = 0) -> DataFrame:
        return sample_table(self.table, self.schema, n, seed, aggregated=False)

    def sampled_table(self, n: int, seed: int = 0) -> DataFrame:
        return sample_table(self.table, self.schema, n, seed)


def _pull(card: int, target: int, strength: float) -> np.ndarray:
    p = np.full(card, (1 - strength) / card)
    p[target % card] += strength
    return p


def independent_model(schema: Schema) -> GraphicalModel:
    return GraphicalModel(schema)


def chain_model(schema: Schema, strength: float = 0.8) -> GraphicalModel:
    """Each variable follows the one before with the given strength."""
    g = GraphicalModel(schema)
    for k in range(1, len(schema)):
        g.set_parents(k, [k - 1])
        for s in range(schema[k - 1].cardinality):
            g.set_conditional(k, [s], _pull(schema[k].cardinality, s, strength))
    return g


def star_model(schema: Schema, center: int = 0, strength: float = 0.8) -> GraphicalModel:
    g = GraphicalModel(schema)
    for k in range(len(schema)):
        if k != center:
            g.set_parents(k, [center])
            for s in range(schema[center].cardinality):
                g.set_conditional(k, [s], _pull(schema[k].cardinality, s, strength))
    return g


def connected_model(schema: Schema, strength: float = 0.8) -> GraphicalModel:
    """The last variable follows the sum of all others."""
    g = GraphicalModel(schema)
    last = len(schema) - 1
    g.set_parents(last, range(last))
    for state in itertools.product(*[range(v.cardinality) for v in schema.variables[:-1]]):
        g.set_conditional(last, state, _pull(schema[last].cardinality, sum(state), strength))
    return g


def parse_variables(text: str) -> Schema:
    """A:2,B:3."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9]*)\s*:\s*([0-9]+)\s*", part)
        if not m or int(m[2]) < 2:
            raise ValidationError(f"{part!r} is not NAME:CARDINALITY")
        out.append(Variable(m[1], m[1], int(m[2])))
    return Schema(tuple(out))


def model_from_spec(schema: Schema, name: str, strength: float = 0.8, seed: int = 0) -> GraphicalModel:
    """A graph whose data obey the model: relations become conditional tables in tree order.

    A model with loops is fitted as a joint table by proportional fitting of random margins and
    becomes the chain rule over all variables.
    """
    m: Model = parse_model(schema, name).completed()
    rng = np.random.default_rng(seed)
    g = GraphicalModel(schema)
    if not m.has_loops:
        forest, done = junction_forest(m.relations), 0
        for r in (forest.cliques[k] for k in forest.pre_order()):
            have = [k for k in bits(r) if done >> k & 1]
            for k in bits(r & ~done):
                if have:
                    g.set_parents(k, have)
                    for state in itertools.product(*[range(schema[q].cardinality) for q in have]):
                        g.set_conditional(k, state, _pull(schema[k].cardinality, sum(state), strength))
                have = [*have, k]
            done |= r
        return g
    joint = dependent_joint(m, strength, rng)
    for k in range(len(schema)):
        g.set_parents(k, range(k))
        part = joint.sum(axis=tuple(range(k + 1, len(schema))))
        for state in itertools.product(*[range(v.cardinality) for v in schema.variables[:k]]):
            if part[state].sum() > 0:
                g.set_conditional(k, state, part[state])
    return g


def dependent_joint(m: Model, strength: float, rng) -> np.ndarray:
    """A joint table with the model's interactions only: a product of one random factor per relation, normalised."""
    shape = [v.cardinality for v in m.schema]
    q = np.ones(shape)
    for r in m.relations:
        axes = [shape[k] if r >> k & 1 else 1 for k in range(len(shape))]
        q = q * np.exp(2 * strength * rng.normal(size=axes))
    return q / q.sum()
