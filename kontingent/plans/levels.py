"""Levels of many models as relations: models, the margins they need, and their statistics are DataFrames.

``search`` keeps a level's models on the driver, which serves beams of a few hundred.  Here a level is a table: neighbours
are made from the seeds by tasks, equal ones dropped by name; each model becomes signed terms (cliques, separators, blocks
with loops); terms are joined with the entropies of margins and of fitted blocks and summed; likelihood ratio, information
criteria and p-values are column expressions; the beam is the head of an ordered table.  Only numbers of rows, up to
``MOST_MASKS`` masks and, in ``search``, the beam come to the driver.

A state of the data is one long: each variable has a field of bits, so a margin's key is the state's long AND the fields of
the margin's variables.  Where there are more states than ``rollup.STEP_CELLS``, they are first summed to a few margins that
cover all others (``rollup.cover``) and the others are summed from these, whose size the data's does not change.  Few states
(and over ``MOST_MASKS`` masks) are dealt to buckets and the masks copied to each, so every (state, mask) is met by an
equi-join in the bucket's task and added up there before anything is shuffled.

Loops: a model falls apart where a separator lies inside a relation (``graph.blocks``); only blocks with loops are fitted, equal
blocks of many models once.  All blocks are scaled together, one table keyed by block, a sweep being one job however many
blocks there are; a block leaves the table when it has converged by itself.  Blocks of more than ``MAX_BLOCK`` states are
fitted on clique tables, one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..algebra import Model, bits, is_subset, model_df
from ..errors import ConvergenceError, ValidationError
from ..functions import distributions
from ..functions.special import LN2
from ..graph import blocks, clique_tree
from ..operators import fit as fitting
from ..operators import inference, rollup
from ..operators.packing import Packing
from ..operators.storage import drop, materialise
from ..operators.table import VALUE, normalize
from ..schema import PROB_MIN, Schema
from .neighbours import rule

MODEL = "model string, relations array<long>"
DESCRIBED = "model string, level int, has_loops boolean, df long, uniform double, masks array<long>, signs array<int>, loops array<string>"
#: States of a block that are scaled in the common table.
MAX_BLOCK = 1 << 20
#: Masks that are planned together on the driver.
MOST_MASKS = 1 << 14
#: Domain states that one row makes.
CHUNK = 1 << 12


def model_frame(spark: SparkSession, models) -> DataFrame:
    return spark.createDataFrame([(m.name, list(m.relations)) for m in models], MODEL)


def neighbours(models: DataFrame, schema: Schema, filter, direction: str = "up") -> DataFrame:
    """All models one step from those given, each once."""
    step = rule(filter, direction)

    def run(batches):
        import pandas as pd

        for b in batches:
            found = dict.fromkeys(x for r in b["relations"] for x in step(Model(schema, [int(k) for k in r])))
            yield pd.DataFrame({"model": [m.name for m in found], "relations": [list(m.relations) for m in found]})

    return _spread(models).mapInPandas(run, MODEL).dropDuplicates(["model"])


def _spread(models: DataFrame) -> DataFrame:
    """Models dealt to all cores: they are few bytes and much work."""
    return models.repartition(models.sparkSession.sparkContext.defaultParallelism, "model")


def describe(models: DataFrame, schema: Schema, pairwise_df: bool = False) -> DataFrame:
    """Each model's terms (DESCRIBED): margins with their signs, names of its blocks with loops, and its degrees of freedom.

    A block's name lists the masks of the relations that it is fitted to.  ``uniform``: bits of variables in no relation.
    """
    def one(m: Model) -> tuple:
        forest = clique_tree(m.relations, schema.cells)
        masks, signs, loops = [], [], []
        for own in blocks(forest, m.relations):
            cover = 0
            for k in own:
                cover |= forest.cliques[k]
            parts = {r & cover for r in m.relations} - {0}
            generators = sorted(g for g in parts if not any(g != h and is_subset(g, h) for h in parts))
            if generators == [cover]:
                masks.append(cover)
                signs.append(1)
            else:
                loops.append(",".join(map(str, generators)))
            seps = [forest.separators[k] for k in own if forest.separators[k] and forest.parent[k] not in own]
            masks += seps
            signs += [-1] * len(seps)
        uniform = sum(math.log2(schema[k].cardinality) for k in bits(m.uncovered))
        return m.name, m.level, m.has_loops, model_df(m, pairwise_df), uniform, masks, signs, loops

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in DESCRIBED.split(", ")]
        for b in batches:
            yield pd.DataFrame([one(Model(schema, [int(k) for k in r])) for r in b["relations"]], columns=names)

    return _spread(models).mapInPandas(run, DESCRIBED)


class Levels:
    """Evaluates tables of models over one contingency table.  ``release`` deletes what it has written."""

    def __init__(self, t: DataFrame, schema: Schema, config: fitting.IPFConfig = fitting.IPFConfig(), buckets: int | None = None, step_cells: int = rollup.STEP_CELLS):
        self.schema, self.packing, self.config = schema.require_valid(), Packing(schema), config
        self.spark, self.table = t.sparkSession, t
        self.states = materialise(t.where(F.col(VALUE) > 0).select(self.packing.key().alias("key"), VALUE).groupBy("key").agg(F.sum(VALUE).alias(VALUE)))
        row = self.states.agg(F.sum(VALUE).alias("n"), F.sum(F.col(VALUE) * F.log2(VALUE)).alias("s"), F.count("*").alias("k")).first()
        self.step_cells, self.n_states = step_cells, row["k"]
        self.n = float(row["n"] or 0.0)
        if self.n <= 0:
            raise ValidationError("the data set has no counts")
        self.h_full = math.log2(self.n) - row["s"] / self.n
        self.buckets = buckets or self.spark.sparkContext.defaultParallelism
        self.written: list[DataFrame] = [self.states]
        self._entropies: DataFrame | None = None
        self._fits: DataFrame | None = None

    def _keep(self, df: DataFrame) -> DataFrame:
        self.written.append(materialise(df))
        return self.written[-1]

    def _forget(self, *frames: DataFrame) -> None:
        drop(*frames)
        self.written = [w for w in self.written if all(w is not f for f in frames)]

    # margins -------------------------------------------------------------------

    def margins(self, masks: DataFrame) -> DataFrame:
        """(mask, key, value) of the margins of a table of masks: keys are the states' longs without the other fields."""
        if self.n_states > self.step_cells:
            some = [r["mask"] for r in masks.select("mask").distinct().limit(MOST_MASKS + 1).collect()]
            if 0 < len(some) <= MOST_MASKS:
                return self._from_steps(some)
        # dealt before they are copied: a task of its own for each bucket, however few files the states lie in
        dealt = self.states.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(self.buckets))).repartition(self.buckets, "_b")
        copies = masks.select("mask", self.packing.fields(F.col("mask")).alias("_f"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.buckets - 1).cast("long"))).alias("_b"))
        met = dealt.join(copies, "_b").select("mask", F.col("key").bitwiseAND(F.col("_f")).alias("key"), VALUE)
        return met.groupBy("mask", "key").agg(F.sum(VALUE).alias(VALUE))

    def _from_steps(self, masks: list[int]) -> DataFrame:
        """Each margin from the smallest step that covers it; the steps are written."""
        cells = self.schema.cells
        steps = rollup.cover(masks, cells, self.step_cells)
        above = [(min((s for s in steps if m & ~s == 0), key=lambda s: (cells(s), s)), m, self.packing.fields_of(m)) for m in masks]
        stored = self._keep(self.packing.sums(self.states, steps))
        own = self.spark.createDataFrame(above, "_s long, mask long, _f long")
        dealt = stored.withColumnRenamed("mask", "_s").repartition(self.buckets, "_s", "key")
        met = dealt.join(F.broadcast(own), "_s").select("mask", F.col("key").bitwiseAND(F.col("_f")).alias("key"), VALUE)
        return met.groupBy("mask", "key").agg(F.sum(VALUE).alias(VALUE))

    def entropies(self, masks: DataFrame) -> DataFrame:
        """(mask, h) of at least these masks; those that are not known yet are computed together and kept."""
        new = masks.select("mask").distinct()
        if self._entropies is not None:
            new = new.join(self._entropies, "mask", "left_anti")
        new = self._keep(new)
        if not new.isEmpty():
            c = F.col(VALUE)
            found = self.margins(new).groupBy("mask").agg((F.lit(math.log2(self.n)) - F.sum(c * F.log2(c)) / F.lit(self.n)).alias("h"))
            before, self._entropies = self._entropies, self._keep(found if self._entropies is None else self._entropies.union(found))
            self._forget(*([before] if before is not None else []))
        self._forget(new)
        return self._entropies if self._entropies is not None else masks.select("mask", F.lit(0.0).alias("h")).limit(0)

    # loops ---------------------------------------------------------------------

    def fits(self, names: DataFrame) -> DataFrame:
        """(loop, h) of at least these blocks (a column ``loop`` of names); unknown ones are fitted together and kept."""
        new = names.select("loop").distinct()
        if self._fits is not None:
            new = new.join(self._fits.select("loop"), "loop", "left_anti")
        new = self._keep(new)
        if not new.isEmpty():
            found = self._fit_blocks(new)
            before, self._fits = self._fits, self._keep(found if self._fits is None else self._fits.union(found))
            self._forget(*([before] if before is not None else []))
        self._forget(new)
        return self._fits if self._fits is not None else names.select("loop", F.lit(0.0).alias("h")).limit(0)

    def _fit_blocks(self, names: DataFrame) -> DataFrame:
        cells = F.lit(1.0)
        for k, v in enumerate(self.schema):
            cells = cells * F.when(F.col("cover").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(float(v.cardinality))).otherwise(F.lit(1.0))
        listed = names.select("loop", F.transform(F.split("loop", ","), lambda x: x.cast("long")).alias("gens"))
        listed = listed.select("*", F.aggregate("gens", F.lit(0).cast("long"), lambda acc, g: acc.bitwiseOR(g)).alias("cover")).withColumn("cells", cells)
        listed = self._keep(listed)
        large = [r["loop"] for r in listed.where(F.col("cells") > MAX_BLOCK).select("loop").toLocalIterator()]
        out = [self._fit_large(x) for x in large]
        small = listed.where(F.col("cells") <= MAX_BLOCK)
        most = small.agg(F.max(F.size("gens")).alias("m")).first()["m"]
        if most:
            out += self._scale_together(small, most)
        found = out[0]
        for x in out[1:]:
            found = found.union(x)
        found = self._keep(found)
        self._forget(listed)
        return found

    def _fit_large(self, name: str) -> DataFrame:
        """A block by itself, on clique tables."""
        generators = [int(x) for x in name.split(",")]
        cover = 0
        for g in generators:
            cover |= g
        small = self.schema.select(self.schema.names(cover))
        place = {k: j for j, k in enumerate(bits(cover))}
        model = Model(small, [sum(1 << place[k] for k in bits(g)) for g in generators])
        tree = inference.fit_cliques(normalize(self.table.groupBy(*small.columns).agg(F.sum(VALUE).alias(VALUE)), self.n), model, self.config)
        h = tree.entropy()
        tree.release()
        return self.spark.createDataFrame([(name, h)], "loop string, h double")

    def _scale_together(self, listed: DataFrame, most: int) -> list[DataFrame]:
        """(loop, h) of blocks scaled side by side: tables of their entropies as they converge."""
        domain = listed.select("loop", "cover", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cells") - 1) / CHUNK).cast("long"))).alias("_c"))
        domain = domain.select("*", F.explode(F.sequence(F.col("_c") * CHUNK, F.least(F.col("_c") * CHUNK + CHUNK, F.col("cells").cast("long")) - 1)).alias("_i"))
        q = self._keep(domain.select("loop", self.packing.of_index(F.col("_i"), F.col("cover")).alias("key"), (1 / F.col("cells")).alias(VALUE),
                                     F.lit(0.0).alias("_gap"), F.lit(float("inf")).alias("_before")))
        steps = listed.select("loop", F.posexplode("gens").alias("_k", "mask"))
        want = self._keep(self.margins(steps.select("mask").distinct()).select("mask", F.col("key").alias("_m"), (F.col(VALUE) / F.lit(self.n)).alias("_want")))
        out: list[DataFrame] = []
        waiting: list[DataFrame] = []
        for sweep in range(1, self.config.max_iterations + 1):
            new = q.withColumns({"_before": F.when(F.lit(sweep > 1), F.col("_gap")).otherwise(F.col("_before")), "_gap": F.lit(0.0)})
            for k in range(most):
                new = self._step(new, steps.where(F.col("_k") == k), want)
            before, q = q, self._keep(new)
            self._forget(before)
            told = q.groupBy("loop").agg(F.max("_gap").alias("gap"), F.max("_before").alias("was"))
            settled = (F.col("gap") < self.config.tolerance) | (F.abs(F.col("was") - F.col("gap")) < self.config.tolerance * 0.1)
            told = self._keep(told.select("loop", settled.alias("settled")))
            some = told.agg(F.count_if("settled").alias("done"), F.count("*").alias("all")).first()  # two numbers, however many blocks
            last = some["done"] == some["all"] or sweep == self.config.max_iterations
            if some["done"] < some["all"] and sweep == self.config.max_iterations and self.config.raise_on_failure:
                raise ConvergenceError("blocks of models did not converge", sweep, math.nan)
            if some["done"] or last:
                over = q if last else q.join(told.where("settled").select("loop"), "loop", "left_semi")
                out.append(self._keep(over.groupBy("loop").agg(F.sum(F.when(F.col(VALUE) > PROB_MIN, -F.col(VALUE) * F.log2(VALUE)).otherwise(0.0)).alias("h"))))
            if not last and some["done"]:
                before, q = q, self._keep(q.join(told.where("not settled").select("loop"), "loop", "left_semi"))
                self._forget(before)
            waiting.append(told)
            if last:
                break
        self._forget(q, want, *waiting)
        return out

    def _step(self, q: DataFrame, step: DataFrame, want: DataFrame) -> DataFrame:
        """Every block scaled to its k-th margin; blocks that have no k-th one stay as they are."""
        own = q.join(step.select("loop", "mask", self.packing.fields(F.col("mask")).alias("_f")), "loop", "left").withColumn("_m", F.col("key").bitwiseAND(F.col("_f")))
        have = own.withColumn("_have", F.sum(VALUE).over(W.partitionBy("loop", "_m"))).join(want, ["mask", "_m"], "left")  # what it starts from is read once
        wanted = F.coalesce("_want", F.lit(0.0))
        factor = F.when(F.col("mask").isNull(), F.lit(1.0)).when(F.col("_have") > 0, wanted / F.col("_have")).otherwise(F.lit(0.0))
        missed = F.when(F.col("mask").isNull(), F.lit(0.0)).otherwise(F.abs(F.col("_have") - wanted))
        return have.select("loop", "key", (F.col(VALUE) * factor).alias(VALUE), F.greatest("_gap", missed).alias("_gap"), "_before")

    # statistics ------------------------------------------------------------------

    def evaluate(self, models: DataFrame, against: Model | None = None, pairwise_df: bool = False) -> DataFrame:
        """model, relations, level, has_loops, h, df, ddf, lr, aic, bic, alpha of each model, stored.

        alpha: of the step between the model and the saturated one, or the model ``against``.
        """
        # one row, and before anything else, as it may replace the tables of margins and fits
        base = None if against is None else self.evaluate(model_frame(self.spark, [against]), None, pairwise_df).first()
        known = self._keep(describe(models, self.schema, pairwise_df))
        terms = known.select("model", F.inline(F.arrays_zip(F.col("masks").alias("mask"), F.col("signs").alias("sign"))))
        loops = known.select("model", F.explode("loops").alias("loop"))
        h = terms.join(self.entropies(terms), "mask").select("model", (F.col("sign") * F.col("h")).alias("h"))
        h = h.union(loops.join(self.fits(loops), "loop").select("model", "h"))
        summed = known.select("model", "level", "has_loops", "df", "uniform").join(h.groupBy("model").agg(F.sum("h").alias("_h")), "model", "left")
        summed = summed.select("model", "level", "has_loops", (F.coalesce("_h", F.lit(0.0)) + F.col("uniform")).alias("h"), "df")
        cells = self.schema.cells() - 1
        scale = 2 * self.n * LN2
        out = summed.select("*", (F.lit(cells) - F.col("df")).cast("long").alias("ddf"), (F.lit(scale) * (F.col("h") - F.lit(self.h_full))).alias("lr"))
        if base is None:
            gap, free = F.col("lr"), F.col("ddf")
        else:
            gap, free = F.abs(F.col("lr") - F.lit(base["lr"])), F.abs(F.col("df") - F.lit(base["df"]))
        out = out.select("*", (F.col("lr") - 2 * F.col("df")).alias("aic"), (F.col("lr") - F.col("ddf") * F.lit(math.log(self.n))).alias("bic"),
                         distributions.chi2_sf(gap, free).alias("alpha"))
        out = self._keep(out.join(models.select("model", "relations"), "model"))
        self._forget(known)
        return out

    def search(self, first: Model, filter="loopless", direction: str = "up", statistic: str = "bic", width: int = 3, levels: int = 7) -> DataFrame:
        """The start and the best models of each level: model, relations, level of the search, statistics; ties by name.

        Each level's table stays in the shared folder; the beam alone is gathered, to be the seeds of the next level.
        """
        order = (F.desc(statistic) if statistic in ("ddf", "df", "h") else F.asc(statistic), F.asc("model"))
        kept = self.evaluate(model_frame(self.spark, [first])).withColumn("step", F.lit(0))
        beam = model_frame(self.spark, [first])
        for level in range(1, levels + 1):
            fresh = self._keep(neighbours(beam, self.schema, filter, direction))
            if fresh.isEmpty():
                break
            best = self.evaluate(fresh).orderBy(*order).limit(width).collect()  # the beam
            beam = self.spark.createDataFrame([(r["model"], list(r["relations"])) for r in best], MODEL)
            rows = self.spark.createDataFrame(best, kept.drop("step").schema)
            kept = kept.union(rows.withColumn("step", F.lit(level)))
            self._forget(fresh)
        first_seen = kept.groupBy("model").agg(F.min("step").alias("step"))
        return kept.dropDuplicates(["model"]).drop("step").join(first_seen, "model").orderBy(*order)

    def release(self) -> None:
        drop(*self.written)
        self.written = []
