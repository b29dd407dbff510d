"""Levels of models as tables: against the driver's figures, and the tails of distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontingent import algebra
from kontingent.errors import ValidationError
from kontingent.functions import distributions, special
from kontingent.operators import fit
from kontingent.operators.analyzer import Analyzer
from kontingent.plans import levels, neighbours, search
from kontingent.progress import stage_figures, tagged
from kontingent.schema import Schema, Variable

CARDS = {"A": 3, "B": 2, "C": 4, "D": 2, "E": 3}
SCHEMA = Schema(tuple(Variable(f"v{c}", c, n) for c, n in CARDS.items()))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(*(int(x) for x in at), float(rng.integers(0, 20))) for at in np.ndindex(*CARDS.values()) if rng.random() < 0.8]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in CARDS) + ", value double").cache()


def test_chi_squared_tail(spark):
    points = [(x, df) for df in (0, 1, 2, 3, 4, 7, 10, 31, 50, 99) for x in (-1.0, 0.0, 0.01, 0.5, 1.0, 3.84, 10.0, 55.0, 150.0, 400.0)]
    got = spark.createDataFrame(points, "x double, df int").withColumn("p", distributions.chi2_sf(F.col("x"), F.col("df"))).collect()
    for r in got:
        want = special.chi2_sf(r["x"], r["df"])
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-300), (r["x"], r["df"])
    large = spark.createDataFrame([(float(x), df) for df in (100, 500, 10**6) for x in (df * 0.8, df * 0.99, df, df * 1.02, df * 1.2)], "x double, df int")
    for r in large.withColumn("p", distributions.chi2_sf(F.col("x"), F.col("df"))).collect():
        assert r["p"] == pytest.approx(special.chi2_sf(r["x"], r["df"]), abs=2e-4)
    z = spark.createDataFrame([(z,) for z in (-9.0, -2.0, -0.1, 0.0, 0.3, 1.96, 2.0, 2.01, 2.9, 6.0, 30.0)], "z double")
    for r in z.withColumn("p", distributions.normal_sf(F.col("z"))).collect():
        assert r["p"] == pytest.approx(special.normal_sf(r["z"]), rel=1e-9, abs=1e-300)


def test_keys_and_margins(spark, table):
    level = levels.Levels(table, SCHEMA, buckets=3)
    for mask in (0b1, 0b10110, SCHEMA.full):
        names = SCHEMA.names(mask)
        key = sum((F.shiftleft(F.col(c).cast("long"), level.packing.shift[SCHEMA.find(c)]) for c in names), F.lit(0))
        want = {(r["k"], r["v"]) for r in table.where("value > 0").groupBy(key.alias("k")).agg(F.sum("value").alias("v")).collect()}
        got = level.margins(spark.createDataFrame([(mask,)], "mask long")).collect()
        assert {(r["key"], r["value"]) for r in got} == want
        keys = spark.range(SCHEMA.cells(mask)).select(level.packing.of_index(F.col("id"), F.lit(mask).cast("long")).alias("k")).distinct()
        assert keys.count() == SCHEMA.cells(mask) and {k for k, _ in want} <= {r["k"] for r in keys.collect()}
    level.release()
    with pytest.raises(ValidationError):
        levels.Packing(Schema(tuple(Variable(f"v{k}", f"V{k}", 1 << 16) for k in range(4))))


@pytest.mark.parametrize("start,filter,direction", [("AB:BC:CD:E", "full", "up"), ("ABC:CDE", "full", "down"), ("ABC:D", "disjoint", "up")])
def test_a_level_equals_the_drivers(spark, table, start, filter, direction):
    """Also models that miss variables."""
    near, first = Analyzer(table, SCHEMA), algebra.parse_model(SCHEMA, start)
    models = neighbours.rule(filter, direction)(first)
    level = levels.Levels(table, SCHEMA, fit.IPFConfig(2000, 1e-11))
    got = {r["model"]: r for r in level.evaluate(levels.neighbours(levels.model_frame(spark, [first]), SCHEMA, filter, direction), against=first).collect()}
    assert set(got) == {m.name for m in models}
    for m in models:
        r = got[m.name]
        assert (r["df"], r["ddf"], r["level"], r["has_loops"]) == (near.df(m), near.ddf(m), m.level, m.has_loops)
        assert r["h"] == pytest.approx(near.h(m), abs=1e-6) and r["bic"] == pytest.approx(near.bic(m), abs=1e-2) and r["aic"] == pytest.approx(near.aic(m), abs=1e-2)
        assert r["alpha"] == pytest.approx(near.incremental_alpha(m, first), abs=1e-4)
    near.release()
    level.release()


def test_large_blocks_are_fitted_alone_and_jobs_do_not_follow_models(spark, table, monkeypatch):
    names = ["AB:BC:AC:D:E", "AB:BD:AD:C:E", "AC:CD:AD:B:E", "BC:CD:BD:A:E", "AB:BC:CD:AD:E", "AB:BC:CD:DE:AE", "ABC:ABD:CD:E"]
    models = [algebra.parse_model(SCHEMA, x) for x in names]
    near = Analyzer(table, SCHEMA)
    config = fit.IPFConfig(4, 0.0)  # always all sweeps, so that numbers of jobs can be compared
    jobs = []
    for some in (models[:2], models):
        together = levels.Levels(table, SCHEMA, config)
        tag = f"levels-{len(some)}"
        with tagged(spark, tag):
            got = {r["model"]: r["h"] for r in together.evaluate(levels.model_frame(spark, some)).collect()}
        jobs.append(stage_figures(spark, tag)["jobs"])
        together.release()
    assert jobs[1] <= jobs[0] * 1.5 + 5
    monkeypatch.setattr(levels, "MAX_BLOCK", 30)
    alone = levels.Levels(table, SCHEMA, fit.IPFConfig(200, 1e-7))
    one = {r["model"]: r["h"] for r in alone.evaluate(levels.model_frame(spark, models[4:5])).collect()}
    for m in models:
        assert got[m.name] == pytest.approx(near.h(m), abs=1e-2)
    for name, h in one.items():
        assert h == pytest.approx(near.h(name), abs=1e-5)
    alone.release()
    near.release()


def test_search_equals_the_drivers(spark, table):
    near = Analyzer(table, SCHEMA)
    level = levels.Levels(table, SCHEMA)
    for filter, direction in (("loopless", "up"), ("full", "up")):
        first = algebra.reference_model(SCHEMA, "bottom")
        want = search.search(near, filter, direction, "bic", 3, 2)
        got = level.search(first, filter, direction, "bic", 3, 2).collect()
        assert [r["model"] for r in got] == [c.name for c in want.candidates]
        assert [r["step"] for r in got] == [c.level for c in want.candidates]
    assert level.evaluate(levels.model_frame(spark, [algebra.independence(SCHEMA)]).limit(0)).count() == 0
    near.release()
    level.release()


def test_margins_from_steps(spark, table):
    """With more states than a step may have, margins come from a few steps and are the same."""
    masks = spark.createDataFrame([(m,) for m in range(1, SCHEMA.full + 1)], "mask long")
    near, far = levels.Levels(table, SCHEMA), levels.Levels(table, SCHEMA, buckets=3, step_cells=12)
    assert far.n_states > 12
    read = lambda d: {(r["mask"], r["key"]): r["value"] for r in d.collect()}
    assert read(far.margins(masks)) == read(near.margins(masks))
    h = {r["mask"]: r["h"] for r in near.entropies(masks).collect()}
    assert {r["mask"]: r["h"] for r in far.entropies(masks).collect()} == pytest.approx(h, abs=1e-12)
    near.release()
    far.release()
