"""Margins summed from the smallest at hand: plans, and equality with grouping sets."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontingent.errors import ValidationError
from kontingent.operators import rollup, table as tables
from kontingent.operators.analyzer import Analyzer
from kontingent.progress import stage_figures, tagged
from kontingent.schema import Schema, Variable


def counts(cards):
    return lambda m: math.prod(n for k, n in enumerate(cards) if m >> k & 1)


def pairs(n):
    return [1 << i for i in range(n)] + [1 << i | 1 << j for i, j in combinations(range(n), 2)]


def test_plans_cover_and_save():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        cards = [int(x) for x in rng.integers(2, 9, n)]
        rows, cells, full = int(rng.integers(1, 10**7)), counts(cards), (1 << n) - 1
        masks = list(dict.fromkeys(int(x) for x in rng.integers(1, full + 1, rng.integers(1, 40))))
        nodes = rollup.plan(masks, rows, cells, full, worth=1000)
        assert sorted(x.mask for x in nodes if x.wanted) == sorted(masks) and len({x.mask for x in nodes}) == len(nodes)
        done = {0}
        for x in nodes:
            assert x.parent in done and (not x.parent or x.mask & ~x.parent == 0 and x.mask != x.parent)
            done.add(x.mask)
        steps = {x.parent for x in nodes} - {0}
        cost = rollup.copied_rows(nodes, rows, cells) + rollup.SHUFFLED * sum(min(rows, cells(m)) for m in steps)
        assert cost <= rows * len(masks)
    thirty = rollup.plan(pairs(30), 10**9, counts([5] * 30), (1 << 30) - 1)
    assert rollup.copied_rows(thirty, 10**9, counts([5] * 30)) < 40 * 10**9  # 465 without steps


def test_equal_to_grouping_sets(spark):
    rng = np.random.default_rng(2)
    cards = [3, 4, 2, 5, 3, 4]
    s = Schema(tuple(Variable(c, c, n) for c, n in zip("ABCDEF", cards)))
    rows = [(*(int(rng.integers(0, n)) for n in cards), float(rng.integers(0, 9))) for _ in range(4000)]
    t = tables.aggregate(spark.createDataFrame(rows, "A int, B int, C int, D int, E int, F int, value double"), s).cache()
    masks = pairs(6) + [0b111, 0b111000, s.full]
    with tagged(spark, "test-rollup"):
        r = rollup.Rollup(t, s, masks, t.count(), worth=1)
        got = {tuple(x) for x in r.margins().select("mask", *s.columns, F.round("value", 6)).collect()}
    assert any(not n.wanted for n in r.nodes) and len({n.parent for n in r.nodes}) > 2
    assert got == {tuple(x) for x in tables.project_many(t, s, masks).select("mask", *s.columns, F.round("value", 6)).collect()}
    h = {x["mask"]: (x["entropy"], x["n"], x["states"]) for x in r.entropies().collect()}
    for x in tables.entropies(t, s, masks).collect():
        assert h[x["mask"]] == pytest.approx((x["entropy"], x["n"], x["states"]), abs=1e-9)
    r.release()
    figures = stage_figures(spark, "test-rollup")
    assert figures["jobs"] >= 2 and figures["shuffle_write_rows"] > 0
    assert stage_figures(spark, "no-such-tag")["jobs"] == 0
    with pytest.raises(ValidationError):
        rollup.Rollup(t, s, [], 1)
    far, near = Analyzer(t, s, local_states=0), Analyzer(t, s)
    assert far.entropies(masks) == pytest.approx(near.entropies(masks), abs=1e-9)
    near.release()


def test_steps_do_not_grow_with_the_table():
    """A step that nobody asked for stays small however many rows there are, and a few steps cover many margins."""
    cells, full = counts([3, 2, 5, 7, 11, 9, 3, 5, 5, 6, 7, 25, 12, 12, 4, 4, 5, 10, 7, 6]), (1 << 20) - 1
    nodes = rollup.plan(pairs(20), 10**9, cells, full, most=rollup.STEP_CELLS)
    assert max(cells(x.mask) for x in nodes if not x.wanted) <= rollup.STEP_CELLS
    steps = rollup.cover(pairs(20), cells, rollup.STEP_CELLS)
    assert len(steps) < 30 and all(cells(s) <= rollup.STEP_CELLS for s in steps)
    assert all(any(m & ~s == 0 for s in steps) for m in pairs(20))
    assert rollup.cover([0b111], cells, 2) == [0b111]  # what is asked for is a step, whatever its size


def test_packed_sums(spark, monkeypatch):
    """Arrays in tasks and copies of rows give the same margins, with states whose values cancel."""
    from pyspark.errors import PythonException

    from kontingent.operators import packing

    s = Schema(tuple(Variable(c, c, n) for c, n in zip("ABC", (3, 4, 2))))
    rows = [(k % 3, k % 4, k % 2, float(k % 5 - 2)) for k in range(500)] + [(1, 1, 1, 2.0), (1, 1, 1, -2.0)]
    t = spark.createDataFrame(rows, "A int, B int, C int, value double").repartition(5)
    p = packing.Packing(s)
    keyed = t.select(p.key().alias("key"), "value")
    masks = [0b1, 0b11, 0b101, 0b111]
    read = lambda d: {tuple(r) for r in d.select("mask", *p.codes(F.col("key"), F.col("mask")), F.round("value", 9)).collect()}
    want = {tuple(r) for r in tables.project_many(t, s, masks).select("mask", "A", "B", "C", F.round("value", 9)).collect()}
    assert read(p.sums(keyed, masks)) == want
    for cells in (0, 7, 24):
        monkeypatch.setattr(packing, "ARRAY_CELLS", cells)
        assert read(p.sums(keyed, masks)) == want
    monkeypatch.undo()
    assert p.sums(keyed.limit(0), masks).count() == 0
    with pytest.raises(PythonException, match="cardinality"):
        p.sums(spark.createDataFrame([(3, 0, 0, 1.0)], "A int, B int, C int, value double").select(p.key().alias("key"), "value"), [0b1]).collect()
