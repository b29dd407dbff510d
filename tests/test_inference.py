"""Clique trees against dense arrays: messages, evidence, elimination, fits with loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontingent.algebra import Model, bits, parse_model, parse_relation
from kontingent.errors import ComputationError, ConvergenceError
from kontingent.graph import blocks, clique_tree, elimination_order, is_acyclic, triangulated
from kontingent.operators import fit, inference as inf
from kontingent.operators.analyzer import Analyzer
from kontingent.operators.table import VALUE, project
from kontingent.plans import wide
from kontingent.schema import Schema, Variable

NAMES = "ABCDEF"


def schema_of(cards):
    return Schema(tuple(Variable(f"v{c}", c, n) for c, n in zip(NAMES, cards)))


def frame(spark, q, names):
    rows = [(*map(int, at), float(q[tuple(at)])) for at in np.argwhere(q > 0)]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names) + f", {VALUE} double")


def dense(df, schema, mask):
    names = schema.names(mask)
    rows = df.toPandas()
    out = np.zeros([schema[k].cardinality for k in bits(mask)])
    np.add.at(out, tuple(rows[c].to_numpy() for c in names), rows[VALUE].to_numpy())
    return out


def margin(q, mask):
    return q.sum(axis=tuple(k for k in range(q.ndim) if not mask >> k & 1))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    cards = [3, 2, 4, 2, 3, 2]
    p = rng.random(cards) * (rng.random(cards) < 0.6)  # four cells of ten are empty
    p /= p.sum()
    s = schema_of(cards)
    return s, p, frame(spark, p, s.columns).cache()


def test_triangulation():
    rng = np.random.default_rng(2)
    cells = lambda m: 2 ** m.bit_count()
    for _ in range(200):
        relations = [int(x) for x in rng.integers(1, 256, rng.integers(1, 9))]
        cliques = triangulated(relations, cells)
        assert is_acyclic(cliques)
        assert all(any(r & ~c == 0 for c in cliques) for r in relations)
        if is_acyclic(set(relations)):
            assert set(cliques) <= set(relations)
        tree = clique_tree(relations, cells)
        own = blocks(tree, relations)
        assert sorted(k for b in own for k in b) == list(range(len(tree.cliques)))
    ring = [1 << k | 1 << (k + 1) % 8 for k in range(8)]
    assert max(c.bit_count() for c in triangulated(ring, cells)) == 3
    assert len(blocks(clique_tree(ring, cells), ring)) == 1 and len(blocks(clique_tree(ring[:7], cells), ring[:7])) == 7


def test_a_chain_is_eliminated_over_three_variables():
    s = Schema(tuple(Variable(f"v{c}", c, 4) for c in "ABCDEFGH"))
    pairs = [3 << k for k in range(7)]
    assert inf.widest(pairs, s, 0b10000001) == 3
    assert sorted(elimination_order(pairs, s.cells, 0b10000001)) == list(range(1, 7))


@pytest.mark.parametrize("name", ["AB:BC:CD:AD:DE", "AB:BC:AC:CD:DE:EF:DF", "ABC:CD:E"])
def test_fits_equal_the_dense_ones(data, name):
    s, p, df = data
    m = parse_model(s, name)
    tree = inf.fit_cliques(df, m, fit.IPFConfig(1000, 1e-12))
    q, _ = fit.dense_ipf(p, m.relations, fit.IPFConfig(5000, 1e-13))
    assert np.abs(dense(tree.joint(), s, s.full) - q).max() < 1e-9
    assert abs(tree.entropy() - float(-(q[q > 0] * np.log2(q[q > 0])).sum())) < 1e-9
    assert tree.info.converged and all(inf.scope(t, s) == c for t, c in zip(tree.tables, tree.forest.cliques))
    for mask in (0b100001, 0b10101, 0b1):
        assert np.abs(dense(tree.marginal(mask), s, mask) - margin(q, mask)).max() < 1e-9
    given = tree.given(C=2, e=1)
    part = q[:, :, 2, :, 1, :]
    assert abs(given.mass - part.sum()) < 1e-9
    assert np.abs(dense(given.marginal(0b1001), s, 0b1001) - part.sum(axis=(1, 3)) / part.sum()).max() < 1e-9
    tree.release()


def test_fits_of_random_models(spark):
    rng = np.random.default_rng(9)
    for trial in range(2):
        cards = [int(x) for x in rng.integers(2, 4, 5)]
        s, p = schema_of(cards), rng.random(cards)
        p /= p.sum()
        m = Model(s, [int(x) for x in rng.integers(1, 31, 5)])
        tree = inf.fit_cliques(frame(spark, p, s.columns), m, fit.IPFConfig(2000, 1e-12))
        q, _ = fit.dense_ipf(p, m.relations, fit.IPFConfig(5000, 1e-13))
        assert np.abs(dense(tree.joint(), s, s.full) - q).max() < 1e-8, m.name


def test_any_potentials_with_zeros_and_weights(spark):
    rng = np.random.default_rng(3)
    s = schema_of([3, 2, 4, 2, 3, 2])
    masks = [parse_relation(s, x) for x in ("AB", "BC", "CD", "AD", "DE", "B")]  # a loop of four, a tail, one variable alone; F is free
    arrays = [rng.random([s[k].cardinality for k in bits(m)]) * (rng.random([s[k].cardinality for k in bits(m)]) < 0.8) * 50 for m in masks]
    want = np.ones([v.cardinality for v in s][:5])
    for m, a in zip(masks, arrays):
        want = want * a.reshape([s[k].cardinality if m >> k & 1 else 1 for k in range(5)])
    tree = inf.calibrate([frame(spark, a, s.names(m)) for m, a in zip(masks, arrays)], s)
    assert abs(tree.mass / want.sum() - 1) < 1e-12
    for mask in (0b10001, 0b1010, 0b111):
        assert np.abs(dense(tree.marginal(mask), s, mask) - margin(want, mask) / want.sum()).max() < 1e-12
    for k, sep in enumerate(tree.forest.separators):
        if sep:
            assert np.abs(dense(tree.separator(k), s, sep) - dense(project(tree.tables[tree.forest.parent[k]], s, sep), s, sep)).max() < 1e-12
    soft = rng.random(4)
    weighed = tree.given([frame(spark, soft, ["C"])], A=1)
    part = (want * soft.reshape(1, 1, 4, 1, 1))[1]
    assert np.abs(dense(weighed.marginal(0b10000), s, 0b10000) - part.sum(axis=(0, 1, 2)) / part.sum()).max() < 1e-12


def test_evidence_that_cannot_be_and_values_that_are_none(spark, data):
    s, _, df = data
    tree = inf.of_model(df, parse_model(s, "AB:BC"))
    with pytest.raises(ComputationError):
        tree.given(A=9)
    with pytest.raises(ComputationError):
        tree.marginal(1 << 6)
    never = frame(spark, np.array([[0.0, 1.0], [0.0, 1.0], [0.0, 1.0]]), ["A", "B"])
    with pytest.raises(ComputationError):
        inf.calibrate([never], s).given(B=0)
    for value in (float("nan"), float("inf"), -1.0, None):
        bad = spark.createDataFrame([(0, 0, 0.5), (1, 1, value)], f"A int, B int, {VALUE} double")
        with pytest.raises(ComputationError):
            inf.calibrate([bad], s)
        good = spark.createDataFrame([(0, 0, 0.5), (1, 1, 0.5)], f"B int, C int, {VALUE} double")
        with pytest.raises(ComputationError):
            inf.calibrate([good, bad], s)
        with pytest.raises(ComputationError):
            inf.calibrate([good], s).given([bad.drop("B")])
    # a message may overflow though no factor does
    huge = [spark.createDataFrame([(k, k, 1e200) for k in range(2)], f"{a} int, {b} int, {VALUE} double") for a, b in ("AB", "BC", "CD")]
    with pytest.raises(ComputationError):
        inf.calibrate(huge, s)
    with pytest.raises(ConvergenceError):
        inf.fit_cliques(df, parse_model(s, "AB:BC:AC"), fit.IPFConfig(1, 1e-15, raise_on_failure=True))
    big = Schema(tuple(Variable(f"v{c}", c, 1 << 15) for c in "AB"))
    with pytest.raises(ComputationError):
        inf.product([spark.createDataFrame([(0, 1.0)], f"{c} int, {VALUE} double") for c in "AB"], big)


def test_analyzer_fits_loops_without_the_driver(data):
    s, p, df = data
    a = Analyzer(df.withColumn(VALUE, F.col(VALUE) * 1000), s, local_states=0)
    name = "AB:BC:AC:D:E:F"
    q, _ = fit.dense_ipf(p, parse_model(s, name).relations)
    assert abs(a.h(name) - float(-(q[q > 0] * np.log2(q[q > 0])).sum())) < 1e-5
    assert np.abs(dense(a.fit_table(name), s, s.full) - q).max() < 1e-5
    a.release()


def test_wide_tables_stay_narrow(spark, sf_dir):
    """The plan of a margin of twelve variables joins tables of three variables at most."""
    p, s = wide.wide_probabilities(spark, sf_dir)
    m = parse_model(s, wide.LOOPS)
    assert s.cells() > 1e9
    tree = clique_tree(m.relations, s.cells)
    assert max(c.bit_count() for c in tree.cliques) == 3 and max(map(s.cells, tree.cliques)) < 1000
    assert inf.widest(tree.cliques, s, parse_relation(s, "AL")) <= 4
