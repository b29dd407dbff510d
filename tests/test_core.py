"""Model algebra, graphs, special functions, and golden statistics of the soft-drink table."""

import pytest

from kontingent import algebra, graph
from kontingent.functions import special
from kontingent.operators import predict, table as tables
from kontingent.operators.analyzer import Analyzer, Compat
from kontingent.plans import neighbours, search
from kontingent.schema import Schema, Variable

# The published 3 x 2 x 2 x 2 soft-drink counts, first variable fastest.
COUNTS = (19, 23, 24, 29, 33, 42, 57, 47, 37, 63, 66, 68, 29, 47, 43, 27, 23, 30, 49, 55, 52, 53, 50, 42)


def drink(directed=False):
    return Schema((Variable("soft", "A", 3, directed), Variable("previous", "B", 2), Variable("temp", "C", 2), Variable("prefer", "D", 2)))


def frame(spark, schema):
    rows = [(*tables.index_state(schema, k), float(c)) for k, c in enumerate(COUNTS)]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in schema.columns) + ", value double")


@pytest.fixture(scope="module", params=[0, 200_000], ids=["spark", "local"])
def analyzer(request, spark):
    return Analyzer(frame(spark, drink()), drink(), local_states=request.param)


@pytest.fixture(scope="module")
def local(spark):
    return Analyzer(frame(spark, drink()), drink())


# Entropies of fitted models.
GOLDEN = {"ABCD": 4.5000704, "A:B:C:D": 4.530791, "A:C:BD": 4.516063, "AC:BD": 4.511698, "AC:BD:CD": 4.508577, "A:B:CD": 4.527670,
          "AC:B:D": 4.526426, "AB:BC:CD": 4.526004, "ABC:BCD": 4.504118, "AB:AC:AD": 4.525374}


def test_golden_entropies(analyzer):
    assert analyzer.n == 1008 and analyzer.schema.cells() == 24
    for name, h in GOLDEN.items():
        assert analyzer.h(name) == pytest.approx(h, abs=2e-6), name


def test_loop_model(local):
    r = local.fit("ABD:ACD:BCD")
    assert r.h == pytest.approx(4.501584, abs=1e-5) and r.lr == pytest.approx(2.11464, abs=1e-3) and r.df == 19 and r.has_loops
    assert local.lr("A:B:C:D") == pytest.approx(42.92866, abs=1e-4)


def test_fit_and_residuals(local):
    for name in ("AB:BC:CD", "A:B:C:D", "ABC:BCD", "AB:CD", "ABD:ACD:BCD"):
        fitted = local.fit_table(name)
        assert tables.total(fitted) == pytest.approx(1.0)
        assert tables.entropy(fitted) == pytest.approx(local.h(name), abs=1e-5)
        for r in local.model(name).relations:
            gap = tables.residuals(tables.project(local.probabilities, local.schema, r), tables.project(fitted, local.schema, r), local.schema.select(local.schema.names(r)))
            assert max(abs(x["residual"]) for x in gap.collect()) < 1e-5
    assert sum(x["residual"] for x in local.residuals("AB:BC").collect()) == pytest.approx(0, abs=1e-9)


def test_frame_ipf_equals_dense(spark):
    from kontingent.operators import fit

    a = Analyzer(frame(spark, drink()), drink(), local_states=0)
    q, info = fit.frame_ipf(a.probabilities, a.model("AB:BC:AC:D"), fit.IPFConfig(tolerance=1e-6))
    b = Analyzer(frame(spark, drink()), drink())
    assert info.converged and tables.entropy(q) == pytest.approx(b.h("AB:BC:AC:D"), abs=1e-4)


def test_pairwise_compat(spark):
    a = Analyzer(frame(spark, drink()), drink(), Compat.reference())
    assert a.h("AB:AC:AD") == pytest.approx(2.940771, abs=2e-6) and a.df("ABD:ACD:BCD") == 18
    b = Analyzer(frame(spark, drink()), drink())
    assert b.df("AB:AC:AD") == 11 and a.df("AB:AC:AD") == 9 and b.df("AB:BC:CD") == a.df("AB:BC:CD") == 9


def test_algebra():
    s = drink()
    p = lambda x: algebra.parse_model(s, x)
    assert p("A:B:AB:BC").name == "AB:BC" and p("cb:ab").name == "AB:BC" and p("AB:AB").relations == p("AB").relations
    with pytest.raises(Exception):
        p("AX")
    assert algebra.parse_model(s, "AX:B", strict=False).name == "A:B"
    for name, loops in {"AB:BC:CD": False, "AB:BC:AC": True, "ABC:BCD": False, "AB:BC:CD:AD": True, "ABD:ACD:BCD": True, "AB:CD": False, "AB:AC:AD": False}.items():
        assert p(name).has_loops is loops, name
    assert [algebra.model_df(p(n)) for n in ("AB:CD", "AB:AC:BC", "ABC:BCD", "A:B:C:D", "ABCD")] == [8, 9, 15, 5, 23]
    assert p("ABC:BCD").contains(p("AB:CD")) and not p("AB").contains(p("CD"))
    long = Schema((Variable("x", "Ab", 2), Variable("y", "A", 2), Variable("z", "B", 2)))
    assert algebra.parse_model(long, "AbA:B").name == "AbA:B"


def test_graph():
    s = drink()
    f = graph.junction_forest(algebra.parse_model(s, "AB:BC:CD").relations)
    assert f.is_tree and len(f.pre_order()) == 3 and f.post_order() == f.pre_order()[::-1]
    assert not graph.junction_forest(algebra.parse_model(s, "AB:CD").relations).is_tree
    with pytest.raises(Exception):
        graph.junction_forest(algebra.parse_model(s, "AB:BC:AC").relations)
    square = graph.primal_graph([0b0011, 0b0110, 0b1100, 0b1001])
    assert not graph.is_chordal(square) and graph.maximal_cliques(square) == [0b0011, 0b1001, 0b0110, 0b1100]
    assert graph.running_intersection_order([0b0011, 0b0110, 0b1100]) is not None


def test_special():
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_critical(0.05, 10) == pytest.approx(18.30704, abs=1e-4)
    assert special.noncentral_chi2_cdf(10, 2, 4) == pytest.approx(0.8314, abs=0.01)
    assert special.noncentral_chi2_cdf(20, 5, 10) == pytest.approx(0.7811, abs=0.01)
    assert special.power(0, 3) == 1.0 and special.power(3, 0) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(1200, 1000) == pytest.approx(1.26e-5, rel=0.05)


def test_search(local):
    s = drink()
    assert len(neighbours.lattice(s)) == 15 and len(neighbours.all_chains(s)) == 12
    assert {m.name for m in neighbours.loopless_up(algebra.independence(s))} == {"AB:C:D", "AC:B:D", "AD:B:C", "A:BC:D", "A:BD:C", "A:B:CD"}
    r = search.search(local, "loopless", "up", "bic", 3, 3)
    assert r.best.value == min(c.value for c in r.candidates) and len(r.levels) == 3
    down = search.search(local, "loopless", "down", "aic", 2, 2)
    assert any(c.name == "ABC:ABD" or c.name == "ABC:BCD" or ":" in c.name for c in down.candidates)
    chains = search.search(local, "chain", statistic="aic")
    assert len(chains.candidates) == 12
    assert search.search(local, "full", "up", "bic", 2, 2).candidates
    edges = search.chow_liu(local)
    assert len(edges) == 3 and not search.tree_model(s, edges).has_loops


def test_directed(spark):
    s = drink(True)
    a = Analyzer(frame(spark, s), s)
    assert a.entropy(s.dependent) == pytest.approx(1.584604, abs=1e-6)
    assert algebra.bottom(s).name == "A:BCD"
    assert {m.name for m in neighbours.loopless_up(algebra.bottom(s))} == {"AB:CD", "AC:BD", "AD:BC"}
    fitted = a.fit_table("ABCD")
    cond = predict.conditional_dv(a.table, fitted, s)
    rows = cond.collect()
    assert len(rows) == 8 and sum(r["total"] for r in rows) == 1008
    best = predict.predictions_by_rank(fitted, s)
    assert {(r["B"], r["C"], r["D"]): r["prediction"] for r in best.collect()} == {(r["B"], r["C"], r["D"]): r["prediction"] for r in rows}
    cells = predict.confusion(a.table, cond, s)
    acc = predict.accuracy(cells).first()["accuracy"]
    assert 100 * acc == pytest.approx(predict.percent_correct(cond).first()["percent_correct"])
    assert predict.confusion_matrix(cells, s).count() == 3 and predict.class_scores(cells, s).count() == 3
    assert a.cond_dh("ABCD") > 0 and a.cond_dh(algebra.bottom(s)) == pytest.approx(0, abs=1e-9)
