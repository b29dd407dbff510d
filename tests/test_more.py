"""Chain messages, table sampling, quantiles, lattice steps, level fits, sinks, estimates, storage."""

import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontingent import algebra, service
from kontingent.errors import ModelError, ValidationError
from kontingent.functions import sequences
from kontingent.operators import binning, chain, storage
from kontingent.operators import analyzer as analyzer_module
from kontingent.operators import fit as fitting
from kontingent.operators import table as tables
from kontingent.operators.analyzer import Analyzer
from kontingent.plans import neighbours, search
from kontingent.progress import load_profile, load_records
from kontingent.schema import Schema, Variable
from kontingent.sources import formats, synthetic

SCHEMA = Schema((Variable("A", "A", 2), Variable("B", "B", 3), Variable("C", "C", 2)))


def a_table(spark, seed=1, schema=SCHEMA):
    rng = np.random.default_rng(seed)
    shape = [v.cardinality for v in schema]
    q = rng.random(shape)
    q.flat[1] = 0  # a state that never occurs
    q /= q.sum()
    rows = [(*map(int, c), float(q[tuple(c)])) for c in np.argwhere(q > 0)]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in schema.columns) + ", value double"), q


def vector(t, name, size):
    got = {r[name]: r["value"] for r in t.collect()}
    return np.array([got.get(k, 0.0) for k in range(size)])


def test_chain_messages(spark):
    p, q = a_table(spark)
    ab, bc = q.sum(2), q.sum(0)
    forward = chain.forward_pass(p, SCHEMA, "ABC")
    want = [q.sum((1, 2)), ab.T @ q.sum((1, 2))]
    want.append(bc.T @ (want[1] / want[1].sum()))
    for t, w, v in zip(forward, want, SCHEMA):
        assert vector(t, v.abbrev, v.cardinality) == pytest.approx(w / w.sum())
    exact = chain.forward_pass(p, SCHEMA, "ABC", conditional=True)
    for t, axes, v in zip(exact, ((1, 2), (0, 2), (0, 1)), SCHEMA):
        assert vector(t, v.abbrev, v.cardinality) == pytest.approx(q.sum(axes))
    backward = chain.backward_pass(p, SCHEMA, "ABC")
    last = np.full(2, 0.5)
    middle = bc @ last / (bc @ last).sum()
    first = ab @ middle / (ab @ middle).sum()
    for t, w, v in zip(backward, (first, middle, last), SCHEMA):
        assert vector(t, v.abbrev, v.cardinality) == pytest.approx(w)
    assert vector(chain.forward_backward(p, SCHEMA, "CA")[0], "C", 2) == pytest.approx(q.sum((0, 1)))
    assert chain.messages(p, SCHEMA, [0, 1]).count() == 3 * 5 and chain.forward_pass(p, SCHEMA, "") == []
    with pytest.raises(ModelError):
        chain.forward_pass(p, SCHEMA, "AA")


def test_table_samples(spark):
    p, q = a_table(spark, 3)
    n = 4000
    got = synthetic.sample_table(p.repartition(5), SCHEMA, n, seed=2)
    assert got.agg(F.sum("value")).first()[0] == n
    seen = np.zeros(q.shape)
    for r in got.collect():
        seen[r["A"], r["B"], r["C"]] = r["value"]
    assert np.abs(seen / n - q).max() < 0.03 and (seen[q == 0] == 0).all()
    again = synthetic.TableModel(SCHEMA, p.withColumn("value", F.col("value") * 50)).sampled_table(n, 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert synthetic.TableModel(SCHEMA, p).samples(10).count() == 10
    with pytest.raises(ValidationError):
        synthetic.sample_table(p.limit(0), SCHEMA, 5)


@pytest.mark.parametrize("most", [10_000, 30])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=3000), rng.integers(0, 4, 2001).astype(float), np.array([7.0]), np.repeat([1.0, 2.0], [1500, 1500])):
        df = spark.createDataFrame([(float(x),) for x in values], "x double").repartition(4)
        at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
        assert binning.exact_quantiles(df, at, most) == pytest.approx(np.quantile(values, at).tolist())
    assert binning.exact_quantiles(spark.createDataFrame([], "x double"), [0.5]) == []


def test_missing_rules_of_numeric_columns(spark):
    df = spark.createDataFrame([("1",), ("2",), ("nil",), ("abc",), ("10",)], "x string")
    for rule, labels in (("separate", 3), ("exclude", 2), ("ignore", 2)):
        assert len(binning.fit_column(df, "x", binning.BinSpec("width", bins=2, missing=rule)).labels) == labels
    profile = {r["column"]: r for r in binning.analyze(df.union(spark.createDataFrame([(" 1 ",), (None,)], "x string"))).collect()}
    assert (profile["x"]["unique_count"], profile["x"]["missing_count"], profile["x"]["n_rows"], profile["x"]["is_numeric"]) == (4, 2, 7, False)


def test_lattice_steps():
    s = Schema(tuple(Variable(c, c, 2) for c in "ABC"))
    m = algebra.parse_model(s, "AB:C")
    assert [x.name for x in neighbours.parents(m)] == ["ABC"]
    assert {x.name for x in neighbours.children(algebra.parse_model(s, "ABC"))} == {"AB:AC", "AB:BC", "AC:BC"}
    assert {x.name for x in neighbours.children(m)} == {"A:B:C"}


def test_loop_models_are_fitted_together(spark):
    s = Schema(tuple(Variable(c, c, 2) for c in "ABCD"))
    p, _ = a_table(spark, 4, s)
    t = p.withColumn("value", F.col("value") * 1000)
    models = [algebra.parse_model(s, x) for x in ("AB:BC:AC:D", "AB:BD:AD:C", "AC:CD:AD:B", "BC:CD:BD:A", "AB:BC:CD:AD")]
    together, alone = Analyzer(t, s), Analyzer(t, s)
    together.prefetch(models)
    assert len(together._fits) == 5
    for m in models:
        assert together.h(m) == pytest.approx(alone.h(m), abs=1e-12)
    together.release()


def test_frame_fit_follows_the_dense_one(spark, monkeypatch):
    p, q = a_table(spark, 6)
    m = algebra.parse_model(SCHEMA, "AB:BC:AC")
    dense, info = fitting.dense_ipf(q, m.relations)
    got, how = fitting.frame_ipf(p, m)
    for r in got.collect():
        assert r["value"] == pytest.approx(dense[r["A"], r["B"], r["C"]], abs=1e-9)
    assert how.iterations == info.iterations and how.converged
    dense, _ = fitting.dense_ipf(q, m.relations, fitting.IPFConfig(2, -1.0))
    swept = {(r["A"], r["B"], r["C"]): r["value"] for r in fitting.fixed_sweeps(p, m, 2).collect()}
    want = {tuple(map(int, at)): float(dense[tuple(at)]) for at in np.ndindex(dense.shape)}
    assert swept == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(fitting, "MAX_BROADCAST", 1)  # a large table: step by step
    assert {(r["A"], r["B"], r["C"]): r["value"] for r in fitting.fixed_sweeps(p, m, 2).collect()} == pytest.approx(want, abs=1e-12)


def test_matching_joins_by_what_both_have(spark):
    rows = [(0, 0, 0, 1.0), (0, None, None, 2.0), (None, 1, None, 3.0), (None, None, None, 4.0), (1, 1, 1, 5.0)]
    t = spark.createDataFrame(rows, "A int, B int, C int, value double")
    got = sorted((r["value_a"], r["value_b"]) for r in tables.matching(t, t, SCHEMA).collect())
    fits = lambda x, y: all(a is None or b is None or a == b for a, b in zip(x, y))
    assert got == sorted((x[3], y[3]) for x in rows for y in rows if fits(x[:3], y[:3]))
    assert tables.matching(t.limit(0), t, SCHEMA).count() == 0
    assert "NestedLoop" not in tables.matching(t.where("A = 0 and B = 0"), t.where("A = 1"), SCHEMA)._jdf.queryExecution().executedPlan().toString()


def test_sinks_and_metadata(spark, tmp_path):
    cols, target = sequences.parse_columns("R3,R5"), sequences.parse_column("R3")
    data = sequences.pair_dataset(sequences.naturals(spark, 50), cols, target)
    sequences.write_csv(data, str(tmp_path / "seq"))
    back = spark.read.option("header", True).csv(str(tmp_path / "seq"))
    assert back.columns == data.columns and back.count() == 49
    j = json.loads(sequences.generic_json(data, cols, target, "naturals"))
    assert j["columnCardinalities"] == [3, 5] and j["dvCardinality"] == 3 and len(j["data"]) == 49 and j["targetColumn"]["kind"] == "residue"
    with pytest.raises(ValidationError):
        sequences.generic_json(data, cols, target, limit=10)
    df = spark.createDataFrame([("x", "1"), ("y", "1")], "a string, b string")
    meta = json.loads(formats.metadata_json(df, dependent="b", names=["first"]))
    assert meta["data"] == [] and [v["name"] for v in meta["variables"]] == ["first", "b"] and meta["variables"][1]["isDependent"] and meta["variables"][0]["values"] == ["x", "y"]


def test_large_json_is_exploded(spark, tmp_path, monkeypatch):
    variables = [{"name": "a", "abbrev": "A", "cardinality": 2, "values": ["x", "y"]}, {"name": "b", "abbrev": "B", "cardinality": 2, "values": ["0", "1"]}]
    plain = {"name": "n", "variables": variables, "data": [["x", "0"], ["y", "1"], ["x", "1"]], "counts": [2, 3, 4]}
    coded = plain | {"format": "aggregated", "data": [[0, 0], [1, 1], [0, 1]]}
    for k, d in enumerate((plain, coded)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(d))
        small = formats.load(spark, str(path))
        monkeypatch.setattr(formats, "LARGE_JSON", 1)
        large = formats.load(spark, str(path))
        monkeypatch.undo()
        assert sorted(map(tuple, small.table().collect())) == sorted(map(tuple, large.table().collect())) and large.name == "n"


def test_first_seen_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string").coalesce(1)
    assert {r["value"]: r["code"] for r in formats.first_seen(df, "v").collect()} == {"b": 0, "a": 1, None: 2, "c": 3}
    assert formats.first_seen(df.limit(0), "v").count() == 0


def test_estimates():
    s = Schema(tuple(Variable(f"v{k}", f"V{k}", 3) for k in range(16)))
    up, down = search.estimate(s, "full", "bic", 3, 4), search.estimate(s, "full", "bic", 3, 4, direction="down")
    assert up["levels"][0]["models"] == 120 and down["levels"][0]["models"] == 16 and up["levels"][1]["loop_probability"] == 0
    assert up["seconds_low"] < up["seconds"] < up["seconds_high"] and any("large relations" in w for w in down["warnings"])
    assert search.estimate(s, "full", cores=8)["seconds"] < search.estimate(s, "full")["seconds"]
    assert search.estimate(s, "loopless", rows=5000)["seconds"] > search.estimate(s, "loopless")["seconds"]


DATA = {"name": "d", "variables": [{"name": n, "abbrev": n, "cardinality": 2, "isDependent": False} for n in "ABCDE"],
        "data": [[str(k >> j & 1) for j in range(5)] for k in range(32)], "counts": [float(1 + (7 * k) % 13) for k in range(32)]}


def test_a_search_is_cancelled_and_another_goes_on(spark, monkeypatch):
    """Both are held in a Spark job of their first level; one is cancelled there."""
    svc, sent = service.Service(spark), {"a": [], "b": []}
    reached, go = {k: threading.Event() for k in "ab"}, threading.Event()
    waits = analyzer_module.Analyzer.prefetch

    def held(self, models):
        name = "a" if not reached["a"].is_set() else "b"
        reached[name].set()
        if name == "a":  # a job that would take minutes
            spark.range(64).repartition(64).rdd.map(lambda _: __import__("time").sleep(5)).count()
        else:
            assert go.wait(60)
        return waits(self, models)

    monkeypatch.setattr(analyzer_module.Analyzer, "prefetch", held)
    message = lambda k, kind: {"type": kind, "requestId": k, "payload": {"data": DATA, "levels": 2}}
    a = svc.stream(message("a", "search_start"), sent["a"].append)
    assert reached["a"].wait(60)
    b = svc.stream(message("b", "search_start"), sent["b"].append)
    assert reached["b"].wait(60) and svc.stream(message("b", "search_start"), sent["b"].append) is None
    began = time.perf_counter()
    assert svc.stream(message("a", "search_cancel"), sent["a"].append) is a
    a.join(30)
    assert not a.is_running and time.perf_counter() - began < 30 and sent["a"][-1]["type"] == "cancelled"
    assert b.is_running
    go.set()
    b.join(120)
    assert sent["b"][-1]["type"] == "result" and sent["b"][-1]["payload"]["results"] and not svc.running
    assert svc.stream(message("a", "search_cancel"), sent["a"].append) is None and sent["a"][-1]["type"] == "error"
    assert svc.stream({"type": "?"}, sent["a"].append) is None
    assert not spark.sparkContext.getJobTags()
    # nothing is left behind: the next search runs
    monkeypatch.setattr(analyzer_module.Analyzer, "prefetch", waits)
    svc.stream(message("a", "search_start"), sent["a"].append).join(120)
    assert sent["a"][-1]["type"] == "result"


def test_profile_by_level_and_all_events(spark, tmp_path):
    s = Schema(tuple(Variable(c, c, 2) for c in "ABCD"))
    t, _ = a_table(spark, 4, s)
    events = []
    found, profile = search.profiled(Analyzer(t.withColumn("value", F.col("value") * 1000), s, local_states=0), "full", "up", "bic", 2, 2, progress=events.append, name="full search")
    kinds = {e.kind for e in events}
    assert {"search_started", "level_started", "model_batch", "level_complete", "search_complete"} <= kinds
    done = [e.data for e in events if e.kind == "level_complete"]
    assert [d["level"] for d in done] == [1, 2] and done[-1]["total_evaluated"] == profile.models and done[-1]["seconds_left"] == 0 and done[-1]["percent"] == 100
    assert [x.level for x in profile.levels] == [1, 2] and all(x.driver_peak_bytes > 0 for x in profile.levels)
    assert profile.levels[0].spark["jobs"] > 0 and profile.levels[0].spark["shuffle_write_bytes"] > 0 and profile.levels[0].spark["peak_memory_bytes"] > 0
    assert profile.operations["entropies"]["count"] >= 2 and profile.cache["misses"] > 0
    at = str(tmp_path / "profile.json")
    profile.save(at)
    assert load_profile(at) == profile and load_records(at)[0]["name"] == "full search"
    again = []
    a = Analyzer(t, s)
    a.tell = again.append
    a.h("AB:BC:AC:D")
    assert [e.kind for e in again if e.kind != "model_batch"][-1] == "ipf" and "ipf_sweep" in {e.kind for e in again}
    a.release()


def test_written_tables_can_be_dropped(spark):
    t = storage.materialise(spark.range(5))
    assert t.count() == 5
    path = t._stored_at
    storage.drop(t, spark.range(1))
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()


def test_compact_forms(spark):
    svc = service.Service(spark)
    cells = {"variables": [{"name": c, "abbrev": c, "cardinality": 2} for c in "AB"], "data": [{"key": [0, 0], "count": 30}, {"key": [0, 1], "count": 10}, {"key": [1, 1], "count": 60}], "model": "A:B"}
    got = svc.fit_compact(json.dumps(cells))
    assert got["success"] and got["converged"] and {tuple(c["key"]): round(c["count"], 6) for c in got["data"]} == {(0, 0): 12, (0, 1): 28, (1, 0): 18, (1, 1): 42}
    h = -(0.3 * np.log2(0.3) + 0.1 * np.log2(0.1) + 0.6 * np.log2(0.6))
    assert svc.entropy_compact(json.dumps(cells))["entropy"] == pytest.approx(h)
    assert not svc.fit_compact(json.dumps(cells | {"model": "A:X"}))["success"]
    request = {"columns": ["age", "city"], "data": [[str(k), "abc"[k % 3]] for k in range(30)] + [["NA"], ["7", "nil"]]}
    found = svc.analyze_columns(request)
    assert found["success"] and [c["suggestedStrategy"] for c in found["columns"]] == ["equalWidth", "none"] and found["columns"][1]["missingCount"] == 2
    configs = svc.suggest_bins(found)
    assert configs["configs"]["age"]["numBins"] == 5 and configs["configs"]["city"] == {"strategy": "none", "numBins": 3, "otherLabel": "Other", "missingHandling": "separateBin", "missingLabel": "Missing"}
    out = svc.apply_bins(request, configs)
    assert out["success"] and sum(out["counts"]) == 32 and [v["cardinality"] for v in out["variables"]] == [6, 4] and out["variables"][0]["values"][0] == "0.0-5.8"
    assert not svc.apply_bins({"columns": ["a"]}, configs)["success"]


def test_calibration_checks(spark):
    p, q = a_table(spark)
    m = algebra.parse_model(SCHEMA, "AB:BC")
    c = fitting.calibrate(p.withColumn("value", F.col("value") * 7), m, fitting.CalibrationConfig(normalize=True, check=True))
    assert tables.total(c.marginal(0b001)) == pytest.approx(1) and vector(c.marginal(0b010), "B", 3) == pytest.approx(q.sum((0, 2)))
    with pytest.raises(Exception, match="finite"):
        fitting.calibrate(p.withColumn("value", -F.col("value")), m, fitting.CalibrationConfig(check=True))
