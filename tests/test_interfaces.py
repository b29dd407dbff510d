"""Files, binning, sequences, synthetic data, service, command line, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from kontingent import cli, service
from kontingent.functions import sequences
from kontingent.operators import binning, table as tables
from kontingent.operators.analyzer import Analyzer
from kontingent.sources import formats, synthetic
from kontingent.streaming.contingency import refit

DATA = {"name": "toy", "variables": [{"name": "a", "abbrev": "A", "cardinality": 2, "values": ["x", "y"]}, {"name": "b", "abbrev": "B", "cardinality": 2},
                                     {"name": "c", "abbrev": "C", "cardinality": 2, "isDependent": True}],
        "data": [["x", "0", "0"], ["x", "1", "0"], ["y", "0", "1"], ["y", "1", "1"], ["x", 1, 1]], "counts": [20, 10, 15, 5, 10]}
SECTIONS = """:action
search
:nominal
alpha,2,1,A
skip,3,0,S
beta,2,2,B  # the dependent one
:data
1 1 2 5
2 3 1 7
"""


def test_json_round_trip(spark, tmp_path):
    d = formats.read_json(spark, json.dumps(DATA))
    assert d.sample_size() == 60 and tables.total(d.table()) == 60 and d.schema.is_directed
    again = formats.read_json(spark, formats.write_json(d))
    assert again.sample_size() == 60
    agg = formats.read_json(spark, formats.write_aggregated_json(d.table(), d.schema))
    assert {tuple(r) for r in agg.table().collect()} == {tuple(r) for r in d.table().collect()}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(DATA | {"data": [[str(x) for x in r] for r in DATA["data"]]}))
    assert tables.total(formats.read_json_frame(spark, str(path)).table()) == 60
    assert formats.load(spark, str(path)).name == "toy"


def test_sections_and_csv(spark, tmp_path):
    d = formats.read_sections(spark, SECTIONS)
    assert [v.name for v in d.schema] == ["alpha", "beta"] and d.sample_size() == 12 and d.options["action"] == "search"
    f = tmp_path / "t.csv"
    f.write_text("City,Age\n oslo ,3\nrome,4\noslo,3\n")
    d = formats.csv_to_dataset(spark, str(f), "*", "Age")
    assert tables.total(d.table()) == 3 and d.schema.dependent
    assert formats.parse_columns("1,city", ["City", "Age"]) == ["Age", "City"]
    with pytest.raises(Exception):
        formats.parse_columns("nope", ["City"])
    cells, s, m = formats.read_cells(spark, json.dumps({"variables": DATA["variables"], "data": {"010": 4, "111": 2}, "model": "AB:C"}))
    assert tables.total(cells) == 6 and m == "AB:C" and len(s) == 3


def test_binning(spark):
    assert binning.equal_width_breaks(0, 10, 5) == (0, 2, 4, 6, 8, 10) and binning.equal_width_breaks(3, 3, 2) == (2.5, 3.5)
    assert binning.range_labels((0, 10.5, 20)) == ("0-10", "10-20") and binning.semantic_labels(8)[7] == "Bin8"
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,), ("10",)], "v string")
    f = binning.fit_column(df, "v", binning.BinSpec("width", bins=3, labels="semantic"))
    assert f.labels == ("Low", "Medium", "High", "Missing")
    assert sorted(r[0] for r in df.select(binning.label_column("v", f)).collect()) == ["High", "Low", "Low", "Missing", "Missing"]
    assert binning.parse_spec("age:width:5")[1].bins == 5
    with pytest.raises(Exception):
        binning.parse_spec("age")


def test_sequences(spark):
    assert [r["n"] for r in sequences.primes(spark, 10).collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    c = sequences.parse_columns("R3")
    t, s = sequences.to_table(sequences.pair_dataset(sequences.primes(spark, 1000), c, c[0]), c, c[0])
    assert tables.total(t) == 999 and s.is_directed
    got = sequences.naturals(spark, 12).select("n", sequences.digit_sum(F.col("n")).alias("d"), sequences.prime_factors("n").alias("f"), sequences.collatz_steps("n").alias("c")).orderBy("n").collect()
    assert [r["f"] for r in got] == [0, 1, 1, 2, 1, 2, 1, 3, 2, 2, 1, 3] and got[11]["d"] == 3 and got[5]["c"] == 8


def test_synthetic(spark):
    s = synthetic.parse_variables("A:2,B:3,C:2")
    t = synthetic.sample(spark, synthetic.model_from_spec(s, "AB:BC", 0.9), 4000, seed=1)
    a = Analyzer(t, s)
    assert a.n == 4000 and a.mutual_information(0, 1) > 0.1 and a.mutual_information(1, 2) > 0.1
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, synthetic.sample(spark, synthetic.model_from_spec(s, "AB:BC", 0.9), 4000, seed=1).collect()))
    loop = Analyzer(synthetic.sample(spark, synthetic.model_from_spec(s, "AB:BC:AC", 0.9), 2000), s)
    assert loop.n == 2000 and synthetic.star_model(s).parents and synthetic.connected_model(s).parents[2] == (0, 1)


def test_service_and_rpc(spark):
    svc = service.Service(spark)
    assert svc.health()["status"] == "ok" and svc.data_info({"data": DATA})["sampleSize"] == 60
    assert svc.fit_model({"data": DATA, "model": "AB:AC"})["df"] == 5
    assert svc.search({"data": DATA, "levels": 2})["results"] and svc.estimate({"data": DATA})["models"] > 0
    said = []
    svc.stream({"type": "search_start", "payload": {"data": DATA, "levels": 1}}, said.append).join()
    assert said[-1]["type"] == "result" and said[0]["type"] == "progress"
    rpc = service.JsonRpc(svc)
    assert "error" in json.loads(rpc.handle("{")) and rpc.handle('{"jsonrpc":"2.0","method":"x"}') is None
    call = lambda name, **a: json.loads(rpc.handle(json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})))
    assert "error" in call("info") and "result" in call("load_data", data=DATA) and "result" in call("fit", model="AB:C")


def test_cli(spark, tmp_path):
    f = tmp_path / "d.json"
    f.write_text(json.dumps(DATA))
    out = []
    for argv in (["info", str(f)], ["fit", str(f), "--model", "ABC", "--conditional-dv"], ["table", str(f), "--model", "AB:C"], ["search", str(f), "--levels", "2"], ["lattice", "A:2,B:2,C:2"],
                 ["samplesize", "1000"], ["generate", "A:2,B:2", "--model", "AB", "--samples", "50"], ["sequence", "--count", "50"], ["preprocess", str(f)], ["convert", str(f)]):
        before = len(out)
        cli.run(cli.parser().parse_args(argv), spark, out.append)
        assert len(out) > before, argv


def test_cli_bin_keeps_counts_and_residuals_are_whole(spark, tmp_path):
    f = tmp_path / "d.json"
    f.write_text(json.dumps(DATA))
    for argv in (["bin", str(f)], ["bin", str(f), "--spec", "a:top:1"]):
        out = []
        cli.run(cli.parser().parse_args(argv), spark, out.append)
        assert sum(r["value"] for r in json.loads(out[0])) == 60
    wide = {"name": "w", "variables": [{"name": n, "abbrev": n.upper(), "cardinality": 1200 if n == "a" else 2} for n in "ab"], "data": [[str(k), str(k % 2)] for k in range(1200)]}
    f.write_text(json.dumps(wide))
    out = []
    cli.run(cli.parser().parse_args(["fit", str(f), "--model", "A:B", "--residuals"]), spark, out.append)
    assert len(out) > 1200


def test_missing_values_of_the_reference(spark):
    cells = ["", "NA", "na", "N/A", "n/a", "NaN", "nan", "null", "NULL", "Null", "nil", "NIL", ".", "-", "?", "None", "none", "NONE", "#N/A", "#NA", "#NULL!", "nile"]
    df = spark.createDataFrame([(c,) for c in cells], "a string")
    got, _ = binning.apply_binning(df, {"a": binning.BinSpec("top", top=2, missing="exclude")})
    assert [tuple(r) for r in got.collect()] == [("nile", 1.0)]


def test_stream(spark, tmp_path):
    d = formats.read_json(spark, json.dumps(DATA))
    rows = d.rows.select(F.when(F.col("a") == "x", 0).otherwise(1).alias("A"), F.col("b").cast("int").alias("B"), F.col("c").cast("int").alias("C"))
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    q = refit(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), d.schema, ["AB:C"], lambda k, r: got.append(r), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert got and got[0][0]["model"] == "AB:C"
