"""Command line: python -m kontingent.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from . import algebra
from .errors import KontingentError
from .functions import sequences
from .operators import binning, predict
from .operators.analyzer import Analyzer
from .plans import neighbours
from .plans import search as searching
from .schema import Schema
from .sources import formats, synthetic


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kontingent", description="Structure discovery in categorical data")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args, **more):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in more.items():
            flag = f"--{k.replace('_', '-')}"
            c.add_argument(flag, action="store_true") if v is False else c.add_argument(flag, default=v, type=type(v) if v is not None else str)

    add("info", "input")
    add("fit", "input", model="", compare=None, residuals=False, conditional_dv=False, confusion_matrix=False)
    add("table", "input", model="")
    add("search", "input", direction="up", filter="loopless", width=3, levels=7, sort="ddf", start=None)
    add("lattice", "variables", loopless=False, max_models=10000)
    add("generate", "variables", model="", samples=1000, strength=0.8, seed=0, output=None)
    add("sequence", kind="primes", count=1000, columns="R3", target="R3", mode="pairs", output=None)
    add("samplesize", "sample")
    add("convert", "input", output=None)
    add("analyze-csv", "input", delimiter=",", no_header=False)
    add("csv-to-json", "input", output=None, columns=None, dv=None, delimiter=",", no_header=False)
    add("bin", "input", spec=None, auto=False, output=None)
    add("preprocess", "input", output=None, columns=None, auto_bin=0)
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("kontingent").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def run(args: argparse.Namespace, spark, out=print) -> None:
    c = args.command

    def emit(text: str) -> None:
        if getattr(args, "output", None):
            with open(args.output, "w") as f:
                f.write(text)
        else:
            out(text)

    if c == "samplesize":
        bases = sequences.largest_residue_set(int(args.sample))
        return out(json.dumps({"residues": bases, **sequences.assess_sample(float(args.sample), [*bases, 3])}))
    if c == "lattice":
        s = synthetic.parse_variables(args.variables)
        return [out(f"{level}\t{m.name}\t{'loops' if loops else '-'}") for m, loops, level in neighbours.lattice(s, args.loopless, args.max_models)] and None
    if c == "generate":
        s = synthetic.parse_variables(args.variables)
        g = synthetic.model_from_spec(s, args.model, args.strength, args.seed) if args.model else synthetic.independent_model(s)
        return emit(formats.write_aggregated_json(synthetic.sample(spark, g, args.samples, args.seed), s))
    if c == "sequence":
        cols, target = sequences.parse_columns(args.columns), sequences.parse_column(args.target)
        build = sequences.pair_dataset if args.mode == "pairs" else sequences.single_dataset
        t, s = sequences.to_table(build(sequences.generate(spark, args.kind, args.count), cols, target), cols, target)
        return emit(formats.write_aggregated_json(t, s))
    if c == "analyze-csv":
        df = formats.read_csv(spark, args.input, not args.no_header, args.delimiter)
        return [out(json.dumps(r.asDict())) for r in formats.infer_values(df).collect()] and None
    if c == "csv-to-json":
        return emit(formats.write_json(formats.csv_to_dataset(spark, args.input, args.columns, args.dv, not args.no_header, args.delimiter)))
    data = formats.load(spark, args.input)
    if c == "info":
        return out(json.dumps({"name": data.name, "sampleSize": data.sample_size(), "stateSpace": data.schema.cells(), "variables": formats.variables_json(data.schema)}))
    if c == "convert":
        return emit(formats.write_json(data))
    if c == "preprocess":
        return emit(formats.write_aggregated_json(*formats.preprocess(data, args.columns, args.auto_bin or None)))
    if c == "bin":
        rows, count = data.rows, "value" if "value" in data.rows.columns else None
        t, fitted = binning.auto_bin(rows, count=count) if args.auto or not args.spec else binning.apply_binning(rows, dict([binning.parse_spec(x) for x in args.spec.split(";")]), count)
        return emit(json.dumps([r.asDict() for r in t.collect()]))
    a = Analyzer(data.table(), data.schema)
    if c == "search":
        found = searching.search(a, args.filter, args.direction, args.sort, args.width, args.levels, args.start)
        for k, x in enumerate(found.candidates[:10]):
            out(f"{k + 1}\t{x.name}\t{x.value:.4f}\tlevel {x.level}")
        return out(f"and {len(found.candidates) - 10} more") if len(found.candidates) > 10 else None
    m = algebra.parse_model(a.schema, args.model) if args.model else algebra.bottom(a.schema)
    if c == "table":
        return [out(json.dumps(r)) for r in a.model_relation_metrics(m)] and None
    out(json.dumps(asdict(a.fit(m))))
    if args.compare:
        out(json.dumps({"alpha": a.incremental_alpha(m, args.compare)}))
    if args.residuals:
        [out(json.dumps(r.asDict())) for r in a.residuals(m).orderBy(*a.schema.columns).toLocalIterator()]
    if args.conditional_dv or args.confusion_matrix:
        cond = predict.conditional_dv(a.table, a.fit_table(m), a.schema)
        shown = cond if args.conditional_dv else predict.confusion_matrix(predict.confusion(a.table, cond, a.schema), a.schema)
        [out(json.dumps(r.asDict())) for r in shown.toLocalIterator()]
    return None


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args, session())
    except KontingentError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


__all__ = ["Schema", "main", "parser", "run"]

if __name__ == "__main__":
    sys.exit(main())
