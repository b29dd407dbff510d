"""Registered queries over the driver's tables, and their SQL twins.

Most queries analyse one data set: lineitem's return flag (A), line status (B),
quantity in five equal bins (C) and line number (D).  Doubles are rounded on
both sides, as sums depend on the order of addition.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import algebra
from ..functions import sequences, special
from ..graph import junction_forest
from ..operators import binning, chain, fit, predict
from ..operators import table as tables
from ..operators.analyzer import Analyzer
from ..schema import Schema, Variable
from ..sources import formats
from ..sources.synthetic import chain_model, sample, sample_table
from . import neighbours, search

VALUE = tables.VALUE
# Labels of the nominal columns, sorted.
FLAGS, STATUS = ("A", "N", "R"), ("F", "O")
# Texts that are looked at as missing values, padded ones and words that are none among them.
MISSING_PROBES = ("", "NA", "na", "N/A", "n/a", "NaN", "nan", "null", "NULL", "Null", "nil", "NIL", ".", "-", "?", "None", "none", "NONE", "#N/A", "#NA", "#NULL!",
                  " NA ", "Unknown", "missing", "--", "Nan", "Nil", "0", "undefined")
BREAKS = binning.equal_width_breaks(1.0, 50.0, 5)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_schema(dependent: str = "") -> Schema:
    return Schema((Variable("l_returnflag", "A", 3, dependent == "A", FLAGS), Variable("l_linestatus", "B", 2, dependent == "B", STATUS),
                   Variable("quantity_bin", "C", 5, dependent == "C"), Variable("line_number", "D", 7, dependent == "D")))


def line_table(spark: SparkSession, sf: str, dependent: str = "") -> DataFrame:
    raw = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", binning.bin_code(F.col("l_quantity"), BREAKS).alias("quantity_bin"), (F.col("l_linenumber") - 1).alias("line_number"))
    return tables.encode(raw, line_schema(dependent))


def analyzer(spark: SparkSession, sf: str, dependent: str = "") -> Analyzer:
    return Analyzer(line_table(spark, sf, dependent), line_schema(dependent))


def rounded(df: DataFrame, digits: int = 8, *names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c), digits).alias(c) if kinds[c] == "double" and (not names or c in names) else F.col(c) for c in df.columns])


def probabilities(spark, sf, dependent=""):
    t = line_table(spark, sf, dependent)
    return tables.normalize(t), line_schema(dependent)


# SQL pieces ---------------------------------------------------------------------------

_CASE = "case " + " ".join(f"when l_quantity < {b!r} then {k}" for k, b in enumerate(BREAKS[1:-1])) + f" else {len(BREAKS) - 2} end"
_T = f"""t as (select cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as integer) as A, cast(case l_linestatus when 'F' then 0 else 1 end as integer) as B,
  cast({_CASE} as integer) as C, cast(l_linenumber - 1 as integer) as D, cast(count(*) as double) as value from lineitem group by all),
p as (select A, B, C, D, value / (select sum(value) from t) as value from t)"""
_N = "(select sum(value) from t)"


def _h(cols: str) -> str:
    """Entropy of a margin of t as a scalar query."""
    by = ", ".join(cols)
    return f"(select log2(sum(v)) - sum(v * log2(v)) / sum(v) from (select sum(value) as v from t group by {by}))"


def _m(cols: str, src: str = "p") -> str:
    by = ", ".join(cols)
    return f"(select {by}, sum(value) as v from {src} group by {by})"


def _model_sql(name: str, plus: list[str], minus: list[str], df: int) -> str:
    h = " + ".join(_h(c) for c in plus) + "".join(f" - {_h(c)}" for c in minus)
    return f"""with {_T}, s as (select {h} as h, {_h('ABCD')} as hd, {_N} as n)
select '{name}' as model, round(h, 8) as h, round(hd - h, 8) as t, cast({df} as bigint) as df, cast({209 - df} as bigint) as ddf,
  round(2 * n * ln(2) * (h - hd), 5) as lr, round(2 * n * ln(2) * (h - hd) - 2 * {df}, 5) as aic,
  round(2 * n * ln(2) * (h - hd) - {209 - df} * ln(n), 5) as bic from s"""


# Queries ----------------------------------------------------------------------------------

def contingency(spark, sf):
    return line_table(spark, sf)


def project_bc(spark, sf):
    return tables.project(line_table(spark, sf), line_schema(), 0b0110)


def normalize(spark, sf):
    return rounded(probabilities(spark, sf)[0], 10)


def coverage(spark, sf):
    return tables.coverage(line_table(spark, sf), line_schema())


def point_lookup(spark, sf):
    return tables.find(line_table(spark, sf), A=1, B=0)


def wildcard_match(spark, sf):
    """Margins of A, AB and B matched against each other: a summed-out variable matches everything."""
    s = line_schema()
    m = tables.project_many(line_table(spark, sf), s, [0b0001, 0b0011, 0b0010])
    return tables.matching(m, m, s).select("A_a", "B_a", "value_a", "A_b", "B_b", "value_b")


def marginal_entropies(spark, sf):
    s = line_schema()
    masks = [1 << k for k in range(4)] + [1 << i | 1 << j for i, j in combinations(range(4), 2)]
    e = tables.entropies(line_table(spark, sf), s, masks)
    name = F.create_map(*[x for m in masks for x in (F.lit(m).cast("long"), F.lit("".join(s.names(m))))])
    return rounded(e.select(F.element_at(name, F.col("mask")).alias("relation"), "entropy", "n", "states"))


def mutual_information(spark, sf):
    with analyzer(spark, sf) as a:
        rows = [("".join(a.schema.names(1 << i | 1 << j)), round(x, 8) + 0.0) for i, j, x in a.all_mutual_information()]
        return spark.createDataFrame(rows, "pair string, mi double")


def kl_divergence(spark, sf):
    """Divergence of the data from the independence fit."""
    p, s = probabilities(spark, sf)
    return rounded(tables.transmission(p, fit.fit_independence(p, s), s))


def max_entropy(spark, sf):
    """The largest entropy that each margin could have, and the one it has."""
    with analyzer(spark, sf) as a:
        s, masks = a.schema, (0b1, 0b11, 0b111, 0b1111)
        h = a.entropies(masks)
        return spark.createDataFrame([("".join(s.names(m)), round(tables.max_entropy(s, m), 10), round(h[m], 8)) for m in masks], "relation string, h_max double, h double")


def _model_row(name):
    def run(spark, sf):
        with analyzer(spark, sf) as a:
            n = a.model(name)
            row = (name, round(a.h(n), 8), round(a.t(n), 8) + 0.0, a.df(n), a.ddf(n), round(a.lr(n), 5) + 0.0, round(a.aic(n), 5), round(a.bic(n), 5))
            return spark.createDataFrame([row], "model string, h double, t double, df long, ddf long, lr double, aic double, bic double")

    return run


def model_fit_table(spark, sf):
    """All statistics of a model with a loop."""
    with analyzer(spark, sf) as a:
        return rounded(a.fit_frame("AB:BC:AC:D"), 4)


def relation_metrics(spark, sf):
    with analyzer(spark, sf) as a:
        rows = [tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in a.relation_metrics(m).values()) for m in (0b0011, 0b0110, 0b1100)]
        return spark.createDataFrame(rows, "relation string, h double, t double, df long, lr double, p2 double")


def _fit(name):
    def run(spark, sf):
        p, s = probabilities(spark, sf)
        return rounded(fit.fit_forest(p, algebra.parse_model(s, name)), 10)

    return run


def ipf_triangle(spark, sf):
    """Three IPF sweeps of AB:BC:AC from the uniform table over A, B, C."""
    p, s = probabilities(spark, sf)
    small = s.select(["A", "B", "C"])
    return rounded(fit.fixed_sweeps(tables.project(p, s, 0b0111), algebra.parse_model(small, "AB:BC:AC"), 3), 10)


def residuals(spark, sf):
    p, s = probabilities(spark, sf)
    small = s.select(["A", "B", "C"])
    p = tables.project(p, s, 0b0111)
    return rounded(tables.residuals(p, fit.fit_forest(p, algebra.parse_model(small, "AB:BC")), small), 10)


def pearson_p2(spark, sf):
    t, s = line_table(spark, sf), line_schema()
    n = tables.total(t)
    p = tables.normalize(t, n)
    return rounded(tables.pearson(p, fit.fit_independence(p, s), s, n), 4)


def potential_algebra(spark, sf):
    """P(AB) P(BC) / P(B) by potential multiplication and division."""
    p, s = probabilities(spark, sf)
    product = fit.multiply(tables.project(p, s, 0b0011), tables.project(p, s, 0b0110))
    return rounded(fit.divide(product, tables.project(p, s, 0b0010)).select("A", "B", "C", VALUE), 10)


def junction_marginal(spark, sf):
    """Margin of A and C of the fit AB:BC, which no clique covers."""
    p, s = probabilities(spark, sf)
    small = s.select(["A", "B", "C"])
    return rounded(fit.calibrate(tables.project(p, s, 0b0111), algebra.parse_model(small, "AB:BC")).marginal(0b101), 10)


def calibrated_cliques(spark, sf):
    """Margins of the cliques and the separator of the calibrated tree AB:BC, from counts."""
    s = line_schema()
    small = s.select(["A", "B", "C"])
    t = tables.project(line_table(spark, sf), s, 0b0111)
    c = fit.calibrate(t, algebra.parse_model(small, "AB:BC"), fit.CalibrationConfig(normalize=True, check=True))
    parts = [*c.cliques, *c.separators.values()]
    out = None
    for part in parts:
        rows = part.select(F.lit("".join(x for x in part.columns if x != VALUE)).alias("part"), *[(F.col(x) if x in part.columns else F.lit(None).cast("int")).alias(x) for x in "ABC"], VALUE)
        out = rows if out is None else out.union(rows)
    return rounded(out, 10)


def cond_entropy(spark, sf):
    with analyzer(spark, sf, "A") as a:
        rows = [(m, round(a.cond_h(m), 8), round(a.cond_dh(m), 8) + 0.0) for m in ("A:BCD", "AB:CD", "ABCD")]
        return spark.createDataFrame(rows, "model string, cond_h double, cond_dh double")


def directed_fit(spark, sf):
    """What models that predict A take off its entropy, in bits, in percent and as a coefficient."""
    with analyzer(spark, sf, "A") as a:
        rows = []
        for name in ("AB:BCD", "ABC:BCD", "ABCD"):
            r = a.fit(name, pearson=False)
            h = a.entropy(a.schema.dependent)
            rows.append((name, round(r.cond_h, 8), round(r.cond_dh, 8), round(r.percent_dh, 6), round(special.uncertainty_coefficient(h, r.cond_h), 8)))
        return spark.createDataFrame(rows, "model string, cond_h double, cond_dh double, percent_dh double, uncertainty double")


def _conditional(spark, sf):
    t, s = line_table(spark, sf, "A"), line_schema("A")
    return t, s, predict.conditional_dv(t, tables.normalize(t), s)


def conditional_dv(spark, sf):
    _, _, c = _conditional(spark, sf)
    return c.select("B", "C", "D", *[F.round(F.element_at("probabilities", k + 1), 8).alias(f"p{k}") for k in range(3)], "prediction", "correct", "total")


def predictions_by_rank(spark, sf):
    p, s = probabilities(spark, sf, "A")
    return rounded(predict.predictions_by_rank(p, s), 8)


def confusion_matrix(spark, sf):
    t, s, c = _conditional(spark, sf)
    return predict.confusion_matrix(predict.confusion(t, c, s), s)


def class_scores(spark, sf):
    t, s, c = _conditional(spark, sf)
    return rounded(predict.class_scores(predict.confusion(t, c, s), s), 8)


def accuracy(spark, sf):
    t, s, c = _conditional(spark, sf)
    cells = predict.confusion(t, c, s)
    return rounded(predict.accuracy(cells).crossJoin(predict.percent_correct(c)), 8)


def incremental_alpha(spark, sf):
    """LR and p-value of the step from independence to AB (two degrees of freedom: a closed form)."""
    with analyzer(spark, sf) as a:
        lr = abs(a.lr("AB:C:D") - a.lr("A:B:C:D"))
        return spark.createDataFrame([(round(lr, 5), round(a.incremental_alpha("AB:C:D", "A:B:C:D"), 6))], "lr double, alpha double")


def _level(filter, direction="up", start=None, dependent="", digits=5):
    def run(spark, sf):
        with analyzer(spark, sf, dependent) as a:
            first = algebra.reference_model(a.schema, start)
            rows = [(r["model"], round(r["lr"], digits) + 0.0, int(r["df"]), round(r["bic"], digits)) for r in a.evaluate(neighbours.rule(filter, direction)(first), ("lr", "df", "bic"))]
            return spark.createDataFrame(rows, "model string, lr double, df long, bic double")

    return run


def all_chains(spark, sf):
    with analyzer(spark, sf) as a:
        return spark.createDataFrame([(r["model"], round(r["h"], 8)) for r in a.evaluate(neighbours.all_chains(a.schema), ("h",))], "model string, h double")


def lattice_partitions(spark, sf):
    """All models of the lattice, with what lineitem says of each."""
    with analyzer(spark, sf) as a:
        found = neighbours.lattice(a.schema)
        a.prefetch([m for m, _, _ in found])
        return spark.createDataFrame([(m.name, loops, level, round(a.h(m), 8), round(a.bic(m), 4)) for m, loops, level in found], "model string, has_loops boolean, level int, h double, bic double")


def directed_lattice(spark, sf):
    """All models that predict A, with the entropy of A that each leaves."""
    with analyzer(spark, sf, "A") as a:
        found = neighbours.lattice(a.schema)
        a.prefetch([m for m, _, _ in found])
        return spark.createDataFrame([(m.name, level, round(a.h(m), 8), round(a.cond_h(m), 8)) for m, _, level in found], "model string, level int, h double, cond_h double")


def beam_search(spark, sf):
    with analyzer(spark, sf) as a:
        return rounded(search.search(a, "loopless", "up", "bic", 3, 3).frame(a), 5)


def full_search(spark, sf):
    with analyzer(spark, sf) as a:
        return rounded(search.search(a, "full", "up", "bic", 2, 2).frame(a), 4)


def search_down(spark, sf):
    with analyzer(spark, sf) as a:
        return rounded(search.search(a, "loopless", "down", "bic", 3, 2).frame(a), 5)


def chow_liu(spark, sf):
    """The tree of greatest mutual information over lineitem's variables."""
    with analyzer(spark, sf) as a:
        return spark.createDataFrame([("".join(a.schema.names(1 << i | 1 << j)), round(x, 10)) for i, j, x in search.chow_liu(a)], "edge string, mi double")


def search_estimate(spark, sf):
    """Cost of searches over lineitem's states in both directions: a row per level, and level 0 for the whole."""
    rows, states = [], line_table(spark, sf).count()
    for filter, direction in (("full", "up"), ("full", "down"), ("loopless", "up")):
        e = search.estimate(line_schema(), filter, "bic", 3, 5, states, direction, 8)
        kind = f"{filter} {direction}"
        rows += [(kind, r["level"], r["models"], round(r["loop_probability"], 10), round(r["seconds"], 8)) for r in e["levels"]]
        rows.append((kind, 0, e["models"], round(e["seconds_low"], 8), round(e["seconds_high"], 8)))
    return spark.createDataFrame(rows, "search string, level int, models int, loop_probability double, seconds double")


def power_table(spark, sf):
    """Each pair of variables: the likelihood ratio of its dependence, its p-value, and the power to find one as large."""
    with analyzer(spark, sf) as a:
        rows = []
        for i, j, mi in a.all_mutual_information():
            df, x = (a.schema[i].cardinality - 1) * (a.schema[j].cardinality - 1), 2 * a.n * special.LN2 * mi
            rows.append(("".join(a.schema.names(1 << i | 1 << j)), df, round(x, 5), round(special.chi2_sf(x, df), 7), round(special.power(df, x), 6)))
        return spark.createDataFrame(rows, "pair string, df int, lr double, alpha double, power double")


def chain_messages(spark, sf):
    """Forward and backward messages and margins along A, B, C, D."""
    p, s = probabilities(spark, sf)
    return rounded(chain.messages(p, s, "ABCD"), 10)


def table_samples(spark, sf):
    """3000 samples of the table of A, B, C, D."""
    return sample_table(line_table(spark, sf), line_schema(), 3000, seed=7)


def missing_values(spark, sf):
    """Which texts mean a missing value: all indicators, some in other letters, and some words that are none."""
    texts = F.array(*map(F.lit, MISSING_PROBES))
    v = read(spark, sf, "orders").select(F.element_at(texts, (F.pmod("o_orderkey", F.lit(len(MISSING_PROBES))) + 1).cast("int")).alias("text"))
    return v.groupBy("text", binning.is_missing(F.col("text")).alias("missing")).agg(F.count("*").alias("n"))


def ipf_converged(spark, sf):
    """The fit of AB:BC:AC:D, until it converges, by the analyzer's dispatcher."""
    with analyzer(spark, sf) as a:
        return rounded(a.fit_table("AB:BC:AC:D"), 6)


def frame_ipf_converged(spark, sf):
    """The same fit over A, B, C as DataFrame sweeps."""
    p, s = probabilities(spark, sf)
    small = s.select(["A", "B", "C"])
    return rounded(fit.frame_ipf(tables.project(p, s, 0b0111), algebra.parse_model(small, "AB:BC:AC"))[0], 6)


def scale_step(spark, sf):
    """One step of proportional fitting: the uniform table over A, B, C scaled to the margin AB."""
    p, s = probabilities(spark, sf)
    small = s.select(["A", "B", "C"])
    model = algebra.parse_model(small, "AB:BC:AC")
    q = fit.start_table(tables.project(p, s, 0b0111), model)
    return rounded(fit.scale_by_margin(q, tables.project(p, s, 0b0011), ["A", "B"]), 10)


def state_enumeration(spark, sf):
    """Every state of A to D, the first running fastest, and how often it occurs."""
    counted = tables.domain(spark, line_schema()).join(line_table(spark, sf), line_schema().columns, "left")
    return counted.select("state", *line_schema().columns, F.coalesce(VALUE, F.lit(0.0)).alias(VALUE))


def _binned(spec, table="lineitem", column="l_extendedprice"):
    def run(spark, sf):
        df = read(spark, sf, table).select(column)
        f = binning.fit_column(df, column, spec)
        return df.select(binning.code_column(column, f).alias("code")).groupBy("code").agg(F.count("*").alias("n"))

    return run


def bin_topn(spark, sf):
    out, _ = binning.apply_binning(read(spark, sf, "part").select("p_brand"), {"p_brand": binning.BinSpec("top", top=5)})
    return out


def bin_threshold(spark, sf):
    out, _ = binning.apply_binning(read(spark, sf, "documents").select("lang"), {"lang": binning.BinSpec("threshold", threshold=0.12)})
    return out


def _missing(rule):
    def run(spark, sf):
        df = read(spark, sf, "orders").select(F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "N/A").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(F.pmod("o_orderkey", F.lit(7)) == 0, " ? ").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
        out, _ = binning.apply_binning(df, {"priority": binning.BinSpec("top", top=2, missing=rule), "price": binning.BinSpec("breaks", breaks=(0.0, 100000.0, 200000.0, 1e6), labels="semantic", missing=rule)})
        return out

    return run


def auto_bin(spark, sf):
    out, _ = binning.auto_bin(read(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linenumber"), target=3, threshold=10)
    return out


def column_profile(spark, sf):
    return binning.analyze(read(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_discount", "l_linenumber"))


def infer_values(spark, sf):
    v = formats.infer_values(read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    return v.select("column", "n_rows", "cardinality", F.array_join("values", "|").alias("labels"))


def first_seen_codes(spark, sf):
    return formats.first_seen(read(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select("n_name"), "n_name").select("value", F.col("code").cast("long").alias("code"))


def preprocess_auto_bin(spark, sf):
    data = formats.dataset_from_frame(read(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("string").alias("l_linenumber")))
    return formats.preprocess(data, "*", auto_bin=3)[0]


def _numbers(spark, sf, table="orders", column="o_orderkey"):
    """The distinct numbers of a key column."""
    return read(spark, sf, table).select(F.col(column).cast("long").alias("n")).where("n > 0").distinct()


def residues_pairs(spark, sf):
    """The part keys of lineitem in order: residues of 3 and 5 against the next key's residue of 3."""
    c = sequences.parse_columns("R3,R5")
    return sequences.to_table(sequences.pair_dataset(_numbers(spark, sf, "lineitem", "l_partkey"), c, c[0]), c, c[0])[0]


def prime_residues(spark, sf):
    """The prime order keys: each one's residue of 3 against the next one's."""
    c, keys = sequences.parse_columns("R3"), _numbers(spark, sf)
    top = keys.agg(F.max("n").alias("n")).first()["n"] or 1
    return sequences.to_table(sequences.pair_dataset(sequences.primes_below(spark, top).join(keys, "n", "left_semi"), c, c[0]), c, c[0])[0]


def digit_sums(spark, sf):
    return _numbers(spark, sf).select("n", sequences.digit_sum(F.col("n")).alias("digits"))


def collatz(spark, sf):
    return _numbers(spark, sf, "part", "p_partkey").select("n", sequences.collatz_steps("n").alias("steps"))


def prime_factor_counts(spark, sf):
    return _numbers(spark, sf, "part", "p_partkey").select("n", sequences.prime_factors("n").alias("factors"))


def synthetic_chain(spark, sf):
    """As many samples of a chain as lineitem has rows, beside lineitem's own counts."""
    own = line_table(spark, sf)
    made = sample(spark, chain_model(line_schema(), 0.8), int(tables.total(own)), seed=3).withColumnRenamed(VALUE, "sampled")
    both = made.join(own.withColumnRenamed(VALUE, "observed"), line_schema().columns, "full")
    return both.select(*line_schema().columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sampled", "observed")])


def events_markov(spark, sf):
    """Each user's event type against the one that follows."""
    from pyspark.sql import Window as W

    e = read(spark, sf, "events").select("user_id", "event_type", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("following"))
    return e.where("following is not null").groupBy("event_type", "following").agg(F.count("*").alias("n"))


def quality_by_language(spark, sf):
    """A directed system over documents and labels: toxicity by language and quality."""
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    s = Schema((Variable("lang", "L", 4, False, ("de", "en", "es", "fr")), Variable("quality", "Q", 2), Variable("toxic", "T", 2, True)))
    a = Analyzer(tables.encode(d, s), s)
    rows = [(m, round(a.cond_dh(m), 8) + 0.0, round(a.lr(m), 5) + 0.0, a.df(m)) for m in ("LQ:T", "LT:Q", "L:QT")]
    return spark.createDataFrame(rows, "model string, cond_dh double, lr double, df long")


QUERIES = {
    "contingency": contingency, "project": project_bc, "normalize": normalize, "coverage": coverage, "point_lookup": point_lookup, "wildcard_match": wildcard_match,
    "marginal_entropies": marginal_entropies, "mutual_information_matrix": mutual_information, "kl_divergence": kl_divergence, "max_entropy": max_entropy,
    "model_independence": _model_row("A:B:C:D"), "model_chain": _model_row("AB:BC:CD"), "model_star": _model_row("AB:AC:AD"), "model_saturated": _model_row("ABCD"),
    "model_triangle_fit": model_fit_table, "relation_metrics": relation_metrics,
    "fit_independence": _fit("A:B:C:D"), "fit_chain_AB_BC": _fit("AB:BC:D"), "fit_jt_ABC_BCD": _fit("ABC:BCD"), "fit_forest_AB_CD": _fit("AB:CD"),
    "ipf_triangle": ipf_triangle, "residuals": residuals, "pearson_p2": pearson_p2, "potential_algebra": potential_algebra, "junction_marginal": junction_marginal, "calibrated_cliques": calibrated_cliques,
    "cond_entropy": cond_entropy, "directed_fit": directed_fit, "conditional_dv": conditional_dv, "predictions_by_rank": predictions_by_rank, "confusion_matrix": confusion_matrix,
    "class_scores": class_scores, "accuracy": accuracy, "incremental_alpha": incremental_alpha,
    "loopless_up_level1": _level("loopless"), "full_up_level1": _level("full"), "disjoint_up_level1": _level("disjoint"), "disjoint_down_level1": _level("disjoint", "down", "ABCD"),
    "loopless_down_level1": _level("loopless", "down", "ABCD"), "all_chains": all_chains, "lattice_partitions": lattice_partitions, "directed_lattice": directed_lattice,
    "beam_search": beam_search, "full_search": full_search, "search_down": search_down, "chow_liu_edges": chow_liu, "search_estimate": search_estimate, "power_table": power_table,
    "state_enumeration": state_enumeration, "bin_equal_width": _binned(binning.BinSpec("width", bins=5)), "bin_quantile": _binned(binning.BinSpec("quantile", bins=4)),
    "bin_breaks": _binned(binning.BinSpec("breaks", breaks=(0.0, 10000.0, 50000.0, 200000.0))), "bin_topn": bin_topn, "bin_threshold": bin_threshold,
    "missing_bin": _missing("separate"), "missing_exclude": _missing("exclude"), "missing_ignore": _missing("ignore"), "auto_bin": auto_bin, "column_profile": column_profile,
    "infer_values": infer_values, "first_seen_codes": first_seen_codes, "preprocess_auto_bin": preprocess_auto_bin, "residues_pairs": residues_pairs, "prime_residues": prime_residues,
    "digit_sums": digit_sums, "collatz": collatz, "prime_factors": prime_factor_counts, "synthetic_chain": synthetic_chain, "events_markov": events_markov,
    "quality_by_language": quality_by_language, "chain_messages": chain_messages, "table_samples": table_samples, "missing_values": missing_values,
    "ipf_converged": ipf_converged, "frame_ipf_converged": frame_ipf_converged, "scale_step": scale_step,
    "loopless_up_directed": _level("loopless", "up", "bottom", "A"), "loopless_down_directed": _level("loopless", "down", "top", "A"),
    "full_up_directed": _level("full", "up", "AB:CD", "A"), "full_up_level2": _level("full", "up", "AB:BC:D", digits=2), "full_down_level": _level("full", "down", "ABC:BCD", digits=2),
    "pairs_up_level": _level("pairs", "up", "AB:C:D"), "pairs_down_level": _level("pairs", "down", "ABC:D"),
    "lattice_parents": _level(neighbours.parents, "up", "AB:CD"), "lattice_children": _level(neighbours.children, "down", "ABC:CD", digits=2),
}


# SQL twins ------------------------------------------------------------------------------------

_INDEP = f"(select a.A, b.B, c.C, d.D, a.v * b.v * c.v * d.v as value from {_m('A')} a, {_m('B')} b, {_m('C')} c, {_m('D')} d)"
_COND = f"""g as (select B, C, D, sum(case when A = 0 then value else 0 end) as n0, sum(case when A = 1 then value else 0 end) as n1,
  sum(case when A = 2 then value else 0 end) as n2 from t group by B, C, D),
k as (select *, n0 + n1 + n2 as total, cast(case when n0 >= n1 and n0 >= n2 then 0 when n1 >= n2 then 1 else 2 end as integer) as prediction from g),
f as (select t.A as actual, k.prediction as predicted, sum(t.value) as value from t join k using (B, C, D) group by all)"""


def _level_sql(models: list[tuple[str, list[str], list[str], int]]) -> str:
    rows = []
    for name, plus, minus, df in models:
        h = " + ".join(_h(c) for c in plus) + "".join(f" - {_h(c)}" for c in minus)
        rows.append(f"select '{name}' as model, {h} as h, cast({df} as bigint) as df")
    return f"""with {_T}, m as ({' union all '.join(rows)}), s as (select {_h('ABCD')} as hd, {_N} as n)
select model, round(2 * n * ln(2) * (h - hd), 5) as lr, df, round(2 * n * ln(2) * (h - hd) - (209 - df) * ln(n), 5) as bic from m, s"""


_CARD = {"A": 3, "B": 2, "C": 5, "D": 7}


def _cells(rel: str) -> int:
    out = 1
    for c in rel:
        out *= _CARD[c]
    return out - 1


def _simple(names: list[str], minus: dict[str, list[str]] | None = None):
    """Rows of (model, cliques, separators, df) for decomposable models."""
    minus = minus or {}
    return [(m, m.split(":"), minus.get(m, []), sum(map(_cells, m.split(":"))) - sum(map(_cells, minus.get(m, [])))) for m in names]


_PAIRS = ["AB:C:D", "AC:B:D", "AD:B:C", "A:BC:D", "A:BD:C", "A:B:CD"]
_SPLITS = {"ABC:ABD": ["AB"], "ABC:ACD": ["AC"], "ABC:BCD": ["BC"], "ABD:ACD": ["AD"], "ABD:BCD": ["BD"], "ACD:BCD": ["CD"]}
_CHAINS = {}
for _a, _b, _c, _d in [x for x in permutations("ABCD") if x[0] < x[3]]:
    _rel = sorted("".join(sorted(x)) for x in (_a + _b, _b + _c, _c + _d))
    _CHAINS[":".join(_rel)] = (_rel, [_b, _c])

_PARTITIONS = [("A:B:C:D", 0), *[(m, 1) for m in _PAIRS], *[(m, 2) for m in ("AB:CD", "AC:BD", "AD:BC", "ABC:D", "ABD:C", "ACD:B", "A:BCD")], ("ABCD", 3)]
_BIN_CASE = "case when x < b1 then 0 when x < b2 then 1 when x < b3 then 2 when x < b4 then 3 else 4 end"
_MISSING_BASE = """b as (select case when o_orderkey % 5 = 0 then null else o_orderpriority end as pr, case when o_orderkey % 7 = 0 then null else o_totalprice end as x from orders),
top as (select pr from b where pr is not null group by pr order by count(*) desc, pr limit 2),
l as (select case when pr is null then {p} when pr in (select pr from top) then pr else 'Other' end as priority,
  case when x is null then {x} when x < 100000 then 'Low' when x < 200000 then 'Medium' else 'High' end as price from b)"""


def _missing_sql(p: str, x: str, where: str = "") -> str:
    return f"with {_MISSING_BASE.format(p=p, x=x)} select priority, price, cast(count(*) as double) as value from l {where} group by all"


def _ipf_sql(sweeps: int) -> str:
    parts = [f"{_T}, q0 as (select A, B, C, 1.0 / 30 as value from (select unnest(range(3))::int as A), (select unnest(range(2))::int as B), (select unnest(range(5))::int as C))"]
    k = 0
    for _ in range(sweeps):
        for r in ("AB", "BC", "AC"):
            parts.append(f"q{k + 1} as (select q.A, q.B, q.C, q.value * m.v / h.v as value from q{k} q join {_m(r)} m on {' and '.join(f'q.{c} = m.{c}' for c in r)} join {_m(r, f'q{k}')} h on {' and '.join(f'q.{c} = h.{c}' for c in r)})")
            k += 1
    return f"with {', '.join(parts)} select A, B, C, round(value, 10) as value from q{k}"


def _fit_ctes(relations: tuple[str, ...], over: str, sweeps: int, name: str) -> tuple[list[str], str]:
    """CTEs that fit a model by so many sweeps from the uniform table over the variables; the last one's name."""
    sides = ", ".join(f"(select unnest(range({_CARD[c]}))::int as {c})" for c in over)
    cells = _cells(over) + 1
    cols = ", ".join(f"q.{c}" for c in over)
    parts, k = [f"{name}0 as materialized (select {', '.join(over)}, 1.0::double / {cells} as value from {sides})"], 0
    for _ in range(sweeps):
        for r in relations:
            on = [" and ".join(f"q.{c} = {x}.{c}" for c in r) for x in "mh"]
            parts.append(f"{name}{k + 1} as materialized (select {cols}, q.value * m.v / h.v as value from {name}{k} q join {_m(r)} m on {on[0]} join {_m(r, f'{name}{k}')} h on {on[1]})")
            k += 1
    return parts, f"{name}{k}"


def _gamma_p(a: str, y: str, terms: int = 400) -> str:
    """The regularised lower incomplete gamma function as a sum."""
    return f"list_sum(list_transform(range({terms}), lambda n: exp(({a} + n) * ln({y}) - ({y}) - lgamma({a} + n + 1))))"


_PROBES = ", ".join(f"({k}, '{v}')" for k, v in enumerate(MISSING_PROBES))


def _line_model(name: str) -> algebra.Model:
    return algebra.parse_model(line_schema(), name)


def _entropy_sql(m: algebra.Model, ctes: list[str]) -> str:
    """The entropy of a model: from margins, or by fitting one with loops (its CTEs are added)."""
    if not m.has_loops:
        forest, names = junction_forest(m.relations), m.schema.names
        plus, minus = ["".join(names(c)) for c in forest.cliques], ["".join(names(e)) for e in forest.separators if e]
        rest = "".join(f" + log2({_CARD[c]})" for c in names(m.uncovered))
        return " + ".join(map(_h, plus)) + "".join(f" - {_h(c)}" for c in minus) + rest
    relations = tuple("".join(m.schema.names(r)) for r in m.relations)
    parts, last = _fit_ctes(relations, "ABCD", 12, f"f{len(ctes)}_")
    ctes += parts
    return f"(select -sum(value * log2(value)) from {last} where value > 0)"


def _models_sql(models: list[algebra.Model], digits: int = 5) -> str:
    """LR, degrees of freedom and BIC of models, as a level's query gives them."""
    ctes: list[str] = []
    rows = [f"select '{m.name}' as model, {_entropy_sql(m, ctes)} as h, cast({_df_of(m)} as bigint) as df" for m in models]
    more = "".join(f", {c}" for c in ctes)
    return f"""with {_T}{more}, m as ({' union all '.join(rows)}), s as (select {_h('ABCD')} as hd, {_N} as n)
select model, round(2 * n * ln(2) * (h - hd), {digits}) as lr, df, round(2 * n * ln(2) * (h - hd) - (209 - df) * ln(n), {digits}) as bic from m, s"""


def _df_of(m: algebra.Model) -> int:
    return _df_sets(tuple("".join(m.schema.names(r)) for r in m.relations))


def _df_sets(relations: tuple[str, ...]) -> int:
    """Free parameters: (cardinality - 1) multiplied over each set of variables that some relation holds."""
    held = {frozenset(c) for r in relations for k in range(1, len(r) + 1) for c in combinations(r, k)}
    out = 0
    for part in held:
        n = 1
        for c in part:
            n *= _CARD[c] - 1
        out += n
    return out


# Searches by themselves: a model is a sorted tuple of sorted strings, and nothing of the library's rules or graph tests is used.

def _tidy(relations) -> tuple[str, ...]:
    """Without relations that lie inside another."""
    own = {"".join(sorted(r)) for r in relations}
    return tuple(sorted(r for r in own if not any(r != q and set(r) <= set(q) for q in own)))


def _ears(m: tuple[str, ...]) -> list[tuple[str, str]] | None:
    """(relation, what it shares with the rest), taken off one after the other; None where a loop leaves none to take."""
    left, out = list(m), []
    while left:
        for r in left:
            rest = [q for q in left if q != r]
            shared = set(r) & set("".join(rest))
            if not rest or any(shared <= set(q) for q in rest):
                out.append((r, "".join(sorted(shared))))
                left.remove(r)
                break
        else:
            return None
    return out


def _merges(m: tuple[str, ...]):
    """A pair of variables that no relation holds brings the last relations with one of them together."""
    for a, b in combinations("ABCD", 2):
        x, y = [r for r in m if a in r], [r for r in m if b in r]
        if x and y and not set(x) & set(y):
            yield _tidy([r for r in m if r not in (x[-1], y[-1])] + [x[-1] + "".join(c for c in y[-1] if c not in x[-1])])


def _splits(m: tuple[str, ...]):
    """A pair of variables that one relation alone holds, and not by itself, is taken apart."""
    for a, b in combinations("ABCD", 2):
        own = [r for r in m if a in r and b in r]
        if len(own) == 1 and len(own[0]) > 2:
            yield _tidy([r for r in m if r != own[0]] + [own[0].replace(a, ""), own[0].replace(b, "")])


def _steps(m: tuple[str, ...], kind: str) -> list[tuple[str, ...]]:
    if kind == "full up":
        pairs = (_tidy([*m, a + b]) for a, b in combinations("ABCD", 2) if not any(a in r and b in r for r in m))
        return list(dict.fromkeys([*_merges(m), *pairs]))
    found = _merges(m) if kind == "loopless up" else _splits(m)
    return [x for x in dict.fromkeys(found) if _ears(x) is not None]


def _beam_sql(kind: str, start: str, width: int, levels: int, digits: int) -> str:
    """A beam search by BIC: statistics of all models in reach and the steps between them; SQL makes the choice."""
    first = _tidy(start.split(":"))
    edges, reach, now = [], [first], [first]
    for _ in range(levels):
        steps = [(m, x) for m in now for x in _steps(m, kind)]
        edges += steps
        now = [x for x in dict.fromkeys(x for _, x in steps) if x not in reach]
        reach += now
    ctes: list[str] = []

    def h(m: tuple[str, ...]) -> str:
        ears = _ears(m)
        if ears is not None:
            return " + ".join(_h(r) for r, _ in ears) + "".join(f" - {_h(s)}" for _, s in ears if s)
        parts, last = _fit_ctes(m, "ABCD", 12, f"f{len(ctes)}_")
        ctes.extend(parts)
        return f"(select -sum(value * log2(value)) from {last} where value > 0)"

    rows = [f"select '{':'.join(m)}' as model, {h(m)} as h, {_df_sets(m)} as df, {str(_ears(m) is None).lower()} as has_loops" for m in reach]
    parts = [_T, *ctes, f"m as materialized ({' union all '.join(rows)})", f"s as (select {_h('ABCD')} as hd, {_N} as n)",
             "stats as materialized (select model, 2 * n * ln(2) * (h - hd) - (209 - df) * ln(n) as stat, has_loops from m, s)",
             "steps as (select * from (values " + ", ".join(f"('{':'.join(a)}', '{':'.join(b)}')" for a, b in dict.fromkeys(edges)) + ") v(parent, child))",
             f"k0 as (select '{':'.join(first)}' as model)"]
    for k in range(1, levels + 1):
        parts.append(f"k{k} as materialized (select model from stats where model in (select child from steps where parent in (select model from k{k - 1})) order by stat, model limit {width})")
    every = " union all ".join(f"select model, {k} as level from k{k}" for k in range(levels + 1))
    return f"""with {', '.join(parts)}, kept as (select model, min(level) as level from ({every}) group by model)
select cast(row_number() over (order by stat, model) as int) as rank, model, round(stat, {digits}) as statistic, level, has_loops from kept join stats using (model)"""


_TRIANGLE, _TRIANGLE_LAST = _fit_ctes(("AB", "BC", "AC"), "ABC", 12, "q")
_TRIANGLE_FIT = f"""with {_T}, {', '.join(_TRIANGLE)}, f as (select q.A, q.B, q.C, d.D, q.value * d.v as value from {_TRIANGLE_LAST} q, {_m('D')} d),
s as (select {_h('ABCD')} as hd, {_N} as n, (select -sum(value * log2(value)) from f) as h, (select count(*) from t) / 210.0 as coverage,
  (select sum((coalesce(p.value, 0) - f.value) * (coalesce(p.value, 0) - f.value) / f.value) from f left join p using (A, B, C, D)) as gap),
g as (select *, 2 * n * ln(2) * (h - hd) as lr, 27 as df, 182 as ddf from s),
c as (with recursive b(lo, hi, k) as (select 100.0::double, 400.0::double, 0 union all
  select case when below then mid else lo end, case when below then hi else mid end, k + 1 from
    (select lo, hi, k, (lo + hi) / 2 as mid, {_gamma_p('91', '((lo + hi) / 4)')} < 0.95 as below from b where k < 60)) select (lo + hi) / 2 as crit from b where k = 60)
select 'AB:AC:BC:D' as model, round(h, 4) as h, round(hd - h, 4) as t, cast(df as bigint) as df, cast(ddf as bigint) as ddf, round(lr, 4) as lr, round(n * gap, 4) as p2,
  round(1 - {_gamma_p('91', '(lr / 2)')}, 4) as alpha,
  round(1 - list_sum(list_transform(range(700), lambda k: exp(k * ln(lr / 2) - lr / 2 - lgamma(k + 1)) * {_gamma_p('(91 + k)', '(crit / 2)')})), 4) as beta,
  round(lr - 2 * df, 4) as aic, round(lr - ddf * ln(n), 4) as bic, 0.0::double as cond_h, 0.0::double as cond_dh, 0.0::double as percent_dh, round(coverage, 4) as coverage,
  true as has_loops, 'ipf' as method from g, c"""
_PAIR_NAMES = ["".join(x) for x in combinations("ABCD", 2)]
_TREES = [x for x in combinations(_PAIR_NAMES, 3) if len(set("".join(x))) == 4]  # three edges that touch all four variables are a tree
_CHAIN = "ABCD"


def _messages_sql() -> str:
    parts = [_T, f"a0 as (select A as code, v as value from {_m('A')})", "b3 as (select unnest(range(7))::int as code, 1.0::double / 7 as value)"]
    for i in (1, 2, 3):
        x, y = _CHAIN[i - 1], _CHAIN[i]
        parts.append(f"a{i} as (select code, value / sum(value) over () as value from (select m.{y} as code, sum(m.v * a.value) as value from {_m(x + y)} m join a{i - 1} a on a.code = m.{x} group by m.{y}))")
    for i in (2, 1, 0):
        x, y = _CHAIN[i], _CHAIN[i + 1]
        parts.append(f"b{i} as (select code, value / sum(value) over () as value from (select m.{x} as code, sum(m.v * b.value) as value from {_m(x + y)} m join b{i + 1} b on b.code = m.{y} group by m.{x}))")
    rows = [f"select '{name}' as pass, {i} as place, '{c}' as variable, code, round(value, 10) as value from {t}{i}" for name, t in (("forward", "a"), ("backward", "b")) for i, c in enumerate(_CHAIN)]
    rows += [f"select 'marginal', {i}, '{c}', {c}, round(v, 10) from {_m(c)}" for i, c in enumerate(_CHAIN)]
    return f"with {', '.join(parts)} {' union all '.join(rows)}"


def _uniform_sql(number: str, stream: str) -> str:
    return f"(('0x' || substr(md5('{stream}:' || cast({number} as varchar)), 1, 13))::bigint / 4503599627370496.0::double)"


def _chain_sample_sql() -> str:
    """The chain model of synthetic_chain by itself: each variable keeps the one before with strength 0.8, else it is uniform."""
    cols, inner = ["i"], "select unnest(range((select count(*) from lineitem))) as i"
    for k, c in enumerate("ABCD"):
        card, u = _CARD[c], _uniform_sql("i", f"3:{k}")
        if not k:
            code = f"least(floor({u} * {card}), {card - 1})::int"
        else:
            before = f"({'ABCD'[k - 1]} % {card})"
            # the running sum before the favoured code grows by 0.2 / card a code, at it by 0.8 more
            code = f"""(case when {u} < {before} * 0.2 / {card} then least(floor({u} * {card} / 0.2), {before} - 1)
              when {u} < ({before} + 1) * 0.2 / {card} + 0.8 then {before} else least({before} + 1 + floor(({u} - ({before} + 1) * 0.2 / {card} - 0.8) * {card} / 0.2), {card - 1}) end)::int"""
        inner = f"select *, {code} as {c} from ({inner})"
        cols.append(c)
    made = f"select A, B, C, D, cast(count(*) as double) as sampled from ({inner}) group by all"
    return f"with {_T}, made as ({made}) select A, B, C, D, coalesce(sampled, 0) as sampled, coalesce(value, 0) as observed from made full join t using (A, B, C, D)"


def _relation_sql(r: str) -> str:
    a, b = r
    df = (_CARD[a] - 1) * (_CARD[b] - 1)
    return f"""select '{r}' as relation, round({_h(r)}, 5) as h, round({_h(a)} + {_h(b)} - {_h(r)}, 5) as t, cast({df} as bigint) as df,
  round(2 * {_N} * ln(2) * ({_h(a)} + {_h(b)} - {_h(r)}), 5) as lr,
  round({_N} * (select sum((x.v - y.v * z.v) * (x.v - y.v * z.v) / (y.v * z.v)) from {_m(r)} x join {_m(a)} y on x.{a} = y.{a} join {_m(b)} z on x.{b} = z.{b}), 5) as p2"""


ORACLES = {
    "contingency": f"with {_T} select * from t",
    "project": f"with {_T} select B, C, sum(value) as value from t group by B, C",
    "normalize": f"with {_T} select A, B, C, D, round(value, 10) as value from p",
    "coverage": f"with {_T} select count(*) as observed_states, 210.0::double as possible_states, count(*) / 210.0::double as coverage from t",
    "point_lookup": f"with {_T} select * from t where A = 1 and B = 0",
    "wildcard_match": f"""with {_T}, m as (select A, null::int as B, sum(value) as value from t group by A union all select A, B, sum(value) from t group by A, B union all select null::int, B, sum(value) from t group by B)
select x.A as A_a, x.B as B_a, x.value as value_a, y.A as A_b, y.B as B_b, y.value as value_b from m x, m y
where (x.A is null or y.A is null or x.A = y.A) and (x.B is null or y.B is null or x.B = y.B)""",
    "marginal_entropies": f"with {_T} " + " union all ".join(
        f"select '{c}' as relation, round(log2(sum(v)) - sum(v * log2(v)) / sum(v), 8) as entropy, sum(v) as n, count(*) as states from (select sum(value) as v from t group by {', '.join(c)})"
        for c in ["A", "B", "C", "D", "AB", "AC", "AD", "BC", "BD", "CD"]),
    "mutual_information_matrix": f"with {_T} " + " union all ".join(f"select '{a}{b}' as pair, round(greatest(0, {_h(a)} + {_h(b)} - {_h(a + b)}), 8) as mi" for a, b in combinations("ABCD", 2)),
    "kl_divergence": f"with {_T} select round(sum(p.value * log2(p.value / q.value)), 8) as kl from p join {_INDEP} q using (A, B, C, D)",
    "max_entropy": f"with {_T} " + " union all ".join(f"select '{r}' as relation, round(log2({_cells(r) + 1}), 10) as h_max, round({_h(r)}, 8) as h" for r in ("A", "AB", "ABC", "ABCD")),
    "model_independence": _model_sql("A:B:C:D", list("ABCD"), [], 13),
    "model_chain": _model_sql("AB:BC:CD", ["AB", "BC", "CD"], ["B", "C"], 5 + 9 + 34 - 1 - 4),
    "model_star": _model_sql("AB:AC:AD", ["AB", "AC", "AD"], ["A", "A"], 5 + 14 + 20 - 4),
    "model_saturated": _model_sql("ABCD", ["ABCD"], [], 209),
    "relation_metrics": f"with {_T} " + " union all ".join(map(_relation_sql, ("AB", "BC", "CD"))),
    "fit_independence": f"with {_T} select A, B, C, D, round(value, 10) as value from {_INDEP}",
    "fit_chain_AB_BC": f"with {_T} select x.A, x.B, y.C, d.D, round(x.v * y.v / s.v * d.v, 10) as value from {_m('AB')} x join {_m('BC')} y on x.B = y.B join {_m('B')} s on s.B = x.B, {_m('D')} d",
    "fit_jt_ABC_BCD": f"with {_T} select x.A, x.B, x.C, y.D, round(x.v * y.v / s.v, 10) as value from {_m('ABC')} x join {_m('BCD')} y on x.B = y.B and x.C = y.C join {_m('BC')} s on s.B = x.B and s.C = x.C",
    "fit_forest_AB_CD": f"with {_T} select x.A, x.B, y.C, y.D, round(x.v * y.v, 10) as value from {_m('AB')} x, {_m('CD')} y",
    "ipf_triangle": _ipf_sql(3),
    "residuals": f"""with {_T}, o as (select A, B, C, sum(value) as v from p group by A, B, C),
f as (select x.A, x.B, y.C, x.v * y.v / s.v as v from {_m('AB')} x join {_m('BC')} y on x.B = y.B join {_m('B')} s on s.B = x.B)
select f.A, f.B, f.C, round(coalesce(o.v, 0), 10) as observed, round(f.v, 10) as fitted, round(coalesce(o.v, 0) - f.v, 10) as residual from f left join o on o.A = f.A and o.B = f.B and o.C = f.C""",
    "pearson_p2": f"with {_T} select round({_N} * sum((coalesce(p.value, 0) - q.value) * (coalesce(p.value, 0) - q.value) / q.value), 4) as p2 from {_INDEP} q left join p using (A, B, C, D)",
    "potential_algebra": f"with {_T} select x.A, x.B, y.C, round(x.v * y.v / s.v, 10) as value from {_m('AB')} x join {_m('BC')} y on x.B = y.B join {_m('B')} s on s.B = x.B",
    "junction_marginal": f"with {_T} select x.A, y.C, round(sum(x.v * y.v / s.v), 10) as value from {_m('AB')} x join {_m('BC')} y on x.B = y.B join {_m('B')} s on s.B = x.B group by x.A, y.C",
    "calibrated_cliques": f"with {_T} select 'AB' as part, A, B, null::int as C, round(v, 10) as value from {_m('AB')} union all select 'BC', null, B, C, round(v, 10) from {_m('BC')} union all select 'B', null, B, null, round(v, 10) from {_m('B')}",
    "cond_entropy": f"""with {_T} select 'A:BCD' as model, round({_h('A')}, 8) as cond_h, 0.0::double as cond_dh
union all select 'AB:CD', round({_h('AB')} + {_h('CD')} - {_h('BCD')}, 8), round({_h('A')} - ({_h('AB')} + {_h('CD')} - {_h('BCD')}), 8)
union all select 'ABCD', round({_h('ABCD')} - {_h('BCD')}, 8), round({_h('A')} - {_h('ABCD')} + {_h('BCD')}, 8)""",
    "directed_fit": f"with {_T}, m as (" + " union all ".join(f"select '{m}' as model, {h} - {_h('BCD')} as c" for m, h in (
        ("AB:BCD", f"{_h('AB')} + {_h('BCD')} - {_h('B')}"), ("ABC:BCD", f"{_h('ABC')} + {_h('BCD')} - {_h('BC')}"), ("ABCD", _h("ABCD"))))
        + f"), a as (select {_h('A')} as h) select model, round(c, 8) as cond_h, round(h - c, 8) as cond_dh, round(100 * (h - c) / h, 6) as percent_dh, round((h - c) / h, 8) as uncertainty from m, a",
    "conditional_dv": f"with {_T}, {_COND} select B, C, D, round(n0 / total, 8) as p0, round(n1 / total, 8) as p1, round(n2 / total, 8) as p2, prediction, case prediction when 0 then n0 when 1 then n1 else n2 end as correct, total from k",
    "predictions_by_rank": f"with {_T}, {_COND} select B, C, D, prediction, round(case prediction when 0 then n0 when 1 then n1 else n2 end / total, 8) as probability from k",
    "confusion_matrix": f"with {_T}, {_COND} select actual, sum(case when predicted = 0 then value else 0 end) as predicted_0, sum(case when predicted = 1 then value else 0 end) as predicted_1, sum(case when predicted = 2 then value else 0 end) as predicted_2 from f group by actual",
    "class_scores": f"""with {_T}, {_COND} select cast(code as int) as code, round(coalesce((select sum(value) from f where actual = code and predicted = code) / (select sum(value) from f where predicted = code), 0), 8) as precision,
round(coalesce((select sum(value) from f where actual = code and predicted = code) / (select sum(value) from f where actual = code), 0), 8) as recall from range(3) r(code)""",
    "accuracy": f"with {_T}, {_COND} select round(sum(case when actual = predicted then value else 0 end) / sum(value), 8) as accuracy, round(100 * sum(case when actual = predicted then value else 0 end) / sum(value), 8) as percent_correct from f",
    "incremental_alpha": f"with {_T}, s as (select 2 * {_N} * ln(2) * ({_h('A')} + {_h('B')} - {_h('AB')}) as lr) select round(lr, 5) as lr, round(exp(-lr / 2), 6) as alpha from s",
    "loopless_up_level1": _level_sql(_simple(_PAIRS)),
    "full_up_level1": _level_sql(_simple(_PAIRS)),
    "disjoint_up_level1": _level_sql(_simple(_PAIRS)),
    "disjoint_down_level1": _level_sql(_simple(["A:BCD", "ACD:B", "ABD:C", "ABC:D"])),
    "loopless_down_level1": _level_sql(_simple(list(_SPLITS), _SPLITS)),
    "all_chains": f"with {_T} " + " union all ".join(f"select '{m}' as model, round({' + '.join(map(_h, r))} - {' - '.join(map(_h, s))}, 8) as h" for m, (r, s) in _CHAINS.items()),
    "lattice_partitions": f"with {_T}, m as (" + " union all ".join(
        f"select '{m}' as model, {k}::int as level, {' + '.join(map(_h, m.split(':')))} as h, {sum(map(_cells, m.split(':')))} as df" for m, k in _PARTITIONS)
        + f") select model, false as has_loops, level, round(h, 8) as h, round(2 * {_N} * ln(2) * (h - {_h('ABCD')}) - (209 - df) * ln({_N}), 4) as bic from m",
    "directed_lattice": f"with {_T}, m as (" + " union all ".join(
        f"select '{m}' as model, {k}::int as level, {' + '.join(map(_h, m.split(':')))} as h" for m, k in (("A:BCD", 0), ("AB:CD", 1), ("AC:BD", 1), ("AD:BC", 1), ("ABC:D", 2), ("ABD:C", 2), ("ACD:B", 2), ("ABCD", 3)))
        + f") select model, level, round(h, 8) as h, round(h - {_h('BCD')}, 8) as cond_h from m",
    "chow_liu_edges": f"with {_T}, e as materialized (" + " union all ".join(f"select '{r}' as edge, {_h(r[0])} + {_h(r[1])} - {_h(r)} as mi" for r in _PAIR_NAMES)
        + "), tree as (select names from (" + " union all ".join(f"select '{':'.join(x)}' as names, (select sum(mi) from e where edge in {x!r}) as total" for x in _TREES)
        + ") order by total desc limit 1) select edge, round(mi, 10) as mi from e, tree where contains(names, edge)",
    "search_estimate": f"with {_T}," + """ k as (select * from (values ('full up', false, true), ('full down', true, true), ('loopless up', false, false)) v(search, down, isfull)),
l as (select search, isfull, level, case when level = 1 then case when down then 4 else 6 end else 3 * greatest(4, case when down then 6 - 3 * level else 6 - level end) end as models,
  case when isfull and level > 2 then least(0.95, 1 - exp(-10 * 4.0 * level * level * level * 2 / (3.0 * 16 * 9))) else 0.0 end as p,
  (1 + (select count(*) from t) / 1000.0 + 4 / 10.0) / (1 + 7 * 0.7) / 1000 as scale from k, range(1, 6) r(level))
select search, cast(level as int) as level, cast(models as int) as models, round(p::double, 10) as loop_probability, round((models * (1 - p) * 5 + models * p * 500) * scale, 8)::double as seconds from l
union all select search, 0, cast(sum(models) as int), round(sum((models * (1 - p) * 2.5 + models * p * 150) * scale), 8)::double, round(sum((models * (1 - p) * 20 + models * p * 2000) * scale), 8)::double from l group by search""",
    "power_table": f"with recursive {_T}, m as materialized (" + " union all ".join(
        f"select '{a}{b}' as pair, {(_CARD[a] - 1) * (_CARD[b] - 1)}::int as df, 2 * {_N} * ln(2) * greatest(0, {_h(a)} + {_h(b)} - {_h(a + b)}) as x" for a, b in combinations("ABCD", 2))
        + f"""), b(pair, df, lo, hi, k) as (select pair, df, 0.0::double, 100.0::double, 0 from m union all
  select pair, df, case when below then mid else lo end, case when below then hi else mid end, k + 1 from
    (select *, (lo + hi) / 2 as mid, {_gamma_p('(df / 2.0)', '((lo + hi) / 4)')} < 0.95 as below from b where k < 60)),
c as (select m.pair, m.df, x, (lo + hi) / 2 as crit from m join b on m.pair = b.pair where k = 60)
select pair, df, round(x, 5) as lr, round(1 - {_gamma_p('(df / 2.0)', '(x / 2)')}, 7) as alpha,
  round(1 - list_sum(list_transform(range(300), lambda k: exp(k * ln(x / 2) - x / 2 - lgamma(k + 1)) * {_gamma_p('(df / 2.0 + k)', '(crit / 2)', 200)})), 6) as power from c""",
    "chain_messages": _messages_sql(),
    "table_samples": f"""with {_T}, c as (select A, B, C, D, sum(value) over (order by A, B, C, D) / {_N} as hi from t), b as (select *, lag(hi, 1, 0) over (order by hi) as lo from c),
u as (select {_uniform_sql('i', '7')} as u from range(3000) r(i))
select A, B, C, D, cast(count(*) as double) as value from u join b on u.u >= b.lo and u.u < b.hi group by all""",
    "missing_values": f"""with v as (select * from (values {_PROBES}) v(k, text)) select text, trim(text) in ({', '.join(repr(x) for x in MISSING_PROBES[:21])}) as missing, count(*) as n
from orders join v on v.k = o_orderkey % {len(MISSING_PROBES)} group by text""",
    "ipf_converged": f"with {_T}, {', '.join(_TRIANGLE)} select q.A, q.B, q.C, d.D, round(q.value * d.v, 6) as value from {_TRIANGLE_LAST} q, {_m('D')} d where q.value * d.v > 0",
    "frame_ipf_converged": f"with {_T}, {', '.join(_TRIANGLE)} select A, B, C, round(value, 6) as value from {_TRIANGLE_LAST} where value > 0",
    "scale_step": f"with {_T} select m.A, m.B, c.C, round(m.v / 5, 10) as value from {_m('AB')} m, (select unnest(range(5))::int as C) c",
    "synthetic_chain": _chain_sample_sql(),
    "model_triangle_fit": _TRIANGLE_FIT,
    "beam_search": _beam_sql("loopless up", "A:B:C:D", 3, 3, 5), "full_search": _beam_sql("full up", "A:B:C:D", 2, 2, 4), "search_down": _beam_sql("loopless down", "ABCD", 3, 2, 5),
    "loopless_up_directed": _level_sql(_simple(["AB:CD", "AC:BD", "AD:BC"])),
    "loopless_down_directed": _models_sql([_line_model(x) for x in ("ABC", "ABD", "ACD")]),
    "full_up_directed": _models_sql([_line_model(x) for x in ("ABC:D", "ABD:C")]),
    "full_up_level2": _models_sql([_line_model(x) for x in ("ABC:D", "AB:BCD", "ABD:BC", "AB:AC:BC:D", "AB:AD:BC", "AB:BC:BD", "AB:BC:CD")], 2),
    "full_down_level": _models_sql([_line_model(x) for x in ("AC:BCD", "AB:BCD", "AB:AC:BCD", "ABC:CD", "ABC:BD", "ABC:BD:CD")], 2),
    "pairs_up_level": _models_sql([_line_model(x) for x in ("ABC:D", "ABD:C", "AB:CD")]),
    "pairs_down_level": _models_sql([_line_model(x) for x in ("A:BC:D", "AC:B:D", "AB:C:D")]),
    "lattice_parents": _models_sql([_line_model(x) for x in ("ABCD",)]),
    "lattice_children": _models_sql([_line_model(x) for x in ("AC:BC:CD", "AB:BC:CD", "AB:AC:CD", "ABC:D")], 2),
    "state_enumeration": f"with {_T}, d as (select cast(i as bigint) as state, cast(i % 3 as int) as A, cast(i // 3 % 2 as int) as B, cast(i // 6 % 5 as int) as C, cast(i // 30 as int) as D from range(210) r(i)) "
        "select state, A, B, C, D, coalesce(value, 0) as value from d left join t using (A, B, C, D)",
    "bin_equal_width": f"""with x as (select l_extendedprice as x from lineitem), m as (select min(x) as lo, max(x) as hi from x),
b as (select lo + (hi - lo) / 5 * 1 as b1, lo + (hi - lo) / 5 * 2 as b2, lo + (hi - lo) / 5 * 3 as b3, lo + (hi - lo) / 5 * 4 as b4 from m)
select cast({_BIN_CASE} as int) as code, count(*) as n from x, b group by 1""",
    "bin_quantile": """with x as (select l_extendedprice as x from lineitem), b as (select quantile_cont(x, 0.25) as b1, quantile_cont(x, 0.5) as b2, quantile_cont(x, 0.75) as b3 from x)
select cast(case when x < b1 then 0 when x < b2 then 1 when x < b3 then 2 else 3 end as int) as code, count(*) as n from x, b group by 1""",
    "bin_breaks": "select cast(case when l_extendedprice < 10000 then 0 when l_extendedprice < 50000 then 1 else 2 end as int) as code, count(*) as n from lineitem group by 1",
    "bin_topn": """with top as (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 5)
select case when p_brand in (select p_brand from top) then p_brand else 'Other' end as p_brand, cast(count(*) as double) as value from part group by 1""",
    "bin_threshold": """with f as (select lang, count(*) as n from documents group by lang)
select case when n >= 0.12 * (select count(*) from documents) then lang else 'Other' end as lang, cast(sum(n) as double) as value from f group by 1""",
    "missing_bin": _missing_sql("'Missing'", "'Missing'"),
    "missing_exclude": _missing_sql("null", "null", "where priority is not null and price is not null"),
    "missing_ignore": _missing_sql("'Other'", "'Low'"),
    "auto_bin": """with m as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem),
b as (select lo, hi, lo + (hi - lo) / 3 * 1 as b1, lo + (hi - lo) / 3 * 2 as b2 from m)
select case when l_quantity < b1 then cast(cast(floor(lo) as bigint) as varchar) || '-' || cast(cast(floor(b1) as bigint) as varchar)
  when l_quantity < b2 then cast(cast(floor(b1) as bigint) as varchar) || '-' || cast(cast(floor(b2) as bigint) as varchar)
  else cast(cast(floor(b2) as bigint) as varchar) || '-' || cast(cast(floor(hi) as bigint) as varchar) end as l_quantity, l_returnflag, l_linenumber, cast(count(*) as double) as value
from lineitem, b group by all""",
    "column_profile": " union all ".join(
        f"select '{c}' as \"column\", {num} as is_numeric, count(distinct {c}) as unique_count, cast(0 as bigint) as missing_count, count(*) as n_rows, {lo} as min, {hi} as max from lineitem"
        for c, num, lo, hi in [("l_quantity", "true", "min(l_quantity)", "max(l_quantity)"), ("l_returnflag", "false", "null::double", "null::double"),
                               ("l_discount", "true", "min(l_discount)", "max(l_discount)"), ("l_linenumber", "true", "min(l_linenumber)::double", "max(l_linenumber)::double")]),
    "infer_values": " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(distinct {c}) as cardinality, (select string_agg(v, '|' order by v) from (select distinct {c} as v from orders)) as labels from orders" for c in ("o_orderstatus", "o_orderpriority")),
    "first_seen_codes": "select n_name as value, row_number() over (order by k) - 1 as code from (select n_name, min(n_nationkey) as k from nation group by n_name)",
    "preprocess_auto_bin": """select cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as int) as "L", cast(least((l_linenumber - 1) // 3, 2) as int) as "Ll", cast(count(*) as double) as value from lineitem group by 1, 2""",
    "residues_pairs": """select cast(n % 3 as int) as A, cast(n % 5 as int) as B, cast(nx % 3 as int) as Z, cast(count(*) as double) as value
from (select n, lead(n) over (order by n) as nx from (select distinct l_partkey as n from lineitem where l_partkey > 0)) q where nx is not null group by all""",
    "prime_residues": """with n as (select distinct o_orderkey as n from orders where o_orderkey > 1), f as (select unnest(range(2, (select cast(ceil(sqrt(max(n))) as bigint) + 1 from n))) as f),
p as (select n from n where not exists (select 1 from f where f.f < n.n and f.f * f.f <= n.n and n.n % f.f = 0)), q as (select n, lead(n) over (order by n) as nx from p)
select cast(n % 3 as int) as A, cast(nx % 3 as int) as Z, cast(count(*) as double) as value from q where nx is not null group by all""",
    "digit_sums": "select n, cast(list_sum(list_transform(range(1, length(n::varchar) + 1), lambda i: substr(n::varchar, i, 1)::int)) as int) as digits from (select distinct o_orderkey as n from orders where o_orderkey > 0) q",
    "collatz": """with recursive w(n, x, k) as (select distinct p_partkey, p_partkey, 0 from part where p_partkey > 0 union all select n, case when x % 2 = 0 then x // 2 else 3 * x + 1 end, k + 1 from w where x > 1)
select n, max(k)::int as steps from w group by n""",
    "prime_factors": """with recursive w(n, x, p, k) as (select distinct p_partkey, p_partkey, cast(2 as bigint), 0 from part where p_partkey > 0
union all select n, case when x % p = 0 then x // p else x end, case when x % p = 0 then p else p + 1 end, case when x % p = 0 then k + 1 else k end from w where p * p <= x)
select n, cast(max(k + case when x > 1 and p * p > x then 1 else 0 end) as int) as factors from w where p * p > x group by n""",
    "events_markov": "select event_type, following, count(*) as n from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as following from events) where following is not null group by all",
    "quality_by_language": """with t as (select lang as L, quality as Q, toxic as T, cast(count(*) as double) as value from documents join labels using (doc_id) group by all),
h as (select """ + ", ".join(f"(select log2(sum(v)) - sum(v * log2(v)) / sum(v) from (select sum(value) as v from t group by {', '.join(c)})) as h{c}" for c in ["L", "Q", "T", "LQ", "LT", "QT", "LQT"]) + """, (select sum(value) from t) as n)
select 'LQ:T' as model, 0.0::double as cond_dh, round(2 * n * ln(2) * (hLQ + hT - hLQT), 5) as lr, cast(8 as bigint) as df from h
union all select 'LT:Q', round(hT - (hLT + hQ - hLQ), 8), round(2 * n * ln(2) * (hLT + hQ - hLQT), 5), 8 from h
union all select 'L:QT', round(hT - (hL + hQT - hLQ), 8), round(2 * n * ln(2) * (hL + hQT - hLQT), 5), 6 from h""",
}
