"""Queries over twelve and more variables of lineitem, orders and part, whose states are far too many to list, and their SQL twins.

The joint domain of A to L has 1.6e9 states; no query makes more than tables of a few variables.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import algebra
from ..operators import fit, inference, rollup
from ..operators import table as tables
from ..operators.analyzer import Analyzer
from ..operators.storage import materialise
from ..schema import Schema, Variable
from . import levels, search
from .catalogue import ORACLES as LINE_ORACLES
from .catalogue import VALUE, _gamma_p, line_schema, line_table, read, rounded

# The first words of part types, sorted.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
#: Abbreviation, name, cardinality, and the code as an expression that Spark and DuckDB read alike.
VARIABLES = (
    ("A", "return_flag", 3, "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end"),
    ("B", "line_status", 2, "case l_linestatus when 'F' then 0 else 1 end"),
    ("C", "quantity", 5, "least(floor((l_quantity - 1) / 10), 4)"),
    ("D", "line_number", 7, "l_linenumber - 1"),
    ("E", "discount", 11, "round(l_discount * 100)"),
    ("F", "tax", 9, "round(l_tax * 100)"),
    ("G", "order_status", 3, "case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end"),
    ("H", "priority", 5, "cast(substr(o_orderpriority, 1, 1) as int) - 1"),
    ("I", "part_size", 5, "least(floor((p_size - 1) / 10), 4)"),
    ("J", "part_type", 6, "case p_type " + " ".join(f"when '{t}' then {k}" for k, t in enumerate(TYPES)) + " end"),
    ("K", "ship_year", 7, "year(l_shipdate) - 1995"),
    ("L", "brand", 25, "cast(substr(p_brand, 7) as int) - 1"),
)
#: Eight more, for what twenty columns take.
MORE = (
    ("M", "ship_month", 12, "month(l_shipdate) - 1"),
    ("N", "order_month", 12, "month(o_orderdate) - 1"),
    ("O", "order_quarter", 4, "floor((month(o_orderdate) - 1) / 3)"),
    ("P", "price", 4, "least(floor(l_extendedprice / 20000), 3)"),
    ("Q", "retail_price", 5, "least(floor(p_retailprice / 400), 4)"),
    ("R", "supplier_group", 10, "l_suppkey % 10"),
    ("S", "customer_group", 7, "o_custkey % 7"),
    ("T", "part_group", 6, "l_partkey % 6"),
)
TWELVE, TWENTY = "ABCDEFGHIJKL", "ABCDEFGHIJKLMNOPQRST"
CARD = {a: n for a, _, n, _ in VARIABLES + MORE}
CHAIN = "AB:BC:CD:DE:EF:FG:GH"
#: A loop of four and a triangle that share a variable, with trees on them.
LOOPS = "AC:CG:GH:AH:HI:IJ:HJ:AB:CD:DE:EF:JK:KL"


def wide_schema(names: str = TWELVE) -> Schema:
    return Schema(tuple(Variable(name, a, n) for a, name, n, _ in VARIABLES + MORE if a in names))


def wide_rows(spark: SparkSession, sf: str, names: str = TWELVE) -> DataFrame:
    """A state and the value 1 for each line, equal ones not merged; the small dimension's join is left to the optimiser's sizes."""
    own = [(a, e) for a, _, _, e in VARIABLES + MORE if a in names]
    rows = read(spark, sf, "lineitem")
    if set(names) & set("GHNOS"):
        rows = rows.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    if set(names) & set("IJLQ"):
        rows = rows.join(read(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*[F.expr(e).cast("int").alias(a) for a, e in own], F.lit(1.0).alias(VALUE))


def wide_table(spark: SparkSession, sf: str, names: str = TWELVE) -> DataFrame:
    """Counts of the variables' states."""
    return tables.aggregate(wide_rows(spark, sf, names), wide_schema(names))


def wide_probabilities(spark: SparkSession, sf: str, names: str = TWELVE) -> tuple[DataFrame, Schema]:
    t = materialise(wide_table(spark, sf, names))
    return tables.normalize(t), wide_schema(names)


def _rows(parts: list[tuple[str, DataFrame]], names: str) -> DataFrame:
    """Tables over some of the variables as one: the part's name, a code or null for each variable, and the value."""
    out = None
    for name, t in parts:
        r = t.select(F.lit(name).alias("part"), *[(F.col(c) if c in t.columns else F.lit(None).cast("int")).alias(c) for c in names], VALUE)
        out = r if out is None else out.union(r)
    return rounded(out, 9)


def _singles(tree: inference.CliqueTree, names: str) -> DataFrame:
    out = None
    for c in names:
        m = tree.marginal(1 << tree.schema.find(c)).select(F.lit(c).alias("variable"), F.col(c).alias("code"), VALUE)
        out = m if out is None else out.union(m)
    return out


# Queries --------------------------------------------------------------------------------------

def bp_evidence(spark, sf):
    """Each variable's distribution under the chain A to H, given the line's tax and its status; and the evidence's probability."""
    p, s = wide_probabilities(spark, sf, "ABCDEFGH")
    tree = inference.of_model(p, algebra.parse_model(s, CHAIN)).given(F=3, B=1)
    return rounded(_singles(tree, "ABCDEFGH").withColumn("evidence", F.lit(tree.mass)), 9)


def bp_potentials(spark, sf):
    """Three potentials in a loop that are no distributions (counts, cross-products, weights), and a weight of one variable."""
    t, s = materialise(wide_table(spark, sf, "ACG")), wide_schema("ACG")
    m = {x: tables.project(t, s, algebra.parse_relation(s, x)) for x in ("AC", "CG", "AG", "G")}
    weight = m["G"].withColumn(VALUE, F.lit(1.0) / (F.col("G") + 1))
    tree = inference.calibrate([m["AC"], m["CG"].withColumn(VALUE, F.sqrt(VALUE)), m["AG"].withColumn(VALUE, F.lit(1.0) / F.col(VALUE)), weight], s)
    return rounded(tree.marginal(0b111), 9)


def chain_ends(spark, sf):
    """The margin of both ends of a chain of eight variables, which no clique covers."""
    p, s = wide_probabilities(spark, sf, "ABCDEFGH")
    return rounded(inference.of_model(p, algebra.parse_model(s, CHAIN)).marginal(0b10000001), 9)


def clique_fit(spark, sf):
    """Margins of the fit of LOOPS: the loop of four, the triangle, and two variables far apart."""
    p, s = wide_probabilities(spark, sf)
    tree = inference.fit_cliques(p, algebra.parse_model(s, LOOPS), fit.IPFConfig(200, 1e-11))
    mask = lambda x: algebra.parse_relation(s, x)
    return _rows([(x, tree.marginal(mask(x))) for x in ("ACGH", "HIJ", "AL")], "ACGHIJL")


def clique_fit_statistics(spark, sf):
    """Statistics of LOOPS by the analyzer, with no table on the driver."""
    a = Analyzer(materialise(wide_table(spark, sf)), wide_schema(), local_states=0)
    row = (a.model(LOOPS).name, round(a.h(LOOPS), 7), a.df(LOOPS), round(a.lr(LOOPS), 2))
    a.release()
    return spark.createDataFrame([row], "model string, h double, df long, lr double")


def rollup_pairs(spark, sf):
    """Entropies of all singles and pairs of twenty columns, from a few larger margins."""
    t, s = materialise(wide_rows(spark, sf, TWENTY)), wide_schema(TWENTY)  # nearly every line is a state of its own
    masks = [1 << i for i in range(20)] + [1 << i | 1 << j for i, j in combinations(range(20), 2)]
    e = rollup.Rollup(t, s, masks, t.count(), worth=1 << 16).entropies()
    name = F.create_map(*[x for m in masks for x in (F.lit(m).cast("long"), F.lit("".join(s.names(m))))])
    return rounded(e.select(F.element_at(name, F.col("mask")).alias("relation"), "entropy", "n", "states"), 8)


def partition_level(spark, sf):
    """All 11,880 partitions of eleven variables into eight groups: three steps up from independence, with their statistics
    and the p-value of what they gain on it.  Models, margins and figures are tables throughout."""
    names = TWELVE[:11]
    s = wide_schema(names)
    level = levels.Levels(wide_rows(spark, sf, names), s)
    first = algebra.independence(s)
    models = levels.model_frame(spark, [first])
    for _ in range(3):
        models = materialise(levels.neighbours(models, s, "disjoint"))
    out = level.evaluate(models, against=first)
    return out.select("model", "df", F.round("lr", 2).alias("lr"), F.round("bic", 2).alias("bic"), F.round("alpha", 6).alias("alpha"))


def loop_level(spark, sf):
    """One step up from AB:BC:D with its loops, all fitted side by side in one table."""
    level = levels.Levels(line_table(spark, sf), line_schema(), fit.IPFConfig(1000, 1e-9))
    models = levels.neighbours(levels.model_frame(spark, [algebra.parse_model(line_schema(), "AB:BC:D")]), line_schema(), "full")
    return rounded(level.evaluate(models).select("model", "lr", "df", "bic"), 2)


def table_search(spark, sf):
    """The search of full_search with levels as tables."""
    level = levels.Levels(line_table(spark, sf), line_schema(), fit.IPFConfig(1000, 1e-9))
    found = level.search(algebra.independence(line_schema()), "full", "up", "bic", 2, 2)
    rank = F.row_number().over(W.orderBy("bic", "model"))  # at most 1 + width x levels rows
    return rounded(found.select(rank.alias("rank"), "model", F.col("bic").alias("statistic"), F.col("step").alias("level"), "has_loops"), 4)


def far_search(spark, sf):
    """The search of beam_search where nothing may be evaluated on the driver."""
    a = Analyzer(line_table(spark, sf), line_schema(), local_states=0)
    out = rounded(search.search(a, "loopless", "up", "bic", 3, 3).frame(a), 5)
    a.release()
    return out


QUERIES = {"partition_level": partition_level, "loop_level": loop_level, "table_search": table_search, "far_search": far_search, "rollup_pairs": rollup_pairs, "bp_evidence": bp_evidence, "bp_potentials": bp_potentials, "chain_ends": chain_ends, "clique_fit": clique_fit, "clique_fit_statistics": clique_fit_statistics}


# SQL twins ------------------------------------------------------------------------------------

def _wide_cte(names: str = TWELVE) -> str:
    """t: counts; p: probabilities."""
    cols = ", ".join(f"cast({e} as int) as {a}" for a, _, _, e in VARIABLES + MORE if a in names)
    source = "lineitem" + (" join orders on l_orderkey = o_orderkey" if set(names) & set("GHNOS") else "") + (" join part on l_partkey = p_partkey" if set(names) & set("IJLQ") else "")
    return f"""t as materialized (select {cols}, cast(count(*) as double) as value from {source} group by all),
p as materialized (select * replace (value / (select sum(value) from t) as value) from t)"""


def _m(cols: str, src: str = "p") -> str:
    by = ", ".join(cols)
    return f"(select {by}, sum(value) as v from {src} group by {by})"


def _h(cols: str, src: str = "p") -> str:
    return f"(select -sum(v * log2(v)) from {_m(cols, src)} where v > 0)"


def _chain_cte(order: str = "ABCDEFGH") -> str:
    """j: the joint table of a chain of variables, from its pairs and singles."""
    x = [(a + b) for a, b in zip(order, order[1:])]
    source = _m(x[0]) + " m0"
    value, cols = "m0.v", [f"m0.{c}" for c in x[0]]
    for k, r in enumerate(x[1:], 1):
        source += f" join {_m(r)} m{k} on m{k}.{r[0]} = m{k - 1}.{r[0]} join {_m(r[0])} s{k} on s{k}.{r[0]} = m{k}.{r[0]}"
        value += f" * m{k}.v / s{k}.v"
        cols.append(f"m{k}.{r[1]}")
    return f"j as materialized (select {', '.join(cols)}, {value} as value from {source})"


def _fit_cte(relations: list[str], over: str, sweeps: int, name: str) -> str:
    """CTEs that fit relations by sweeps from the uniform table over the variables; the last is the name."""
    sides = ", ".join(f"(select unnest(range({CARD[c]}))::int as {c})" for c in over)
    cols = ", ".join(f"q.{c}" for c in over)
    parts, k = [f"{name}0 as materialized (select {', '.join(over)}, 1.0::double as value from {sides})"], 0
    for _ in range(sweeps):
        for r in relations:
            on = [" and ".join(f"q.{c} = {x}.{c}" for c in r) for x in "mh"]
            parts.append(f"{name}{k + 1} as materialized (select {cols}, q.value * m.v / h.v as value from {name}{k} q join {_m(r)} m on {on[0]} join {_m(r, f'{name}{k}')} h on {on[1]})")
            k += 1
    return ", ".join([*parts, f"{name} as materialized (select * from {name}{k} where value > 0)"])


_LOOP_FITS = f"{_fit_cte(['AC', 'CG', 'GH', 'AH'], 'ACGH', 10, 'q')}, {_fit_cte(['HI', 'IJ', 'HJ'], 'HIJ', 10, 'r')}"
_TREE_EDGES = [("AB", "A"), ("CD", "C"), ("DE", "D"), ("EF", "E"), ("JK", "J"), ("KL", "K")]


def _loops_df() -> int:
    """Free parameters: singles, and (cardinality - 1) multiplied for each pair."""
    pairs = LOOPS.split(":")
    return sum(CARD[c] - 1 for c in TWELVE) + sum((CARD[a] - 1) * (CARD[b] - 1) for a, b in pairs)


def _partition_level_sql(names: str = TWELVE[:11], groups: int = 8) -> str:
    """Partitions as strings of group numbers (each at most one more than those before), their entropies from keys of states."""
    n, step = len(names), 5  # five bits a variable
    key = " + ".join(f"({c}::bigint << {step * k})" for k, c in enumerate(names))
    small = n - groups + 1  # variables of the largest group
    cards = "[" + ", ".join(str(CARD[c]) for c in names) + "]"
    letters = "[" + ", ".join(f"'{c}'" for c in names) + "]"
    tail = f"case when z >= 0 then {gamma_q('0.5', '(z * z / 2)')} / 2 else 1 - {gamma_q('0.5', '(z * z / 2)')} / 2 end"
    return f"""with recursive {_wide_cte(names)},
k as materialized (select {key} as key, value from t),
masks as materialized (select m, list_sum(list_transform(range({n}), lambda i: case when (m >> i) & 1 = 1 then 31::bigint << ({step} * i) else 0 end))::bigint as f from (select unnest(range(1, {1 << n})) as m) q where bit_count(m) <= {small}),
h as materialized (select m, log2(sum(v)) - sum(v * log2(v)) / sum(v) as h from (select m, key & f as x, sum(value) as v from k, masks group by m, key & f) q group by m),
grow(i, top, a) as (select 1, 0, [0] union all select i + 1, greatest(top, g), list_append(a, g) from (select i, top, a, unnest(range(0, top + 2)) as g from grow where i < {n}) q
  where greatest(top, g) + 1 + {n} - i - 1 >= {groups} and greatest(top, g) < {groups}),
part as materialized (select row_number() over () as r, a from grow where i = {n} and top = {groups - 1}),
grp as materialized (select r, g, list_sum(list_transform(range({n}), lambda i: case when a[i + 1] = g then 1::bigint << i else 0 end))::bigint as m,
  list_aggregate(list_transform(range({n}), lambda i: case when a[i + 1] = g then {letters}[i + 1] else '' end), 'string_agg', '') as name,
  list_product(list_transform(range({n}), lambda i: case when a[i + 1] = g then {cards}[i + 1] else 1 end))::bigint - 1 as df from part, (select unnest(range({groups})) as g) u),
mo as (select string_agg(name, ':' order by g) as model, sum(h) as h, sum(df)::bigint as df from grp join h using (m) group by r),
c as (select {_h(names)} as hd, (select sum(value) from t) as n, (select sum(h) from h where bit_count(m) = 1) as h0, {sum(CARD[c] - 1 for c in names)} as df0),
s as (select model, df, 2 * n * ln(2) * (h - hd) as lr, 2 * n * ln(2) * (h0 - h) as x, (df - df0)::double as d, n from mo, c),
w as (select *, (pow(x / d, 1.0::double / 3) - (1 - 2 / (9 * d))) / sqrt(2 / (9 * d)) as z from s)
select model, df, round(lr, 2) as lr, round(lr - ({math.prod(CARD[c] for c in names) - 1} - df) * ln(n), 2) as bic,
  round(case when x <= 0 then 1 when d >= 100 then {tail} else {gamma_q('(d / 2)', '(x / 2)')} end, 6) + 0.0 as alpha from w"""


def gamma_q(a: str, y: str) -> str:
    return f"(1 - {_gamma_p(a, y, 1500)})"


_EIGHT = "ABCDEFGH"
_SINGLES_AND_PAIRS = [*TWENTY, *map("".join, combinations(TWENTY, 2))]
ORACLES = {
    "partition_level": _partition_level_sql(),
    "loop_level": LINE_ORACLES["full_up_level2"],
    "table_search": LINE_ORACLES["full_search"],
    "far_search": LINE_ORACLES["beam_search"],
    "rollup_pairs": f"with {_wide_cte(TWENTY)} " + " union all ".join(
        f"select '{c}' as relation, round(log2(sum(v)) - sum(v * log2(v)) / sum(v), 8) as entropy, sum(v) as n, count(*) as states from {_m(c, 't')}" for c in _SINGLES_AND_PAIRS),
    "bp_evidence": f"with {_wide_cte(_EIGHT)}, {_chain_cte()}, g as materialized (select * from j where F = 3 and B = 1), n as (select sum(value) as n from g) "
        + " union all ".join(f"select '{c}' as variable, {c} as code, round(sum(value) / any_value(n), 9) as value, round(any_value(n), 9) as evidence from g, n group by {c}" for c in _EIGHT),
    "bp_potentials": f"""with {_wide_cte('ACG')}, g as (select x.A, x.C, y.G, x.v * sqrt(y.v) / z.v / (y.G + 1) as value from {_m('AC', 't')} x join {_m('CG', 't')} y on x.C = y.C join {_m('AG', 't')} z on x.A = z.A and y.G = z.G)
select A, C, G, round(value / (select sum(value) from g), 9) as value from g""",
    "chain_ends": f"with {_wide_cte(_EIGHT)}, {_chain_cte()} select A, H, round(sum(value), 9) as value from j group by A, H",
    "clique_fit": f"""with {_wide_cte()}, {_LOOP_FITS}
select 'ACGH' as part, A, C, G, H, null::int as I, null::int as J, null::int as L, round(value, 9) as value from q
union all select 'HIJ', null, null, null, H, I, J, null, round(value, 9) from r
union all select 'AL', x.A, null, null, null, null, null, z.L, round(sum(x.v * y.v / h.v * w.v / j.v * z.v / k.v), 9) from {_m('AH')} x join {_m('HJ')} y on x.H = y.H join {_m('H')} h on h.H = x.H
  join {_m('JK')} w on w.J = y.J join {_m('J')} j on j.J = w.J join {_m('KL')} z on z.K = w.K join {_m('K')} k on k.K = z.K group by x.A, z.L""",
    "clique_fit_statistics": f"""with {_wide_cte()}, {_LOOP_FITS},
s as (select (select -sum(value * log2(value)) from q) + (select -sum(value * log2(value)) from r) - {_h('H')} {''.join(f' + {_h(r)} - {_h(x)}' for r, x in _TREE_EDGES)} as h, {_h('ABCDEFGHIJKL')} as hd, (select sum(value) from t) as n)
select 'AB:AC:AH:CD:CG:DE:EF:GH:HI:HJ:IJ:JK:KL' as model, round(h, 7) as h, cast({_loops_df()} as bigint) as df, round(2 * n * ln(2) * (h - hd), 2) as lr from s""",
}
