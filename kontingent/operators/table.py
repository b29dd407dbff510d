"""Weighted contingency tables as DataFrames: encode, aggregate, project, reduce.

A table has one int column per variable (its code, never null) and ``value``.
Null stands for a variable that was summed out, as GROUPING SETS leaves it.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..algebra import bits
from ..errors import ComputationError, ValidationError
from ..schema import PROB_MIN, Schema, TableKind

VALUE = "value"
#: Grouping sets in one job: Spark expands each row once per set.
SETS_PER_JOB = 48


def encode(raw: DataFrame, schema: Schema, columns: dict[str, str] | None = None, count: str | None = None, unknown: str = "error") -> DataFrame:
    """Contingency table of rows of labels.

    columns: abbreviation -> column of ``raw`` (default: the variable's name).  A label is looked up
    among the variable's values.  unknown="error" fails on any other label; "index" reads it as a
    number from 1, taken modulo the cardinality, and anything else as 0.
    """
    if unknown not in ("error", "index"):
        raise ValidationError(f"unknown={unknown!r}")
    codes = []
    for v in schema:
        label = F.col((columns or {}).get(v.abbrev, v.name)).cast("string")
        lookup = F.create_map(*[x for k, s in enumerate(v.labels()) for x in (F.lit(s), F.lit(k))])
        code = F.element_at(lookup, label)
        if unknown == "index":
            number = F.expr(f"try_cast({_sql_name((columns or {}).get(v.abbrev, v.name))} as int)")
            code = F.coalesce(code, F.pmod(number - 1, F.lit(v.cardinality)), F.lit(0))
        else:
            code = F.coalesce(code, F.raise_error(F.concat(F.lit(f"{v.name}: unknown value "), F.coalesce(label, F.lit("null")))).cast("int"))
        codes.append(code.cast("int").alias(v.abbrev))
    weight = F.col(count).cast("double") if count else F.lit(1.0)
    return aggregate(raw.select(*codes, weight.alias(VALUE)), schema)


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def aggregate(t: DataFrame, schema: Schema) -> DataFrame:
    """Equal states merged, values summed."""
    return t.groupBy(*schema.columns).agg(F.sum(VALUE).alias(VALUE))


def total(t: DataFrame) -> float:
    return float(t.agg(F.sum(VALUE).alias("s")).first()["s"] or 0.0)


def normalize(t: DataFrame, n: float | None = None) -> DataFrame:
    """Values divided by their sum (by a scalar; no window over the whole table)."""
    n = total(t) if n is None else n
    return t.withColumn(VALUE, F.col(VALUE) / F.lit(n)) if n > 0 else t


def project(t: DataFrame, schema: Schema, mask: int) -> DataFrame:
    """Values summed over the variables outside the mask."""
    names = schema.names(mask)
    return t.groupBy(*names).agg(F.sum(VALUE).alias(VALUE)) if names else t.agg(F.sum(VALUE).alias(VALUE))


def project_many(t: DataFrame, schema: Schema, masks) -> DataFrame:
    """All projections in one pass: schema columns (null where summed out), value, and ``mask``."""
    masks, cols = list(dict.fromkeys(masks)), schema.columns
    k = len(cols)
    if k > 63:
        raise ValidationError("at most 63 variables can be projected together")
    grouped = t.groupingSets([[F.col(c) for c in schema.names(m)] for m in masks], *[F.col(c) for c in cols]).agg(
        F.sum(VALUE).alias(VALUE), F.grouping_id().alias("_g"))
    present = F.lit(0).cast("long")
    for i in range(k):  # grouping_id has a 1 for a column that was summed out, the first column highest
        present = present.bitwiseOR(F.when(F.col("_g").bitwiseAND(F.lit(1 << (k - 1 - i)).cast("long")) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return grouped.select(*cols, VALUE, present.alias("mask"))


def entropies(t: DataFrame, schema: Schema, masks) -> DataFrame:
    """(mask, entropy in bits, n, states) of each projection, SETS_PER_JOB projections a scan.

    log2 N - sum(c log2 c) / N needs no normalised copy.
    """
    masks = list(dict.fromkeys(masks))
    out = None
    for at in range(0, len(masks), SETS_PER_JOB):
        e = entropies_of(project_many(t, schema, masks[at: at + SETS_PER_JOB]))
        out = e if out is None else out.union(e)
    if out is None:
        raise ValidationError("no projection given")
    return out


def entropies_of(margins: DataFrame) -> DataFrame:
    """(mask, entropy in bits, n, states) of the margins that a table with a column ``mask`` holds."""
    return margins.where(F.col(VALUE) > 0).groupBy("mask").agg(
        (F.log2(F.sum(VALUE)) - F.sum(F.col(VALUE) * F.log2(VALUE)) / F.sum(VALUE)).alias("entropy"), F.sum(VALUE).alias("n"), F.count("*").alias("states"))


def entropy(t: DataFrame, kind: TableKind = TableKind.INFORMATION_THEORETIC) -> float:
    """Entropy in bits of a table of counts or probabilities."""
    if kind is not TableKind.INFORMATION_THEORETIC:
        raise ComputationError("only information-theoretic tables have an entropy")
    row = t.where(F.col(VALUE) > PROB_MIN).agg(F.sum(VALUE).alias("n"), F.sum(F.col(VALUE) * F.log2(VALUE)).alias("s")).first()
    return math.log2(row["n"]) - row["s"] / row["n"] if row["n"] else 0.0


def max_entropy(schema: Schema, mask: int | None = None) -> float:
    return sum(math.log2(schema[k].cardinality) for k in bits(schema.full if mask is None else mask))


def transmission(p: DataFrame, q: DataFrame, schema: Schema) -> DataFrame:
    """Kullback-Leibler divergence in bits of probability table p from q, one row ``kl``; cells missing in q are skipped."""
    joined = p.select(*schema.columns, F.col(VALUE).alias("_p")).join(q.select(*schema.columns, F.col(VALUE).alias("_q")), schema.columns)
    joined = joined.where((F.col("_p") > PROB_MIN) & (F.col("_q") > PROB_MIN))
    return joined.agg(F.coalesce(F.sum(F.col("_p") * F.log2(F.col("_p") / F.col("_q"))), F.lit(0.0)).alias("kl"))


def pearson(observed: DataFrame, expected: DataFrame, schema: Schema, n: float) -> DataFrame:
    """Pearson's statistic over the expected cells, one row ``p2``; both tables hold probabilities."""
    e = expected.select(*schema.columns, F.col(VALUE).alias("_e")).where(f"_e > {PROB_MIN}")
    joined = e.join(observed.select(*schema.columns, F.col(VALUE).alias("_o")), schema.columns, "left")
    gap = F.coalesce("_o", F.lit(0.0)) - F.col("_e")
    return joined.agg((F.coalesce(F.sum(gap * gap / F.col("_e")), F.lit(0.0)) * F.lit(n)).alias("p2"))


def residuals(observed: DataFrame, fitted: DataFrame, schema: Schema) -> DataFrame:
    """observed, fitted and their difference for every cell that either table has."""
    o = observed.select(*schema.columns, F.col(VALUE).alias("observed"))
    f = fitted.select(*schema.columns, F.col(VALUE).alias("fitted"))
    both = o.join(f, schema.columns, "full")
    return both.select(*schema.columns, F.coalesce("observed", F.lit(0.0)).alias("observed"), F.coalesce("fitted", F.lit(0.0)).alias("fitted")).withColumn(
        "residual", F.col("observed") - F.col("fitted"))


def find(t: DataFrame, **codes: int) -> DataFrame:
    """Rows with these codes."""
    out = t
    for name, code in codes.items():
        out = out.where(F.col(name) == code)
    return out


def matching(a: DataFrame, b: DataFrame, schema: Schema, names=None) -> DataFrame:
    """Pairs of rows that agree where both have a code; a null code matches every code.  Values come as value_a and value_b.

    Rows with codes in the same columns are joined on the codes that both sides have, one equi-join per pair of such sets.
    """
    names = names or schema.columns
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in schema.columns], F.col(VALUE).alias("value_a"))
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in schema.columns], F.col(VALUE).alias("value_b"))
    out = None
    for have_a in _present(left, names, "_a"):
        for have_b in _present(right, names, "_b"):
            x, y = (t.where(reduce(and_, [F.col(f"{c}{side}").isNotNull() if c in have else F.col(f"{c}{side}").isNull() for c in names], F.lit(True)))
                    for t, have, side in ((left, have_a, "_a"), (right, have_b, "_b")))
            both = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in names if c in have_a and c in have_b]
            some = x.join(y, reduce(and_, both)) if both else x.crossJoin(y)  # without a common code every pair matches
            out = some if out is None else out.union(some)
    return left.crossJoin(right).limit(0) if out is None else out


def _present(t: DataFrame, names, side: str) -> list[set[str]]:
    """The sets of columns that rows have codes in: one per projection that the table holds."""
    rows = t.select(*[F.col(f"{c}{side}").isNotNull().alias(c) for c in names]).distinct().collect()
    return [{c for c in names if r[c]} for r in rows]


def decode(t: DataFrame, schema: Schema) -> DataFrame:
    """Codes replaced by labels, columns named by the variables."""
    def label(v) -> Column:
        return F.element_at(F.array(*map(F.lit, v.labels())), F.col(v.abbrev) + 1).alias(v.name)

    return t.select(*[label(v) for v in schema], *[c for c in t.columns if c not in schema.columns])


def coverage(t: DataFrame, schema: Schema) -> DataFrame:
    """Observed states over possible states, one row."""
    return t.where(F.col(VALUE) > 0).agg(F.count("*").alias("observed_states")).select(
        "observed_states", F.lit(float(schema.cells())).alias("possible_states"), (F.col("observed_states") / F.lit(float(schema.cells()))).alias("coverage"))


def domain(spark: SparkSession, schema: Schema, first_fastest: bool = True) -> DataFrame:
    """Every state with its index; the first variable runs fastest, or the last one."""
    out = spark.range(schema.cells()).withColumnRenamed("id", "state")
    step = 1
    order = list(schema) if first_fastest else list(schema)[::-1]
    for v in order:
        out = out.withColumn(v.abbrev, F.pmod(F.floor(F.col("state") / F.lit(step)), F.lit(v.cardinality)).cast("int"))
        step *= v.cardinality
    return out.select("state", *schema.columns)


def state_index(schema: Schema, codes) -> int:
    """Index of a state, the first variable running fastest."""
    out, step = 0, 1
    for v, c in zip(schema, codes):
        out += c * step
        step *= v.cardinality
    return out


def index_state(schema: Schema, index: int) -> list[int]:
    out = []
    for v in schema:
        index, c = divmod(index, v.cardinality)
        out.append(c)
    return out
