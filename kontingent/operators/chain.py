"""Messages along a chain of variables: forward, backward, and the marginals.

A message is a table over one variable that sums to one.  Each step joins the
message before with the margin of two neighbouring variables and adds up, so no
task sees more than a message and a margin.  Messages are written to the shared
folder: the plan of a step does not hold the steps before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError
from ..schema import Schema
from .storage import materialise
from .table import VALUE, normalize, project, total


def _order(schema: Schema, order) -> list[int]:
    places = [schema.columns.index(x) if isinstance(x, str) else int(x) for x in order]
    if len(set(places)) != len(places) or not all(0 <= k < len(schema) for k in places):
        raise ModelError("a chain names each of its variables once")
    return places


def _every_code(message: DataFrame, schema: Schema, k: int) -> DataFrame:
    """The message with a row for every code, 0 where it has none, divided by its sum."""
    v = schema[k]
    codes = message.sparkSession.range(v.cardinality).select(F.col("id").cast("int").alias(v.abbrev))
    whole = materialise(codes.join(message, v.abbrev, "left").select(v.abbrev, F.coalesce(VALUE, F.lit(0.0)).alias(VALUE)))
    return normalize(whole, total(whole))


def forward_pass(p: DataFrame, schema: Schema, order, conditional: bool = False) -> list[DataFrame]:
    """The forward message of each variable of the chain.

    The first is its margin; each next one sums the joint margin with the variable before, weighted by the message there.
    ``conditional``: the joint margin is divided by the margin of the variable before, which makes every message the
    margin of its variable; the published messages are not divided so.
    """
    places = _order(schema, order)
    out: list[DataFrame] = []
    for i, k in enumerate(places):
        if not i:
            out.append(_every_code(project(p, schema, 1 << k), schema, k))
            continue
        before = schema[places[i - 1]].abbrev
        weight = out[-1].withColumnRenamed(VALUE, "_w")
        if conditional:
            own = project(p, schema, 1 << places[i - 1]).withColumnRenamed(VALUE, "_m")
            weight = weight.join(own, before).select(before, F.when(F.col("_m") > 0, F.col("_w") / F.col("_m")).otherwise(F.lit(0.0)).alias("_w"))
        joint = project(p, schema, 1 << k | 1 << places[i - 1]).join(weight, before)
        out.append(_every_code(joint.groupBy(schema[k].abbrev).agg(F.sum(F.col(VALUE) * F.col("_w")).alias(VALUE)), schema, k))
    return out


def backward_pass(p: DataFrame, schema: Schema, order) -> list[DataFrame]:
    """The backward message of each variable: uniform for the last, else the joint margin with the next, weighted by its message."""
    places = _order(schema, order)
    out: list[DataFrame] = []
    for i in reversed(range(len(places))):
        v = schema[places[i]]
        if i == len(places) - 1:
            codes = p.sparkSession.range(v.cardinality).select(F.col("id").cast("int").alias(v.abbrev))
            out.insert(0, codes.withColumn(VALUE, F.lit(1.0 / v.cardinality)))
            continue
        following = schema[places[i + 1]].abbrev
        joint = project(p, schema, 1 << places[i] | 1 << places[i + 1]).join(out[0].withColumnRenamed(VALUE, "_w"), following)
        out.insert(0, _every_code(joint.groupBy(v.abbrev).agg(F.sum(F.col(VALUE) * F.col("_w")).alias(VALUE)), schema, places[i]))
    return out


def forward_backward(p: DataFrame, schema: Schema, order) -> list[DataFrame]:
    """The margin of each variable of the chain, by projection: data margins need no messages."""
    return [project(p, schema, 1 << k) for k in _order(schema, order)]


def messages(p: DataFrame, schema: Schema, order, conditional: bool = False) -> DataFrame:
    """(pass, place, variable, code, value) of all messages and margins of a chain."""
    out = None
    for name, tables in (("forward", forward_pass(p, schema, order, conditional)), ("backward", backward_pass(p, schema, order)), ("marginal", forward_backward(p, schema, order))):
        for place, (k, t) in enumerate(zip(_order(schema, order), tables)):
            c = schema[k].abbrev
            rows = t.select(F.lit(name).alias("pass"), F.lit(place).alias("place"), F.lit(c).alias("variable"), F.col(c).alias("code"), F.col(VALUE).alias("value"))
            out = rows if out is None else out.union(rows)
    return out
