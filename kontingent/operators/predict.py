"""Prediction of the dependent variable in directed systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ModelError
from ..schema import Schema
from .table import VALUE, domain


def _sides(schema: Schema) -> tuple[list[str], str]:
    if not schema.is_directed:
        raise ModelError("prediction needs a dependent variable")
    return schema.names(schema.independent), schema.names(schema.dependent)[0]


def conditional_dv(counts: DataFrame, fitted: DataFrame, schema: Schema, whole_grid: bool = False) -> DataFrame:
    """One row per state of the independent variables: probabilities (array by code of the dependent one), prediction,
    correct and total counts.

    The prediction is the likeliest code, ties to the least; where the fit has nothing it is 0.
    ``whole_grid``: also states that were never observed.
    """
    ivs, dv = _sides(schema)
    card = schema[schema.find(dv)].cardinality
    cells = lambda t, name: [F.sum(F.when(F.col(dv) == k, F.col(VALUE)).otherwise(0.0)).alias(f"_{name}{k}") for k in range(card)]
    seen = counts.groupBy(*ivs).agg(*cells(counts, "n"))
    if whole_grid:
        grid = domain(counts.sparkSession, schema.select(ivs)).drop("state")
        seen = grid.join(seen, ivs, "left")
    both = seen.join(fitted.groupBy(*ivs).agg(*cells(fitted, "q")), ivs, "left")
    q = F.array(*[F.coalesce(f"_q{k}", F.lit(0.0)) for k in range(card)])
    n = F.array(*[F.coalesce(f"_n{k}", F.lit(0.0)) for k in range(card)])
    out = both.select(*ivs, q.alias("_q"), n.alias("_c")).withColumn("_mass", F.aggregate("_q", F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("prediction", (F.array_position("_q", F.array_max("_q")) - 1).cast("int"))
    return out.select(
        *ivs, F.when(F.col("_mass") > 0, F.transform("_q", lambda x: x / F.col("_mass"))).otherwise(F.col("_q")).alias("probabilities"), "prediction",
        F.element_at("_c", F.col("prediction") + 1).alias("correct"), F.aggregate("_c", F.lit(0.0), lambda a, x: a + x).alias("total"))


def predictions_by_rank(fitted: DataFrame, schema: Schema) -> DataFrame:
    """The same predictions by a ranking window: (independent variables, prediction, probability)."""
    ivs, dv = _sides(schema)
    order = W.partitionBy(*ivs).orderBy(F.desc(VALUE), F.asc(dv))
    p = F.col(VALUE) / F.sum(VALUE).over(W.partitionBy(*ivs))
    ranked = fitted.select(*ivs, F.col(dv).alias("prediction"), p.alias("probability"), F.row_number().over(order).alias("_k"))
    return ranked.where("_k = 1").drop("_k")


def percent_correct(conditional: DataFrame) -> DataFrame:
    return conditional.agg((100 * F.sum("correct") / F.sum("total")).alias("percent_correct"))


def confusion(counts: DataFrame, conditional: DataFrame, schema: Schema) -> DataFrame:
    """(actual, predicted, value) of every pair that occurs; a state without prediction counts as predicted 0."""
    ivs, dv = _sides(schema)
    joined = counts.join(conditional.select(*ivs, "prediction"), ivs, "left")
    return joined.groupBy(F.col(dv).alias("actual"), F.coalesce("prediction", F.lit(0)).alias("predicted")).agg(F.sum(VALUE).alias(VALUE))


def confusion_matrix(cells: DataFrame, schema: Schema) -> DataFrame:
    """One row per actual code, one column per predicted code."""
    _, dv = _sides(schema)
    card = schema[schema.find(dv)].cardinality
    wide = cells.groupBy("actual").agg(*[F.sum(F.when(F.col("predicted") == k, F.col(VALUE)).otherwise(0.0)).alias(f"predicted_{k}") for k in range(card)])
    every = cells.sparkSession.range(card).select(F.col("id").cast("int").alias("actual"))
    return every.join(wide, "actual", "left").na.fill(0.0)


def class_scores(cells: DataFrame, schema: Schema) -> DataFrame:
    """precision and recall of each code of the dependent variable (0 where undefined)."""
    _, dv = _sides(schema)
    card = schema[schema.find(dv)].cardinality
    every = F.broadcast(cells.sparkSession.range(card).select(F.col("id").cast("int").alias("code")))
    hit = lambda c: F.sum(F.when(c, F.col(VALUE)).otherwise(0.0))
    long = every.join(cells, (F.col("code") == F.col("actual")) | (F.col("code") == F.col("predicted")), "left")
    s = long.groupBy("code").agg(hit((F.col("actual") == F.col("code")) & (F.col("predicted") == F.col("code"))).alias("tp"),
                                 hit(F.col("predicted") == F.col("code")).alias("pred"), hit(F.col("actual") == F.col("code")).alias("act"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return s.select("code", ratio("tp", "pred").alias("precision"), ratio("tp", "act").alias("recall"))


def accuracy(cells: DataFrame) -> DataFrame:
    return cells.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col(VALUE)).otherwise(0.0)) / F.sum(VALUE)).alias("accuracy"))
