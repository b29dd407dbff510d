"""Integer sequences as data sets: residues, digit sums, Collatz steps, prime factors."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..errors import ValidationError
from ..schema import Schema, Variable

KINDS = ("primes", "naturals", "odds")
#: Numbers in one part of the consecutive-pair window.
PART = 1 << 20


def naturals(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "n")


def odds(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select((F.col("id") * 2 + 1).alias("n"))


def primes_below(spark: SparkSession, limit: int) -> DataFrame:
    """Primes up to ``limit``: numbers without the multiples of the primes up to its root."""
    root = int(limit**0.5) + 1
    small = np.ones(root + 1, bool)
    small[:2] = False
    for p in range(2, int(root**0.5) + 1):
        if small[p]:
            small[p * p:: p] = False
    base = spark.range(1).select(F.explode(F.array(*[F.lit(int(p)) for p in np.flatnonzero(small) if p * p <= limit] or [F.lit(limit + 1)])).alias("p"))
    multiples = base.where(F.col("p") <= limit).select(F.explode(F.expr(f"sequence(cast(p as bigint) * p, {limit}L, cast(p as bigint))")).alias("n"))
    return spark.range(2, limit + 1).withColumnRenamed("id", "n").join(multiples.distinct(), "n", "left_anti")


def prime_bound(count: int) -> int:
    """A number below which there are at least ``count`` primes."""
    return 15 if count < 6 else int(count * (np.log(count) + np.log(np.log(count)))) + 1


def primes(spark: SparkSession, count: int) -> DataFrame:
    return primes_below(spark, prime_bound(count)).orderBy("n").limit(count)


def generate(spark: SparkSession, kind: str, count: int) -> DataFrame:
    if kind not in KINDS:
        raise ValidationError(f"unknown sequence {kind!r}")
    return {"primes": primes, "naturals": naturals, "odds": odds}[kind](spark, count)


def digit_sum(n: Column) -> Column:
    digits = F.filter(F.split(n.cast("string"), ""), lambda d: d != "")
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d.cast("int"))


@F.pandas_udf(IntegerType())
def collatz_steps(n: pd.Series) -> pd.Series:
    """Steps of the 3n + 1 walk to 1, at most 1000; the walks of a batch go together."""
    x, steps = n.to_numpy(np.int64).copy(), np.zeros(len(n), np.int32)
    for _ in range(1000):
        live = x > 1
        if not live.any():
            break
        x = np.where(live, np.where(x % 2 == 0, x // 2, 3 * x + 1), x)
        steps += live
    return pd.Series(steps)


@F.pandas_udf(IntegerType())
def prime_factors(n: pd.Series) -> pd.Series:
    """Number of prime factors, with multiplicity."""
    x, count = n.to_numpy(np.int64).copy(), np.zeros(len(n), np.int32)
    p = 2
    while len(x) and p * p <= x.max():
        hit = (x % p == 0) & (x > 1)
        while hit.any():
            x[hit] //= p
            count += hit
            hit = (x % p == 0) & (x > 1)
        p += 1 if p == 2 else 2
    return pd.Series(count + (x > 1))


@dataclass(frozen=True)
class SequenceColumn:
    """kind: residue (with base), collatz, digits, factors, or custom (a function Column -> Column)."""

    kind: str
    base: int = 0
    name: str = ""
    function: object = None

    def of(self, n: Column) -> Column:
        made = {"residue": lambda: F.pmod(n, F.lit(self.base)).cast("int"), "collatz": lambda: collatz_steps(n), "digits": lambda: digit_sum(n),
                "factors": lambda: prime_factors(n), "custom": lambda: self.function(n).cast("int")}
        return made[self.kind]()

    @property
    def title(self) -> str:
        return self.name or (f"R{self.base}" if self.kind == "residue" else self.kind)

    @property
    def prefix(self) -> str:
        return {"collatz": "k", "digits": "d", "factors": "f", "custom": "c"}.get(self.kind, "")


def parse_column(text: str) -> SequenceColumn:
    text = text.strip()
    if text[:1] in "Rr" and text[1:].isdigit() and int(text[1:]) > 0:
        return SequenceColumn("residue", int(text[1:]))
    if text.lower() in ("collatz", "digits", "factors"):
        return SequenceColumn(text.lower())
    raise ValidationError(f"unknown column {text!r}")


def parse_columns(text: str) -> list[SequenceColumn]:
    return [parse_column(p) for p in text.split(",") if p.strip()]


def consecutive(numbers: DataFrame) -> DataFrame:
    """(n, next): each number with the following one.

    Ranges of PART numbers are windows of their own; each takes the next range's least number at its
    end, so no window spans the table.
    """
    parts = numbers.select("n", F.floor(F.col("n") / PART).alias("part"))
    heads = parts.groupBy("part").agg(F.min("n").alias("head"))
    after = heads.select("part", F.lead("head").over(W.orderBy("part")).alias("head"))  # one row per range
    ahead = F.lead("n").over(W.partitionBy("part").orderBy("n"))
    linked = parts.join(F.broadcast(after), "part").select("n", F.coalesce(ahead, F.col("head")).alias("next"))
    return linked.where("next is not null")


def pair_dataset(numbers: DataFrame, columns: list[SequenceColumn], target: SequenceColumn) -> DataFrame:
    """Columns of each number, and the target column Z of the number after it."""
    return consecutive(numbers).select(*[c.of(F.col("n")).alias(c.title) for c in columns], target.of(F.col("next")).alias("Z"))


def single_dataset(numbers: DataFrame, columns: list[SequenceColumn], target: SequenceColumn) -> DataFrame:
    """Columns and target of the same number."""
    return numbers.select(*[c.of(F.col("n")).alias(c.title) for c in columns], target.of(F.col("n")).alias("Z"))


def to_table(data: DataFrame, columns: list[SequenceColumn], target: SequenceColumn) -> tuple[DataFrame, Schema]:
    """Contingency table and schema; the dependent variable is Z."""
    every = [*columns, target]
    names = [*[c.title for c in columns], "Z"]
    tops = data.agg(*[F.max(n).alias(n) for n in names]).first()
    sizes = [c.base if c.kind == "residue" else int(tops[n] or 0) + 1 for c, n in zip(every, names)]
    abbrevs = [chr(65 + k) for k in range(len(columns))] + ["Z"]
    schema = Schema(tuple(Variable(n, a, s, a == "Z", tuple(f"{c.prefix}{j}" for j in range(s))) for c, n, a, s in zip(every, names, abbrevs, sizes)))
    return data.groupBy(*[F.col(n).cast("int").alias(a) for n, a in zip(names, abbrevs)]).agg(F.count("*").cast("double").alias("value")), schema


# Sinks ---------------------------------------------------------------------------

def write_csv(data: DataFrame, path: str, header: bool = True) -> None:
    """A sequence data set as a folder of CSV files, columns and target Z."""
    data.write.option("header", header).csv(path)


def generic_json(data: DataFrame, columns: list[SequenceColumn], target: SequenceColumn, name: str = "", limit: int = 1_000_000) -> str:
    """A sequence data set as JSON: its columns, target, cardinalities and rows; larger ones belong into CSV or Parquet."""
    rows = data.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValidationError(f"more than {limit} rows; write CSV or Parquet instead")
    _, schema = to_table(data, columns, target)
    about = [{"name": c.title, "abbrev": v.abbrev, "kind": c.kind} for c, v in zip([*columns, target], schema)]
    about[-1]["name"] = "Z"
    return json.dumps({"name": name, "columns": about[:-1], "targetColumn": about[-1], "columnCardinalities": [v.cardinality for v in schema][:-1],
                       "dvCardinality": schema[len(columns)].cardinality, "data": [list(r) for r in rows]})


# Sample size -----------------------------------------------------------------------

def state_space(cardinalities) -> int:
    out = 1
    for c in cardinalities:
        out *= c
    return out


def required_sample(cardinalities, per_state: int = 5) -> int:
    return per_state * state_space(cardinalities)


def largest_residue_set(sample: int, candidates=(3, 5, 7, 11, 13, 17, 19), per_state: int = 5) -> list[int]:
    """The longest run of bases, with the least base once more as the target, that the sample can fill."""
    out: list[int] = []
    for b in candidates:
        if required_sample([*out, b, candidates[0]], per_state) > sample:
            break
        out.append(b)
    return out


def assess_sample(sample: float, cardinalities) -> dict:
    """Observations per state, and a verdict: 10 and more good, 5 adequate, 1 marginal."""
    ratio = sample / state_space(cardinalities)
    verdict = "good" if ratio >= 10 else "adequate" if ratio >= 5 else "marginal" if ratio >= 1 else "inadequate"
    return {"state_space": state_space(cardinalities), "ratio": ratio, "verdict": verdict, "required": required_sample(cardinalities)}
