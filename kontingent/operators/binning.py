"""Discretising columns: numeric breaks, frequent categories, missing values.

A specification is fitted on a column (one aggregate) and then applied as an
expression, so binning a table is a projection and at most one join-free group
by.  Bins are given as labels or as codes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schema import Schema, Variable, unique_abbrevs

# Texts that mean a missing value, compared exactly after trimming.
MISSING = ("", "NA", "na", "N/A", "n/a", "NaN", "nan", "null", "NULL", "Null", "nil", "NIL", ".", "-", "?", "None", "none", "NONE", "#N/A", "#NA", "#NULL!")
# Names of two to seven ordered bins.
SEMANTIC = {
    1: ("Single",), 2: ("Low", "High"), 3: ("Low", "Medium", "High"), 4: ("Low", "MediumLow", "MediumHigh", "High"),
    5: ("VeryLow", "Low", "Medium", "High", "VeryHigh"), 6: ("VeryLow", "Low", "MediumLow", "MediumHigh", "High", "VeryHigh"),
    7: ("VeryLow", "Low", "MediumLow", "Medium", "MediumHigh", "High", "VeryHigh"),
}
STRATEGIES = ("none", "width", "quantile", "breaks", "top", "threshold")
#: Most distinct values that a categorical column may keep.
MAX_VALUES = 10_000


@dataclass(frozen=True)
class BinSpec:
    """strategy: see STRATEGIES; labels: "range", "semantic", "index" or a tuple of names; missing: "separate", "exclude" or "ignore"."""

    strategy: str = "none"
    bins: int = 5
    breaks: tuple[float, ...] = ()
    top: int = 5
    threshold: float = 0.0
    threshold_is_ratio: bool = True
    labels: str | tuple[str, ...] = "range"
    precision: int = 0
    missing: str = "separate"
    missing_label: str = "Missing"
    other_label: str = "Other"

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValidationError(f"unknown strategy {self.strategy!r}")
        if self.missing not in ("separate", "exclude", "ignore"):
            raise ValidationError(f"unknown missing rule {self.missing!r}")


@dataclass(frozen=True)
class Fitted:
    """A specification with its breaks or kept values, and the labels of all codes."""

    spec: BinSpec
    labels: tuple[str, ...]
    breaks: tuple[float, ...] = ()
    kept: tuple[str, ...] = ()
    has_other: bool = False
    has_missing: bool = False


def is_missing(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")).isin(*MISSING), F.lit(True))


def number(name: str) -> Column:
    """The column as a number; null where it is none."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.expr(f"try_cast(trim(cast({quoted} as string)) as double)")


# Breaks and labels -----------------------------------------------------------------

def equal_width_breaks(low: float | None, high: float | None, bins: int) -> tuple[float, ...]:
    """Breaks of ``bins`` equal parts; half a unit around a constant, (0, 1) without values."""
    if low is None or high is None:
        return (0.0, 1.0)
    if low == high:
        return (low - 0.5, high + 0.5)
    return tuple(low + (high - low) / bins * k for k in range(bins)) + (high,)


def range_labels(breaks, precision: int = 0) -> tuple[str, ...]:
    if len(breaks) < 2:
        return ("0",)
    text = (lambda x: str(int(x))) if precision == 0 else (lambda x: f"{x:.{precision}f}")
    return tuple(f"{text(a)}-{text(b)}" for a, b in zip(breaks, breaks[1:]))


def semantic_labels(n: int) -> tuple[str, ...]:
    return SEMANTIC.get(n) or tuple(f"Bin{k + 1}" for k in range(n))


def bin_labels(spec: BinSpec, breaks) -> tuple[str, ...]:
    n = max(1, len(breaks) - 1)
    if isinstance(spec.labels, tuple):
        return spec.labels[:n] + tuple(f"Bin{k + 1}" for k in range(len(spec.labels), n))
    if spec.labels == "semantic":
        return semantic_labels(n)
    if spec.labels == "index":
        return tuple(str(k) for k in range(n))
    return range_labels(breaks, spec.precision)


def bin_code(value: Column, breaks) -> Column:
    """Half-open bins; values at or below the first break are in bin 0, at or above the last in the last bin."""
    inner = list(breaks[1:-1])
    out = F.lit(len(inner))
    for k in reversed(range(len(inner))):
        out = F.when(value < F.lit(float(inner[k])), F.lit(k)).otherwise(out)
    return out


# Fitting ------------------------------------------------------------------------------

def analyze(df: DataFrame, names=None) -> DataFrame:
    """One row per column: is_numeric, unique_count, missing_count, n_rows, min, max (over present values).

    Each column is grouped by its values first, in a scan of its own that reads nothing else; texts are looked at once per
    distinct value.
    """
    out = None
    for c in names or df.columns:
        seen = df.select(F.col(c).alias("_value")).groupBy("_value").agg(F.count("*").alias("k"))
        seen = seen.select(F.trim(F.col("_value").cast("string")).alias("v"), number("_value").alias("x"), is_missing(F.col("_value")).alias("m"), "k")
        present = ~F.col("m")
        one = seen.agg(
            F.coalesce(F.bool_and(F.when(present, F.col("x").isNotNull())), F.lit(False)).alias("is_numeric"),
            F.count_distinct(F.when(present, F.col("v"))).alias("unique_count"), F.coalesce(F.sum(F.when(F.col("m"), F.col("k"))), F.lit(0)).cast("long").alias("missing_count"),
            F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n_rows"), F.min(F.when(present, F.col("x"))).alias("min"), F.max(F.when(present, F.col("x"))).alias("max"))
        one = one.select(F.lit(c).alias("column"), "*")
        out = one if out is None else out.union(one)
    return out


def exact_quantiles(x: DataFrame, at: list[float], most: int = MAX_VALUES) -> list[float]:
    """Quantiles of the column ``x`` (no nulls), interpolated between neighbours; [] without rows.

    A sketch brackets each quantile; then rows below each bracket are counted and the distinct values inside are fetched.
    A bracket with more than ``most`` distinct values is narrowed by another sketch of what it holds, so nothing but
    bounded lists reaches the driver and every pass adds up partially.
    """
    error = 1e-4
    n, lows, highs = x.agg(F.count("*"), *[F.percentile_approx("x", [min(1.0, max(0.0, p + e)) for p in at], int(1 / error)) for e in (-2 * error, 2 * error)]).first()
    if not n:
        return []
    spans = [[lo, hi] for lo, hi in zip(lows, highs)]
    while True:
        below = x.agg(*[F.count(F.when(F.col("x") < F.lit(lo), 1)) for lo, _ in spans]).first()
        inside = F.lit(False)
        for lo, hi in spans:
            inside = inside | F.col("x").between(lo, hi)
        values = x.where(inside).groupBy("x").agg(F.count("*").alias("k")).limit(most * len(at) + 1).collect()
        if len(values) <= most * len(at):
            break
        for k, p in enumerate(at):  # narrow around the rank among what the bracket holds
            lo, hi = spans[k]
            part = x.where(F.col("x").between(lo, hi))
            size = part.count()
            share = (p * (n - 1) - below[k]) / max(1, size)
            spans[k] = list(part.agg(F.percentile_approx("x", [min(1.0, max(0.0, share + e)) for e in (-2 * error, 2 * error)], int(1 / error))).first()[0])
    values = sorted((r["x"], r["k"]) for r in values)
    out = []
    for p, (lo, hi), under in zip(at, spans, below):
        own = [(v, k) for v, k in values if lo <= v <= hi]

        def ranked(rank):
            have = under
            for v, k in own:
                have += k
                if have > rank:
                    return v
            return x.where(F.col("x") > hi).agg(F.min("x")).first()[0]  # the neighbour just above the bracket

        rank = p * (n - 1)
        a = ranked(int(rank))
        b = a if rank == int(rank) else ranked(int(rank) + 1)
        out.append(a if a == b else (1 - (rank - int(rank))) * a + (rank - int(rank)) * b)
    return out


def frequencies(df: DataFrame, name: str) -> DataFrame:
    """(value, n) of present values, most frequent first, ties by value."""
    v = F.trim(F.col(name).cast("string"))
    return df.where(~is_missing(F.col(name))).groupBy(v.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def fit_column(df: DataFrame, name: str, spec: BinSpec, approximate: bool = False) -> Fitted:
    """Breaks or kept values of a column.  ``approximate``: quantiles from a sketch instead of exactly."""
    if spec.strategy in ("width", "quantile", "breaks"):
        x = df.select(number(name).alias("x"))
        missing, bad, low, high = df.select(number(name).alias("x"), is_missing(F.col(name)).alias("m")).agg(F.bool_or("m"), F.bool_or(F.isnull("x")), F.min("x"), F.max("x")).first()
        if spec.strategy == "width":
            breaks = equal_width_breaks(low, high, spec.bins)
        elif spec.strategy == "quantile":
            at = [k / spec.bins for k in range(spec.bins + 1)]
            x = x.where("x is not null")
            found = x.agg(F.percentile_approx("x", at, 100_000)).first()[0] if approximate else exact_quantiles(x, at)
            breaks = tuple(dict.fromkeys(found or (0.0, 1.0)))
            breaks = breaks if len(breaks) > 1 else (breaks[0] - 0.5, breaks[0] + 0.5)
        else:
            breaks = tuple(spec.breaks)
            if len(breaks) < 2 or list(breaks) != sorted(set(breaks)):
                raise ValidationError("breaks must ascend, two at least")
        separate = spec.missing == "separate" and bool(missing or bad)
        return Fitted(spec, bin_labels(spec, breaks) + ((spec.missing_label,) if separate else ()), breaks=breaks, has_missing=separate)
    separate = spec.missing == "separate" and bool(df.where(is_missing(F.col(name))).limit(1).count())
    freq = frequencies(df, name)
    if spec.strategy == "top":
        kept = [r["value"] for r in freq.limit(spec.top).collect()]
    elif spec.strategy == "threshold":
        n = df.where(~is_missing(F.col(name))).count()
        least = spec.threshold * n if spec.threshold_is_ratio else spec.threshold
        kept = [r["value"] for r in freq.where(F.col("n") >= least).limit(MAX_VALUES + 1).collect()]
    else:
        kept = [r["value"] for r in freq.limit(MAX_VALUES + 1).collect()]
    if len(kept) > MAX_VALUES:
        raise ValidationError(f"{name} keeps more than {MAX_VALUES} values")
    other = spec.strategy != "none" and bool(freq.where(~F.col("value").isin(*kept) if kept else F.lit(True)).limit(1).count())
    labels = (*kept, *((spec.other_label,) if other else ()), *((spec.missing_label,) if separate else ()))
    return Fitted(spec, labels, kept=tuple(kept), has_other=other, has_missing=separate)


def code_column(name: str, f: Fitted) -> Column:
    """Code of each row; null where the row is to be left out."""
    if f.breaks:
        x = number(name)
        gone = {"separate": F.lit(len(f.labels) - 1), "exclude": F.lit(None).cast("int"), "ignore": F.lit(0)}[f.spec.missing]
        return F.when(x.isNull(), gone).otherwise(bin_code(x, f.breaks)).cast("int")
    v = F.trim(F.col(name).cast("string"))
    other = F.lit(min(len(f.kept), len(f.labels) - 1))
    code = F.coalesce(F.element_at(F.create_map(*[x for k, s in enumerate(f.kept) for x in (F.lit(s), F.lit(k))]), v), other) if f.kept else other
    gone = {"separate": F.lit(len(f.labels) - 1), "exclude": F.lit(None).cast("int"), "ignore": other}[f.spec.missing]
    return F.when(is_missing(F.col(name)), gone).otherwise(code).cast("int")


def label_column(name: str, f: Fitted) -> Column:
    return F.element_at(F.array(*map(F.lit, f.labels)), code_column(name, f) + 1)


def suggest(is_numeric: bool, unique_count: int, target: int = 5) -> BinSpec:
    if is_numeric:
        return BinSpec("width", bins=target)
    if unique_count > target:
        return BinSpec("top", top=target, labels="index")
    return BinSpec("none")


def apply_binning(df: DataFrame, specs: dict[str, BinSpec], count: str | None = None) -> tuple[DataFrame, dict[str, Fitted]]:
    """``df`` with the named columns binned to labels, equal rows merged; weights in ``value``."""
    fitted = {c: fit_column(df, c, s) for c, s in specs.items()}
    names = [c for c in df.columns if c != count]
    cols = [label_column(c, fitted[c]).alias(c) if c in fitted else F.col(c) for c in names]
    for c, f in fitted.items():
        if f.spec.missing == "exclude":  # on the code: a label looked up by a null code may be taken for never null
            df = df.where(code_column(c, f).isNotNull())
    out = df.select(*cols, (F.col(count).cast("double") if count else F.lit(1.0)).alias("value"))
    return out.groupBy(*names).agg(F.sum("value").alias("value")), fitted


def auto_bin(df: DataFrame, target: int = 5, threshold: int = 10, count: str | None = None) -> tuple[DataFrame, dict[str, Fitted]]:
    """Bins every column with more than ``threshold`` distinct values as suggested."""
    specs = {r["column"]: suggest(r["is_numeric"], r["unique_count"], target) for r in analyze(df.drop(count) if count else df).collect() if r["unique_count"] > threshold}
    return apply_binning(df, specs, count)


def merge_codes(code: Column, cardinality: int, target: int) -> Column:
    """Neighbouring codes put together in groups of equal size."""
    width = -(-cardinality // target)
    return F.least(F.floor(code / F.lit(width)).cast("int"), F.lit(target - 1))


def parse_spec(text: str) -> tuple[str, BinSpec]:
    """NAME:STRATEGY:PARAM, for example age:width:5, income:freq:4, age:breaks:0,18,65,120, city:top:3, city:thresh:0.05."""
    parts = text.rsplit(":", 2)
    if len(parts) != 3 or not parts[0]:
        raise ValidationError(f"{text!r} is not NAME:STRATEGY:PARAM")
    name, strategy, param = parts
    try:
        if strategy == "width":
            return name, BinSpec("width", bins=int(param))
        if strategy in ("freq", "quantile"):
            return name, BinSpec("quantile", bins=int(param))
        if strategy == "breaks":
            return name, BinSpec("breaks", breaks=tuple(float(x) for x in param.split(",")))
        if strategy == "top":
            return name, BinSpec("top", top=int(param))
        if strategy in ("thresh", "threshold"):
            x = float(param)
            return name, BinSpec("threshold", threshold=x, threshold_is_ratio=x < 1)
    except ValueError as e:
        raise ValidationError(f"{text!r}: {e}") from e
    raise ValidationError(f"unknown strategy {strategy!r}")


def schema_of(fitted: dict[str, Fitted], dependent: str | None = None) -> Schema:
    """Variables of binned columns."""
    return Schema(tuple(Variable(c, a, len(f.labels), c == dependent, f.labels) for (c, f), a in zip(fitted.items(), unique_abbrevs(fitted))))


def with_precision(spec: BinSpec, digits: int) -> BinSpec:
    return replace(spec, precision=digits)
