"""Data sets in files: JSON, sectioned text, CSV, and any table Spark reads.

A data set is a frame of label columns (named by the variables) with a weight
column ``value``, and a schema.  JSON and sectioned text are control-plane files
that the driver parses; CSV, Parquet and ORC are read by Spark.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..operators.table import VALUE, encode
from ..schema import Schema, Variable, spreadsheet_name, unique_abbrevs


@dataclass
class DataSet:
    name: str
    schema: Schema
    rows: DataFrame
    options: dict = field(default_factory=dict)

    def sample_size(self) -> float:
        return float(self.rows.agg(F.sum(VALUE).alias("n")).first()["n"] or 0.0)

    def table(self, unknown: str = "index") -> DataFrame:
        """The contingency table."""
        return encode(self.rows, self.schema, count=VALUE, unknown=unknown)


def _frame(spark: SparkSession, schema: Schema, rows, counts) -> DataFrame:
    kinds = ", ".join(f"`{v.name}` string" for v in schema) + f", {VALUE} double"
    return spark.createDataFrame([(*r, float(c)) for r, c in zip(rows, counts)], kinds)


# JSON ------------------------------------------------------------------------------

def schema_from_json(variables: list[dict]) -> Schema:
    abbrevs = [v.get("abbrev") for v in variables]
    if not all(abbrevs):
        abbrevs = unique_abbrevs([v["name"] for v in variables])
    return Schema(tuple(Variable(v["name"], a, int(v["cardinality"]), bool(v.get("isDependent", False)), tuple(map(str, v.get("values", ())))) for v, a in zip(variables, abbrevs)))


def read_json(spark: SparkSession, text: str) -> DataSet:
    """Variables, positional rows (labels or numbers) and optional counts.

    With ``format`` = "aggregated" the rows hold codes from 0; otherwise a number that is no label counts from 1.
    """
    root = json.loads(text)
    schema = schema_from_json(root["variables"])
    data = root.get("data", [])
    if any(len(r) != len(schema) for r in data):
        raise ValidationError("every row needs one value per variable")
    aggregated = root.get("format") == "aggregated"
    cell = (lambda v, x: v.label(int(x))) if aggregated else (lambda v, x: str(x))
    rows = [[cell(v, x) for v, x in zip(schema, r)] for r in data]
    counts = root.get("counts") or [1.0] * len(rows)
    if len(counts) != len(rows):
        raise ValidationError("there must be one count per row")
    return DataSet(root.get("name", ""), schema, _frame(spark, schema, rows, counts))


def read_json_frame(spark: SparkSession, path: str) -> DataSet:
    """The same layout, its rows exploded by Spark (for files too large for the driver to hold as objects)."""
    raw = spark.read.option("multiLine", True).json(path)
    extra = [c for c in ("format", "name") if c in raw.columns]
    first = raw.select("variables", *extra).first()
    schema = schema_from_json([{k: v for k, v in r.asDict().items() if v is not None} for r in first["variables"]])
    aggregated = "format" in extra and first["format"] == "aggregated"
    has_counts = "counts" in raw.columns
    zipped = raw.select(F.posexplode("data").alias("at", "r"), *(["counts"] if has_counts else []))
    weight = F.element_at("counts", F.col("at") + 1).cast("double") if has_counts else F.lit(1.0)
    def cell(k: int, v: Variable):
        text = F.element_at("r", k + 1).cast("string")
        return F.element_at(F.array(*map(F.lit, v.labels())), text.cast("int") + 1) if aggregated else text

    cells = [cell(k, v).alias(v.name) for k, v in enumerate(schema)]
    return DataSet((first["name"] if "name" in extra else "") or "", schema, zipped.select(*cells, weight.alias(VALUE)))


def variables_json(schema: Schema) -> list[dict]:
    return [{"name": v.name, "abbrev": v.abbrev, "cardinality": v.cardinality, "isDependent": v.is_dependent, "values": list(v.labels())} for v in schema]


def write_json(data: DataSet, limit: int = 1_000_000) -> str:
    """The data set as JSON text; larger ones belong into Parquet."""
    names = [v.name for v in data.schema]
    rows = data.rows.groupBy(*names).agg(F.sum(VALUE).alias(VALUE)).orderBy(*names).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValidationError(f"more than {limit} states; write Parquet instead")
    return json.dumps({"name": data.name, "sampleSize": sum(r[VALUE] for r in rows), "variables": variables_json(data.schema),
                       "data": [[r[n] for n in names] for r in rows], "counts": [r[VALUE] for r in rows]}, ensure_ascii=False)


def write_aggregated_json(t: DataFrame, schema: Schema, name: str = "", limit: int = 1_000_000) -> str:
    """A contingency table as sorted codes with counts."""
    rows = t.orderBy(*schema.columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValidationError(f"more than {limit} states; write Parquet instead")
    return json.dumps({"name": name, "format": "aggregated", "sampleSize": sum(r[VALUE] for r in rows), "uniqueStates": len(rows),
                       "variables": variables_json(schema), "data": [[r[c] for c in schema.columns] for r in rows], "counts": [r[VALUE] for r in rows]}, ensure_ascii=False)


def metadata_json(df: DataFrame, columns=None, dependent: str | None = None, abbrevs=None, names=None, name: str = "Converted from CSV") -> str:
    """The variables of a table as JSON, without its rows: data and counts are empty."""
    columns = list(columns or df.columns)
    found = {r["column"]: r["values"] for r in infer_values(df, columns).collect()}
    shown = [n or c for n, c in zip([*(names or ()), *[None] * len(columns)], columns)]
    short = [a or b for a, b in zip([*(abbrevs or ()), *[None] * len(columns)], unique_abbrevs(shown))]
    schema = Schema(tuple(Variable(n, a, len(found[c]), dependent in (c, n, a) and dependent is not None, tuple(found[c])) for c, n, a in zip(columns, shown, short)))
    return json.dumps({"name": name, "variables": variables_json(schema), "data": [], "counts": []}, ensure_ascii=False)


def read_cells(spark: SparkSession, text: str) -> tuple[DataFrame, Schema, str | None]:
    """Compact JSON: variables, and cells as [{"key": codes, "count": n}] or {"codes": n}; an optional model name."""
    root = json.loads(text)
    schema = schema_from_json(root["variables"])
    cells = root["data"]
    pairs = [(c["key"], c["count"]) for c in cells] if isinstance(cells, list) else [([int(x) for x in k], n) for k, n in cells.items()]
    kinds = ", ".join(f"{c} int" for c in schema.columns) + f", {VALUE} double"
    return spark.createDataFrame([(*map(int, k), float(n)) for k, n in pairs], kinds), schema, root.get("model")


# Sectioned text ---------------------------------------------------------------------

def read_sections(spark: SparkSession, text: str, name: str = "") -> DataSet:
    """Legacy text with sections :action, :nominal, :short-model, :optimize-search-width, :search-levels,
    :no-frequency and :data.  Variables of type 0 are left out, type 2 is dependent; labels are
    gathered from the data, sorted."""
    options: dict = {"action": "", "models": [], "frequency": True}
    raw_vars: list[tuple[str, int, int, str]] = []
    rows: list[list[str]] = []
    section = ""
    for line in text.splitlines():
        line = line.split("#")[0].split("//")[0].strip()
        if not line:
            continue
        if line.startswith(":"):
            section = line[1:].split()[0].lower() if line[1:].split() else ""
            if section == "no-frequency":
                options["frequency"] = False
        elif section == "action":
            options["action"] = line
        elif section == "nominal":
            f = [x.strip() for x in line.split(",")]
            if len(f) < 4:
                raise ValidationError(f"variable line {line!r} needs four fields")
            raw_vars.append((f[0], int(f[1]), int(f[2]), f[3]))
        elif section == "short-model":
            options["models"].append(line)
        elif section == "optimize-search-width":
            options["width"] = int(line)
        elif section == "search-levels":
            options["levels"] = int(line)
        elif section == "data":
            rows.append(line.split())
    wide = len(raw_vars)
    counts = [float(r[wide]) if options["frequency"] and len(r) > wide else 1.0 for r in rows]
    if any(len(r) < wide for r in rows):
        raise ValidationError("a data row has too few fields")
    active = [k for k, v in enumerate(raw_vars) if v[2] != 0]
    labels = {k: tuple(sorted({r[k] for r in rows}, key=lambda x: (not x.lstrip("-").isdigit(), int(x) if x.lstrip("-").isdigit() else 0, x))) for k in active}
    schema = Schema(tuple(
        Variable(raw_vars[k][0], raw_vars[k][3], max(raw_vars[k][1], len(labels[k])) or 1, raw_vars[k][2] == 2,
                 labels[k] + tuple(f"unseen{j}" for j in range(len(labels[k]), raw_vars[k][1]))) for k in active))
    return DataSet(name, schema, _frame(spark, schema, [[r[k] for k in active] for r in rows], counts), options)


# CSV and tables ------------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """All columns as trimmed strings; without a header they are named Col1, Col2, ..."""
    raw = spark.read.option("header", header).option("sep", delimiter).option("inferSchema", False).csv(path)
    names = raw.columns if header else [f"Col{k + 1}" for k in range(len(raw.columns))]
    return raw.toDF(*names).select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names])


def infer_values(df: DataFrame, names=None, most: int = 10_000) -> DataFrame:
    """(column, n_rows, cardinality, values): sorted distinct labels of every column, in one pass.

    Distinct (column, label) pairs are counted before they are gathered, so a column with more than
    ``most`` labels comes back with its cardinality and no labels.
    """
    names = list(names or df.columns)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("v")) for c in names])).alias("r")).select("r.*")
    pairs = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    sizes = pairs.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count("v").alias("cardinality"))
    small = F.broadcast(sizes.where(F.col("cardinality") <= most).select("column"))
    lists = pairs.where("v is not null").join(small, "column").groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("values"))
    return sizes.join(lists, "column", "left").select("column", "n_rows", "cardinality", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def first_seen(df: DataFrame, name: str) -> DataFrame:
    """(value, code): labels numbered by their first appearance in the table's order.

    Labels are dealt by ranges of their first place; each range is numbered by itself and shifted by the sizes of the
    ranges before, so no task sees all labels.  The order is that in which the table's files are read.
    """
    from pyspark.sql import Window as W

    from ..operators.storage import materialise

    seen = df.select(F.col(name).cast("string").alias("value"), F.monotonically_increasing_id().alias("at")).groupBy("value").agg(F.min("at").alias("at"))
    dealt = materialise(seen.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    before, shifts = 0, [F.lit(0).cast("long")]
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        shifts += [F.lit(r["part"]), F.lit(before).cast("long")]
        before += r["n"]
    shift = F.element_at(F.create_map(*shifts[1:]), F.col("part")) if len(shifts) > 1 else shifts[0]
    return dealt.select("value", (F.row_number().over(W.partitionBy("part").orderBy("at")) - 1 + shift).cast("int").alias("code"))


def dataset_from_frame(df: DataFrame, columns=None, dependent: str | None = None, abbrevs=None, names=None, count: str | None = None, name: str = "") -> DataSet:
    """A data set of any table: labels inferred, each row counting 1 or the ``count`` column."""
    columns = list(columns or [c for c in df.columns if c != count])
    found = {r["column"]: r["values"] for r in infer_values(df, columns).collect()}
    empty = [c for c in columns if not found.get(c)]
    if empty:
        raise ValidationError(f"no usable labels in {', '.join(empty)}")
    shown = list(names or columns)
    abbrevs = list(abbrevs or unique_abbrevs(shown))
    schema = Schema(tuple(Variable(n, a, len(found[c]), dependent in (c, n, a) and dependent is not None, tuple(found[c])) for c, n, a in zip(columns, shown, abbrevs)))
    weight = F.col(count).cast("double") if count else F.lit(1.0)
    return DataSet(name, schema, df.select(*[F.trim(F.col(c).cast("string")).alias(n) for c, n in zip(columns, shown)], weight.alias(VALUE)))


def csv_to_dataset(spark: SparkSession, path: str, columns=None, dependent=None, header=True, delimiter=",", abbrevs=None, names=None) -> DataSet:
    df = read_csv(spark, path, header, delimiter)
    picked = parse_columns(columns, df.columns) if isinstance(columns, str) else columns
    return dataset_from_frame(df, picked, dependent, abbrevs, names)


def parse_columns(spec: str | None, names) -> list[str]:
    """Columns chosen by "*", places from 0, ranges of places and names in any case, each once."""
    names = list(names)
    if spec is None or spec.strip() in ("", "*"):
        return names
    low = {n.lower(): n for n in names}
    out: list[str] = []
    for part in (p.strip() for p in spec.split(",") if p.strip()):
        a, dash, b = part.partition("-")
        if part.lower() in low:
            got = [low[part.lower()]]
        elif part == "*":
            got = names
        elif part.isdigit():
            got = names[int(part): int(part) + 1]
        elif dash and a.strip().isdigit() and b.strip().isdigit():
            got = names[int(a): int(b) + 1]
        else:
            got = []
        if not got:
            raise ValidationError(f"{part!r} names no column")
        out += [g for g in got if g not in out]
    return out


def detect(path: str) -> str:
    """json, csv, sections or parquet, by the suffix."""
    kind = {".json": "json", ".csv": "csv", ".tsv": "csv", ".in": "sections", ".txt": "sections", ".parquet": "parquet", ".orc": "orc"}.get(os.path.splitext(path)[1].lower())
    if not kind:
        raise ValidationError(f"unknown kind of file: {path}")
    return kind


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file, through Spark, so that any store it can read will do."""
    return spark.read.option("wholetext", True).text(path).first()[0]


#: JSON files of more bytes are exploded by Spark.
LARGE_JSON = 1 << 20


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def load(spark: SparkSession, path: str, **how) -> DataSet:
    kind = detect(path)
    if kind == "json":
        return read_json(spark, read_text(spark, path)) if bytes_of(spark, path) <= LARGE_JSON else read_json_frame(spark, path)
    if kind == "sections":
        return read_sections(spark, read_text(spark, path))
    if kind == "csv":
        return csv_to_dataset(spark, path, **how)
    return dataset_from_frame(spark.read.format(kind).load(path), **how)


def preprocess(data: DataSet, columns: str | None = None, auto_bin: int | None = None) -> tuple[DataFrame, Schema]:
    """Aggregated table of chosen variables; with ``auto_bin`` neighbouring codes of larger variables are merged to that many."""
    from ..operators.binning import merge_codes
    from ..operators.table import aggregate

    picked = parse_columns(columns, [v.name for v in data.schema])
    schema = data.schema.select([next(v.abbrev for v in data.schema if v.name == n) for n in picked])
    t = aggregate(data.table().select(*schema.columns, VALUE), schema)
    if auto_bin:
        new = []
        for v in schema:
            if v.cardinality > auto_bin:
                width = -(-v.cardinality // auto_bin)
                used = -(-v.cardinality // width)
                t = t.withColumn(v.abbrev, merge_codes(F.col(v.abbrev), v.cardinality, auto_bin))
                v = Variable(v.name, v.abbrev, used, v.is_dependent, tuple(f"{v.label(k * width)}-{v.label(min((k + 1) * width, v.cardinality) - 1)}" for k in range(used)))
            new.append(v)
        schema = Schema(tuple(new))
        t = aggregate(t, schema)
    return t, schema


def default_abbrevs(n: int) -> list[str]:
    return [spreadsheet_name(k) for k in range(n)]
