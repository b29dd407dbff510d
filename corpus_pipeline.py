"""Corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; between stages the documents are written as Parquet and read again.  All
stages but the last return the columns of ``documents`` with ``n_chars``
brought up to date; the last returns the packed pieces.

Edge cases: a null text passes every stage and is packed as an empty document; a
null id comes after all others when a group's document to keep is chosen; of
equal least ids (ties) the text with the least hash stays, repeated rows become
one; texts are taken whole by every stage, however long; without documents the
result is empty, without labels nothing is toxic, without benchmark items nothing
is cut; columns that documents do not have are dropped first, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontingent.llm import decontaminate, packing, pii, queries, setjoin, toxicity
from kontingent.llm.common import drop, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being the length of the text as it is now (as given for a null text)."""
    n = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return docs.select(*[n.alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects at their language's threshold go."""
    docs = docs.select(*COLUMNS)
    labels = queries.table(spark, sf_dir, "labels").where(~queries.held_out("doc_id", 5, 0))
    net = toxicity.fit(docs, labels)
    return toxicity.score(docs, net, keep_text=True).where("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a word-5-gram similarity of 0.8 or more one stays, the one of the least id.

    Documents without words have no partners and stay; repeated rows (equal id and text) become one.  Only rows that go or
    are repeated, and a few others, are shuffled with their texts.
    """
    docs = docs.select(*COLUMNS)
    told = setjoin.join_documents(docs, n=5, percent=80).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "leads")
    doubted = materialise(told.groupBy("id", "th").agg(F.min("leads").alias("stays"), F.count("*").alias("copies")).where("not stays or copies > 1"))
    some, others = setjoin.split_by_bits(docs.withColumns({"id": F.col("doc_id"), "th": F.xxhash64("text")}), doubted)
    same = lambda c: F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    judged = some.alias("l").join(doubted.alias("r"), same("id") & same("th"), "left").where("stays or stays is null").select("l.*", "copies")
    repeated = judged.where("copies > 1").dropDuplicates(["id", "text"])
    return judged.where("copies is null").union(repeated).select(*COLUMNS).union(others.select(*COLUMNS))


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside 10-word windows of benchmark items go, also where a cut made the window; documents that are mostly such
    words go as a whole."""
    items = queries.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _sized(decontaminate.decontaminate(docs.select(*COLUMNS), items, window=10, max_span=0, max_coverage=0.5))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets."""
    return _sized(pii.detect(docs.select(*COLUMNS), redact=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of at most 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), *queries.tokenizer_files(), room=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_text),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]
#: SQL cannot express the classifier or the tokenizer; tests hold each stage against its definition, by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
