"""A contingency table over a stream, refitted per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analyzer import Analyzer
from ..schema import Schema


def running_table(stream: DataFrame, schema: Schema) -> DataFrame:
    """Counts of the encoded rows so far; write it with output mode "complete" or "update"."""
    return stream.groupBy(*schema.columns).agg(F.count("*").cast("double").alias("value"))


def refit(stream: DataFrame, schema: Schema, models, sink, checkpoint: str | None = None):
    """Calls ``sink(batch id, statistics of the models)`` after every micro-batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch_id, Analyzer(batch, schema).evaluate(models))

    writer = running_table(stream, schema).writeStream.outputMode("complete").foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
