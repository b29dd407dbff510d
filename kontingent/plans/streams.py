"""Queries that run a stream over a given table to its end, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..streaming import transitions
from .catalogue import ORACLES as TABLE_ORACLES
from .catalogue import read, rounded


#: Groups of users that share a state: such a run has events of all users in a batch.
GROUPS = 4096


def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(changes of cells, entropies) of an available-now run over all events; files may hold them in any order."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # as a pattern, which may match one file as well as a folder of files
    events = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")

    def cells(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/cells/batch={batch_id}")

    query = transitions.start(events, folder, "60 days", cells, groups=GROUPS)
    query.awaitTermination()
    return spark.read.schema(f"{transitions.CELLS}, batch long").parquet(f"{folder}/cells"), transitions.Totals(spark, f"{folder}/totals").entropies()


def stream_transitions(spark, sf):
    """Each user's event type against the one that follows, maintained by a stream."""
    changes, _ = _run(spark, sf)
    pairs = changes.where("margin = 'pair'").groupBy("event_type", "following").agg(F.sum("n").alias("n"))
    return pairs.where("n > 0")


def stream_entropies(spark, sf):
    """Entropies of what came first, of what followed, and of both, from maintained sums."""
    return rounded(_run(spark, sf)[1], 8)


QUERIES = {"stream_transitions": stream_transitions, "stream_entropies": stream_entropies}

_PAIRS = "e as (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as following from events), p as (select * from e where following is not null)"
ORACLES = {
    "stream_transitions": TABLE_ORACLES["events_markov"],
    "stream_entropies": f"with {_PAIRS} " + " union all ".join(
        f"select '{m}' as margin, sum(c)::bigint as n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 8) as entropy from (select count(*) as c from p group by {', '.join(own)})"
        for m, own in transitions.MARGINS.items()),
}
