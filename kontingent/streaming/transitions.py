"""What follows what, per user, over an unbounded stream: counts and entropies that are maintained, not counted anew.

Two stateful operators.  The first keeps, per user (by itself or in a group), the events that a late one may still fall between (those after the
watermark, and the last one before it).  An event that arrives is put into its place in time; it adds the transitions to
and from its neighbours and takes away the one that it breaks.  A task adds up the changes of its users by cell.  The second
keeps a count per cell and says by how much the
cell's c log2 c has changed.  A micro-batch adds a handful of such numbers to the totals, from which the entropies of both
margins and of the pair follow; no count of any other cell is read.

Order: an event's place is by (time, id).  Late rows: an event is accepted while it is not older than the watermark, which
lags ``delay`` behind the newest event; older ones are dropped by Spark, and nothing that was counted changes.  Repeated
rows (equal user, time and id) count once while the first is kept, that is, until the watermark has passed it.
Rows with a null user, time or type are dropped.

Restart: the operators' state is in the query's checkpoint, the totals of each batch are a file of their own beside it, so
a batch that runs again starts from the totals of the batch before and overwrites its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "user_id long, ts timestamp, event_id long, event_type string"
CHANGES = "event_type string, following string, delta long"
#: Cells that a task holds before it sends their changes on.
CELLS_HELD = 1 << 16
CELLS = "margin string, event_type string, following string, n long, gain double"
TOTALS = "margin string, n long, s double"
#: The margins of a pair: what came first, what followed, both.
MARGINS = {"first": ("event_type",), "second": ("following",), "pair": ("event_type", "following")}


def c_log_c(c: int) -> float:
    return c * math.log2(c) if c > 0 else 0.0


def placed(kept: list[tuple], new: list[tuple]) -> tuple[list[tuple], list[tuple[str, str, int]]]:
    """(events kept, changes) when new events (time, id, type) are put among those kept, in order of time and id."""
    both, at = {}, {e[:2]: e for e in kept}  # of repeated rows the first stays
    for e in sorted(new):
        at.setdefault(e[:2], e)
    after = sorted(at.values())
    for events, sign in ((kept, -1), (after, 1)):
        for x, y in zip(events, events[1:]):
            both[x[2], y[2]] = both.get((x[2], y[2]), 0) + sign
    return after, [(a, b, n) for (a, b), n in both.items() if n]


def trimmed(kept: list[tuple], watermark_us: int) -> list[tuple]:
    """Without what no accepted event can precede: all but the last event before the watermark."""
    old = sum(e[0] < watermark_us for e in kept)
    return kept[max(0, old - 1):]


def summed(batches):
    """Changes of a task's users added up, sent whenever there are ``CELLS_HELD`` cells: the next operator gets rows by task and cell."""
    import pyarrow as pa

    sums: dict[tuple, int] = {}

    def sent():
        rows = [(*cell, n) for cell, n in sums.items() if n]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["event_type", "following", "delta"])

    for b in batches:
        part = pa.Table.from_batches([b]).group_by(["event_type", "following"]).aggregate([("delta", "sum")])
        for first, then, n in zip(*[part[c].to_pylist() for c in ("event_type", "following", "delta_sum")]):
            sums[first, then] = sums.get((first, then), 0) + n
        if len(sums) >= CELLS_HELD:
            yield sent()
            sums.clear()
    yield sent()


def _frame(names: list[str], rows: list[tuple]):
    """A pandas table of plain objects: strings in pandas' own arrays would come to Spark in chunks, which it does not take."""
    import pandas as pd

    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})


class _Order(StatefulProcessor):
    """Per group of users: each user's events in their place; changes of transitions."""

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "users array<long>, times array<long>, ids array<long>, types array<string>")

    def _load(self) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for user, *event in zip(*(self.kept.get() or ())):
            out.setdefault(user, []).append(tuple(event))
        return out

    def _save(self, kept: dict[int, list[tuple]], watermark_us: int) -> None:
        rows = [(user, *e) for user, events in kept.items() for e in trimmed(events, watermark_us)]
        self.kept.update(tuple(map(list, zip(*rows))))

    def handleInputRows(self, key, rows, timerValues):
        kept, new, sums = self._load(), {}, {}
        for b in rows:
            for user, *event in zip(*[b[c].tolist() for c in ("user_id", "us", "event_id", "event_type")]):
                new.setdefault(user, []).append(tuple(event))
        for user, events in new.items():
            kept[user], changes = placed(kept.get(user, []), events)
            for first, then, n in changes:
                sums[first, then] = sums.get((first, then), 0) + n
        self._save(kept, 1000 * timerValues.getCurrentWatermarkInMs())
        newest = max(events[-1][0] for events in kept.values())
        self.handle.registerTimer(newest // 1000 + 1)  # when the watermark has passed the newest, one event a user is enough
        yield _frame(["event_type", "following", "delta"], [(*cell, n) for cell, n in sums.items() if n])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._save(self._load(), 1000 * timerValues.getCurrentWatermarkInMs())
        yield _frame(["event_type", "following", "delta"], [])

    def close(self) -> None:
        pass


class _Count(StatefulProcessor):
    """Per cell: its count; what a batch adds to c log2 c."""

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        before = int(self.count.get()[0]) if self.count.exists() else 0
        after = before + sum(int(b["delta"].sum()) for b in rows)
        if after != before:
            self.count.update((after,))
            yield _frame(["margin", "event_type", "following", "n", "gain"], [(*key, after - before, c_log_c(after) - c_log_c(before))])

    def close(self) -> None:
        pass


def cell_changes(events: DataFrame, delay: str = "1 day", groups: int | None = None) -> DataFrame:
    """(CELLS) of a stream of events: by how much the counts of cells and their c log2 c have changed in a batch.

    groups: users are kept together in so many groups by a hash.  A batch reads and writes a group's state once, whoever of the
    group has events in it, so this is for batches that hold events of most users; None: every user alone.
    """
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type").where("user_id is not null and ts is not null and event_id is not null and event_type is not null")
    rows = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("user_id"), F.lit(groups)) if groups else F.col("user_id"))
    changes = rows.groupBy("place").transformWithStateInPandas(_Order(), CHANGES, "Append", "EventTime").mapInArrow(summed, CHANGES)
    cells = F.array(*[F.struct(F.lit(m).alias("margin"), *[(F.col(c) if c in own else F.lit("")).alias(c) for c in ("event_type", "following")]) for m, own in MARGINS.items()])
    spread = changes.select(F.explode(cells).alias("c"), "delta").select("c.*", "delta")
    return spread.groupBy("margin", "event_type", "following").transformWithStateInPandas(_Count(), CELLS, "Append", "None")


class Totals:
    """n and the sum of c log2 c of each margin after each batch, one small file a batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self.folder}/batch-{batch:012d}"

    def batches(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")))

    def after(self, batch: int | None = None) -> DataFrame:
        """The totals of the last batch, or of the last one up to a number; no rows before the first."""
        done = [b for b in self.batches() if batch is None or b <= batch]
        return self.spark.read.schema(TOTALS).parquet(self._path(done[-1])) if done else self.spark.createDataFrame([], TOTALS)

    def add(self, changes: DataFrame, batch: int) -> None:
        more = changes.groupBy("margin").agg(F.sum("n").alias("n"), F.sum("gain").alias("s"))
        new = self.after(batch - 1).unionByName(more).groupBy("margin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        new.coalesce(1).write.mode("overwrite").parquet(self._path(batch))

    def entropies(self, batch: int | None = None) -> DataFrame:
        """(margin, n, entropy in bits)."""
        return self.after(batch).where("n > 0").select("margin", "n", (F.log2(F.col("n")) - F.col("s") / F.col("n")).alias("entropy"))


def start(events: DataFrame, folder: str, delay: str = "1 day", cells: Callable[[DataFrame, int], None] | None = None, available_now: bool = True, groups: int | None = None):
    """A running query that maintains ``Totals(spark, folder/totals)``; ``cells`` also gets each batch's changes of cells.

    folder: shared storage for the checkpoint and the totals; the same folder goes on where it stopped.  groups: see ``cell_changes``.
    """
    spark = events.sparkSession
    totals = Totals(spark, f"{folder.rstrip('/')}/totals")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # what a batch changes is read by the totals and by the caller
        try:
            totals.add(batch, batch_id)
            if cells:
                cells(batch, batch_id)
        finally:
            batch.unpersist()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the store that such operators need; a query keeps what it was started with
    try:
        writer = cell_changes(events, delay, groups).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
