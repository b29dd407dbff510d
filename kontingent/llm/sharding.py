"""Sharding through a permutation-filled lookup table (DataFrame functions only).

Each shard has its own permutation of the slots of a prime-sized table (an
offset and a step, both hashed from its name).  The shards take turns; at its
turn a shard claims the first slot of its permutation that is still free.  A
row's key is hashed to a slot, and the broadcast table answers with the shard.
Adding or removing a shard moves few slots besides the shard's own share.

The table has ``slots`` rows, a parameter, so the broadcast is bounded however
large the data are.  A hot key is spread as the row id, not the source, is the
key.  A null key counts as the empty string; equal keys (repeated rows, ties)
share a shard; texts are not looked at; an empty table gives an empty result;
columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; over a hundred slots for each of up to 40 shards keep shares within about 1 %.
SLOTS = 4099
SHARDS = tuple(f"shard-{k:02d}" for k in range(32))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, and no more than slots")
    walk = [_number(f"{s}:offset") % slots for s in shards]
    step = [_number(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[walk[k]] >= 0:
                walk[k] = (walk[k] + step[k]) % slots
            table[walk[k]] = k
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot int, shard string)."""
    filled = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "k")).select(
        "slot", F.element_at(F.array(*map(F.lit, shards)), F.col("k").cast("int") + 1).alias("shard"))


def assign(df: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (string)."""
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    placed = df.select(*kept, (hashed % slots).cast("int").alias("slot"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select(*kept, "slot", "shard")


def shares(assigned: DataFrame) -> DataFrame:
    """Rows per shard."""
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"))


def write_shards(assigned: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """One folder per shard; each task writes what it has, so no shard meets in one task."""
    assigned.write.partitionBy("shard").option("maxRecordsPerFile", max_rows).parquet(path)
