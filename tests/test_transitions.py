"""Transitions over a stream: in order, out of order, late, repeated, restarted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontingent.plans import catalogue
from kontingent.streaming import transitions as tr


def test_places_events_in_any_order():
    rng = np.random.default_rng(3)
    for _ in range(200):
        events = [(int(t), k, str(rng.choice(list("abc")))) for k, t in enumerate(rng.integers(0, 10, rng.integers(1, 12)))]
        kept, net = [], {}
        arrived = [events[k] for k in rng.permutation(len(events))]
        while arrived:
            n = int(rng.integers(1, len(arrived) + 1))
            kept, changes = tr.placed(kept, arrived[:n] + arrived[:1])  # one of them twice
            arrived = arrived[n:]
            for a, b, d in changes:
                net[a, b] = net.get((a, b), 0) + d
        want = {}
        for x, y in zip(sorted(events), sorted(events)[1:]):
            want[x[2], y[2]] = want.get((x[2], y[2]), 0) + 1
        assert {k: n for k, n in net.items() if n} == want
    assert tr.trimmed([(1, 0, "a"), (2, 0, "b"), (5, 0, "c")], 4) == [(2, 0, "b"), (5, 0, "c")]
    assert tr.trimmed([(5, 0, "c")], 4) == [(5, 0, "c")] and tr.trimmed([], 4) == []


def stream(spark, folder):
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def entropy(values):
    p = np.array(values) / sum(values)
    return float(-(p * np.log2(p)).sum())


def test_stream_equals_the_batch_query(spark, sf_dir, tmp_path):
    """Files hold the events out of order; the query stops and goes on; a late row and a repeated row change nothing."""
    events = catalogue.read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    rows = events.orderBy("ts").toPandas()
    source, folder = tmp_path / "events", tmp_path / "state"
    source.mkdir()
    cut = np.array_split(np.arange(len(rows)), 3)
    swap = 40  # neighbours in time that come a file early or late
    cut[0], cut[1] = np.append(cut[0][:-swap], cut[1][:swap]), np.append(cut[0][-swap:], cut[1][swap:])
    seen = {}

    def cells(batch, batch_id):
        for r in batch.where("margin = 'pair'").collect():
            seen[r["event_type"], r["following"]] = seen.get((r["event_type"], r["following"]), 0) + r["n"]

    def write(k, part):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        q = tr.start(stream(spark, source), str(folder), "2 days", cells)
        assert q.awaitTermination(240)

    write(0, rows.iloc[cut[0]])
    run()
    for k in (1, 2):
        write(k, rows.iloc[cut[k]])
    late = rows.iloc[[0]].assign(event_id=10**9, event_type="never")
    write(3, late)
    write(4, rows.iloc[[-1]])
    write(5, rows.iloc[[-1]].assign(user_id=None, event_id=10**9 + 1))
    run()  # from the checkpoint
    want = {(r["event_type"], r["following"]): r["n"] for r in catalogue.events_markov(spark, sf_dir).collect()}
    assert {k: n for k, n in seen.items() if n} == want
    totals = tr.Totals(spark, f"{folder}/totals")
    got = {r["margin"]: (r["n"], r["entropy"]) for r in totals.entropies().collect()}
    first, second = {}, {}
    for (a, b), n in want.items():
        first[a], second[b] = first.get(a, 0) + n, second.get(b, 0) + n
    for margin, counts in (("first", first), ("second", second), ("pair", want)):
        assert got[margin][0] == sum(want.values()) and got[margin][1] == pytest.approx(entropy(list(counts.values())), abs=1e-9)
    # a batch that runs again writes the same totals
    last = totals.batches()[-1]
    again = spark.createDataFrame([("pair", "a", "b", 5, 1.5)], tr.CELLS)
    n = {r["margin"]: r["n"] for r in totals.after(last - 1).collect()}["pair"]
    for _ in range(2):
        totals.add(again, last)
        assert {r["margin"]: r["n"] for r in totals.after(last).collect()}["pair"] == n + 5


def test_changes_of_a_task_are_added_up():
    import pyarrow as pa

    schema = pa.schema([("event_type", pa.string()), ("following", pa.string()), ("delta", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([{"event_type": a, "following": b, "delta": d} for a, b, d in rows], schema) for rows in (
        [("a", "b", 1), ("a", "b", 2), ("b", "a", 5)], [("a", "b", -3), ("b", "b", 1)], [])]
    got = [tuple(r.values()) for b in tr.summed(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [("b", "a", 5), ("b", "b", 1)]
    assert sum(b.num_rows for b in tr.summed(iter([]))) == 0


def test_users_in_groups(spark, sf_dir, tmp_path):
    """Users that share a state are counted as by themselves, over two batches that lie beside each other in time."""
    events = catalogue.read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    net = {}

    def cells(batch, batch_id):
        for r in batch.where("margin = 'pair'").collect():
            net[r["event_type"], r["following"]] = net.get((r["event_type"], r["following"]), 0) + r["n"]

    for part in (0, 1):
        events.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    assert tr.start(stream(spark, tmp_path / "events"), str(tmp_path / "state"), "60 days", cells, groups=3).awaitTermination(240)
    assert {k: n for k, n in net.items() if n} == {(r["event_type"], r["following"]): r["n"] for r in catalogue.events_markov(spark, sf_dir).collect()}
