"""Streams with state against their batch twins: late and out-of-order batches, runs that go on, state that ends."""

import datetime as dt
import random

from pyspark.sql import functions as F

from snapweave.operators import ingest
from snapweave.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
CHANGES, EVENTS = "page_id long, ts timestamp, hidden boolean", "page_id long, seq long, event string, ts timestamp"


def arrive(spark, folder, rows, kind):
    """One more file of rows, and the stream of all files, one a batch."""
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def states(spark, query_path):
    return spark.read.format("statestore").option("stateVarName", "page").load(query_path).count()


def test_bursts_of_late_and_out_of_order_batches(spark, tmp_path):
    rng = random.Random(5)
    changes = [(rng.randrange(6), T0 + dt.timedelta(seconds=rng.randrange(400)), rng.random() < 0.2) for _ in range(700)]
    changes.sort(key=lambda c: c[1].timestamp() + rng.randrange(25))  # out of order by less than the watermark's delay
    changes += [(None, T0, False), (3, None, False), (77, T0 + dt.timedelta(hours=2), True)]
    root, folder = str(tmp_path / "run"), str(tmp_path / "in")
    for low in range(0, len(changes), 180):
        stream = arrive(spark, folder, changes[low : low + 180], CHANGES)
        got = jobs.run_available(jobs.stream_change_bursts(stream, delay="30 seconds"), root)
    batch = spark.createDataFrame(changes, CHANGES).where("page_id IS NOT NULL AND ts IS NOT NULL")
    want = {tuple(r) for r in ingest.change_bursts(batch).collect()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) > 20
    assert set(rows) == want
    assert states(spark, f"{root}/state") == 0  # pages 0 to 5 are past their lives; that of 77 is not closed


def test_bursts_of_a_table_without_rows(spark, tmp_path):
    stream = arrive(spark, str(tmp_path / "in"), [], CHANGES)
    assert jobs.run_available(jobs.stream_change_bursts(stream), str(tmp_path / "run")).count() == 0


def lifecycle_rows(spark, folder, root, rows):
    """What a run gives for events (page, seq, event), each at seq seconds."""
    out, rows = [], [(*r, r[1] is not None and T0 + dt.timedelta(seconds=r[1]) or None) for r in rows]
    stream = jobs.stream_lifecycle(arrive(spark, folder, rows, EVENTS), "5 minutes", dt.timedelta(minutes=30))
    jobs.run_batches(stream, root, lambda b, _: out.extend(tuple(r) for r in b.collect()), "update")
    return out


def test_lifecycle_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    events = [(rng.randrange(8), seq, rng.choice(["created", "retried", "finalized", "updated", "failed"])) for seq in range(120)]
    events.append((9, 250, "failed"))
    shuffled = rng.sample(events, len(events)) + [events[3], (4, None, "failed"), (4, 260, "seen"), (4, 260, None), (None, 260, "failed")]
    last = {}
    for low in range(0, len(shuffled), 45):
        for page, seq, state in lifecycle_rows(spark, str(tmp_path / "in"), str(tmp_path / "run"), shuffled[low : low + 45]):
            last[page] = (seq, state)
    want = jobs.fold_lifecycle(spark.createDataFrame(events, "page_id long, seq long, event string"))
    assert last == {r.page_id: (r.seq, r.snapshot_state) for r in want.collect()}


def test_lifecycle_state_of_a_quiet_page_goes(spark, tmp_path):
    go = lambda rows: lifecycle_rows(spark, str(tmp_path / "in"), str(tmp_path / "run"), rows)
    assert go([(1, 10, "finalized")]) == [(1, 10, "ready")]
    assert go([(1, 5, "failed")]) == [(1, 10, "ready")]
    assert go([(2, 9000, "created")]) == [(2, 9000, "pending")]
    assert states(spark, str(tmp_path / "run/state")) == 1
    assert go([(1, 20, "failed"), (1, 9001, "failed")]) == [(1, 9001, "failed")]  # the first is too late, the other a page of its own
