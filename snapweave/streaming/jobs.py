"""The archive's jobs on streams. Each has a batch operator of the same meaning, with which tests compare it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import logs, resources
from ..sources import logfiles


def with_state_store(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB, which state with timers and lifetimes needs; a provider that is set is left as it is."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(key):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now, and read all that it has written under root.

    Its progress is kept there too: run again with the same root, it goes on where it (or a run that broke off) stopped.
    """
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def run_batches(stream: DataFrame, root: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """As run_available, with each micro-batch handed to `each`, which must give the same when a batch comes again."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def merge_snapshots(held: DataFrame | None, captures: DataFrame | None) -> DataFrame:
    """url, content_hash, first and last capture and visits after more captures; late ones only widen the span. Of `held` alone, its rows added up."""
    new = captures and captures.groupBy("url", "content_hash").agg(F.min("captured_at").alias("first_visited"), F.max("captured_at").alias("last_visited"), F.count("*").alias("visits"))
    if held is None:
        return new
    rows = held if new is None else held.unionByName(new)
    return rows.groupBy("url", "content_hash").agg(F.min("first_visited").alias("first_visited"), F.max("last_visited").alias("last_visited"), F.sum("visits").alias("visits"))


def stream_dedup_captures(captures: DataFrame, path: str) -> DataFrame:
    """Snapshots of a stream of captures (url, content_hash, captured_at).

    Each batch writes what it adds to each snapshot, in a folder of its own number, so that a batch that is run again replaces its own rows; readers add these
    up. compact_snapshots puts the parts of a stopped stream together. A source without rows gives an empty table.
    """
    spark, schema = captures.sparkSession, merge_snapshots(None, captures).schema

    def each(batch: DataFrame, number: int) -> None:
        merge_snapshots(None, batch).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    run_batches(captures, path, each)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return merge_snapshots(spark.read.schema(schema).parquet(f"{path}/parts"), None)


def compact_snapshots(spark: SparkSession, path: str, to: str) -> DataFrame:
    """The parts of stream_dedup_captures as one table at `to`, which a reader may use in their place."""
    merge_snapshots(spark.read.parquet(f"{path}/parts").drop("batch"), None).write.mode("errorifexists").parquet(to)
    return spark.read.parquet(to)


def first_of_content(captures: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The feed of new content: one capture of each (url, content_hash) as far as the watermark reaches."""
    return captures.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["url", "content_hash"])


def stream_recent_capture(captures: DataFrame, within: str) -> DataFrame:
    """Captures without those of a url that was captured within `within`."""
    return captures.withWatermark("captured_at", within).dropDuplicatesWithinWatermark(["url"])


class _Lifecycle(StatefulProcessor):
    """The highest sequence of each kind of a page's events, from which its state follows in whatever order they come."""

    def __init__(self, keep: timedelta) -> None:
        self.keep = keep // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.page = handle, handle.getValueState("page", "made long, ready long, failed long, ends long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        *seen, ends = self.page.get() if self.page.exists() else (None,) * 4
        later = ends or 0
        for part in rows:
            later = max(later, int(part["ms"].max()) + self.keep)
            for k, top in part.groupby("kind")["seq"].max().items():
                seen[k] = int(top) if seen[k] is None else max(seen[k], int(top))
        if later != ends:
            if ends is not None:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(later)
        self.page.update((*seen, later))
        made, ready, failed = (-math.inf if x is None else x for x in seen)
        now = "ready" if ready > made else "failed" if failed > max(made, ready) else "pending"
        yield pd.DataFrame({"page_id": [key[0]], "seq": [max(x for x in seen if x is not None)], "snapshot_state": [now]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.page.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_lifecycle(events: DataFrame, delay: str = "1 hour", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """page_id, seq and state of the pages of each batch of events (page_id, seq, event, ts), in output mode update; the row of a page's highest seq, the latest of these, holds.

    Events may come in any order that the watermark's delay allows: a page's state is what fold_lifecycle makes of all that has come. Events of other names, or without a page, seq or ts, change
    nothing. The state of a page goes when the watermark has passed its last event by `keep`; what comes after that is judged alone.
    """
    kind = F.when(F.col("event").isin("created", "retried"), 0).when(F.col("event").isin("finalized", "updated"), 1).when(F.col("event") == "failed", 2)
    rows = events.withWatermark("ts", delay).select("page_id", "seq", "ts", F.unix_millis("ts").alias("ms"), kind.alias("kind")).dropna()
    with_state_store(events.sparkSession)
    return rows.groupBy("page_id").transformWithStateInPandas(_Lifecycle(keep), "page_id long, seq long, snapshot_state string", "Update", "EventTime")


def fold_lifecycle(events: DataFrame) -> DataFrame:
    """Batch twin of stream_lifecycle: the fold over a page's events by sequence."""
    order = F.array_sort(F.collect_list(F.struct("seq", "event")))  # a page has few events
    step = lambda acc, e: F.when(e["event"].isin("created", "retried"), "pending").when(e["event"].isin("finalized", "updated"), "ready").when((e["event"] == "failed") & (acc == "pending"), "failed").otherwise(acc)
    return events.groupBy("page_id").agg(F.max("seq").alias("seq"), order.alias("e")).select("page_id", "seq", F.aggregate("e", F.lit("pending"), step).alias("snapshot_state"))


class _Bursts(StatefulProcessor):
    """Walks over a page's ticks as the watermark closes them; each batch brings later ones than those before."""

    def __init__(self, least: int, life: timedelta, forget: timedelta) -> None:
        self.least, self.life, self.forget = least, life // timedelta(microseconds=1), forget // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.page = handle, handle.getValueState("page", "first long, held long, ends long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ticks = sorted((int(t), int(n), int(f)) for part in rows for t, n, f in part[["tick", "changes", "first"]].itertuples(index=False))
        first, held, ends = self.page.get() if self.page.exists() else (ticks[0][2], 0, None)
        out = []
        for tick, n, _ in ticks:
            if tick < first + self.life and n:
                held += n
                if held >= self.least:
                    out.append((key[0], tick, held))
                    held = 0
        later = max(first + self.life, ticks[-1][0]) // 1000 + self.forget
        if later != ends:
            if ends is not None:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(later)
        self.page.update((first, held, later))
        if out:
            yield pd.DataFrame(out, columns=["page_id", "tick", "changes"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.page.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_change_bursts(changes: DataFrame, least: int = 10, delay: str = "10 seconds", life: timedelta = timedelta(minutes=5), forget: timedelta = timedelta(0)) -> DataFrame:
    """The stream of emits of change_bursts (page_id, tick, changes) over a stream of changes (page_id, ts, hidden), in output mode append.

    Ticks are summed first, with partial sums before the shuffle, so a page with very many changes costs the walk one row for each tick. Changes may come in any order that the watermark's
    delay allows; an emit leaves the stream when the watermark has passed its tick. A page's state goes when the watermark has passed its life, or its last tick
    if that is later, by `forget`; a page that changes after that is a new one. Changes without a page or time are left out.
    """
    rows = changes.where("page_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    ticks = rows.groupBy("page_id", F.window("ts", "5 seconds").alias("w")).agg(F.count_if(~F.col("hidden")).alias("changes"), F.min("ts").alias("first"))
    ticks = ticks.select("page_id", F.window_time("w").alias("at"), F.unix_micros("w.start").alias("tick"), "changes", F.unix_micros("first").alias("first"))
    with_state_store(changes.sparkSession)
    out = ticks.groupBy("page_id").transformWithStateInPandas(_Bursts(least, life, forget), "page_id long, tick long, changes long", "Append", "EventTime")
    return out.select("page_id", F.timestamp_micros("tick").alias("tick"), "changes")


def stream_log_follow(spark: SparkSession, path: str, keyword: str | None = None) -> DataFrame:
    """file and line of files that grow, those with the keyword: each complete line once, an unfinished one when it has ended."""
    rows = logfiles.follow_log_lines(spark, path).select("file", "line")
    return logs.log_grep(rows, keyword) if keyword else rows


def stream_retention(queue: DataFrame, protected: DataFrame, as_of, days: int, path: str) -> DataFrame:
    """The daily run: each new part of the queue is judged once; html paths to delete."""

    def each(batch: DataFrame, number: int) -> None:
        resources.retention_plan(batch, protected, as_of, days)[0].write.mode("overwrite").parquet(f"{path}/gone/batch={number}")

    run_batches(queue, path, each)
    return queue.sparkSession.read.schema(queue.schema).parquet(f"{path}/gone")


def stream_freshness_join(requests: DataFrame, fetches: DataFrame, ttl: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Each request (request_id, url, requested_at) with the good fetches (url, fetched_at, fetch_id) of its url within the TTL before it, if any."""
    r = requests.withWatermark("requested_at", delay)
    f = fetches.withWatermark("fetched_at", delay).withColumnRenamed("url", "f_url")
    near = F.expr(f"url = f_url AND fetched_at <= requested_at AND fetched_at >= requested_at - INTERVAL {ttl}")
    return r.join(f, near, "leftOuter").select("request_id", "url", "requested_at", "fetch_id", "fetched_at")


def newest_fresh(joined: DataFrame) -> DataFrame:
    """Of each request the newest fetch that can be reused."""
    return joined.groupBy("request_id", "url").agg(F.max_by("fetch_id", "fetched_at").alias("fetch_id"))
