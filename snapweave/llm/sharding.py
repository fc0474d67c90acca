"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, fresh

#: Rows of a block: the unit that keeps sums over a shard from being one task's work.
BLOCK_ROWS = 4096
#: Blocks that are summed up together.
RUN = 1024


def min_cost_transfers(supply: list[int], capacity: list[int], cost: np.ndarray | None = None) -> dict[tuple[int, int], int]:
    """Bytes from each old shard i to each new shard j, of least total cost, by successive shortest paths.

    cost[i, j] is the price of a byte; by default 0 where i = j (it stays) and else 1. The sum of the
    capacities must not be under the sum of the supply. Works on numbers of shards, never on rows.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are under the bytes there are")
    cost = np.where(np.arange(n)[:, None] == np.arange(m), 0.0, 1.0) if cost is None else np.asarray(cost, float)
    left, room = np.array(supply, dtype=np.int64), np.array(capacity, dtype=np.int64)
    flow = np.zeros((n, m), np.int64)
    while left.any():
        near, far = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        from_old, from_new = np.full(m, -1), np.full(n, -1)
        while True:  # Bellman-Ford over the residual graph, old and new shards in turn
            step = near[:, None] + cost
            best = step.min(axis=0)
            better = best < far - 1e-12
            far[better], from_old[better] = best[better], step.argmin(axis=0)[better]
            back = np.where(flow > 0, far[None, :] - cost, np.inf)
            best = back.min(axis=1)
            again = best < near - 1e-12
            near[again], from_new[again] = best[again], back.argmin(axis=1)[again]
            if not again.any():
                break
        j = int(np.where(room > 0, far, np.inf).argmin())
        path, amount, at = [], int(room[j]), j
        while True:
            i = int(from_old[at])
            path.append((i, at, 1))
            if from_new[i] < 0:
                break
            at = int(from_new[i])
            path.append((i, at, -1))
            amount = min(amount, int(flow[i, at]))
        amount = min(amount, int(left[path[-1][0]]))
        for i, k, sign in path:
            flow[i, k] += sign * amount
        left[path[-1][0]] -= amount
        room[j] -= amount
    return {(i, j): int(flow[i, j]) for i in range(n) for j in range(m) if flow[i, j]}


def sum_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of equal keys whose `order` (a number from 0) is less.

    In two levels, so that the rows of one key are no single task's: sums of RUN numbers of the order first, and within these the rows.
    """
    part = rows.withColumn("run", F.floor(F.col(order) / RUN))
    ahead = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = part.groupBy(*keys, "run").agg(F.sum(value).alias("of_run")).select(*keys, "run", F.coalesce(F.sum("of_run").over(ahead), F.lit(0)).alias("before_run"))
    inner = Window.partitionBy(*keys, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return part.join(runs, [*keys, "run"]).withColumn(name, F.col(name) + F.col("before_run")).drop("run", "before_run")


def reshard(docs: DataFrame, old_shard, old_shards: int, new_shards: int, weights: list[float] | None = None, scratch: Scratch | None = None, key: list[str] | None = None) -> DataFrame:
    """Put every row in a new shard, moving the fewest bytes that make the shards' bytes nearly equal (or as `weights`).

    Returns doc_id, size (UTF-8 bytes of the text, none for a null one, plus 1), text_crc32, old_shard,
    shard and slot (gapless from 0 in each shard), and the columns `key` of docs, for rewrite_shards. old_shard: a column expression, 0 to old_shards - 1;
    null counts as 0. A shard's rows are dealt to blocks by a hash, and blocks, then rows in a block, are
    laid in a fixed order, so that a transfer is a run of that order and a shard misses its share by less
    than a row at each end of a run. Rows of equal doc_id and text are rows of their own. An empty table
    gives an empty result. Nothing but one number per shard or per transfer reaches the driver.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "reshard")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.col("doc_id"), size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), *(key or []))
    rows = scratch.table(rows, "rows")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    each = scratch.table(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")), "blocks")
    held = {r.old_shard: r.bytes for r in each.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [held.get(i, 0) for i in range(old_shards)]
    weights = weights or [1.0] * new_shards
    ends = np.floor(np.cumsum(weights) / sum(weights) * sum(supply)).astype(np.int64)
    ends[-1] = sum(supply)
    plan = min_cost_transfers(supply, np.diff(ends, prepend=0).tolist())

    runs, ahead = [], [0] * old_shards
    for i, j in sorted(plan, key=lambda x: (x[0], x[0] != x[1], x[1])):  # what stays comes first
        ahead[i] += plan[i, j]
        runs.append((i, ahead[i], j))
    runs = spark.createDataFrame(runs or [(0, 0, 0)], "old_shard int, until long, shard int")
    runs = runs.groupBy("old_shard").agg(F.sort_array(F.collect_list(F.struct("until", "shard"))).alias("runs"))  # a list of new shards at most

    each = sum_before(each, ["old_shard"], "block", "bytes", "ahead").drop("bytes")
    order = [F.col("size").desc(), "doc_id", "text_crc32", *(key or [])]
    inner = Window.partitionBy("old_shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inner)).join(each, ["old_shard", "block"]).join(F.broadcast(runs), "old_shard")
    middle = F.col("ahead") + F.col("upto") - F.col("size") / 2
    run = F.get(F.filter("runs", lambda r: middle < r["until"]), F.lit(0))["shard"]
    placed = placed.withColumn("shard", F.coalesce(run, F.element_at("runs", -1)["shard"])).drop("runs", "ahead", "upto")
    nth = F.row_number().over(Window.partitionBy("old_shard", "block", "shard").orderBy(*order))
    placed = scratch.table(placed.withColumn("nth", nth), "placed")
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    counts = counts.withColumn("place", F.col("old_shard") * F.lit(blocks).cast("long") + F.col("block"))
    counts = sum_before(counts, ["shard"], "place", "n", "first").drop("n", "place")
    out = placed.join(counts, ["shard", "old_shard", "block"])
    return out.select(*(key or []), "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))


def rewrite_shards(spark: SparkSession, docs: DataFrame, placed: DataFrame, path: str, key: list[str] | None = None) -> DataFrame:
    """Write the shards that rows leave or enter, one folder shard=<n> each; the others stay as they are. Returns (shard) rewritten.

    Each file row holds docs' columns without `key`, and slot; docs' own columns named shard or slot get underscores after
    their names. `key` names columns of docs and placed that identify a row; without it, rows of equal doc_id, size and
    crc32 of the text are numbered on both sides and paired. Null and repeated ids are rows like others. The
    folder of a shard that all rows leave is deleted.
    """
    moved = placed.where("old_shard != shard")
    touched = moved.select("shard").unionByName(moved.select(F.col("old_shard").alias("shard"))).distinct()
    shards = {r.shard for r in touched.collect()}  # a number per shard at most
    rows = placed.join(F.broadcast(touched), "shard")
    kept = [c for c in docs.columns if c not in (key or [])]
    names = [fresh(docs, c) if c.lower() in ("shard", "slot") else c for c in kept]
    own = [F.col(c).alias(f"own_{k}") for k, c in enumerate(kept)]
    if key:
        body = docs.select(*[F.col(c).alias(f"key_{k}") for k, c in enumerate(key)], *own)
        rows = rows.select(*[F.col(c).alias(f"key_{k}") for k, c in enumerate(key)], "shard", "slot")
        on = [f"key_{k}" for k in range(len(key))]
    else:
        size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
        each = F.to_json(F.struct(F.col("doc_id").alias("i"), size.alias("s"), F.crc32(F.coalesce("text", F.lit(""))).alias("c")))
        nth = lambda *by: F.row_number().over(Window.partitionBy("key_0").orderBy(*by))
        body = docs.select(each.alias("key_0"), *own).withColumn("key_1", nth("key_0"))
        at = F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("size").alias("s"), F.col("text_crc32").alias("c")))
        rows = placed.select(at.alias("key_0"), "shard", "slot").withColumn("key_1", nth("shard", "slot")).join(F.broadcast(touched), "shard")
        on = ["key_0", "key_1"]
    body = body.join(rows, on).select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(names)], "shard", "slot")
    body.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    jvm = spark._jvm
    for n in sorted(shards - {r.shard for r in rows.select("shard").distinct().collect()}):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={n}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def resharded_files(docs: DataFrame, old_shard, old_shards: int, new_shards: int, key: list[str]) -> DataFrame:
    """As reshard(), with the touched shards written; doc_id, size, text_crc32, shard and slot of their rows are read from the files.

    Rows of untouched shards are not written; theirs are as placed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    placed = scratch.table(reshard(docs, old_shard, old_shards, new_shards, None, scratch, key), "slots")
    came = fresh(docs, "came_from")
    whole = docs.withColumn(came, F.coalesce(old_shard.cast("int"), F.lit(0)))
    path = f"{scratch.root}/shards"
    touched = rewrite_shards(spark, whole, placed, path, key)
    names = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    rest = placed.join(F.broadcast(touched), "shard", "left_anti").select(names)
    if not placed.where("old_shard != shard").limit(1).count():
        return rest
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    back = spark.read.parquet(path)
    return back.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.col(came).alias("old_shard"), F.col("shard").cast("int").alias("shard"), "slot").unionByName(rest)
