"""Groups of sorted Arrow rows, one after the other, so that a task holds one bounded block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, join_counted


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by (cell, i, j), those of each key; a key's rows may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[low])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def dealt_cells(told: DataFrame, block: int, scratch: Scratch) -> DataFrame | None:
    """Members (key, node, component) of keys that still hold several components, dealt to cells (key, i, j) in which those of side 0 meet those of side 1.

    Side 1 are the members outside a key's largest component, in blocks j; side 0 are all members, in blocks i. Any two
    members of different components meet in a cell: two of side 1 in two, with sides changed. A member of the largest component is copied once for
    every block of the others, so a key costs its size times the part that isn't joined yet. None if no key is left.
    """
    each = scratch.table(told.groupBy("key", "component").agg(F.count("*").alias("n")), "cell-counts")
    key = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("n > most.n")
    key = key.select("key", F.ceil(F.col("n") / block).cast("int").alias("lefts"), F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("rights"), F.col("most.component").alias("most"))
    key = scratch.table(key, "cell-keys")
    if not key.limit(1).count():
        return None
    told = told.join(key, "key")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = told.select("key", "node", "component", F.lit(0).alias("side"), place("lefts").alias("i"), upto("rights").alias("j"))
    right = told.where("component != most").select("key", "node", "component", F.lit(1).alias("side"), upto("lefts").alias("i"), place("rights").alias("j"))
    return scratch.table(left.unionByName(right), "cells")


def join_hot(pairs: DataFrame, side: DataFrame, on: str, scratch: Scratch, each: int = 1000) -> DataFrame:
    """Inner join with `side` (one row for an id) where an id may be in very many pairs: its row is then copied once for every `each` of them, and they are dealt over the copies."""
    hot = pairs.groupBy(on).agg(F.count("*").alias("n")).where(F.col("n") > each).select(on, F.ceil(F.col("n") / each).cast("int").alias("copies"))
    hot = scratch.table(hot, f"hot-{on}")
    copies, salt = F.coalesce("copies", F.lit(1)), fresh(pairs, "salt")
    dealt = join_counted(pairs, hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(*[c for c in pairs.columns if c != on]), copies).cast("int")).drop("copies")
    copied = join_counted(side, hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return dealt.join(copied, [on, salt]).drop(salt)
