"""Embedding near-dedup: random projections decoded to E8 lattice points in several tables, near cells probed, cosine verified.

Vectors link if their labels are equal and not null and their cosine, in double precision, is at least the
threshold. A vector goes into its nearest lattice point and the next two of every table, so that two
vectors of cosine 0.98 meet in a table with probability 0.85 and miss each other in all seven in about one
of a million cases. Equal vectors of one label are a class, and only classes are compared. The members of a
cell are compared in blocks, and what leaves a block is one row per member: how many links it has that no
earlier cell has counted, and a member that its links reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import sorted_groups
from .components import connected_components
from .scratch import Scratch
from .words import mix, trimmed

TABLES, PROBES, SCALE = 7, 3, 8.0
#: Members of a cell that are compared with as many others at once.
BLOCK = 2048


def _d8(x: np.ndarray) -> list[np.ndarray]:
    """The two nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    gap = x - near
    step = np.where(gap >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(gap), axis=1)
    rows, odd = np.arange(len(x)), near.sum(axis=1) % 2 != 0
    first, second = near.copy(), near.copy()
    for out, which, where in ((first, 0, odd), (second, 1, odd), (second, 0, ~odd), (second, 1, ~odd)):
        out[rows[where], order[where, which]] += step[rows[where], order[where, which]]
    return [first, second]


def e8_points(x: np.ndarray, count: int) -> list[np.ndarray]:
    """The `count` (up to 4) nearest found points of E8 (D8 and D8 moved by a half), twice their coordinates."""
    found = np.stack([*_d8(x), *(p + 0.5 for p in _d8(x - 0.5))])
    order = np.argsort(((found - x) ** 2).sum(axis=2), axis=0, kind="stable")
    return [np.rint(2 * found[order[k], np.arange(len(x))]).astype(np.int64) for k in range(count)]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, vec_id, label, vector -> the vector scaled by a power of two (so that no square overflows), two digests of it and the label, and its cells."""
    schema = pa.schema([(n, pa.int64()) for n in ("rid", "vec_id", "label", "digest", "twin")] + [("vector", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))])
    for batch in batches:
        rid, vec_id, label, vectors = batch.columns
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        cells: list = [None] * batch.num_rows
        scaled: list = [None] * batch.num_rows
        digests = np.zeros((2, batch.num_rows), np.uint64)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dim)
            raw = vectors.take(pa.array(at)).flatten()
            x = raw.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null component becomes NaN
            most = np.abs(x).max(axis=1)  # NaN where one is
            fine = np.isfinite(most) & (most > 0) & label.is_valid().to_numpy(zero_copy_only=False)[at]
            at, x, most = at[fine], x[fine], most[fine]
            raw = np.ldexp(x, -np.frexp(most)[1][:, None]) + 0.0
            x = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
            marks = np.array(label.take(pa.array(at)).to_pylist(), np.int64).astype(np.uint64)
            random = np.random.Generator(np.random.PCG64(dim))
            keys = []
            for t in range(TABLES):
                flat = x @ random.normal(size=(dim, 8)) * (SCALE / np.sqrt(64))
                for point in e8_points(flat, PROBES):
                    key = mix(marks + np.uint64(t * 1000003 + dim))
                    for c in range(8):
                        key = mix(key ^ point[:, c].astype(np.uint64), c)
                    keys.append(key.view(np.int64))
            for k in range(2):
                digests[k, at] = mix(mix(raw.view(np.uint64) + np.arange(dim, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), 15 + k).sum(axis=1, dtype=np.uint64) ^ marks, dim + k)
            for k, own, part in zip(at.tolist(), np.stack(keys, axis=1), raw, strict=True):
                cells[k], scaled[k] = own.tolist(), part.tolist()
        yield pa.RecordBatch.from_arrays([rid, vec_id, label, *(pa.array(d.view(np.int64)) for d in digests), pa.array(scaled, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int64()))], schema=schema)


def _compare(threshold: float):
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("reached", pa.int64())])

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for group in sorted_groups(batches):
            cell, i, j = (group.column(k)[0].as_py() for k in range(3))
            rid, own, label, copies = (group.column(c).to_numpy() for c in ("rid", "own", "label", "n"))
            lengths = pc.list_value_length(group.column("vector")).to_numpy()
            keep = lengths == lengths[0]  # differs only if the hashes of two cells are equal
            if not keep.all():
                group = group.filter(pa.array(keep))
                rid, own, label, copies = rid[keep], own[keep], label[keep], copies[keep]
            x, cells = matrix(group, "vector"), matrix(group, "cells")
            norm = np.sqrt((x * x).sum(axis=1))
            left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(x)),) * 2
            near = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right]) >= threshold
            near &= (rid[left][:, None] != rid[right]) & (label[left][:, None] == label[right])
            a, b = np.nonzero(near)
            if not len(a):
                continue
            first = np.zeros(len(a), bool)  # is this the first cell in which the two meet?
            for low in range(0, len(a), 20_000):
                ka, kb = cells[left[a[low : low + 20_000]]].reshape(-1, TABLES, PROBES), cells[right[b[low : low + 20_000]]].reshape(-1, TABLES, PROBES)
                meet = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=3)
                key = np.where(meet, ka, np.int64(2**63 - 1)).reshape(len(ka), -1)
                lowest = key.min(axis=1)
                first[low : low + 20_000] = lowest == cell
            links = np.zeros(len(x), np.int64)
            np.add.at(links, left[a], first * copies[right[b]])
            if i != j:
                np.add.at(links, right[b], first * copies[left[a]])
            root = np.arange(len(x))
            p, q = left[a], right[b]
            while True:
                low = np.minimum(root[p], root[q])
                new = root.copy()
                np.minimum.at(new, p, low)
                np.minimum.at(new, q, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            touched = np.unique(np.concatenate([p, q]))
            out.append((rid[touched], links[touched], rid[root[touched]]))
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    A null or empty vector, one of zeros, one that holds a null or a number that isn't finite, and one
    without a label link with nothing. Vectors of different length never link. Rows of one vec_id are
    vectors of their own, so equal ones link with each other. A null vec_id counts as larger than all;
    if a component has no other, its component_id is null and it is kept. Empty in, empty out. Other
    columns are not read.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "vectors")
    label = F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"))).alias("label")
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), label, F.col("embedding").cast("array<double>").alias("vector"))
    rows = scratch.table(rows.mapInArrow(trimmed(_cells), "rid long, vec_id long, label long, digest long, twin long, vector array<double>, cells array<long>"), "rows")
    same = rows.where("cells is not null").groupBy("digest", "twin").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first(F.struct("label", "vector", "cells")).alias("one"))
    same = scratch.table(same.select(F.monotonically_increasing_id().alias("rid"), "digest", "twin", "n", "least", "one.*"), "classes")
    member = same.select("rid", F.explode(F.array_distinct("cells")).alias("cell"))
    size = member.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    member = member.join(size, "cell").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64("rid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rid")
    member = member.join(same.select("rid", "n", "label", "vector", "cells"), "rid").select("cell", "i", "j", "own", "rid", "n", "label", "vector", "cells")
    tasks = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = member.repartition(tasks, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rid")
    part = scratch.table(dealt.mapInArrow(trimmed(_compare(threshold)), "rid long, links long, reached long"), "parts")
    reach = connected_components(part.where("rid != reached").select(F.col("rid").alias("a"), F.col("reached").alias("b")), scratch)
    links = part.groupBy("rid").agg(F.sum("links").alias("links"))
    told = same.select("rid", "digest", "twin", "n", "least").join(links, "rid", "left").join(reach.withColumnRenamed("node", "rid"), "rid", "left")
    told = scratch.table(told.withColumn("component", F.coalesce("component", "rid")), "told")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(least, "component").select("digest", "twin", F.lit(True).alias("known"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    own = rows.select("vec_id", F.when(F.size("cells") > 0, F.col("digest")).alias("digest"), "twin").join(scratch.table(told, "home"), ["digest", "twin"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
