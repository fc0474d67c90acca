"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, and union of links.

Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; a document's set is its distinct five-word
shingles, or its whole sequence where it has fewer words. Two documents are linked if
100 * |intersection| >= percent * |union|; a component is all that links reach.

Documents of equal sets (by their size and two 64-bit digests of the full set) are one class, and only classes are compared, so copies
cost nothing. A class is looked for in the buckets of its bands; in each bucket first two centres are compared
with all its members, then the members outside the bucket's largest component with all of other components, in
cells, so that a group of copies needs few comparisons and no link between components is lost.
One-bit sketches of signatures (512 registers; 4096 for members of large buckets of several components)
leave out pairs more than five standard deviations below the threshold; what is left is confirmed on the
full sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt_cells, join_hot, sorted_groups
from .components import connected_components
from .scratch import Scratch, fresh, join_counted, same_row, without
from .words import column_words, mix, shingles, trimmed

REGISTERS, BANDS = 512, 24
#: Registers of the longer sketch that members of large, mixed buckets get.
FINE = 4096
#: Members of a bucket that are compared in one block (with sketches of 512 bytes each).
BLOCK = 4096


def super_minhash(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """A row of `registers` values for each set.

    In round j every element puts (j, its random fraction for j) at the place that its own permutation
    gives j, and a register keeps the least. So ranks of an element in different registers differ, which
    lowers the variance, and a set is done once each of its registers has a value of an earlier round.
    """
    out = np.full((len(sets), registers), np.uint64(0xFFFFFFFFFFFFFFFF))
    if not sets:
        return out
    sizes = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat, low = out.reshape(-1), np.uint64(registers - 1)
    shift = np.uint64(64 - (registers - 1).bit_length())
    half = np.uint64((registers - 1).bit_length() // 2)
    key = mix(element, 7)
    a, b, c = key >> np.uint64(3), (key >> np.uint64(20)) | np.uint64(1), (key >> np.uint64(40)) | np.uint64(1)
    for j in range(registers):
        place = (np.uint64(j) * b + a) & low
        place = ((place ^ (place >> half)) * c) & low
        value = (np.uint64(j) << shift) | (mix(element + np.uint64(j * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF), 11) >> (np.uint64(64) - shift))
        np.minimum.at(flat, owner * registers + place.astype(np.int64), value)
        if j > 4 and j % 8:  # a round too many changes nothing
            continue
        going = out.max(axis=1) == np.uint64(0xFFFFFFFFFFFFFFFF)
        live = going[owner]
        if not live.any():
            break
        if live.mean() < 0.7:
            element, owner, a, b, c = element[live], owner[live], a[live], b[live], c[live]
    return out


def _one_bit(signed: np.ndarray) -> np.ndarray:
    return np.packbits((signed & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, n and the longer sketch."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("bits", pa.list_(pa.int64()))])
    for batch in batches:
        for row, stop, hashes, begins in column_words(batch.column(1)):
            sets = shingles(hashes, begins)
            bits = np.concatenate([_one_bit(super_minhash(sets[k : k + 200], FINE)) for k in range(0, len(sets), 200)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bits.shape[1], pa.int32()), pa.array(bits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], pa.array([len(s) for s in sets], pa.int64()), lists], schema=schema)


def _rows(percent: int) -> int:
    """Registers of a band. Of pairs at the threshold, one in a million (85) or three (80) share none of 24 bands."""
    return 5 if percent >= 85 else 4 if percent >= 80 else 3


def _features(percent: int):
    rows = _rows(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("twin", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
    weight = mix(np.arange(BANDS * rows, dtype=np.uint64), 3) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, hashes, begins in column_words(batch.column(2)):
                sets = shingles(hashes, begins)
                n = np.array([len(s) for s in sets], np.int64)
                digest = [mix(np.array([mix(s, k).sum(dtype=np.uint64) for s in sets], np.uint64) + n.astype(np.uint64), 2).view(np.int64) for k in (1, 4)]
                # k shingles can be like others only if k / (k + 1) reaches the threshold, else equality alone links
                far = n * 100 >= percent * (n + 1)
                signed = super_minhash([s for s, f in zip(sets, far, strict=True) if f])
                bands = (signed[:, : BANDS * rows] * weight).reshape(-1, BANDS, rows).sum(axis=2, dtype=np.uint64)
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                bits = _one_bit(signed)
                at = np.append(0, np.cumsum(far))
                lists = [pa.ListArray.from_arrays(pa.array(at * x.shape[1], pa.int32()), pa.array(x.reshape(-1))) for x in (bands, bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], batch.column(1)[row:stop], pa.array(n), *map(pa.array, digest), *lists], schema=schema)

    return run, "doc_id long, row_key long, n long, node long, twin long, bands array<long>, bits array<long>"


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets(nodes: pa.Array, texts: pa.Array) -> list[np.ndarray]:
            out, new = [], {}
            for k, node in enumerate(nodes.to_pylist()):
                if node not in held and node not in new:
                    new[node] = k
            if new:
                made = [s for _, _, h, b in column_words(texts.take(pa.array(list(new.values())))) for s in shingles(h, b)]
                now = dict(zip(new, made, strict=True))
            for node in nodes.to_pylist():
                out.append(held[node] if node in held else now[node])
            held.update(now if new else {})
            while len(held) > 500:
                held.popitem(last=False)
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                left, right = sets(part.column(0), part.column(2)), sets(part.column(1), part.column(3))
                good = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=schema).filter(pa.array(good))

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id (smallest doc_id reachable), kept.

    row_key is xxhash64(doc_id, text). A null or empty text, or one without words, has n_shingles 0, is
    linked with nothing and kept. Rows of one doc_id and text are one document that occurs twice: both get
    the same result. A row of a null doc_id is linked as others are, but takes the component's smallest
    known doc_id (null if none) and is kept only if it has none. Columns other than doc_id and text are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    run, schema = _features(percent)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    rows = scratch.table(texts.mapInArrow(trimmed(run), schema), "rows")
    one = F.first(F.struct("doc_id", "row_key", "bands", "bits")).alias("one")
    classes = rows.where("n > 0").groupBy("n", "node", "twin").agg(F.min("doc_id").alias("least"), one)
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("id"), "n", "node", "twin", "least", "one.*"), "classes")
    nodes = classes.where(F.size("bands") > 0).select(F.col("id").alias("node"), "doc_id", "row_key", "n", "bands", "bits")

    member = nodes.select("node", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    centre = member.groupBy("key").agg(F.count("*").alias("size"), F.min(order)["node"].alias("c1"), F.max(order)["node"].alias("c2")).where("size > 1")
    full = scratch.table(member.join(centre, "key"), "full")  # the members of buckets that hold more than one
    sketch = nodes.select("node", "n", "bits")
    pair = full.select("node", F.explode(F.array("c1", "c2")).alias("c")).where("node != c")
    pair = scratch.table(pair.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct(), "pair")
    pair = join_hot(join_hot(pair, sketch.toDF("a", "n_a", "bits_a"), "a", scratch), sketch.toDF("b", "n_b", "bits_b"), "b", scratch)
    first = scratch.table(pair.where(_alike("n_a", "n_b", "bits_a", "bits_b", percent)).select("a", "b"), "first")

    wanted = full.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("own"), "row_key"), "node")
    body = join_counted(texts, scratch.table(wanted, "wanted"), "row_key").where(F.col("doc_id").eqNullSafe(F.col("own")))
    body = scratch.table(body.select("node", "text").dropDuplicates(["node"]), "body")
    check = _verify(percent)

    def verified(pairs: DataFrame) -> DataFrame:
        long = join_hot(join_hot(pairs, body.toDF("a", "text_a"), "a", scratch), body.toDF("b", "text_b"), "b", scratch)
        return long.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(check), "a long, b long")

    links = scratch.table(verified(first), "links-1")
    label = connected_components(links, scratch, "label-1")

    told = full.where("size > 3").select("key", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))  # two centres have met all of three
    cells = dealt_cells(told, BLOCK, scratch)
    if cells is not None:
        fine = scratch.table(body.join(cells.select("node").distinct(), "node", "left_semi").mapInArrow(trimmed(_fine), "node long, n long, bits array<long>"), "fine")
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        keys = cells.select("key", "node").distinct().groupBy("node").agg(F.collect_list("key").alias("keys"))  # one for each band at most
        cells = cells.join(fine.join(keys, "node"), "node").select("key", "i", "j", "side", "node", "component", "n", "bits", "keys")
        cells = cells.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        second = cells.mapInArrow(trimmed(_meet(percent)), "a long, b long").distinct()
        second = scratch.table(second.join(first, ["a", "b"], "left_anti"), "second")
        links = scratch.table(verified(second).unionByName(links), "links-2")
        label = connected_components(links, scratch, "label-2")

    whole = classes.select("id", "n", "node", "twin", "least").join(label.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    home = scratch.table(whole.join(least, "component").select("n", "node", "twin", "component_id"), "home")
    out = rows.select("doc_id", "row_key", "n", "node", "twin").join(home, ["n", "node", "twin"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), own.alias("component_id"), (own.eqNullSafe(F.col("doc_id"))).alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """docs with one row of every group of near duplicates: that of the smallest doc_id, and of its rows that of the smallest row_key.

    Rows without words stay, whatever they repeat. Columns are as they are.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    found = scratch.table(near_duplicates(docs, percent, scratch), "found")
    best = found.where("kept and n_shingles > 0").groupBy("component_id").agg(F.min("row_key").alias("best"), F.count("*").alias("n"))
    twice = scratch.table(best.where("n > 1"), "twice")  # several rows of one doc_id
    gone = found.where("not kept").select("doc_id", "row_key")
    best = twice.select(F.col("component_id").alias("same"), "best")
    more = found.where("kept and n_shingles > 0").join(best, F.col("component_id").eqNullSafe(F.col("same"))).where("row_key != best").select("doc_id", "row_key")
    out = without(docs, scratch.table(gone.unionByName(more).distinct(), "gone"))
    if not twice.limit(1).count():
        return out
    own, key = fresh(out, "row_id"), fresh(out, "row_key")
    again = scratch.table(twice.select(F.col("component_id").alias(own), F.col("best").alias(key)), "again")
    once = same_row(out, again, key, own, "inner").dropDuplicates([own, key]).select(docs.columns)
    return same_row(out, again, key, own, "left_anti").select(docs.columns).unionByName(once)


def _limit(percent: int, registers: int, sure: bool = False) -> int:
    """Bits in which two sketches may differ: equal bits are (1 + J) / 2 of all on average, here less 5.5 standard deviations; or, to be `sure`, more."""
    share = (1 + percent / 100) / 2
    least = share + (5.5 if sure else -5.5) * (share * (1 - share) / registers) ** 0.5
    return int((1 - least) * registers)


def _alike(n_a: str, n_b: str, bits_a: str, bits_b: str, percent: int):
    """Sizes and one-bit sketches that don't rule the threshold out."""
    differ = sum((F.bit_count(F.col(bits_a)[k].bitwiseXOR(F.col(bits_b)[k])) for k in range(REGISTERS // 64)), F.lit(0))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (differ <= _limit(percent, REGISTERS))


def _meet(percent: int):
    """Of the cells of buckets: pairs of different components that may reach the threshold.

    A pair that shares several buckets is given in the least of them alone. Of pairs that reach it beyond doubt a cell gives those of a forest, and others only where
    that leaves two components apart, so that a group of copies gives about a row for each member.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    most, sure, nothing = _limit(percent, FINE), _limit(percent, FINE, True), np.iinfo(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            key = group.column("key")[0].as_py()
            side, node, own, n = (group.column(c).to_numpy() for c in ("side", "node", "component", "n"))
            bits = group.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            keys = np.full((len(node), BANDS), nothing.max)
            lists = group.column("keys").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            keys[np.repeat(np.arange(len(node)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            other = np.isin(node, node[right])  # those meet twice, with sides changed
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            for low in range(0, len(left), 64):
                part = left[low : low + 64]
                good = (own[part][:, None] != own[right]) & (np.minimum(n[part][:, None], n[right]) * 100 >= np.maximum(n[part][:, None], n[right]) * percent)
                good &= ~other[part][:, None] | (node[part][:, None] < node[right])
                a, b = np.nonzero(good)
                for at in range(0, len(a), 8192):
                    p, q = part[a[at : at + 8192]], right[b[at : at + 8192]]
                    apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                    near = apart <= most
                    p, q, apart = p[near], q[near], apart[near]
                    y = np.where(keys[q] == nothing.max, nothing.min, keys[q])  # what fills a row up is equal to nothing
                    first = np.where((keys[p][:, :, None] == y[:, None, :]).any(axis=2), keys[p], nothing.max).min(axis=1, initial=nothing.max) == key
                    found = []
                    for k in np.flatnonzero(first)[np.argsort(apart[first], kind="stable")].tolist():
                        u, v = top(int(own[p[k]])), top(int(own[q[k]]))
                        if u != v:
                            found.append(k)
                            if apart[k] <= sure:
                                up[max(u, v)] = min(u, v)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[p[found]], node[q[found]])), pa.array(np.maximum(node[p[found]], node[q[found]]))], schema=schema)

    return run
