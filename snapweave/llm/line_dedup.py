"""Fuzzy line dedup: minima of hashed words, a join on tables of them, edit similarity, one occurrence per group kept.

The tables stand where SimHash blocks were: of line pairs with edit similarity 0.8, 64 SimHash bits within a distance that
pigeonhole blocks can serve (3) find 0.2 to 34 %; the README has the figures of both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt_cells, join_hot, sorted_groups
from .components import connected_components
from .edits import edit_within, within
from .scratch import Scratch, fresh, join_counted, same_row
from .words import hash_runs, mix, pieces, runs, text_bytes, trimmed

#: Tables that lines meet in, tables that are joined at a time, and the minima that a key of one is made of.
TABLES, TOGETHER, MINIMA = 12, 6, 3
#: Words that make up this share of all words or more (ten thousand words at most) count only in pairs; what a task may overlook of a word's share.
FREQUENT, OVERLOOKED = 1e-4, 1e-5
#: A sketch: three bits each of ORDERS minima, and the length as a power of STEP. Lines of fewer than SHARED equal minima or further apart in length aren't looked at.
ORDERS, SHARED, STEP, STEPS = 40, 13, 1.05, 5
#: Lines of one key up to which all pairs are verified; more are first compared with one of them.
SMALL = 8
#: Lines of a key that are compared in one block if they are still of several components.
BLOCK = 1024
#: Features whose minima are taken together, so that they stay in a processor's cache.
STRIP = 1 << 16
#: Bytes that part words of a normalised line: all of ASCII but letters and digits.
_PART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_PARTS = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


_rng = np.random.Generator(np.random.PCG64(20250301))
_TURN = _rng.integers(0, 1 << 32, (2, ORDERS), dtype=np.uint64).astype(np.uint32) | np.array([[0], [1]], np.uint32)


def features(words: np.ndarray, begins: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each line's words that aren't frequent and of its pairs of frequent words in a row, and where each line's begin; a line of neither has its first word."""
    often = np.isin(words, frequent)
    first = np.zeros(len(words), bool)
    first[begins] = True
    pair = np.append(often[:-1] & often[1:] & ~first[1:], False)
    value = np.where(pair, mix(words, 14) + np.append(words[1:], np.uint64(0)), words)
    keep = ~often | pair
    none = np.add.reduceat(keep, begins) == 0
    keep[begins[none]] = True
    return (mix(value[keep], 13) >> np.uint64(32)).astype(np.uint32), np.append(0, np.cumsum(keep))[begins]


def minima(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each row the least of its features under ORDERS orders: ORDERS x rows."""
    out = np.empty((ORDERS, len(begins)), np.uint32)
    ends = np.append(begins[1:], len(grams))
    low = 0
    while low < len(begins):
        high = max(low + 1, int(np.searchsorted(ends, begins[low] + STRIP, "right")))
        part, at = grams[begins[low] : ends[high - 1]], begins[low:high] - begins[low]
        now = np.empty_like(part)
        for k in range(ORDERS):
            np.bitwise_xor(part, _TURN[0, k], out=now)
            np.multiply(now, _TURN[1, k], out=now)
            out[k, low:high] = np.minimum.reduceat(now, at)
        low = high
    return out


def table_keys(least: np.ndarray) -> np.ndarray:
    """64 bits for each row and table, each table from MINIMA minima of its own: rows x TABLES."""
    out = np.arange(TABLES, dtype=np.uint64)[:, None] + np.zeros((1, least.shape[1]), np.uint64)
    for k in range(MINIMA):
        out = mix(out + least[k : TABLES * MINIMA : MINIMA], k)
    return out.view(np.int64).T


def sketches(least: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """2 x rows: in each half three bits of every other minimum, and above them four bits of the length."""
    length = np.minimum(np.log(sizes) / np.log(STEP), 255).astype(np.uint64)
    out = np.stack([length & np.uint64(15), length >> np.uint64(4)]) << np.uint64(60)
    for k in range(ORDERS):
        out[k % 2] |= (least[k] >> np.uint32(9) & np.uint32(7)).astype(np.uint64) << np.uint64(3 * (k // 2))
    return out


_THIRD = np.uint64(sum(1 << 3 * k for k in range(ORDERS // 2)))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """May lines of these sketches (2 x ...) be alike?"""
    length = lambda s: ((s[0] >> np.uint64(60)) | (s[1] >> np.uint64(60)) << np.uint64(4)).astype(np.int16)
    other = x ^ y
    other = (other | other >> np.uint64(1) | other >> np.uint64(2)) & _THIRD
    unlike = np.bitwise_count(other[0]) + np.bitwise_count(other[1])
    return (unlike <= ORDERS - SHARED) & (np.abs(length(x) - length(y)) <= STEPS)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key (key, id, s1, s2): pairs (key, a, b) of one key that are near.

    Up to SMALL lines of a key are all compared. Of more, each is compared with the first, and (key, id, null) tells that it is of such a
    key. A key's rows are never held together beyond a batch.
    """
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def star(rows: np.ndarray, centre: np.ndarray) -> pa.RecordBatch:
        """The members of a large key, and their pairs with its first line."""
        near = _near(rows[2:].view(np.uint64), centre[2:, None].view(np.uint64)) & (rows[1] != centre[1])
        n, other = rows.shape[1], rows[1][near]
        b = np.append(np.zeros(n, np.int64), np.maximum(other, centre[1]))
        columns = [np.full(len(b), centre[0]), np.append(rows[1], np.minimum(other, centre[1]))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(b, mask=np.arange(len(b)) < n)], schema=schema)

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keys all of whose rows are here."""
        key, node, sketch = rows[0], rows[1], rows[2:].view(np.uint64)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        each = np.repeat(size, size)
        p, q = [], []
        for d in range(1, min(SMALL, int(size.max()))):
            at = np.flatnonzero((key[d:] == key[:-d]) & (each[:-d] <= SMALL))
            at = at[_near(sketch[:, at], sketch[:, at + d])]
            p.append(at)
            q.append(at + d)
        if p:
            p, q = np.concatenate(p), np.concatenate(q)
            yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(np.minimum(node[p], node[q])), pa.array(np.maximum(node[p], node[q]))], schema=schema)
        for k in np.flatnonzero(size > SMALL).tolist():
            yield star(rows[:, start[k] : start[k] + size[k]], rows[:, start[k]])

    held, centre = None, None
    for batch in batches:
        now = np.stack([c.to_numpy() for c in batch.columns])
        if centre is not None and now.shape[1]:
            n = int(np.searchsorted(now[0], centre[0], "right"))
            if n:
                yield star(now[:, :n], centre)
            now = now[:, n:]
            centre = None if now.shape[1] else centre
        now = now if held is None else np.concatenate([held, now], axis=1)
        if not now.shape[1]:
            continue
        cut = int(np.searchsorted(now[0], now[0, -1]))  # the last key may go on
        if cut:
            yield from whole(now[:, :cut])
        held = now[:, cut:]
        if held.shape[1] > SMALL:
            centre, held = held[:, 0].copy(), None
            yield star(now[:, cut:], centre)
    if held is not None and held.shape[1]:
        yield from whole(held)


def _compare(similarity: float):
    """Of the cells of large keys: links between lines of different components, a forest of them in each cell."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches):
            side, own, node = (group.column(c).to_numpy() for c in ("side", "component", "node"))
            sketch = np.stack([group.column(c).to_numpy() for c in ("s1", "s2")]).view(np.uint64)
            first, second, lines = np.flatnonzero(side == 0), np.flatnonzero(side == 1), group.column("line")
            key, keys = group.column("key")[0].as_py(), group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), TABLES)
            twice = np.isin(node, node[second])  # these meet in two cells, with sides changed
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            for low in range(0, len(first), 64):
                part = first[low : low + 64]
                meet = (own[part][:, None] != own[second]) & (~twice[part][:, None] | (node[part][:, None] < node[second]))
                p, q = np.nonzero(meet & _near(sketch[:, part][:, :, None], sketch[:, None, second]))
                p, q = part[p], second[q]
                here = np.where(keys[p] == keys[q], keys[p], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == key  # a pair of several keys is compared in the least
                p, q = p[here], q[here]
                for at in range(0, len(p), 2000):
                    x, y = p[at : at + 2000], q[at : at + 2000]
                    pairs = [(k, other) for k, other in zip(x.tolist(), y.tolist(), strict=True) if top(int(own[k])) != top(int(own[other]))]
                    good = within([lines[k].as_py() for k, _ in pairs], [lines[other].as_py() for _, other in pairs], similarity)
                    for k, other in (pair for pair, g in zip(pairs, good.tolist(), strict=True) if g):
                        u, v = top(int(own[k])), top(int(own[other]))
                        if u != v:
                            up[max(u, v)] = min(u, v)
                            a.append(min(node[k], node[other]))
                            b.append(max(node[k], node[other]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


class _Counts:
    """How often words occur, without those of less than the share OVERLOOKED of all, so that it stays small."""

    def __init__(self):
        self.words, self.counts, self.total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, words: np.ndarray) -> None:
        found, counts = np.unique(words, return_counts=True)
        self.total += len(words)
        if len(self.words) + len(found):
            both, at = np.unique(np.concatenate([self.words, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([self.counts, counts])).astype(np.int64)
            keep = counts > self.total * OVERLOOKED / 4
            self.words, self.counts = both[keep], counts[keep]


def _lines(min_words: int, frequent: np.ndarray | None = None):
    """doc_id, row_key, line_no and two hashes (node, twin) of every line, and with words that are `frequent` its sketch and keys, one for each table.

    Without them, there are rows of line_no -1 too: a task's words (node) and how often they occur (twin), and one of line_no -2 with the number of all.
    """
    keyed = frequent is not None
    names = ("doc_id", "row_key", "line_no", "node", "twin", "s1", "s2")
    schema = pa.schema([(n, pa.int64()) for n in names[: 5 + 2 * keyed]] + [("keys", pa.list_(pa.int64()))] * keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, keys = batch.column(0), batch.column(1)
            ahead: dict[int, int] = {}  # lines of a row that earlier pieces hold
            for row, stop, low, high in _line_pieces(data, offsets):
                part = data[low:high]
                begins = np.clip(offsets[row : stop + 1] - low, 0, high - low)
                newline = np.flatnonzero(part == 10) + 1
                starts, ends = runs(part, _PART[part], np.concatenate([begins[:-1], newline[newline < len(part)]]))
                word_row = np.searchsorted(begins, starts, "right") - 1
                lines_before = np.searchsorted(newline, starts, "right")
                line = lines_before - np.searchsorted(newline, begins[:-1], "right")[word_row] + ahead.get(row, 0) * (word_row == 0)
                if stop == row + 1:
                    ahead[row] = ahead.get(row, 0) + len(newline)
                if not len(starts):
                    continue
                cut = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (word_row[1:] != word_row[:-1])))
                size = np.diff(np.append(cut, len(starts)))
                long = size >= min_words
                if not long.any():
                    continue
                inside = np.repeat(long, size)
                where, line = row + word_row[cut][long], line[cut][long]
                starts, ends, size = starts[inside], ends[inside], size[long]
                words = hash_runs(part, starts, ends)
                cut = np.cumsum(size) - size
                at = (np.arange(len(words)) - np.repeat(cut, size)).astype(np.uint64)
                hashes = [mix(np.add.reduceat(mix(words + at * np.uint64(odd), seed), cut) + size.astype(np.uint64)) for odd, seed in ((0xD1342543DE82EF95, 6), (0xAF251AF3B0F025B5, 12))]
                columns = [ids.take(pa.array(where)), keys.take(pa.array(where)), pa.array(line.astype(np.int64)), *(pa.array(h.view(np.int64)) for h in hashes)]
                if keyed:
                    least = minima(*features(words, cut, frequent))
                    total = np.add.reduceat(ends - starts + 1, cut) - 1
                    columns += [*(pa.array(h) for h in sketches(least, total).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1, dtype=np.int32) * TABLES), pa.array(table_keys(least).reshape(-1)))]
                else:
                    counts.add(words)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if not keyed:
            keep = counts.counts > counts.total * OVERLOOKED
            nothing = np.zeros(int(keep.sum()) + 1, np.int64)
            columns = [nothing, nothing, nothing - 1, np.append(counts.words[keep].view(np.int64), 0), np.append(counts.counts[keep], counts.total)]
            columns[2][-1] = -2
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run, "doc_id long, row_key long, line_no long, node long, twin long" + ", s1 long, s2 long, keys array<long>" * keyed


def _similar(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(good, pa.bool_()))

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and its wanted (node, line_no) -> node and the normalised line."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            lines, wanted = text.as_py().split("\n"), wanted.as_py()
            clean = [_PARTS.sub(" ", lines[w["line_no"]]).strip(" ").translate(_LOWER) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([w["node"] for w in wanted], pa.int64()), pa.array(clean, pa.string())], ["node", "line"])


def _line_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """As pieces(), but a long row is cut only after line ends."""
    held = None
    for row, stop, low, high in pieces(data, offsets):
        low = low if held is None else held
        if stop == row + 1 and high < offsets[stop]:
            found = np.flatnonzero(data[low:high] == 10)
            if not len(found):
                held = low
                continue
            held = low + int(found[-1]) + 1
            yield row, stop, low, held
        else:
            held = None
            yield row, stop, low, high


def line_groups(docs: DataFrame, min_words: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """Occurrences of repeated lines to take out: doc_id, row_key, line_no (from 0).

    A line is what stands between line feeds; normalised, it is its words (runs of letters, digits and
    bytes above ASCII, A-Z lower-cased). Lines under `min_words` words are never repeats. Equal normalised
    lines (by two 64-bit hashes) are one node. Two nodes link if levenshtein <= (1 - similarity) * longer length on the normalised
    lines; the first occurrence of a connected group, by doc_id (nulls first), row_key and line_no, stays.

    Nodes meet in tables keyed by three minima each of their hashed words, of which frequent ones count in pairs only,
    and those whose sketches and lengths are too far apart are passed over before the edit distance: that
    is a search with a recall, measured in the README, no further rule. Up to SMALL nodes of a key are all
    compared, of more each with one of them. Keys whose nodes are then still of several components are
    compared in cells, a pair in the least of its keys: every node outside the key's largest component with all others, and what leaves a
    cell is a forest of verified links.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    run, schema = _lines(min_words)
    lines = scratch.table(texts.mapInArrow(trimmed(run), schema), "lines")
    total = lines.where("line_no = -2").agg(F.sum("twin")).first()[0] or 0
    often = lines.where("line_no = -1").groupBy("node").agg(F.sum("twin").alias("n")).where(F.col("n") >= total * FREQUENT)
    often = np.array([r.node for r in often.collect()], np.int64).view(np.uint64)  # 1 / FREQUENT words at most
    lines = lines.where("line_no >= 0")
    run, schema = _lines(min_words, np.sort(often))
    place = F.struct("doc_id", "row_key", "line_no")
    nodes = texts.mapInArrow(trimmed(run), schema).groupBy("node", "twin").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("keys").alias("keys"), F.min(place).alias("first"), F.count("*").alias("n"))
    nodes = scratch.table(nodes.select(F.monotonically_increasing_id().alias("id"), "*"), "nodes")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    found = []
    for low in range(0, TABLES, TOGETHER):  # some tables at a time, so that the shuffled rows are never many times the input
        each = nodes.select(F.explode(F.slice("keys", low + 1, TOGETHER)).alias("key"), F.col("id").alias("node"), "s1", "s2")
        dealt = each.repartition(tasks, "key").sortWithinPartitions("key")
        found.append(scratch.table(dealt.mapInArrow(trimmed(_meet), "key long, a long, b long"), f"found-{low}"))
    met = found[0]
    for part in found[1:]:
        met = met.unionByName(part)
    pairs = scratch.table(met.where("b is not null").select("a", "b").distinct(), "pairs")
    large = scratch.table(met.where("b is null").select("key", F.col("a").alias("node")), "large")

    def bodies(wanted: DataFrame, name: str) -> DataFrame:
        """node and normalised line of the nodes in `wanted`."""
        at = wanted.select("node").distinct().join(nodes.select(F.col("id").alias("node"), "first"), "node")
        at = at.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.row_key").alias("row_key")).agg(F.collect_list(F.struct("node", F.col("first.line_no").alias("line_no"))).alias("wanted"))  # no more than a text has
        at = scratch.table(at, f"at-{name}")
        held = join_counted(texts, at.withColumnRenamed("doc_id", "own"), "row_key", values=F.size("wanted") * 2).where(F.col("doc_id").eqNullSafe(F.col("own")))
        return scratch.table(held.select("text", "wanted").mapInArrow(trimmed(_pick), "node long, line string"), f"body-{name}")

    body = bodies(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), "pairs").dropDuplicates(["node"])
    both = join_hot(join_hot(pairs, body.toDF("b", "l_b"), "b", scratch), body.toDF("a", "l_a"), "a", scratch).select("a", "b", "l_a", "l_b")
    links = scratch.table(both.mapInArrow(trimmed(_similar(similarity)), "a long, b long"), "links-1")
    scratch.drop("body-pairs")
    label = connected_components(links, scratch, "label-1")

    told = scratch.table(large.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "told")
    cells = dealt_cells(told, BLOCK, scratch)
    if cells is not None:
        body = bodies(cells.select("node"), "large").dropDuplicates(["node"])
        cells = cells.join(nodes.select(F.col("id").alias("node"), "s1", "s2", "keys"), "node").join(body, "node")
        cells = cells.select("key", "i", "j", "side", "node", "component", "s1", "s2", "keys", "line").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = scratch.table(cells.mapInArrow(trimmed(_compare(similarity)), "a long, b long"), "links-2")
        label = connected_components(more.unionByName(links), scratch, "label-2")

    held = nodes.select(F.col("id"), "node", "twin", "first", "n").join(label.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    first = held.groupBy("component").agg(F.min("first").alias("first"))
    held = scratch.table(held.select("node", "twin", "component").join(first, "component").select("node", "twin", "first"), "held")
    scratch.drop("nodes", "large", "told", *(f"found-{low}" for low in range(0, TABLES, TOGETHER)))
    out = lines.join(held, ["node", "twin"]).where(place != F.col("first"))
    return scratch.table(out.select("doc_id", "row_key", "line_no").distinct(), "repeats")


def dedup_lines(docs: DataFrame, min_words: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """docs with repeated lines taken out of `text`, and one more column, lines_removed (with underscores after it where docs has one of that name).

    Rows of equal doc_id and text are one document that occurs twice; both lose the same lines. A null text
    stays null, an empty one empty; a text all of whose lines go becomes empty. Other columns are kept as
    they are. Empty in, empty out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    key, own, gone, removed = (fresh(docs, n) for n in ("row_key", "row_id", "gone", "lines_removed"))
    found = line_groups(docs, min_words, similarity, scratch).groupBy("doc_id", "row_key").agg(F.collect_list("line_no").alias(gone))  # no more than a text has
    found = scratch.table(found.withColumnsRenamed({"doc_id": own, "row_key": key}), "gone")
    rows = same_row(docs, found, key, own, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(gone, k.cast("long")))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return rows.withColumn("text", text).withColumn(removed, count).select(*docs.columns, removed)
