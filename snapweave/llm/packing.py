"""Best-fit packing by hierarchical residuals: partitions best-fit, emit nearly full bins, and merge the rest as items."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import trimmed

#: Chunks that each half of a worker's memory of ids holds, and the longest that is remembered (so it is bounded in bytes too).
REMEMBERED, LONGEST = 200_000, 40
#: Bytes of text that are tokenised together.
TOGETHER = 1 << 19
#: Letters (of blocks where every letter stands for itself under NFC and has one lower case), then ASCII marks other than ' < |.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]*)([!-&(-/:;=>?@\[-`{}~]*)")
_loaded: dict[str, _Ids] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (k for k in range(256) if k not in shown)
    return {k: chr(k) for k in shown} | {k: chr(256 + n) for n, k in enumerate(other)}


_BYTES = _byte_letters()


class _Ids:
    """Ids of chunks by one tokenizer, with a memory in two generations: the older goes when the younger is full, and what it is asked for moves to the younger."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probe = ["Ab", "\u00c9t\u00e9,", "na\u00efve!", "x-", "y\u01ce#"]
        found = b"".join(self._parts(c, _PLAIN.fullmatch(c).groups()) for c in probe)
        self.plain = found == np.array(self.tokenizer.encode(" ".join(probe), add_special_tokens=False).ids, np.uint32).tobytes()

    def _parts(self, chunk: str, parts: tuple[str, ...]) -> bytes:
        """Ids of letters and of the marks after them, by the model alone."""
        out = b""
        for part in parts:
            if not part:
                continue
            part = part.lower()
            ids = self.young.get(part)
            if ids is None:
                ids = self.old.get(part)
                if ids is None:
                    shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
                    ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
                if len(part) <= LONGEST:
                    self.young[part] = ids
            out = out + ids if out else ids
        if len(chunk) <= LONGEST:
            self.young[chunk] = out
        return out

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, as the bytes of 32-bit numbers. The tokenizer splits at white space before anything else, so a text's ids are those of its chunks.

        A chunk of letters and then marks would only be lower-cased and parted into these two by the tokenizer's own
        rules, so its parts go to the model at once; all others are encoded in full, many together.
        """
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        out: list = list(map(self.young.get, chunks))
        rest = []
        for k, ids in enumerate(out):
            if ids is None:
                chunk = chunks[k]
                ids = self.old.get(chunk)
                if ids is not None:
                    self.young[chunk] = out[k] = ids
                elif self.plain and (fit := _PLAIN.fullmatch(chunk)):
                    out[k] = self._parts(chunk, fit.groups())
                else:
                    rest.append(k)
        for low in range(0, len(rest), 2000):
            part = rest[low : low + 2000]
            got = self.tokenizer.encode(" ".join(chunks[k] for k in part), add_special_tokens=False)
            sizes = np.array([len(chunks[k]) + 1 for k in part])
            begins = np.cumsum(sizes) - sizes
            ids = np.array(got.ids, np.uint32)
            at = np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), np.append(begins, begins[-1] + sizes[-1]))
            for k, a, b in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[k] = ids[a:b].tobytes()
                if len(chunks[k]) <= LONGEST:
                    self.young[chunks[k]] = out[k]
        return out

    def forget(self) -> None:
        self.young, self.old = {}, {}


def _ids(path: str) -> _Ids:
    if path not in _loaded:
        _loaded[path] = _Ids(path)
    return _loaded[path]


def token_ids(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each begins; a null text has none."""
    lists = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    words = lists.flatten().dictionary_encode()
    known = _ids(path).of(words.dictionary.to_pylist())
    sizes = np.array([len(x) for x in known] or [0], np.int64) // 4
    flat = np.frombuffer(b"".join(known), np.uint32)
    begins = np.cumsum(sizes) - sizes
    use = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = sizes[use]
    ends = np.append(0, np.cumsum(n))
    at = np.arange(ends[-1]) + np.repeat(begins[use] - ends[:-1], n)
    offsets = lists.offsets.to_numpy()
    return flat[at], ends[offsets - offsets[0]]


def _cut(path: str, capacity: int):
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()))
            row = 0
            while row < batch.num_rows:  # some of the text at a time
                stop = max(row + 1, int(np.searchsorted(sizes, sizes[row] + TOGETHER, "right")) - 1)
                out: list[tuple] = []
                docs, texts = batch.column(0)[row:stop].to_pylist(), batch.column(1)[row:stop]
                ids, begins = token_ids(path, texts)
                for doc, low, high in zip(docs, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    whole = np.append(ids[low:high], np.uint32(0)).astype("<u4")
                    for k in range(0, len(whole), capacity):
                        part = whole[k : k + capacity]
                        out.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                row = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:
            _ids(path).forget()  # a worker goes on to other stages, and its memory counts beside the JVM's

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number for each size, largest first, each into the bin that it leaves least room in."""
    out = np.empty(len(sizes), np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    mask, n = 0, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            found = bins[room].pop()
            if not bins[room]:
                mask ^= 1 << room
        else:
            room, found, n = capacity, n, n + 1
        out[k] = found
        if room > size:
            bins[room - size].append(found)
            mask |= 1 << (room - size)
    return out


def _merge(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        own, fill, offset = (rows.column(c).to_numpy() for c in ("sequence_id", "fill", "offset"))
        items, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        into = best_fit(fill[first], capacity)
        order = np.lexsort((items, into))
        size = fill[first][order]
        ahead = np.cumsum(size) - size
        start = np.append(True, into[order][1:] != into[order][:-1])
        base = np.empty(len(items), np.int64)
        base[order] = ahead - np.maximum.accumulate(np.where(start, ahead, 0))
        name = items[order][start][np.cumsum(start) - 1]  # the least of the items names the bin
        names = np.empty(len(items), np.int64)
        names[order] = name
        total = np.bincount(into, weights=fill[first]).astype(np.int64)[into]
        for c, x in (("sequence_id", names[inverse]), ("fill", total[inverse]), ("offset", offset + base[inverse])):
            rows = rows.set_column(rows.schema.get_field_index(c), c, pa.array(x))
        yield from rows.to_batches(max_chunksize=50_000)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, nearly: float = 0.995, per_task: int = 50_000, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    A document is its ids, then id 0; only longer ones are cut, into pieces of `capacity` and a shorter
    last one. A null or empty text is the one id 0. In a round every task packs some `per_task` items best
    fit, largest first. A bin filled to the share `nearly` is emitted; the others are items of the next
    round, which has an eighth of the tasks, down to one, but never more than `per_task` items for a task.
    Rounds end with one task, or when a round no longer joins anything. Rows of one doc_id are documents
    of their own. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(_cut(tokenizer, capacity)), kinds)
    rows = scratch.table(rows.withColumn("sequence_id", F.monotonically_increasing_id()), "pieces")
    rows = rows.withColumn("fill", F.col("length")).withColumn("offset", F.lit(0).cast("long"))
    done = [rows.where(F.col("fill") >= capacity)]
    rest, n = rows.where(F.col("fill") < capacity), rows.where(F.col("fill") < capacity).count()
    tasks, merge, k = -(-n // per_task), _merge(capacity), 0
    while n:
        dealt = rest.repartition(tasks, F.xxhash64("sequence_id")) if tasks > 1 else rest.repartition(1)
        out = scratch.table(dealt.mapInArrow(trimmed(merge), dealt.schema), f"round-{k}")
        enough = F.col("fill") >= int(nearly * capacity)
        was, n = n, out.where(~enough & (F.col("offset") == 0)).count()
        if tasks == 1 or n > 0.99 * was:
            done.append(out)
            break
        done.append(out.where(enough))
        rest, tasks, k = out.where(~enough), max(1, tasks // 8, -(-n // per_task)), k + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
