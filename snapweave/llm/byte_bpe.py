"""Byte-level BPE: ranked merges folded by higher-order functions over the bytes of distinct words, and ids back to bytes."""

from __future__ import annotations

import base64
import json
import unicodedata
import zlib
from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import trimmed

#: Lists that a literal map is dealt to by a checksum, so that a look-up reads a few keys.
BUCKETS = 32768
#: Stands before and after a word, and stands for a pair that no merge joins; it sorts after all pieces.
EDGE, NONE = "\x01", "\U0010ffff"
#: Bytes of text whose distinct words are encoded together.
BLOCK = 96 << 20
#: Bytes from which a word is encoded in windows, and their strides: each in turn until all windows agree with the next. At last the whole word is one.
LONG, STRIDES = 160, (64, 1024)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks (which are the ids) of a vocabulary file: base64 of a piece, a blank, its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def letter(rank: int) -> str:
    """One letter for a rank; letters sort as ranks do, before NONE, and leave out the surrogates."""
    return chr(rank + 256 if rank + 256 < 0xD800 else rank + 256 + 0x800)


def _dealt(entries: dict[str, str]) -> str:
    out: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        out[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return json.dumps(out, ensure_ascii=False)


@lru_cache(maxsize=4)
def _texts(path: str) -> tuple[str, str, str, str]:
    """Of a vocabulary, as JSON: pairs of pieces and what they merge to, whole words, the bytes of each id; and the letters of the 256 bytes."""
    own = ranks(path)
    if missing := [b for b in range(256) if bytes([b]) not in own]:
        raise ValueError(f"the vocabulary has no piece for the bytes {missing}")
    pairs, whole = {}, {}
    for piece, rank in own.items():
        for k in range(1, len(piece)):
            left, right = own.get(piece[:k]), own.get(piece[k:])
            if left is not None and right is not None:
                pairs[letter(left) + letter(right)] = letter(rank)
        whole["".join(letter(own[bytes([b])]) for b in piece)] = letter(rank)
    by_id = {rank: base64.b64encode(piece).decode() for piece, rank in own.items()}
    return _dealt(pairs), _dealt(whole), json.dumps([by_id.get(k) for k in range(max(by_id) + 1)]), "".join(letter(own[bytes([b])]) for b in range(256))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_pattern(spark: SparkSession, pattern: str) -> str:
    """A pattern of classes \\s, \\p{L} and \\p{N} for Java: white space as Unicode has it, and the letters and numbers that are newer than Java's Unicode."""

    def newer(kind: str) -> str:
        known = "".join(chr(k) for k in range(0x110000) if unicodedata.category(chr(k))[0] == kind)
        found, out = spark._jvm.java.util.regex.Pattern.compile(r"\p{Cn}+").matcher(known), []
        while found.find():
            out += [ord(c) for c in found.group()]
        return "".join(rf"\x{{{k:x}}}" for k in out) if len(out) < 2 else _ranges(out)

    return "(?U)" + pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}@L@N]").replace(r"\p{L}+", r"[\p{L}@L]+").replace(r"\p{N}+", r"[\p{N}@N]+").replace("@L", newer("L")).replace("@N", newer("N"))


def _ranges(points: list[int]) -> str:
    cuts = [0, *[k for k in range(1, len(points)) if points[k] != points[k - 1] + 1], len(points)]
    return "".join(rf"\x{{{points[a]:x}}}-\x{{{points[b - 1]:x}}}" for a, b in zip(cuts[:-1], cuts[1:], strict=True))


class Vocabulary:
    """Expressions of one vocabulary. Its rank map and its pieces are literals of the plan: from_json of a constant, which Catalyst folds."""

    def __init__(self, path: str):
        pairs, whole, pieces, self.bytes = _texts(path)
        self.pairs, self.whole = (F.from_json(F.lit(x), "array<map<string,string>>") for x in (pairs, whole))
        self.pieces = F.from_json(F.lit(pieces), "array<binary>")

    def all_encoded(self, words: Column) -> Column:
        """The piece letters of each word of a list; the literals are bound once, as the plan would else hold them wherever they are used."""

        def bound(tables: Column) -> Column:
            own = copy(self)
            own.pairs, own.whole, own.pieces = (tables[c] for c in ("pairs", "whole", "pieces"))
            return F.transform(words, own.encoded)

        return let(F.struct(*[getattr(self, c).alias(c) for c in ("pairs", "whole", "pieces")]), bound)

    @staticmethod
    def _at(table: Column, key: Column) -> Column:
        return F.get(table, F.crc32(key.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))[key]

    def _merge(self, pair: Column) -> Column:
        return F.coalesce(self._at(self.pairs, pair), F.lit(NONE))

    def _merged(self, word: Column) -> Column:
        """A word of byte letters to one of piece letters: each step of the fold joins the first pair of the least rank.

        The state is the word between edges and, letter by letter, what each pair of neighbours would merge to. As a merge's letter stands
        for its rank, the least letter is the next merge, and a merge changes only the pairs at its two sides.
        """
        one, far = F.lit(1), F.lit(1 << 28)

        def joined(state: Column, new: Column, at: Column) -> Column:
            left, right = self._merge(F.concat(F.substring(state["word"], at - 1, one), new)), self._merge(F.concat(new, F.substring(state["word"], at + 2, one)))
            word = F.concat(F.substring(state["word"], one, at - 1), new, F.substring(state["word"], at + 2, far))
            return F.struct(word.alias("word"), F.concat(F.substring(state["next"], one, at - 2), left, right, F.substring(state["next"], at + 2, far)).alias("next"))

        def step(state: Column, _: Column) -> Column:
            return let(F.array_min(F.split(state["next"], "")), lambda new: F.when(new == NONE, state).otherwise(let(F.instr(state["next"], new), lambda at: joined(state, new, at))))

        pairs = lambda whole: F.array_join(F.transform(F.sequence(one, F.length(word) + 1), lambda k: self._merge(F.substring(whole, k, F.lit(2)))), "")
        start = let(F.concat(F.lit(EDGE), word, F.lit(EDGE)), lambda whole: F.struct(whole.alias("word"), pairs(whole).alias("next")))
        return F.aggregate(F.sequence(one, F.length(word)), start, step, lambda state: F.substring(state["word"], F.lit(2), F.length(state["word"]) - 2))

    def _size(self, piece: Column) -> Column:
        """Bytes of a piece letter."""
        point = F.ascii(piece)
        return F.length(F.get(self.pieces, F.when(point < 0xD800, point - 256).otherwise(point - 256 - 0x800)))

    def _windows(self, word: Column, stride: Column) -> Column:
        """A long word merged in windows of two strides, or null if two neighbours have no piece in common.

        Merges are always the least rank first, so a row of pieces is what a text merges to exactly if each two neighbours are what
        their bytes merge to. Two windows that have a piece at the same place can hence be joined there.
        """

        def placed(at: Column) -> Column:
            pieces = F.split(self._merged(F.substring(word, at + 1, stride * 2)), "")
            start = F.struct(at.alias("at"), F.array().cast("array<struct<at:int,piece:string>>").alias("all"))
            return F.aggregate(pieces, start, lambda s, p: F.struct((s["at"] + self._size(p)).alias("at"), F.array_append(s["all"], F.struct(s["at"].alias("at"), p.alias("piece"))).alias("all")), lambda s: s["all"])

        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(word) / stride).cast("int") - 2) * stride, stride)
        nothing = F.lit(None).cast("int")

        def glued(all_: Column) -> Column:
            last = F.size(all_) - 1
            cuts = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k == last, F.length(word)).otherwise(F.coalesce(F.get(F.array_intersect(F.get(all_, k), F.get(all_, k + 1)), F.lit(0))["at"], nothing)))
            kept = lambda cuts: F.transform(all_, lambda w, k: F.array_join(F.transform(F.filter(w, lambda p: (p["at"] < F.get(cuts, k)) & (p["at"] >= F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1)))), lambda p: p["piece"]), ""))
            return let(cuts, lambda cuts: F.when(F.exists(cuts, lambda c: c.isNull()), F.lit(None).cast("string")).otherwise(F.array_join(kept(cuts), "")))

        return let(F.transform(starts, placed), glued)

    def encoded(self, word: Column) -> Column:
        """The piece letters of a word: itself if it is a piece, else merged."""
        letters = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(map(chr, range(256))), self.bytes)
        strides = F.array(*[F.lit(s) for s in STRIDES])
        long = lambda w: F.coalesce(F.aggregate(strides, F.lit(None).cast("string"), lambda found, stride: F.coalesce(found, self._windows(w, stride))), self._merged(w))
        return let(letters, lambda w: F.coalesce(self._at(self.whole, w), F.when(F.length(w) < LONG, self._merged(w)).otherwise(long(w))))

    def decoded(self, ids: Column) -> Column:
        """The bytes of ids: their pieces one after the other. An id that is not in the vocabulary has none."""
        pieces = F.transform(ids, lambda k: F.get(self.pieces, k)).cast("array<string>")
        return F.array_join(pieces, "").cast("binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, words) to blocks of rows: their distinct words, and of each row how many words it has and which."""
    rows: list = []
    sizes: list = []
    codes: list = []
    words: list = []
    held = 0

    def block() -> pa.RecordBatch:
        both = pa.concat_arrays(words).dictionary_encode()
        at = both.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
        starts = np.cumsum([0, *map(len, words[:-1])])
        use = np.concatenate([at[a : a + len(w)][c] for a, w, c in zip(starts, words, codes, strict=True)])
        packed = zlib.compress(use.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
        lists = [pa.concat_arrays(rows), pa.array(np.concatenate(sizes)), both.dictionary]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], ["rows", "sizes", "words", "codes"])

    for batch in batches:
        lists = batch.column(1)
        found = lists.flatten().dictionary_encode()
        rows.append(batch.column(0))
        sizes.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32))
        codes.append(found.indices.to_numpy(zero_copy_only=False))
        words.append(found.dictionary)
        held += lists.flatten().nbytes
        if held >= BLOCK:
            yield block()
            rows, sizes, codes, words, held = [], [], [], [], 0
    if rows:
        yield block()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with encoded words to rows with their ids, some at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows, sizes, words = (batch.column(c)[k].values for c in range(3))
            codes = np.frombuffer(zlib.decompress(batch.column(3)[k].as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
            counts = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int32)
            ids = np.where(points < 0xD800, points - 256, points - 256 - 0x800)
            begins = np.cumsum(counts) - counts
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < len(ends):
                first = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, first + 1_000_000, "right")))
                use = codes[first : ends[high - 1]]
                each = counts[use]
                upto = np.append(0, np.cumsum(each))
                flat = ids[np.arange(upto[-1]) + np.repeat(begins[use] - upto[:-1], each)] if len(use) else ids[:0]
                offsets = upto[np.append(0, ends[low:high] - first)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["row", "ids"])
                low = high


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every row with the column `ids` (array<int>) in place of `text`: each match of `pattern` encoded by the ranks in the file `path`, as tiktoken's encode_ordinary does.

    A block of rows (BLOCK bytes of words, of one task) is parted into its distinct words; a fold of higher-order functions over the
    bytes of each merges pairs by a literal rank map; ids are then put in the words' places. Nothing is shuffled, and no state but a
    block is held. Words of LONG bytes and more are merged in overlapping windows. A null or empty text has no ids; rows may be repeated; an
    empty table gives an empty result; other columns stay as they are, but one called `ids` is an error.
    """
    if "ids" in [c.lower() for c in docs.columns]:
        raise ValueError("the table has a column ids")
    spark, own = docs.sparkSession, Vocabulary(path)
    kept = [c for c in docs.columns if c.lower() != text.lower()]
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(words_pattern(spark, pattern)), F.lit(0))
    rows = docs.select(F.struct(*kept).alias("row"), words.alias("words"))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    parts = rows.rdd.getNumPartitions()
    rows = rows.coalesce(max(1, min(parts, spark.sparkContext.defaultParallelism), parts // max(1, BLOCK // (2 * split))))  # large blocks, but no core without one
    kind = docs.select(F.struct(*kept).alias("row")).schema[0].dataType.simpleString()
    blocks = rows.mapInArrow(trimmed(_blocks), f"rows array<{kind}>, sizes array<int>, words array<string>, codes binary")
    blocks = blocks.select("rows", "sizes", own.all_encoded(F.col("words")).alias("words"), "codes")
    return blocks.mapInArrow(trimmed(_rows), f"row {kind}, ids array<int>").select("row.*", "ids")


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the column `into` (binary): the bytes of their ids. Null for null ids, empty for none."""
    return rows.withColumn(into, Vocabulary(path).decoded(F.col(ids)))
