"""Benchmark decontamination by template canonicalisation.

A token is a run of letters and digits (points, commas, colons, slashes and hyphens between digits
belong to it), or a sign of arithmetic beside a number. Tokens that hold a digit, unit words, and capitalised tokens inside a
sentence become the typed placeholders number, unit and name; neighbours of one type are one placeholder. Windows of eight
template tokens are joined on their hash. Matches of one document and item on one diagonal (document
place less item place) are one copy, and count only if each value of the item's slots always has the same
value in the copy: so a question with other numbers is caught, a text of the same frame but jumbled values
is not. An item with hardly any plain words (a sum, a list of names) has no template to speak of and is looked for as it
is: windows of its very tokens, lines taken together.

Items of one template whose slots repeat alike are one class, which a text meets once, however many items are in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, join_counted, without
from .words import _SPOT, hash_runs, mix, pieces, runs, text_bytes, trimmed

#: Tokens of a window; plain words that it needs; those that suffice for a whole item of ASKED_SIZE tokens or more.
WINDOW, LITERALS, ASKED, ASKED_SIZE = 8, 4, 3, 5
MEMBER = 99  # in place of a size: an item of a class, and the values of its slots
#: Bits of the filter that documents' windows pass before the join: 2 MB, however large the benchmark is.
FILTER_BITS = 24
# Unit words.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros yen percent degree degrees celsius fahrenheit kelvin watt watts kw volt volts amp amps joule joules newton newtons mph kph hz khz mhz ghz kb mb gb tb"
).split()
_NUMBER, _UNIT, _NAME = (np.uint64(k) for k in (0x1F3A5C7E9B2D4F61, 0x2E4B6D8FA1C3E507, 0x3D5C7B9AF8E6D4C2))
_GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_JOIN = np.isin(np.arange(256), np.frombuffer(b".,:/-", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?:;\n", np.uint8))
_BREAK = np.isin(np.arange(256), np.frombuffer(b"!?;\n", np.uint8))  # stops that are never inside a token
_SIGN = np.isin(np.arange(256), np.frombuffer(b"+*=<>^-/", np.uint8))
_BETWEEN = np.isin(np.arange(256), np.frombuffer(b"-/", np.uint8))  # signs only between two numbers
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(hash_runs(data, *runs(data, data == 32, np.array([0]))))


def signs(data: np.ndarray, gap: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of + * = < > ^ with a digit next to them, and of - and / between two, blanks left out; in gaps and in one text."""
    at = np.flatnonzero(_SIGN[data] & gap)
    if not len(at):
        return at
    shown = np.flatnonzero(~_BLANK[data])
    spot, own = np.searchsorted(shown, at), np.searchsorted(begins, at, "right")

    def beside(step: int) -> np.ndarray:
        near = shown[np.clip(spot + step, 0, len(shown) - 1)]
        return _DIGIT[data[near]] & (near != at) & (np.searchsorted(begins, near, "right") == own)

    left, right = beside(-1), beside(1)
    return at[np.where(_BETWEEN[data[at]], left & right, left | right)]


def tokens(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that begin at `begins` in data: which bytes are in no token, tokens' starts and ends, their rows and hashes."""
    gap, digit = _GAP[data], _DIGIT[data]
    if len(data) > 2:
        gap[1:-1] &= ~(_JOIN[data[1:-1]] & digit[:-2] & digit[2:])
    starts, ends = runs(data, gap, begins)
    sign = signs(data, gap, begins)
    if len(sign):
        starts, ends = np.sort(np.append(starts, sign)), np.sort(np.append(ends, sign + 1))
    return gap, starts, ends, np.searchsorted(begins, starts, "right") - 1, hash_runs(data, starts, ends)


def template(data: np.ndarray, gap: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, literal: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each template token's row, its value, (a placeholder's) literal, else 0, and whether it is a plain word."""
    if not len(starts):
        return np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, np.zeros(0, bool)
    digit = _DIGIT[data]
    stops = np.append(0, np.cumsum(_STOP[data] & gap))
    opens = np.append(True, (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]]))
    follow = data[np.minimum(starts + 1, len(data) - 1)]
    upper = _UPPER[data[starts]] | ((data[starts] == 0xC3) & (follow >= 0x80) & (follow <= 0x9E))  # A-Z and the capitals of Latin-1
    kind = np.where(upper & ~opens, 3, 0)
    kind[np.isin(literal, _unit_hashes())] = 2
    kind[np.logical_or.reduceat(digit, starts)] = 1
    kind[_SIGN[data[starts]]] = 4
    first = np.append(True, (kind[1:] % 4 == 0) | (kind[1:] != kind[:-1]) | opens[1:] | (row[1:] != row[:-1]))
    at = np.flatnonzero(first)
    place = np.arange(len(kind)) - at[np.cumsum(first) - 1]
    joined = np.add.reduceat(mix(literal + place.astype(np.uint64), 8), at)
    held = kind[at] % 4
    value = np.where(held == 0, literal[at], np.choose(held, [np.uint64(0), _NUMBER, _UNIT, _NAME]))
    return row[at], value, np.where(held == 0, np.uint64(0), joined), kind[at] == 0


def windows(row: np.ndarray, value: np.ndarray, plain: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next `size` template tokens are of one row and hold enough plain words, and their hashes."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = value[:n] * _SPOT[0]
    for k in range(1, size):
        total = total + value[k : n + k] * _SPOT[k]
    words = np.append(0, np.cumsum(plain))
    good = (row[:n] == row[size - 1 :]) & (words[size : size + n] - words[:n] >= (ASKED if ASKED_SIZE <= size < WINDOW else LITERALS))
    at = np.flatnonzero(good)
    return at, mix(total[at], size)


def bare_windows(row: np.ndarray, literal: np.ndarray, line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next `size` tokens are of one row, and (under LITERALS tokens) begin and end a line, and hashes of these tokens."""
    n = len(literal) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = literal[:n] * _SPOT[0]
    for k in range(1, size):
        total = total + literal[k : n + k] * _SPOT[k]
    good = row[:n] == row[size - 1 :]
    if size < LITERALS:
        edge = np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1]), [True]])
        good &= edge[:n] & edge[size:]
    at = np.flatnonzero(good)
    return at, mix(total[at], 16 + size)


def _class(value: np.ndarray, slot: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of an item's tokens: its class, the number of each token's slot value (by first place, from 1; 0: no slot), the values in this order."""
    kinds, first, which = np.unique(slot[slot != 0], return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.zeros(len(slot), np.int64)
    number[slot != 0] = np.argsort(order)[which] + 1
    place = np.arange(len(slot)).astype(np.uint64)
    cls = np.add.reduce(mix(mix(value + place * np.uint64(0xD1342543DE82EF95), 17) + number.astype(np.uint64), 18), initial=np.uint64(len(slot)))
    return int(np.int64(cls.view(np.int64))), number, kinds[order].view(np.int64)


_NAMES = ("doc_id", "row_key", "pos", "size", "win", "slots")


def _schema(*more: str) -> tuple[pa.Schema, str]:
    names = [*_NAMES, *more]
    kinds = [(n, pa.list_(pa.int64()) if n == "slots" else pa.int64()) for n in names]
    return pa.schema(kinds), ", ".join(f"{n} {'array<long>' if n == 'slots' else 'long'}" for n in names)


def _read(batches: Iterator[pa.RecordBatch], bare: bool) -> Iterator[tuple]:
    """(batch, first row, row after the last, template of these rows, their tokens' rows, hashes and lines if `bare`); a text is never in parts."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        held, lines = [], 0
        for row, stop, low, high in pieces(data, offsets, _BREAK):
            part = data[low:high]
            found = tokens(part, np.clip(offsets[row:stop] - low, 0, high - low))
            got = template(part, *found)
            if bare:
                broken = np.append(0, np.cumsum(part == 10))
                got += found[3], found[4], broken[found[1]] + lines
            if stop == row + 1:  # pieces of a long text are one text
                held.append(got)
                lines += int(broken[-1]) if bare else 0
                if high < offsets[stop]:
                    continue
                got = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, lines = [], 0
            yield batch, row, stop, got[:4], got[4:]


def _emit(passes, sizes: list[int]):
    """Rows of the texts' windows of `sizes` that a filter keeps, with values of their slots. A size under 0 is one of bare tokens. passes() -> (hashes -> which to keep)."""
    schema, ddl = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = passes()
        for batch, row, stop, (own, value, slot, plain), bare in _read(batches, min(sizes, default=0) < 0):
            for size in sizes:
                if size > 0:
                    at, win = windows(own, value, plain, size)
                    rows, first = own, np.searchsorted(own, np.arange(stop - row))
                else:
                    at, win = bare_windows(*bare, -size)
                    rows, first = bare[0], np.searchsorted(bare[0], np.arange(stop - row))
                good = keep(win)
                at, win = at[good], win[good]
                if not len(at):
                    continue
                around = slot[at[:, None] + np.arange(size)].view(np.int64) if size > 0 else np.zeros((len(at), 0), np.int64)
                where = pa.array(row + rows[at])
                columns = [(at - first[rows[at]]).astype(np.int64), np.full(len(at), size), win.view(np.int64)]
                slots = pa.array([x[x != 0].tolist() for x in around], schema.field("slots").type)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *map(pa.array, columns), slots], schema=schema)

    return run, ddl


def _emit_items():
    """Rows of the items' windows with numbers of their slots' values, and one of size MEMBER of each item with these values; cls is an item's class."""
    schema, ddl = _schema("cls")

    def told(value: np.ndarray, slot: np.ndarray, plain: np.ndarray, bare: tuple) -> Iterator[tuple]:
        none = np.zeros(len(value), np.int64)
        size = min(len(value), WINDOW)
        at, win = windows(none, value, plain, size) if size >= LITERALS else (none[:0], none[:0])
        if len(at):
            cls, number, values = _class(value, slot)
            slots = [[int(n) for n in number[k : k + size] if n] for k in at.tolist()]
        else:
            size = -min(len(bare[0]), WINDOW)
            if not size:
                return
            at, win = bare_windows(np.zeros(len(bare[0]), np.int64), *bare, -size)
            cls, _, values = _class(bare[0], np.zeros(len(bare[0]), np.uint64))
            cls, slots = cls ^ size, [[]] * len(at)
        yield -1, MEMBER, cls, values.tolist(), cls
        for k, w, s in zip(at.tolist(), win.view(np.int64).tolist(), slots, strict=True):
            yield k, size, w, s, cls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, stop, got, bare in _read(batches, True):
            spans = np.searchsorted(got[0], np.arange(stop - row + 1)), np.searchsorted(bare[0], np.arange(stop - row + 1))
            for k in range(stop - row):
                (a, b), (c, d) = (x[k : k + 2] for x in spans)
                rows = list(told(*(x[a:b] for x in got[1:]), tuple(x[c:d] for x in bare[1:])))
                if rows:
                    where = pa.array(np.full(len(rows), row + k))
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows), schema.types[2:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *columns], schema=schema)

    return run, ddl


def _items(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.xxhash64("item_id", "text").alias("row_key"), "text")
    run, schema = _emit_items()
    return scratch.table(items.mapInArrow(trimmed(run), schema), "items")


def template_classes(benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """item_id, class_item: the smallest item_id of its class. Items without tokens have no row, one id with several texts may have several."""
    items = _items(benchmark, scratch or Scratch(benchmark.sparkSession, "classes")).where(F.col("size") == MEMBER)
    least = items.groupBy("cls").agg(F.min("doc_id").alias("class_item"))
    return items.join(least, "cls").select(F.col("doc_id").alias("item_id"), "class_item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, enough: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """One row per document and class of benchmark items that it holds: doc_id, row_key, item_id, items, matched, item_windows, coverage, reparameterised.

    A class (`template_classes` has its members) is told by its smallest item_id, `items` is the number of its ids. A class is held if
    `coverage` of its windows, or `enough` of them (15 words in a row), are in the text, in copies whose slots are consistent. An item
    of fewer than eight template tokens is one window of all of them; it needs four plain words, of five tokens or more three. Items
    without such a window have windows of their very tokens, at most eight, anywhere in a text; one of fewer than four tokens is held only
    where they begin and end a line (or lines). reparameterised: no copy has the values of an item of the class throughout. Null and
    empty texts and items match nothing; rows of equal doc_id and text give one row; items of equal id and other text are taken together.
    Only doc_id, text and item_id are read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    items = _items(benchmark, scratch)
    members = items.where(F.col("size") == MEMBER).select("cls", F.col("doc_id").alias("item_id"), F.col("slots").alias("values"))
    bench = items.where(F.col("size") != MEMBER).groupBy("cls", F.col("pos").alias("b_pos"), F.col("size").alias("b_size")).agg(F.first("win").alias("win"), F.first("slots").alias("b_slots"))  # alike in a class
    bench = scratch.table(bench, "bench")
    least = members.groupBy("cls").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("items"))
    of_class = scratch.table(bench.groupBy("cls").agg(F.count("*").alias("item_windows")).join(least, "cls"), "classes")
    sizes = [r.b_size for r in bench.select("b_size").distinct().collect()]  # from -WINDOW to WINDOW

    mask = (1 << FILTER_BITS) - 1
    low = F.col("win").bitwiseAND(F.lit(mask))
    words = bench.select(F.shiftright(low, 5).alias("word"), F.expr(f"shiftleft(1L, int((win & {mask}) & 31))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    filled = np.zeros((mask + 1) // 32, np.uint32)
    for word, bits in words.toLocalIterator():  # a row per 32 bits of the filter at most
        filled[word] = bits & 0xFFFFFFFF
    held = spark.sparkContext.broadcast(np.packbits(np.unpackbits(filled.view(np.uint8), bitorder="little"), bitorder="little"))

    def passes():
        table = held.value

        def keep(win: np.ndarray) -> np.ndarray:
            at = (win & np.uint64(mask)).astype(np.int64)
            return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

        return keep

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    run, schema = _emit(passes, sizes)
    found = join_counted(texts.mapInArrow(trimmed(run), schema), bench, "win", values=F.size("b_slots") + 5)
    found = found.where((F.size("slots") == F.size("b_slots")) & (F.col("size") == F.col("b_size"))).withColumn("diagonal", F.col("pos") - F.col("b_pos"))
    slots = F.arrays_zip(F.col("b_slots").alias("old"), F.col("slots").alias("new"))
    copy = found.groupBy("doc_id", "row_key", "cls", "diagonal").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(slots)))).alias("pairs"), F.collect_set("b_pos").alias("places"))  # no more than an item has
    copy = copy.select("*", F.transform("pairs", lambda p: p["old"]).alias("olds"), F.transform("pairs", lambda p: p["new"]).alias("news"))
    copy = scratch.table(copy.where(F.size(F.array_distinct("olds")) == F.size("olds")), "copies")
    asked = copy.select("cls", "olds").distinct()
    own = asked.join(members.select("cls", "values").distinct(), "cls").select("cls", "olds", F.transform("olds", lambda k: F.element_at("values", k.cast("int"))).alias("news")).distinct()
    copy = copy.join(own.withColumn("same", F.lit(True)), ["cls", "olds", "news"], "left").select("doc_id", "row_key", "cls", F.coalesce("same", F.lit(False)).alias("same"), F.explode("places").alias("place"))
    out = copy.groupBy("doc_id", "row_key", "cls").agg(F.countDistinct("place").alias("matched"), F.max("same").alias("same"))
    out = join_counted(out, of_class, "cls")
    share = F.col("matched") / F.col("item_windows")
    out = out.where((share >= coverage) | (F.col("matched") >= enough))
    out = out.groupBy("doc_id", "row_key", "item_id").agg(F.max("matched").alias("matched"), F.max_by("item_windows", "matched").alias("item_windows"), F.max("items").alias("items"), F.max(share).alias("coverage"), (~F.max("same")).alias("reparameterised"))
    return scratch.table(out, "held")


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs without those that hold an item; all columns as they are."""
    scratch = scratch or Scratch(docs.sparkSession, "clean")
    return without(docs, scratch.table(contaminated(docs, benchmark, scratch=scratch).select("doc_id", "row_key").distinct(), "gone"))
