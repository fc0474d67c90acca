"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans of a text.

A word is a longest run of letters of one script and the marks that combine with them. Its score for a language is the sum over its character
trigrams (with its ends) of log P(trigram | language), counted over all labelled texts, against one chance in as many as there are buckets. A path over the
words pays `switch` for each change of language; its spans are the language spans of the text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, without
from .words import mix, trimmed

BUCKETS = 1 << 14
SWITCH = 6.0
#: lang values that a task counts for at a time, and beyond which a column isn't one of languages (each takes 64 KB of a broadcast): an error then.
COUNTED, LANGUAGES = 64, 4096
#: Characters that are looked at together.
CHARS = 1 << 19
#: Weights that are looked up together.
WIDE = 1 << 21

# First and last code point of scripts' ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = ["", *SCRIPTS, "other", "mark"]
OTHER, MARK = len(NAMES) - 2, len(NAMES) - 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Script number of each code point (0: neither letter nor mark), its lower case where that is one character, and whether it is a letter."""
    script, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(0x32400):
        char = chr(c)
        kind = unicodedata.category(char)[0]
        if kind == "L":
            script[c], letter[c] = OTHER, True
            if len(low := char.lower()) == 1:
                lower[c] = ord(low)
        elif kind == "M":
            script[c] = MARK
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            part = script[first : last + 1]
            part[part > 0] = k
    return script, lower, letter


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, row after the last, code points, where each row begins) of rows of about CHARS characters together."""
    row, held, total = 0, [], 0
    for k, text in enumerate(texts):
        held.append(np.frombuffer((text.as_py() or "").encode("utf-32-le", "replace"), np.uint32))
        total += len(held[-1])
        if total >= CHARS or k == len(texts) - 1:
            yield row, k + 1, np.concatenate(held), np.append(0, np.cumsum([len(x) for x in held]))
            row, held, total = k + 1, [], 0


def _words(chars: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and scripts of words, and all characters in lower case. A mark is of the script of what it follows; marks without a letter are no word."""
    script, lower, letter = _tables()
    if not len(chars):
        return (np.zeros(0, np.int64),) * 2 + (script[:0], lower[:0])
    kind = script[chars]
    first = np.zeros(len(chars) + 1, bool)
    first[begins] = True
    mark = (kind == MARK) & ~first[:-1]
    if mark.any():
        kind = kind[np.maximum.accumulate(np.where(mark, 0, np.arange(len(kind))))]
    change = np.append(True, kind[1:] != kind[:-1])
    starts = np.flatnonzero((kind > 0) & (change | first[:-1]))
    edge = np.append(change, True) | first
    ends = np.flatnonzero(edge[1:] & (kind > 0)) + 1
    if len(starts):
        letters = np.append(0, np.cumsum(letter[chars]))
        some = letters[ends] > letters[starts]
        starts, ends = starts[some], ends[some]
    return starts, ends, kind[starts], lower[chars]


def _alike(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words the first of each kind, and for every word which of these it equals (by a 64-bit hash)."""
    sizes = ends - starts
    place = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(place, sizes)
    value = mix(chars[at + np.repeat(starts, sizes)].astype(np.uint64) << np.uint64(32) | at.astype(np.uint64), 16)
    _, first, which = np.unique(np.add.reduceat(value, place), return_index=True, return_inverse=True)
    return first, which


def _grams(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of all words with a space at both ends, and where each word's begin."""
    sizes = ends - starts + 2
    place = np.cumsum(sizes) - sizes
    row = np.full(int(sizes.sum()), 32, np.uint64)
    at = np.arange(len(row)) - np.repeat(place, sizes)
    inner = (at > 0) & (at < np.repeat(sizes, sizes) - 1)
    row[inner] = chars[(at + np.repeat(starts, sizes) - 1)[inner]]
    two = np.append(np.uint64(0), row[:-1])
    three = np.append(np.zeros(2, np.uint64), row[:-2])
    three[at < 2] = 0
    grams = mix(row | (two << np.uint64(21)) | (three << np.uint64(42)), 5) & np.uint64(BUCKETS - 1)
    keep = at > 0
    return grams[keep].astype(np.int64), place - np.arange(len(place))


def train(labelled: DataFrame) -> dict:
    """A model from columns text and lang: counts over all rows with both and all lang values; nothing else is read.

    Without any labelled row the model is empty and predicts nothing but und. Returns names, log weights (BUCKETS x languages, against the
    chance 1 / BUCKETS) and the scripts of each language: those that hold at least a hundredth of its letters. Counts by
    bucket and language reach the driver as Arrow columns. More than LANGUAGES lang values are an error.
    """
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    index = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for k, tables in held.items():
                for what, table in enumerate(tables):
                    at = np.flatnonzero(table)
                    columns = [np.full(len(at), what, np.int32), np.full(len(at), k, np.int32), at.astype(np.int32), table[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["what", "k", "bucket", "n"])
            held.clear()

        for batch in batches:
            own = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()])
            for row, _, chars, begins in _parts(batch.column(0)):
                starts, ends, kind, low = _words(chars, begins)
                if not len(starts):
                    continue
                grams, place = _grams(low, starts, ends)
                lang = own[row + np.searchsorted(begins, starts, "right") - 1]
                each = np.repeat(lang, np.diff(np.append(place, len(grams))))
                for k in np.unique(lang[lang >= 0]).tolist():
                    if k not in held and len(held) >= COUNTED:
                        yield from told()
                    total, letters = held.setdefault(k, (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)))
                    total += np.bincount(grams[each == k], minlength=BUCKETS)
                    letters += np.bincount(kind[lang == k], (ends - starts)[lang == k], len(NAMES)).astype(np.int64)
        yield from told()

    found = rows.mapInArrow(trimmed(count), "what int, k int, bucket int, n long").groupBy("what", "k", "bucket").agg(F.sum("n").alias("n"))
    what, k, bucket, n = (c.to_numpy() for c in found.toArrow().columns)  # a number for each bucket and language at most
    total, letters = np.zeros((BUCKETS, len(names)), np.float32), np.zeros((len(names), len(NAMES)))
    total[bucket[what == 0], k[what == 0]] = n[what == 0]
    letters[k[what == 1], bucket[what == 1]] = n[what == 1]
    weight = np.log(total + np.float32(0.5)) - np.log(total.sum(axis=0, dtype=np.float64) / BUCKETS + 0.5).astype(np.float32)
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return {"names": names, "weights": weight.astype(np.float32), "scripts": share >= 0.01, "sizes": letters.sum(axis=1)}


def viterbi(scores: np.ndarray, begins: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: rows of scores, cut into texts at `begins` (whose last entry is their number).

    All texts step forward together, longest first, so that each step is one operation on those not ended.
    """
    n, path = np.diff(begins), np.zeros(len(scores), np.int64)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return path
    start, size = begins[:-1][order], n[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts that have a t-th word
    came = np.empty(scores.shape, np.int16)
    value = scores[start].astype(np.float64)
    last = np.zeros(len(order), np.int64)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, size[0]):
        k = live[t]
        ended = slice(k, live[t - 1])
        last[ended] = value[ended].argmax(axis=1)
        value = value[:k]
        best = value.argmax(axis=1)
        moved = value[np.arange(k), best][:, None] - switch
        change = moved > value
        at = start[:k] + t
        came[at] = np.where(change, best[:, None], own)
        value = np.where(change, moved, value) + scores[at]
    last[: len(value)] = value.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        k = live[t]
        at = start[:k] + t
        path[at] = last[:k]
        if t:
            last[:k] = came[at, last[:k]]
    return path


def predict(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """doc_id, row_key, lang_pred, score, spans, n_words, fit and foreign of every row, from its whole text.

    lang_pred is the language of most letters on the best path, score their share of all letters, spans a
    list of (start, end, lang) in characters. A null text or one without letters, or an empty model: und,
    0.0 and no spans. Letters of a script that no language has can be any language. fit is the mean over all trigrams of their log
probability in the language of their word, against one chance in BUCKETS: under 0, the text is less like its languages than any
string is. foreign is the share of letters in scripts that no language has. row_key is
    xxhash64(doc_id, text). Columns other than doc_id and text are not read. Empty in, empty out.
    """
    names, scripts, weights = model["names"], model["scripts"], model["weights"]
    allowed = np.zeros((len(NAMES), max(1, len(names))), bool)
    strange = np.ones(len(NAMES), bool)
    if names:
        allowed[:] = scripts.T
        strange = ~allowed.any(axis=1)
        allowed[strange] = True
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 64 KB for each of LANGUAGES at most
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)), ("n_words", pa.int64()), ("fit", pa.float64()), ("foreign", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        label = pa.array(names, pa.string())
        for batch in batches:
            for row, stop, chars, begins in _parts(batch.column(2)):
                n = stop - row
                pred, score, fit, foreign = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n)
                first = np.zeros(0, np.int64)
                starts, ends, kind, low = _words(chars, begins)
                doc = np.searchsorted(begins, starts, "right") - 1
                path = np.zeros(0, np.int64)
                if names and len(starts):
                    once, which = _alike(low, starts, ends)  # a word is scored once for all its places
                    grams, place = _grams(low, starts[once], ends[once])
                    scores = np.empty((len(place), len(names)), np.float32)
                    cuts = np.unique(np.searchsorted(place, np.arange(0, len(grams) + WIDE // len(names) + 1, WIDE // len(names) + 1)))
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        scores[a:b] = np.add.reduceat(table[grams[place[a] : place[b] if b < len(place) else None]], place[a:b] - place[a], axis=0)
                    scores = scores[which]
                    scores[~allowed[kind]] = -1e4
                    path = viterbi(scores, np.searchsorted(doc, np.arange(n + 1)), switch)
                    letters = np.bincount(doc * len(names) + path, ends - starts, n * len(names)).reshape(n, -1)
                    total = letters.sum(axis=1)
                    pred = np.where(total > 0, letters.argmax(axis=1), -1)
                    score = letters.max(axis=1) / np.maximum(total, 1)
                    won = scores[np.arange(len(path)), path]
                    fit = np.bincount(doc, won, n) / np.maximum(np.bincount(doc, ends - starts + 1, n), 1)  # a word has a trigram more than letters
                    foreign = np.bincount(doc, (ends - starts) * strange[kind], n) / np.maximum(total, 1)
                    first = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])))
                    stops = ends[np.append(first[1:], len(ends)) - 1]
                whole = np.searchsorted(doc[first], np.arange(n + 1)) if len(first) else np.zeros(n + 1, np.int64)
                part = [starts[first] - begins[doc[first]], stops - begins[doc[first]]] if len(first) else [np.zeros(0, np.int64)] * 2
                lang = label.take(pa.array(path[first])) if len(first) else pa.array([], pa.string())
                spans = pa.StructArray.from_arrays([pa.array(part[0]), pa.array(part[1]), lang], fields=list(span))
                named = pa.array([names[k] if k >= 0 else "und" for k in pred.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], batch.column(1)[row:stop], named, pa.array(score), pa.ListArray.from_arrays(pa.array(whole, pa.int32()), spans), pa.array(np.bincount(doc, minlength=n)), pa.array(fit), pa.array(foreign)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, row_key long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>, n_words long, fit double, foreign double")


def held_out(doc_id="doc_id"):
    """True for the documents that training leaves out: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def in_known_language(docs: DataFrame, least: float = 0.35, enough: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """docs whose text is in languages learned from their own lang column; columns as they are.

    What goes: a text without letters (und), one of which no language has the share `least`, one most of whose letters are of
    scripts that no language has, and one of at least `enough` words whose fit is under 0 (an unlearned language, or letters
    at random). Where no row has a lang value nothing is learned, and all documents stay. Empty in, empty out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "language")
    model = train(docs)
    if not model["names"]:
        return docs
    bad = (F.col("lang_pred") == "und") | (F.col("score") < least) | (F.col("foreign") > 0.5) | ((F.col("n_words") >= enough) & (F.col("fit") < 0))
    return without(docs, scratch.table(predict(docs, model).where(bad).select("doc_id", "row_key").distinct(), "rejected"))
