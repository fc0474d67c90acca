"""Phrases that stand together more often than their parts: counts by a multikey three-way quicksort of suffix pointers, in ranges routed by leading words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import join_hot, sorted_groups
from .scratch import Scratch
from .words import _LETTER, hash_runs, mix, pieces, runs, text_bytes, trimmed

#: Words of the longest phrase, bytes of text that are parted into words together, and suffixes that are sorted together (about).
DEPTH, TOGETHER, EACH = 4, 8 << 20, 1_000_000
#: A prefix that starts a SHARE-th of all suffixes is routed by one word more. So there are at most 2 * SHARE of each length.
SHARE = 1 << 16
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDED = np.uint64(0x9E3779B97F4A7C15)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, bytes, where texts begin): texts of one lang, about TOGETHER bytes of them; a longer one is parted at a break."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            data, offsets = text_bytes(batch.column(1).filter(pc.equal(langs.indices, code)))
            row = 0
            while row < len(offsets) - 1:
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOGETHER, "right")) - 1)
                if stop > row + 1:
                    yield lang, data[offsets[row] : offsets[stop]], offsets[row:stop] - offsets[row]
                else:
                    for _, _, low, high in pieces(data[offsets[row] : offsets[stop]], np.array([0, offsets[stop] - offsets[row]]), _BREAK):
                        yield lang, data[offsets[row] + low : offsets[row] + high], np.zeros(1, np.int64)
                row = stop


def _suffixes(data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts with a hash of each, and the distinct suffixes of up to DEPTH words (codes of words, -1 after a piece's end) with their counts."""
    starts, ends = runs(data, _GAP[data], begins[begins < len(data)])
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.uint64), np.zeros((0, DEPTH), np.int64), np.zeros(0, np.int64)
    breaks = np.append(0, np.cumsum(_BREAK[data]))
    piece = breaks[starts] + np.searchsorted(begins, starts, "right")
    flat = _LOWER[data[~_GAP[data]]]
    upto = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held, offsets = text_bytes(words.dictionary.view(pa.large_binary()).cast(pa.large_binary()).view(pa.large_string()))
    hashes = hash_runs(held, offsets[:-1], offsets[1:])
    rows = np.full((len(code), DEPTH), -1, np.int64)
    rows[:, 0] = code
    for k in range(1, DEPTH):
        rows[:-k, k] = np.where(piece[k:] == piece[:-k], code[k:], -1) if k < len(code) else -1
    front, back = rows[:, 0] << 32 | (rows[:, 1] + 1), rows[:, 2] + 1 << 32 | (rows[:, 3] + 1)
    order = np.lexsort((back, front))
    front, back = front[order], back[order]
    first = np.flatnonzero(np.append(True, (front[1:] != front[:-1]) | (back[1:] != back[:-1])))
    rows, counts = rows[order[first]], np.diff(np.append(first, len(order)))
    return words.dictionary, hashes, rows, counts


def _routes(lang: str, hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first one, two ... words of each suffix and its lang."""
    known = np.append(hashes, _ENDED)
    base = np.frombuffer(lang.encode() or b"\0", np.uint8)
    at = hash_runs(base, np.array([0]), np.array([len(base)]))[0]
    out = []
    for k in range(DEPTH):
        at = mix(at + known[rows[:, k]], k)
        out.append(at)
    return out


def _words_and_hot(min_share: float):
    """lang, key, f: all counts of single words (key: the word), and of prefixes that are frequent here, by their length and hash."""
    schema = pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("word", pa.string()), ("prefix", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, begins in _texts(batches):
            words, hashes, rows, counts = _suffixes(data, begins)
            if not len(words):
                continue
            n = np.bincount(rows[:, 0], counts, len(words)).astype(np.int64)
            out = [(words.cast(pa.large_string()).cast(pa.string()), np.zeros(len(words), np.int64), n, 1)]
            new = np.append(True, rows[1:, 0] != rows[:-1, 0])
            for depth in (2, 3):  # suffixes are sorted, so those of a prefix are side by side
                new[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
                first = np.flatnonzero(new)
                total = np.add.reduceat(counts, first)
                hot = (total >= max(2, counts.sum() * min_share)) & (rows[first, 1] >= 0)
                prefix = _routes(lang, hashes, rows[first[hot]])[depth - 1]
                out.append((pa.nulls(int(hot.sum()), pa.string()), prefix.view(np.int64), total[hot], depth))
            for word, prefix, f, depth in out:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(np.full(len(f), depth, np.int32)), word, pa.array(prefix), pa.array(f)], schema=schema)

    return run


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the greatest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind.newbyteorder("<")).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _dealt(buckets: int, hot: dict[int, np.ndarray]):
    """Suffixes of at least two words, dealt to (bucket): words, codes, counts, and how many words route a suffix."""
    names = ["bucket", "lang", "words", "codes", "counts", "routed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, begins in _texts(batches):
            words, hashes, rows, counts = _suffixes(data, begins)
            several = rows[:, 1] >= 0
            rows, counts = rows[several], counts[several]
            if not len(rows):
                continue
            prefixes = _routes(lang, hashes, rows)
            routed, by = np.full(len(rows), 2, np.uint8), prefixes[1].copy()
            for depth in (2, 3):
                if not len(hot[depth]):
                    continue
                at = np.minimum(np.searchsorted(hot[depth], prefixes[depth - 1]), len(hot[depth]) - 1)
                deeper = (routed == depth) & (hot[depth][at] == prefixes[depth - 1])
                routed[deeper], by[deeper] = depth + 1, prefixes[depth][deeper]
            bucket = (by % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[low:high]
                part = rows[at].T + 1  # 0 is the end of a piece
                used = np.zeros(len(words) + 1, bool)
                used[part] = True
                used[0] = False
                use, local = np.flatnonzero(used) - 1, np.cumsum(used)[part] * (part > 0)
                own = words.take(pa.array(use)).cast(pa.large_string()).cast(pa.string())
                own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                blobs = [pa.array([x], pa.binary()) for x in (_narrow(local), _narrow(counts[at]), routed[at].tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[at[0]])]), pa.array([lang]), own, *blobs], names)

    return run


def _quicksorted(codes: np.ndarray, weight: np.ndarray, routed: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a suffix, words, count) of each prefix of two words or more that counts `least`, or that is routed deeper than it is long.

    Pointers to suffixes are parted by their word at one depth into those before, at and after a pivot. The part at the pivot is a
    prefix with its count, and is parted at the next depth; a part that can't hold `least` is left alone.
    """
    out: list[tuple[int, int, int]] = []
    stack = [(np.arange(len(codes[0])), 0)]
    while stack:
        own, depth = stack.pop()
        if weight[own].sum() < least and not (routed[own] > max(depth, 1) + 1).any():
            continue
        word = codes[depth][own]
        pivot = word[len(word) // 2]
        if word[0] != pivot or word[-1] != pivot or (word != pivot).any():
            before = word < pivot
            after = word > pivot
            stack += [(part, depth) for part in (own[before], own[after]) if len(part)]
            own = own[~(before | after)]
        if not pivot:
            continue  # pieces that have ended
        count = int(weight[own].sum())
        if depth and (count >= least or routed[own[0]] > depth + 1):
            out.append((int(own[0]), depth + 1, count))
        if depth + 1 < DEPTH:
            stack.append((own, depth + 1))
    return out


def _counted(least: int):
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches):
            lists = rows.column("words").combine_chunks()
            both = lists.flatten().dictionary_encode()
            names, at = both.dictionary, np.append(both.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, 0)
            shift = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
            codes = []
            for k, blob in enumerate(rows.column("codes").to_pylist()):
                local = _wide(blob).reshape(DEPTH, -1)
                codes.append(np.where(local > 0, at[np.where(local > 0, local - 1 + shift[k], len(at) - 1)], 0).astype(np.int32))
            weight = np.concatenate([_wide(b) for b in rows.column("counts").to_pylist()])
            routed = np.concatenate([np.frombuffer(b, np.uint8) for b in rows.column("routed").to_pylist()])
            codes = np.concatenate(codes, axis=1)
            found = _quicksorted(codes, weight, routed, least)
            lang, texts = rows.column("lang")[0].as_py(), names.to_pylist
            held = {int(c) for first, n, _ in found for c in codes[:n, first]}
            named = dict(zip(held, names.take(pa.array([c - 1 for c in held], pa.int64())).to_pylist(), strict=True)) if held else {}
            for low in range(0, len(found), 50_000):
                part = found[low : low + 50_000]
                phrases = [" ".join(named[int(c)] for c in codes[:n, first]) for first, n, _ in part]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(phrases, pa.string()), pa.array([n for _, n, _ in part], pa.int32()), pa.array([f for _, _, f in part], pa.int64())], schema=schema)

    return run


def phrase_counts(docs: DataFrame, least: int = 30, each: int = EACH, share: int = SHARE, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of single words (lang, phrase, f), and of all phrases of 2 to 4 words that occur `least` times within pieces (lang, phrase, words, f).

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and these at blanks and tabs into words; everything is per lang
    (null: `und`). Suffixes go to buckets by a hash of their first two words; those of a prefix that starts a `share`-th of all by three or
    four, equal ones of 8 MiB of text as one with a count, so no word or phrase makes a hot bucket. Counts of prefixes that are routed deeper are added
    up over buckets. The number of buckets grows with the text. Null and empty texts have no words.
    """
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(trimmed(_words_and_hot(1 / (2 * share))), "lang string, depth int, word string, prefix long, f long")
    found = scratch.table(found.groupBy("lang", "depth", "word", "prefix").agg(F.sum("f").alias("f")), "words")
    words = found.where("depth = 1").select("lang", F.col("word").alias("phrase"), "f")
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    often = found.where((F.col("depth") > 1) & (F.col("f") >= max(least, total // (2 * share)))).select("depth", "prefix").toArrow()
    hot = {d: np.sort(often.column("prefix").to_numpy()[often.column("depth").to_numpy() == d].view(np.uint64)) for d in (2, 3)}
    kinds = "bucket long, lang string, words array<string>, codes binary, counts binary, routed binary"
    dealt = texts.mapInArrow(trimmed(_dealt(max(1, -(-total // each)), hot)), kinds)
    dealt = dealt.select("bucket", F.xxhash64("lang").alias("lang_key"), F.lit(0).alias("part"), *dealt.columns[1:])
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "lang_key")
    counts = dealt.mapInArrow(trimmed(_counted(least)), "lang string, phrase string, words int, f long")
    counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return words, scratch.table(counts, "phrases")


def _first(rows: DataFrame, keys: list[str], order: list, n: int, name: str) -> DataFrame:
    """The first n rows of each key, with their rank: of each 64th of its rows first, so that no task sorts a whole key."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    part = rows.withColumn("salt", salt).withColumn(name, F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).where(F.col(name) <= n)
    return part.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n).drop("salt")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, scratch: Scratch | None = None, **sizes) -> DataFrame:
    """The first `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    a, l, r count a phrase and its two parts at the cut that scores least (then the one with the shorter first part), n all words of the
    lang; score is floor(2000000 * a / (l + r)), in decimals of 38 digits. A phrase within a longer one that occurs 0.8 times as often goes.
    Ranks are by score, a (both falling) and phrase by its bytes. An empty table gives an empty result; rows may be repeated.
    """
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    words, phrases = phrase_counts(docs, least, scratch=scratch, **sizes)
    key = lambda phrase: F.concat("lang", F.lit("\t"), phrase)
    split = phrases.withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", key(part(F.lit(1), F.col("k"))).alias("left"), key(part(F.col("k") + 1, F.lit(DEPTH))).alias("right"))
    counts = words.where(F.col("f") >= least).select(key(F.col("phrase")).alias("left"), F.col("f").alias("l")).unionByName(phrases.where("words < 4").select(key(F.col("phrase")).alias("left"), F.col("f").alias("l")))
    counts = scratch.table(counts, "counts")
    cuts = scratch.table(join_hot(scratch.table(cuts, "cuts"), counts, "left", scratch), "cuts-left")
    cuts = join_hot(cuts.drop("left"), counts.toDF("right", "r"), "right", scratch)
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000BD) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: part(at, n))))
    inner = split.where("words > 2").select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (exact("most", 100) < exact("a", 80)))
    rows = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    ranked = _first(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
