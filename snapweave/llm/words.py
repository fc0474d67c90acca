"""Words of whole Arrow text columns as 64-bit hashes, by numpy over the bytes of UTF-8."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer document is read in pieces of this size.
PIECE = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
_ODD = np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _ODD
_LETTER[65:91] = _LETTER[97:123]
_PLACE = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + _ODD
_SPOT = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + _ODD


def _give_back() -> None:
    """Memory that freed arrays still hold goes back to the system: idle Python workers live beside a JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """run, for mapInArrow, with memory given back after each batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            _give_back()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        _give_back()

    return wrapped


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run data[start:end], A-Z read as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = _LETTER[data[at + np.repeat(starts, sizes)]]
    value *= _PLACE[at & 4095] + (at >> 12).astype(np.uint64) * np.uint64(2)
    return mix(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def runs(data: np.ndarray, gap: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs outside `gap` that don't go past a place of `begins`."""
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    inside = np.append(~gap, False)
    before = np.append(False, ~gap)
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends


def pieces(data: np.ndarray, offsets: np.ndarray, at: np.ndarray = _GAP) -> Iterator[tuple[int, int, int, int]]:
    """(row, row after the last, from byte, to byte): whole rows of about PIECE bytes; a longer row alone, cut before a byte of `at` (white space)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        low, high = int(offsets[row]), int(offsets[stop])
        while high - low > PIECE:
            cut = low + PIECE
            while cut < high and not at[data[cut]]:
                cut += 1
            if cut == high:
                break
            yield row, stop, low, cut
            low = cut
        yield row, stop, low, high
        row = stop


def column_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, row after the last, hashes of their words, where each row's words begin), words being [^\\x20\\x09-\\x0D]+."""
    data, offsets = text_bytes(column)
    held, held_row = [], 0
    for row, stop, low, high in pieces(data, offsets):
        part = data[low:high]
        begins = np.clip(offsets[row : stop + 1] - low, 0, high - low)
        starts, ends = runs(part, _GAP[part], begins[:-1])
        found = hash_runs(part, starts, ends)
        if stop == row + 1:
            held.append(found)
            held_row = row
            if high == offsets[stop]:
                found = np.concatenate(held)
                yield held_row, stop, found, np.array([0, len(found)])
                held = []
        else:
            yield row, stop, found, np.searchsorted(starts, begins)


def shingles(hashes: np.ndarray, begins: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of `size` words in a row; of fewer words the whole sequence; none without words."""
    out = []
    whole = np.zeros(0, np.uint64)
    if len(hashes) >= size:
        whole = hashes[: len(hashes) - size + 1] * _SPOT[0]
        for k in range(1, size):
            whole = whole + hashes[k : len(hashes) - size + 1 + k] * _SPOT[k]
        whole = mix(whole)
    for low, high in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if high - low >= size:
            found = np.sort(whole[low : high - size + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        elif high > low:
            part = (hashes[low:high] * _SPOT[: high - low]).sum(dtype=np.uint64)
            out.append(mix(np.array([part], np.uint64), high - low))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
