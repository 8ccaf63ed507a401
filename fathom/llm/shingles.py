"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A word's 64-bit hash is a
polynomial over its bytes, read off one running sum for the whole buffer; a shingle's hash mixes
the hashes of five consecutive words.  Everything is numpy over the UTF-8 buffer: no Python code
runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathom.llm.common import kept_in_worker

WIDTH = 5
#: Bytes of text hashed at a time; bounds the numpy temporaries whatever the batch size.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: One odd multiplier for each word of a shingle.
_PLACE = [(0xD6E8FEB86659FD93 + 0xA0761D6478BD642E * k) % (1 << 64) | 1 for k in range(WIDTH)]

_powers: dict[str, np.ndarray] = {}
kept_in_worker(_powers.clear)


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``size`` of each."""
    if len(_powers.get("up", ())) < size:
        n = max(size, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, dtype=_U64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
        return h ^ (h >> _U64(31))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows bounded by ``offsets``, and each row's number of words."""
    base, end = int(offsets[0]), int(offsets[-1])
    data = _LOWER[raw[base:end]]
    size = end - base
    if not size:
        return np.zeros(0, dtype=_U64), np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(size + 1, dtype=bool)
    cut[offsets - base] = True
    before = np.empty(size, dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    after = np.empty(size, dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    up, down = _power_table(size + 1)
    with np.errstate(over="ignore"):
        running = np.zeros(size + 1, dtype=_U64)
        np.cumsum((data.astype(_U64) + _U64(1)) * up[:size], out=running[1:])
        h = (running[ends] - running[starts]) * down[starts]
        h = mix(h + (ends - starts).astype(_U64) * _U64(0x9FB21C651E98DF25))
    counts = np.searchsorted(starts, offsets[1:] - base) - np.searchsorted(starts, offsets[:-1] - base)
    return h, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's 5-word shingles with repeats, and each row's number of them.

    A row of one to four words has one shingle, its whole word sequence; a row without words has none.
    """
    n = len(words)
    per_row = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    if not n:
        return np.zeros(0, dtype=_U64), per_row
    first_word = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        acc = np.zeros(n, dtype=_U64)
        left = (first_word + counts).repeat(counts) - np.arange(n)  # words from here to the row's end
        for k in range(WIDTH):
            m = n - k
            part = words[k:] * _U64(_PLACE[k])
            acc[:m] += np.where(left[:m] > k, part, _U64(0))
        acc += np.minimum(left, WIDTH).astype(_U64) * _U64(0xC2B2AE3D27D4EB4F)
    keep = np.arange(n) - first_word.repeat(counts) < per_row.repeat(counts)
    return mix(acc[keep]), per_row


def row_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(row number, sorted distinct shingle hashes)`` of each row, whole texts, in order."""
    raw, offsets = utf8_parts(column)
    for first, last in slices(offsets):
        words, counts = word_hashes(raw, offsets[first : last + 1])
        hashes, per_row = shingle_hashes(words, counts)
        at = 0
        for row, n in zip(range(first, last), per_row.tolist(), strict=True):
            own = np.sort(hashes[at : at + n])
            at += n
            if n > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield row, own
