"""Hashes of words and of runs of words, for whole Arrow columns of text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is taken alone, in parts cut between words.
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit permutation whose output bits all depend on all input bits."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK_BYTES of text each."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, min(end, len(texts))
        at = min(end, len(texts))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per word of the texts: its hash and the number of its row.  Words are runs of bytes other
    than space and 9 to 13; nulls have none.  lower: A to Z count as a to z."""
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    if lower:
        data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    value, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # as many words at a time as CHUNK_BYTES hold, so that tables of powers stay small
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, "right")))
        part, first, last = data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
        value[i:j] = (sums[last] - sums[first]) * _power(_INVERSE, len(part))[first]
        i = j
    return mix(value ^ mix((end - start).astype(np.uint64), 7)), np.searchsorted(offsets, start, "right") - 1


def run_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run of `width` words of one row: its hash and the number of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : n + i]
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(out[at], width), at
