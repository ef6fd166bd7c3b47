"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes outside 09-0D and 20. Its hash is a polynomial over random values of its bytes, modulo 2^64,
taken as a difference of running sums, then mixed. Windows of words are hashed the same way over the words' hashes.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that make a slice of a batch (a longer text is taken alone), most rows of one, and bytes that are hashed at once.
CHUNK, ROWS, BLOCK = 1 << 19, 512, 1 << 17
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words of letters: all ASCII characters but letters.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        grown = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            grown.append(np.multiply.accumulate(x))
        _powers = grown[0], grown[1]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums_of_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run [start, end) of values a hash of its values in their order."""
    power, inverse = _powers_to(len(values) + 1)
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=run[1:])
    return mixed((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """of: the text of each word; hash: its hash; start and end: its place in buffer; first: the first word of each text, and the number of words."""

    def __init__(self, texts: list[bytes], lower: bool = False, separators: np.ndarray = _SPACE):
        self.buffer = b" ".join(texts)
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        np.logical_not(separators[raw], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        value = _BYTE[_LOWER] if lower else _BYTE
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):  # whole words, about a block of bytes at a time: eight bytes are held for each
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + BLOCK, "right")))
            self.hash[i:j] = sums_of_runs(value[raw[a : self.end[j - 1]]], self.start[i:j] - a, self.end[i:j] - a)
            i = j
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, at)
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of n words that lies in one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts = np.flatnonzero(self.of[: len(self.of) - n + 1] == self.of[n - 1 :])
        return starts, sums_of_runs(self.hash, starts, starts + n)


#: What other operators keep in a worker process between tasks: functions that let it go.
KEPT: list[Callable[[], None]] = []


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, chunk: int = CHUNK, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about `chunk` bytes of text each, and their texts; null is empty."""
    for whole in batches:
        for row in range(0, whole.num_rows, rows):
            batch = whole.slice(row, rows)
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            at, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= chunk or k == len(texts) - 1:
                    yield batch.slice(at, k + 1 - at), texts[at : k + 1]
                    at, size = k + 1, 0


def give_back() -> None:
    """What this process has freed, but its allocators keep, goes back to the system: an executor's workers share its memory limit."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """slices(); a worker that comes from another operator lets go of what that kept."""
    for forget in KEPT:
        forget()
    give_back()
    yield from slices(batches, text)
