"""numpy helpers that run inside tasks: row slices of bounded size, a hash index and ragged gathers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 19


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts take ``most`` bytes together, or one row."""
    ends = text_bytes(batch[column])[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a column of texts without NULL; offsets count from 0."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of every i, one after another."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[ends[i]:ends[i + 1]] for every i, 0 where that is empty."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        out[some] = np.add.reduceat(values, ends[:-1][some], axis=0, dtype=np.float64)
    return out


class Grown:
    """An array that rows are added to; its room doubles when it is full."""

    def __init__(self, like: np.ndarray):
        self.room, self.n = np.empty((1024, *like.shape[1:]), like.dtype), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.room):
            room = np.empty((2 * (self.n + len(rows)), *self.room.shape[1:]), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:self.n + len(rows)] = rows
        self.n += len(rows)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class HashIndex:
    """Places of distinct 64-bit keys: open addressing with linear probes, looked up for whole arrays."""

    FREE = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self.FREE)
        self.places = np.zeros(1 << self.bits, np.int32)
        left, step = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            at = self._slot(keys[left], step)
            free = self.keys[at] == self.FREE
            self.places[at[free]] = left[free]  # of several keys for one slot the last stays
            won = free.copy()
            won[free] = self.places[at[free]] == left[free]
            self.keys[at[won]] = keys[left[won]]
            left, step = left[~won], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            first = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((first + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those not held."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for step in range(self.steps):
            at = self._slot(keys, step)
            held = self.keys[at]
            hit = (held == keys) & (keys != self.FREE)
            out[left[hit]] = self.places[at[hit]]
            go = ~hit & (held != self.FREE)
            if not go.any():
                break
            left, keys = left[go], keys[go]
        return out


def mix(a: np.ndarray, b: int) -> np.ndarray:
    """A hash of the hashes ``a`` that differs with ``b``."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(b)
    return x ^ (x >> np.uint64(32))


def ngrams(values: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbours within a text and their offsets; shorter texts have none."""
    counts = np.maximum(0, np.diff(ends) - n + 1)
    at = np.repeat(ends[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = values[at]
    for i in range(1, n):
        out = mix(out, i) + values[at + i]
    return out, np.concatenate([[0], np.cumsum(counts)])
