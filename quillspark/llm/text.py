"""Whole Arrow batches of text as byte arrays: tokens and their 64-bit hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 & ~0x7 | 0x5)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words of the pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that separate words of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
MARKS = np.ones(256, dtype=bool)
MARKS[48:58] = MARKS[97:123] = MARKS[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 20)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = Powers()


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `most` bytes; a longer text is a run of its own.  Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def tokens(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each token, and for each text the place of its first token (with one more entry at the end)."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[0] = after[-1] = False
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        before[firsts] = False
        after[firsts[firsts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; it depends on the range's bytes alone."""
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_of(text: str | bytes) -> int:
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, dtype=np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, their text's number, and how often each occurs."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return v[at], o[at], np.diff(np.append(at, len(v)))


class Lookup:
    """A fixed table from 64-bit keys to positions, looked up for whole arrays: open addressing with linear steps."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.slot = np.full(size, -1, dtype=np.int32)
        self.key = np.zeros(size, dtype=np.uint64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of those that want the same place, the last gets it
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)
        used = self.slot >= 0
        self.key[used] = keys[self.slot[used]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        at = self._home(keys)
        out = self.slot[at]
        again = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        at = at[again]
        while len(again):
            at = (at + 1) & (len(self.slot) - 1)
            got = self.slot[at]
            out[again] = got
            more = (got >= 0) & (self.key[at] != keys[again])
            again, at = again[more], at[more]
        return out


class Tally:
    """Counts of 64-bit keys, handed on in parts when there are more than `most` distinct ones."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most, self.size = most, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, counts = np.unique(keys, return_counts=True)
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.most:
            self.held = [self._folded()]
            self.size = len(self.held[0][0])
            if self.size > self.most:
                yield from self.rest()

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
        return keys[at], np.add.reduceat(counts, at) if len(at) else counts

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield self._folded()
        self.held, self.size = [], 0
