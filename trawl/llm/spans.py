"""Words of many texts at once, by array operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are taken apart together; a longer text comes alone.
GROUP = 1 << 21


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte value whether it lies in one of the ranges (both ends included)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: ASCII white space.
SPACE = byte_table((9, 13), (32, 32))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[raw]


def sizes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and where each value begins (one more entry than
    values); null is empty. Nothing is copied."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def groups(batches: Iterable[pa.RecordBatch], column: int, most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in ``column`` have at most ``most`` bytes together."""
    for batch in batches:
        _, begins = sizes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(begins, begins[at] + most, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()  # workers wait for other tasks


def spans(raw: np.ndarray, begins: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of bytes that are no ``separator`` begin and end; none of them
    reaches from one text into the next."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~separator[raw]
    cuts = begins[(begins > 0) & (begins < len(raw))]
    first, last = np.empty(len(raw), bool), np.empty(len(raw), bool)
    first[0] = last[-1] = True
    np.logical_not(inside[:-1], out=first[1:])
    np.logical_not(inside[1:], out=last[:-1])
    first[cuts] = last[cuts - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def owners(begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the text in which each word begins."""
    return np.searchsorted(begins, starts, side="right") - 1


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as a binary array, one copy of their bytes."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    marks = np.zeros(len(raw) + 1, np.int8)
    marks[starts] = 1
    marks[ends] -= 1
    data = raw[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


#: Bytes hashed together; words of over LONG bytes are hashed one by one.
_CHUNK, LONG = 1 << 20, 4096
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """A random value for each byte, and the powers of an odd number and of its inverse."""
    if not _powers:
        values = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) * 2 + 1
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(_CHUNK, base, np.uint64)
            powers[0] = 1
            _powers.append(np.cumprod(powers, dtype=np.uint64))
        _powers.append(values)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes; different ones stay different."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, from running sums."""
    up, down, values = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, side="right")))
        own = slice(at, stop)
        if ends[at] - low <= _CHUNK:
            part = raw[low : int(ends[stop - 1])]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[part] * up[: len(part)], dtype=np.uint64)])
            out[own] = (sums[ends[own] - low] - sums[starts[own] - low]) * down[starts[own] - low]
        at = stop
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return mixed(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` hashes in a row."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
    return mixed(out)
