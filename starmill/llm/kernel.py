"""Word and shingle hashes of Arrow text columns, vectorised with numpy.

Texts are handled as UTF-8 bytes in slices of about ``SLICE`` bytes, so memory does not
follow the size of an Arrow batch; one longer text makes a slice of its own. Null texts
are empty. Hashes depend on content only, so all tasks and retries agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over all others (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(1)
def _folded_values() -> np.ndarray:
    values = _byte_values().copy()
    values[65:91] = values[97:123]
    return values


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0..n, and its inverses modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            made = np.full(size, base, np.uint64)
            made[0] = 1
            _powers[name] = np.multiply.accumulate(made)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


@lru_cache(1)
def blanks() -> np.ndarray:
    """Of 256 byte values, those that separate words: blank and tab to carriage return."""
    made = np.zeros(256, bool)
    made[[9, 10, 11, 12, 13, 32]] = True
    return made


def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of a string or binary column."""
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(int(np.searchsorted(at, at[row] + size, "right")) - 1, row + 1)
        yield row, end, data[at[row]: at[end]], at[row: end + 1] - at[row]
        row = end


def prefix_hash(data: np.ndarray, fold: bool) -> np.ndarray:
    """Running polynomial hash; entry i covers the first i bytes."""
    up, _ = powers(len(data))
    made = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_folded_values() if fold else _byte_values())[data] * up[: len(data)], out=made[1:])
    return made


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray | None = None,
          fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its length in bytes, first word of each row and the end)."""
    if not len(data):
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~(blanks() if separators is None else separators)[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[first] = False
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    running = prefix_hash(data, fold)
    _, down = powers(len(data))
    length = ends - starts
    value = (running[ends] - running[starts]) * down[starts]
    value = mix(value + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return value, length, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (places that have k words after them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, made = int(_BASE), np.zeros(n, np.uint64)
    for j in range(k):
        factor = factor * 0xD1342543DE82EF95 + 0x63 & _MASK | 1
        made += hashes[j: j + n] * np.uint64(factor)
    return mix(made)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which beats numpy's hash table here)."""
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each row; fewer than k words are one shingle as a whole."""
    every, made = shingles(hashes, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            made.append(distinct(every[a: b - k + 1]))
        elif b > a:
            made.append(shingles(hashes[a: b], b - a) ^ np.uint64(b - a))
        else:
            made.append(np.zeros(0, np.uint64))
    return made


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """One list of 64-bit integers per row."""
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
