"""Which rows of a text column contain any of very many short texts.

The texts' lengths are few, so each row looks at its own windows of those lengths. A window
is hashed from running sums (a polynomial modulo 2^64), without cutting it out, and looked
up in a Bloom filter of ``BITS`` bits a text. Only windows that pass become rows and meet
the texts in an equality join, so the answer is exact; about one window in ten million
passes without being one. A filter holds at most ``SLICE`` texts, whatever their number:
more are split by a hash into several filters, and each is a pass over the rows.

Lengths and windows count bytes of UTF-8, where a text can only start at the start of a
character, so they find what characters would. Null rows and texts hold nothing; an empty
text is in every row that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, PROBES, SLICE = 34, 12, 8_000_000
_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit words (xor-shift and multiply), so that any of their bits may be used."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of windows of ``data`` that depend on their bytes alone."""

    def __init__(self, data: np.ndarray):
        up, down = np.full(len(data) + 1, _BASE), np.full(len(data) + 1, _INVERSE)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        self._down = np.multiply.accumulate(down)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])

    def windows(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        ends = starts + length
        own = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return _spread(own + np.asarray(length).astype(np.uint64))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about a megabyte."""
    column = column.cast(pa.string()).fill_null("")
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(int(np.searchsorted(at, at[row] + _BYTES, "right")) - 1, row + 1)
        yield row, end, data[at[row]: at[end]], at[row: end + 1] - at[row]
        row = end


def _places(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes + step * np.uint64(probe)) % np.uint64(bits)


def _hasher(slices: int, bits: int):
    """Words of the Bloom filters: ``part``, ``at`` (word) and the bits that one text sets in it."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column("id")):
                own = Rolling(data).windows(offsets[:-1], np.diff(offsets))
                part = _spread(own ^ _BASE) % np.uint64(slices)
                place = np.concatenate([_places(own, bits, k) for k in range(PROBES)])
                word = np.uint64(1) << (place % np.uint64(64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(part, PROBES).astype(np.int32)), pa.array((place // np.uint64(64)).astype(np.int64)),
                     pa.array(word.view(np.int64))], names=["part", "at", "word"])

    return hashed


def _finder(words: np.ndarray, bits: int, part: int, slices: int, lengths: list[int]):
    """(line, gram): the distinct windows of each row that the filter lets pass."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in _texts(batch.column("value")):
                rolling, raw, found = Rolling(data), data.tobytes(), set()
                row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                for n in lengths:
                    starts = np.flatnonzero(np.arange(len(data)) + n <= offsets[1:][row_of])
                    own = rolling.windows(starts, n)
                    for probe in range(PROBES):
                        place = _places(own, bits, probe)
                        stays = (words[(place // np.uint64(64)).astype(np.int64)] >> (place % np.uint64(64))) & np.uint64(1) != 0
                        starts, own = starts[stays], own[stays]
                    if slices > 1:
                        starts = starts[_spread(own ^ _BASE) % np.uint64(slices) == part]
                    found.update((int(row_of[s]), raw[s: s + n]) for s in starts.tolist())
                if found:
                    rows, grams = zip(*sorted(found), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("line").take(pa.array([first + r for r in rows])), pa.array(grams, pa.binary())],
                        names=["line", "gram"])

    return find


def candidates(lines: DataFrame, ids: DataFrame, most: int = SLICE) -> DataFrame:
    """(line, gram) of ``lines`` (line, value): windows that may be one of the distinct texts ``ids`` (id)."""
    known = ids.agg(F.count("id").alias("n"), F.collect_set(F.octet_length("id")).alias("lengths")).first()
    lengths = sorted(n for n in known["lengths"] if n)
    slices = max(1, -(-known["n"] // most))
    # a filter's bits follow the number of texts, at most ``most`` * BITS of them
    bits = 64 * max(1, -(-known["n"] * BITS // (64 * slices)))
    words = ids.where("id <> ''").select("id").mapInArrow(_hasher(slices, bits), "part int, at bigint, word bigint").groupBy(
        "part", "at").agg(F.bit_or("word").alias("word"))
    kind = dict(lines.dtypes)["line"]
    found = lines.sparkSession.createDataFrame([], f"line {kind}, gram binary")
    for part in range(slices if lengths else 0):
        own = words.where(F.col("part") == part).select("at", "word").toArrow()
        filled = np.zeros(bits // 64, np.uint64)
        filled[own.column("at").to_numpy()] = own.column("word").to_numpy().view(np.uint64)
        found = found.union(lines.select("line", "value").mapInArrow(
            _finder(filled, bits, part, slices, lengths), f"line {kind}, gram binary"))
    return found


def containing(lines: DataFrame, ids: DataFrame, most: int = SLICE) -> DataFrame:
    """The distinct ``line`` of rows of ``lines`` (line, value) that contain one of ``ids`` (id)."""
    grams = candidates(lines, ids, most).join(ids.select(F.encode("id", "UTF-8").alias("gram")), "gram", "left_semi")
    anywhere = bool(ids.where("id = ''").limit(1).count())
    every = lines.where(F.col("value").isNotNull() & F.lit(anywhere)).select("line")
    return grams.select("line").union(every).distinct()
