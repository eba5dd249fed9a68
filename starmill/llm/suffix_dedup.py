"""Remove repeated strings of ``LENGTH`` bytes by content hashes of anchored windows.

Every string of 100 bytes (a window) belongs to one anchor: of the ``CORE``-byte grams in
it, the one with the smallest hash, the leftmost of equals. Equal windows have equal
anchors at equal offsets, so only windows of equal anchors need be compared, and the suffix
order is kept for anchors alone, about one place in 36.

Levels refine buckets of places, from a core that all windows of a place share:

1. an anchor's windows (at most 71) share its gram of 30 bytes;
2. up to 16 of them in a row share 85 bytes;
3. one window is its 100 bytes.

At each level places are range-sorted by (bucket identifier, identifier of the place's whole
context, document, start). Both are hashes made from the text; no bucket pointer of a later
offset is read. Within one context every place but the first is settled: all its windows start
earlier elsewhere. A bucket with one context needs no more. First places of buckets with
several contexts go on to the next level, which hashes longer strings of the bytes read once.
Sorting by both identifiers also splits a bucket that holds much of the
data over many tasks, and repeats of a context within a batch are settled before the
shuffle. Identifiers are two 64-bit hashes of content, so no task needs a global rank.

Order of documents: by id; rows without an id stand before all others as one id. Rows that
repeat an id are one document (an equal start is not earlier). Places belong to a text: they
carry its 64-bit digest beside the id, and both join them to their rows, so the places of rows
without an id are never put together. Equal rows have the same places once. Where several texts
of one id have a context at the same start, all of them go on with the first.
Texts under 100 bytes, empty and null texts lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.kernel import mix, powers, prefix_hash, text_slices
from starmill.llm.stored import stored

LENGTH, CORE, RANGE = 100, 30, 16
PLACES = "h bigint, f bigint, doc bigint, key bigint, at bigint"
MARKS = "settled boolean, doc bigint, key bigint, at bigint"
NO_ID = -(1 << 63)
_SETTLED = np.int64(-(1 << 63))


def _at(start: np.ndarray, count: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """A place in 64 bits: start, number of windows, anchor after start."""
    return start << 14 | count << 7 | ahead


def _of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, at >> 7 & 127, at & 127


def _span_hash(running: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (running[b] - running[a]) * down[a]


def _context(running: np.ndarray, down: np.ndarray, begin: np.ndarray, count: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Identifier of all bytes of a place's windows and of where its anchor is in them."""
    text = _span_hash(running, down, begin, begin + count - 1 + LENGTH)
    return mix(text + (ahead * 1000 + count).astype(np.uint64))


@lru_cache(1)
def _other_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span:]) if span < width else x


def _anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(h, f, row, start in the slice, count, anchor after start) of a slice's anchors."""
    n = len(data)
    if n < LENGTH:
        return None
    running, (_, down) = prefix_hash(data, False), powers(n)
    grams = mix((running[CORE:] - running[:-CORE]) * down[: n - CORE + 1])
    ranked = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least_of(ranked, LENGTH - CORE + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edges = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    np.add.at(edges, offsets[:-1][long], 1)
    np.add.at(edges, offsets[1:][long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(edges[: n - LENGTH + 1]) > 0)
    if not len(start):
        return None
    owner = anchor[start]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    begin, count = start[first], np.diff(np.append(first, len(start)))
    ahead = owner[first] - begin
    row = np.searchsorted(offsets, begin, "right") - 1
    return grams[owner[first]], _context(running, down, begin, count, ahead), row, begin, count, ahead


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text; those that repeat a context of their batch are settled."""
    for batch in batches:
        found = []
        ids, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
        for a, _, data, offsets in text_slices(batch.column("text")):
            if (got := _anchored(data, offsets)) is not None:
                h, f, row, begin, count, ahead = got
                found.append((h, f, ids[a + row], keys[a + row], _at(begin - offsets[row], count, ahead)))
        if found:
            h, f, doc, key, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((key, at, doc, f, h))
            h, f, doc, key, at = (x[order] for x in (h, f, doc, key, at))
            fresh = _class_starts(h, f)
            once = fresh.copy()
            once[1:] |= (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
            later = _later(fresh, doc, at)
            yield _rows(h[once], f[once], doc[once], key[once], at[once], later[once])


def _class_starts(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])))


def _later(fresh: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that come after the first of their class (rows sorted, the first one fresh)."""
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    return (doc != doc[first]) | (_of(at)[0] != _of(at[first])[0])


def _rows(h: np.ndarray, f: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
    """Rows of PLACES; settled ones have the sign bit in ``at`` and a bucket drawn by place, so they spread."""
    drawn = mix(mix(doc.astype(np.int64).view(np.uint64)) ^ key.view(np.uint64) ^ at.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h, f = np.where(settled, drawn, h), np.where(settled, drawn, f)
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(doc), pa.array(key),
         pa.array(np.where(settled, at ^ _SETTLED, at))], names=["h", "f", "doc", "key", "at"])


def _marks(settled: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(settled), pa.array(doc), pa.array(key), pa.array(at)], names=["settled", "doc", "key", "at"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of places sorted by bucket, context, document, start, text; two rows are held at most.

    Settled places, and unsettled ones: first places of buckets with several contexts, in every
    text of the document that has them. A partition's first and last bucket may go on in its
    neighbours, and a batch's last context in the next batch, so their first places or other
    texts count as unsettled; that only costs work.
    """
    held = None  # the current class's first place: h, f, doc, key, at, whether its bucket has others
    for batch in batches:
        h, f, doc, key, at = (batch.column(c).to_numpy() for c in ("h", "f", "doc", "key", "at"))
        done = at < 0
        if done.any():
            yield _marks(np.ones(int(done.sum()), bool), doc[done], key[done], at[done] ^ _SETTLED)
            h, f, doc, key, at = (x[~done] for x in (h, f, doc, key, at))
        if not len(h):
            continue
        if held is not None:
            h, f, doc, key, at = (np.concatenate(([x], y)) for x, y in zip(held[:5], (h, f, doc, key, at), strict=True))
        fresh = _class_starts(h, f)
        later = _later(fresh, doc, at)
        first = np.flatnonzero(fresh)
        same = h[first[1:]] == h[first[:-1]]
        several = np.append(same, False) | np.append(held[5] if held is not None else True, same)
        last = first[-1]
        level = ~fresh & ~later
        level[1:] &= key[1:] != key[:-1]
        wanted = several.copy()
        wanted[-1] = True
        level &= wanted[np.cumsum(fresh) - 1]
        give = np.concatenate((first[:-1][several[:-1]], np.flatnonzero(level)))
        yield _marks(np.concatenate((np.ones(int(later.sum()), bool), np.zeros(len(give), bool))),
                     *(np.concatenate((x[later], x[give])) for x in (doc, key, at)))
        held = (h[last], f[last], doc[last], key[last], at[last], bool(several[-1]))
    if held is not None:
        yield _marks(np.zeros(1, bool), *(np.array([x]) for x in held[2:5]))


def refine(places: DataFrame, purpose: str) -> DataFrame:
    """Marks (settled, doc, at) of places; a place that needs no more has no row."""
    ordered = places.repartitionByRange("h", "f").sortWithinPartitions("h", "f", "doc", "at", "key")
    return stored(ordered.mapInArrow(_refined, MARKS), purpose)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text")
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "text"),
             pa.array([pack.compress(x.as_buffer()) if x.is_valid and len(x.as_buffer()) else None for x in texts], pa.binary())],
            names=[*(c for c in batch.schema.names if c != "text"), "packed"])


def _unpacked(packed: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_buffer()) if x.is_valid else b"" for x in packed], pa.binary())


def _listed(lists: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(row from 0, value) of the lists of rows a to b; null lists are empty."""
    part = lists.slice(a, b - a)
    sizes = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
    return np.repeat(np.arange(b - a), sizes), part.flatten().to_numpy()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each place; rows that equal the one before them have none of their own."""
    held = None
    for batch in batches:
        texts = _unpacked(batch.column("packed"))
        doc, key = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        if len(doc):
            fresh[0], held = held != (doc[0], key[0]), (doc[-1], key[-1])
        for a, b, data, offsets in text_slices(texts):
            row, at = _listed(batch.column("ats"), a, b)
            good = fresh[a + row]
            row, at = row[good], at[good]
            start, count, ahead = _of(at)
            begin, size = offsets[row] + start, count - 1 + LENGTH
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            flat = data[np.repeat(begin, size) + inside]
            bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[a + row]), pa.array(key[a + row]), pa.array(start + ahead), pa.array(at),
                 pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])],
                names=["doc", "key", "anchor", "at", "bytes"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 2: windows by their distance to the anchor, ``RANGE`` in a row."""
    share = LENGTH - RANGE + 1
    for batch in batches:
        doc, key, at = (batch.column(c).to_numpy() for c in ("doc", "key", "at"))
        for a, b, data, offsets in text_slices(batch.column("bytes")):
            running, (_, down) = prefix_hash(data, False), powers(len(data))
            start, count, ahead = _of(at[a:b])
            for k in range(-(-(LENGTH - CORE + 1) // RANGE)):
                near = ahead - RANGE * k
                low, high = np.maximum(near - RANGE + 1, 0), np.minimum(near, count - 1)
                has = np.flatnonzero(low <= high)
                if not len(has):
                    continue
                base, low, size = offsets[:-1][has], low[has], high[has] - low[has] + 1
                core = base + near[has]
                h = mix(_span_hash(running, down, core, core + share) + np.uint64(k + 1))
                f = _context(running, down, base + low, size, ahead[has] - low)
                yield _rows(h, f, doc[a:b][has], key[a:b][has], _at(start[has] + low, size, ahead[has] - low), np.zeros(len(has), bool))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 3: every window of the ranges that level 2 left."""
    for batch in batches:
        doc, key, at = (batch.column(c).to_numpy() for c in ("doc", "key", "at"))
        for a, b, data, offsets in text_slices(batch.column("bytes")):
            running, (up, down) = prefix_hash(data, False), powers(len(data))
            other = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_other_values()[data] * up[: len(data)], out=other[1:])
            row, left = _listed(batch.column("ats"), a, b)
            start, count, _ = _of(left)
            place = np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(row, count)
            origin, _, ahead = _of(at[a:b][row])
            begin = offsets[row] + place - origin
            h = mix(_span_hash(running, down, begin, begin + LENGTH))
            f = mix(_span_hash(other, down, begin, begin + LENGTH))
            one, ahead = np.ones(len(row), np.int64), origin + ahead - place
            yield _rows(h, f, doc[a:b][row], key[a:b][row], _at(place, one, ahead), np.zeros(len(row), bool))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _unpacked(batch.column("packed"))
        for a, b, data, offsets in text_slices(texts):
            gone = _covered(data, offsets, batch.column("ats"), a, b)
            rises = gone.copy()
            rises[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            rises[heads] = gone[heads]
            removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, rises))
            hashes = [hashlib.sha256(data[i:j][~gone[i:j]].tobytes()).hexdigest()
                      for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets)),
                 pa.array(removed[offsets[1:]] - removed[offsets[:-1]]),
                 pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(hashes)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _covered(data: np.ndarray, offsets: np.ndarray, lists: pa.Array, a: int, b: int) -> np.ndarray:
    row, at = _listed(lists, a, b)
    start, count, _ = _of(at)
    edges = np.zeros(len(data) + 1, np.int64)
    np.add.at(edges, offsets[row] + start, 1)
    np.add.at(edges, offsets[row] + start + count - 1 + LENGTH, -1)
    return np.cumsum(edges[:-1]) > 0


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _unpacked(batch.column("packed"))
        for a, b, data, offsets in text_slices(texts):
            gone = _covered(data, offsets, batch.column("ats"), a, b)
            kept = [data[i:j][~gone[i:j]].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(kept, pa.binary())], names=["doc_id", "kept"])


def _by_text(marks: DataFrame, *more: Column) -> DataFrame:
    return marks.groupBy("doc", "key", *more).agg(F.collect_set("at").alias("ats"))


def _spans(docs: DataFrame, text_column: str) -> DataFrame:
    """Rows doc_id, doc, key, packed text and ``ats``, the settled places of the text."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    keyed = named.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "key": F.xxhash64("text")})
    packed = keyed.mapInArrow(_packed, "doc_id bigint, doc bigint, key bigint, packed binary")
    one = refine(keyed.select("doc", "key", "text").mapInArrow(_places, PLACES), "suffix-1")
    contexts = stored(packed.join(_by_text(one.where("not settled")), ["doc", "key"]).mapInArrow(
        _contexts, "doc bigint, key bigint, anchor bigint, at bigint, bytes binary"), "suffix-contexts")
    two = refine(contexts.mapInArrow(_ranges, PLACES), "suffix-2")
    left = _by_text(two.where("not settled"), (F.shiftright("at", 14) + F.col("at").bitwiseAND(127)).alias("anchor"))
    three = refine(contexts.join(left, ["doc", "key", "anchor"]).mapInArrow(_windows, PLACES), "suffix-3")
    settled = one.where("settled").union(two.where("settled")).union(three.where("settled"))
    return packed.join(_by_text(settled), ["doc", "key"], "left")


def _map(docs: DataFrame, text_column: str, function: Callable, schema: str) -> DataFrame:
    return _spans(docs, text_column).mapInArrow(function, schema)


def remove_repeats(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id and ``kept``: the remaining bytes of each text (which may cut a character)."""
    return _map(docs, text_column, _kept_texts, "doc_id bigint, kept binary")


def digest(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of ``docs``."""
    return _map(docs, text_column, _digest,
                "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
