"""Token ids in ORC files, read by stripes and pruned by document id.

Documents are range-partitioned and sorted by id, so each file holds one range of ids in
ascending order. Ids are an array of integers, which ORC stores with integer run-length
encoding in stripes. Row indexes and Bloom filters on ``doc_id`` let a read for given ids
skip stripes and row groups. Columns of a file:

* ``doc_id``, ``shard`` (files count from 0 in id order), ``place`` (ids of the file before it),
* ``n_tokens`` (with the end id) and ``ids``.

Rows without an id come first; rows that repeat an id stand together, ordered by a hash of
their text, then by the text; equal rows may be cut into several ranges. Null and empty texts hold the end id alone.

Encoding: byte-level BPE never merges across a single blank between two other characters,
a letter beside a sign, or a single line feed, so a text is cut there, each distinct piece
is encoded once by the tokenizers library and kept in a bounded table of the worker, and ids
are looked up and put together by numpy. Texts with a blank beside other white space, or with ``<|``, as
special tokens have, are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starmill.llm.kernel import mix, powers, prefix_hash, text_slices

SCHEMA = "doc_id bigint, shard int, place bigint, n_tokens bigint, ids array<int>"
END = 0
#: Places for pieces that a worker remembers, the ids it holds for them, and the longest that it keeps, in bytes.
CACHE, HELD, KEPT = 1 << 20, 4_000_000, 64
_SLICE = 2 << 20
_WIDE = {0xE19A80, 0xE2819F, 0xE38080, 0xE280A8, 0xE280A9, 0xE280AF, *range(0xE28080, 0xE2808B)}

_workers: dict[str, tuple] = {}


def _library(path: str) -> tuple:
    """The tokenizer and what this worker process knows by it, made once per file."""
    if path not in _workers:
        from tokenizers import Tokenizer

        _workers[path] = (Tokenizer.from_file(path), _Known())
    return _workers[path]


def _spaced(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Blanks that may not be cut: at an end of their text or beside other white space."""
    row = np.searchsorted(offsets, blank, "right") - 1
    low, high = offsets[row], offsets[row + 1] - 1
    white = np.zeros(256, bool)
    white[[*range(9, 14), *range(28, 33)]] = True
    bad = (blank == low) | (blank == high)
    wide = np.array(sorted(_WIDE))

    def at(i: np.ndarray) -> np.ndarray:
        return data[np.clip(i, 0, len(data) - 1)].astype(np.int64)

    for a, b, c in ((blank - 3, blank - 2, blank - 1), (blank + 1, blank + 2, blank + 3)):
        near = c if c[0] < blank[0] else a
        bad |= white[at(near)]
        odd = np.flatnonzero(at(near) > 127)
        if len(odd):
            one, two, three = at(a[odd]), at(b[odd]), at(c[odd])
            pair = two * 256 + three if near is c else one * 256 + two
            bad[odd] |= np.isin(one * 65536 + two * 256 + three, wide) | np.isin(pair, (0xC285, 0xC2A0))
    return bad


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of bytes: 1 ASCII letters and digits, 2 ASCII signs but for the apostrophe, 3 line feed."""
    made = np.zeros(256, np.uint8)
    made[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]] = 1
    made[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 2
    made[10] = 3
    return made


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of what is encoded by itself, in order.

    Cuts stand before a lone blank, between a letter or digit and a sign, and around a lone
    line feed between those: places where the tokenizer's own pattern always cuts.
    """
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    kind = _kinds()[data]
    cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] >= 2)) + 1
    feed = np.flatnonzero(kind[1:-1] == 3) + 1
    near = (kind[feed - 1] > 0) & (kind[feed - 1] < 3)
    after = feed[near & (kind[feed + 1] == 1)]
    blank = np.flatnonzero(data == 32)
    every = np.concatenate((cut, feed[near], after + 1, blank))
    if len(every):
        row = np.searchsorted(offsets, every, "right") - 1
        whole = np.zeros(len(offsets), bool)
        if len(blank):
            whole[row[-len(blank):][_spaced(data, offsets, blank)]] = True
        # signs of a special token stay together, so its text goes whole
        whole[np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1] = True
        every = every[~whole[row]]
    begins = np.zeros(len(data), bool)
    begins[full] = True
    begins[every] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))


def _plain(piece: bytes) -> int:
    """0 for a blank and a word, 1 for a word: pieces whose ids can be told apart in a row of such; else 2."""
    text = piece.decode()
    if len(text.split()) != 1 or text[-1].isspace() or len(text) > KEPT:
        return 2
    return 0 if text[0] == " " else 2 if text[0].isspace() else 1


def _kinds_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """``_plain`` of each piece; those of ASCII letters and digits are told from running counts."""
    odd = np.concatenate(([0], np.cumsum(_kinds()[data] != 1)))
    lead = data[starts] == 32
    body = starts + lead
    simple = (odd[ends] == odd[body]) & (body < ends) & (ends - starts <= KEPT)
    made = np.where(simple, np.where(lead, 0, 1), 2).astype(np.int8)
    for k in np.flatnonzero(~simple).tolist():
        made[k] = _plain(pieces[k])
    return made


def _encoded(tokenizer, pieces: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all pieces, where each piece's begin, how many they are); many pieces go in one call."""
    feed = tokenizer.encode("\n", add_special_tokens=False).ids[0]
    opens = _opening(tokenizer)
    begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    made, total = [], 0
    for kind, glue, most in ((0, b"", 64), (1, b"\n", 64), (2, b"", 1)):
        chosen = np.flatnonzero(kinds == kind)
        groups = [chosen[k: k + most] for k in range(0, len(chosen), most)]
        texts = [glue.join([pieces[k] for k in group.tolist()]).decode() for group in groups]
        for group, e in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            if kind == 0:
                at = np.flatnonzero(opens[ids])
            elif kind == 1:
                breaks = np.flatnonzero(ids == feed)
                ids, at = np.delete(ids, breaks), np.concatenate(([0], breaks - np.arange(len(breaks))))
            else:
                at = np.zeros(1, np.int64)
            begin[group] = total + at
            size[group] = np.diff(np.append(at, len(ids)))
            made.append(ids)
            total += len(ids)
    return np.concatenate(made) if made else np.zeros(0, np.int32), begin, size


class _Known:
    """Ids of pieces seen before: a table with one place per hash, and the ids one after another.

    A piece is known by a 64-bit hash of its bytes and length, its first eight bytes and its
    last ones. A later piece may take another's place; that one is encoded again.
    """

    def __init__(self):
        self.name, self.head = np.zeros(CACHE, np.uint64), np.zeros(CACHE, np.uint64)
        self.begin, self.size = np.full(CACHE, -1, np.int32), np.zeros(CACHE, np.int16)
        self.ids, self.filled = np.zeros(HELD, np.int32), 0

    def place(self, name: np.ndarray) -> np.ndarray:
        return (name % np.uint64(CACHE)).astype(np.int64)

    def add(self, ids: np.ndarray) -> int:
        """Where the ids now begin."""
        at, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(self.filled - len(self.ids), np.int32)))
        self.ids[at: self.filled] = ids
        return at

    def limit(self) -> None:
        """Forget all pieces if their ids have grown beyond ``HELD``."""
        if self.filled > HELD:
            self.begin[:], self.ids, self.filled = -1, np.zeros(HELD, np.int32), 0


def _heads(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """First eight bytes of each piece (fewer: as many), mixed with its last four."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    every = np.lib.stride_tricks.sliding_window_view(padded, 8)
    masks = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], np.uint64)
    first = np.ascontiguousarray(every[starts]).view(np.uint64).ravel() & masks[np.minimum(length, 8)]
    last = np.ascontiguousarray(every[np.maximum(starts + length - 4, starts)]).view(np.uint64).ravel() & masks[np.minimum(length, 4)]
    return first ^ mix(last + length.astype(np.uint64))


@lru_cache(4)
def _opening(tokenizer) -> np.ndarray:
    """Of all ids: those whose token begins with a blank."""
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return np.array([(tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(size)])


def _encode(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, bounds of each row), each row with its end id."""
    rows = len(offsets) - 1
    if not len(data):
        return np.full(rows, END, np.int32), np.arange(rows + 1)
    tokenizer, known = _library(path)
    known.limit()
    starts, ends = _pieces(data, offsets)
    running, (_, down) = prefix_hash(data, False), powers(len(data))
    span = ends - starts
    name = mix((running[ends] - running[starts]) * down[starts] + span.astype(np.uint64))
    head, place = _heads(data, starts, span), known.place(name)
    begin, length = known.begin[place].astype(np.int64), known.size[place].astype(np.int64)
    missing = np.flatnonzero((known.name[place] != name) | (known.head[place] != head) | (begin < 0))
    _, first, which = np.unique(name[missing], return_index=True, return_inverse=True)
    new = missing[first]
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
    ids, at, size = _encoded(tokenizer, pieces, _kinds_of(data, starts[new], ends[new], pieces))
    at += known.add(ids)
    begin[missing], length[missing] = at[which], size[which]
    _, own = np.unique(place[new], return_index=True)  # one piece per place
    own = own[span[new][own] <= KEPT]
    slot = place[new][own]
    known.name[slot], known.head[slot] = name[new][own], head[new][own]
    known.begin[slot], known.size[slot] = at[own], size[own]
    table = known.ids
    row = np.searchsorted(offsets, starts, "right") - 1
    target = np.cumsum(length) - length + row
    total = int(length.sum()) + rows
    ids = np.full(total, END, np.int32)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    ids[np.repeat(target, length) + inside] = table[np.repeat(begin, length) + inside]
    counts = np.bincount(row, weights=length, minlength=rows).astype(np.int64) + 1
    return ids, np.concatenate(([0], np.cumsum(counts)))


def _encoder(path: str):
    import os

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text"), _SLICE):
                ids, bounds = _encode(path, data, offsets)
                counts = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, shard, np.int32)),
                     pa.array(place + bounds[:-1]), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "shard", "place", "n_tokens", "ids"])
                place += int(bounds[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id",
                 text_column: str = "text", stripe: int = 64 << 20) -> None:
    """Encode every text with the tokenizer file ``tokenizer`` and write ORC files to ``path``."""
    named = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    # rows of one id and text are interchangeable; a spread lets a range end between them
    order = ["doc_id", "tie", "spread"]
    ordered = named.withColumn("tie", F.xxhash64("text")).withColumn(
        "spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order)
    ordered.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(
        _encoder(tokenizer), SCHEMA).write.format("orc").option("compression", "zstd").option(
        "orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option(
        "orc.row.index.stride", "10000").option("orc.stripe.size", str(stripe)).save(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The stored rows; a condition on ``doc_id`` reaches the files' indexes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if where is None else rows.where(where)


def starts(tokens: DataFrame) -> DataFrame:
    """(shard, base): ids in all files before each one. One row per file."""
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "shard", "place", "n_tokens")), pa.array(sums, pa.int64())],
            names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from stored rows."""
    rows = tokens.mapInArrow(
        _checked, "doc_id bigint, shard int, place bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts(tokens), "shard").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
