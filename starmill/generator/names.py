"""Part names: the first five words of a colour list that is shuffled again per part.

The shuffle starts from where the part before left it, so a name depends on all earlier
rows. Shuffles compose, and composition is associative, so the lists are a prefix scan:
chunks of ``CHUNK`` rows are each reduced to one permutation, blocks of ``FAN`` chunks to
one, and so on until a single block is left; going back down, each block's start gives the
starts of its members, and a chunk's start the names of its rows. Every level is a Spark
job over bounded groups; nothing is collected, and a trillion rows take four levels. Within
a task all rows of a chunk are shuffled at once as a matrix. The result does not depend on
the chunk size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.generator import words
from starmill.generator.streams import MODULUS, MULTIPLIER

COLOURS = len(words.COLOURS)
WORDS_PER_NAME = 5
CHUNK, FAN = 4096, 4096
#: Rows of a chunk that are followed one after another; all such runs go side by side.
_RUN = 64
_CHUNKS_PER_TASK = 1024

_IDENTITY = np.arange(COLOURS, dtype=np.uint8)
_POWERS = np.array([pow(MULTIPLIER, k, MODULUS) for k in range(1, COLOURS + 1)])
_STEP = pow(MULTIPLIER, COLOURS, MODULUS)


@lru_cache(4)
def _jumps(rows: int) -> np.ndarray:
    """Factors from the state of a row to those of the rows after it."""
    made = np.ones(rows, np.int64)
    done = 1
    while done < rows:
        width = min(done, rows - done)
        made[done: done + width] = made[:width] * pow(_STEP, done, MODULUS) % MODULUS
        done += width
    return made


def _shuffles(first: int, rows: int) -> np.ndarray:
    """One permutation per row, as a column: what the row's 92 swaps make of 0..91."""
    start = words.STREAMS["part_name"][0] * pow(_STEP, first - 1, MODULUS) % MODULUS
    state = start * _jumps(rows) % MODULUS
    order = np.repeat(_IDENTITY[:, None], rows, 1)
    flat, every = order.reshape(-1), np.arange(rows)
    for place in range(COLOURS):
        draw = state * _POWERS[place] % MODULUS
        source = (place + (draw / float(MODULUS) * (COLOURS - place)).astype(np.int64)) * rows + every
        held = flat[source]
        flat[source] = order[place]
        order[place] = held
    return order


def _after(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Per column, list ``one`` rearranged by permutation ``two``."""
    columns = one.shape[1]
    return one.reshape(-1)[two.astype(np.int64) * columns + np.arange(columns)]


def _composed(moves: np.ndarray) -> np.ndarray:
    """What all columns make together, in their order: neighbours are joined until one is left."""
    while moves.shape[1] > 1:
        even = moves.shape[1] // 2 * 2
        joined = _after(np.ascontiguousarray(moves[:, 0:even:2]), np.ascontiguousarray(moves[:, 1:even:2]))
        moves = joined if even == moves.shape[1] else np.concatenate((joined, moves[:, even:]), 1)
    return moves[:, 0]


def _scanned(moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The list after each column of ``moves``, beginning with ``start``: a scan in runs side by side."""
    rows = moves.shape[1]
    runs = -(-rows // _RUN)
    padded = np.repeat(_IDENTITY[:, None], runs * _RUN, 1)
    padded[:, :rows] = moves
    # inside[k] holds row k of every run
    inside = np.ascontiguousarray(padded.reshape(COLOURS, runs, _RUN).transpose(2, 0, 1))
    for k in range(1, _RUN):
        inside[k] = _after(inside[k - 1], inside[k])
    begins, begin = np.empty((COLOURS, runs), np.uint8), start
    for run in range(runs):
        begins[:, run] = begin
        begin = begin[inside[-1, :, run]]
    for k in range(_RUN):
        inside[k] = _after(begins, inside[k])
    return inside.transpose(1, 2, 0).reshape(COLOURS, -1)[:, :rows]


def _lists(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COLOURS).T


def _binary(lists: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(lists.T)], pa.binary())


def _reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to the permutation that all their rows make together."""
    for batch in batches:
        moved = [_composed(_shuffles(first, last - first + 1)).tobytes()
                 for first, last in zip(batch["first"].to_pylist(), batch["last"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["chunk"], pa.array(moved, pa.binary())], names=["at", "moved"])


def _reduce_block(group: pa.Table) -> pa.Table:
    ordered = group.sort_by("at")
    moved = _composed(_lists(ordered["moved"].combine_chunks()))
    return pa.table({"at": [ordered["at"][0].as_py() // FAN], "moved": pa.array([moved.tobytes()], pa.binary())})


def _block_starts(group: pa.Table) -> pa.Table:
    """Where each member of a block starts, from where the block does."""
    ordered = group.sort_by("at")
    moves = _lists(ordered["moved"].combine_chunks())
    start = np.frombuffer(ordered["start"][0].as_py(), np.uint8)
    after = _scanned(moves, start)
    return pa.table({"at": ordered["at"], "start": _binary(np.concatenate((start[:, None], after[:, :-1]), 1))})


def _starts(moves: DataFrame, count: int) -> DataFrame:
    """(at, start): the list before each of the dense numbers 0..count-1 of ``moves``."""
    block = F.floor(F.col("at") / FAN).alias("block")
    if count > FAN:
        blocks = moves.groupBy(block).applyInArrow(_reduce_block, "at bigint, moved binary")
        above = _starts(blocks, -(-count // FAN)).withColumnRenamed("at", "block")
        led = moves.withColumn("block", block).join(above, "block")
    else:
        led = moves.withColumn("block", block).withColumn("start", F.lit(bytearray(range(COLOURS))))
    return led.groupBy("block").applyInArrow(_block_starts, "at bigint, start binary")


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    colours = pa.array(words.COLOURS)
    for batch in batches:
        for chunk in batch.to_pylist():
            rows = chunk["last"] - chunk["first"] + 1
            lists = _scanned(_shuffles(chunk["first"], rows), np.frombuffer(chunk["start"], np.uint8))
            names = pc.binary_join_element_wise(
                *(colours.take(pa.array(lists[k])) for k in range(WORDS_PER_NAME)), " ")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(chunk["first"], chunk["last"] + 1)), names], names=["p_partkey", "p_name"])


def part_names(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Names for the dense row numbers 1..n in column ``row``.

    The names of rows 1..n need all of these rows, so gaps are an error.
    """
    chunks = (
        rows.groupBy(F.floor((F.col("row") - 1) / size).alias("chunk"))
        .agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("row").alias("n"))
        .withColumn("first", F.when(
            (F.col("n") == F.col("last") - F.col("first") + 1)
            & (F.col("first") == F.col("chunk") * size + 1), F.col("first"),
        ).otherwise(F.raise_error(F.lit("row numbers are not dense"))))
        .select("chunk", "first", "last")
    )
    count = -(-(rows.agg(F.max("row")).first()[0] or 0) // size)
    # a chunk is one small row but much work, so Spark's sizes must not put many in one task
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, count // _CHUNKS_PER_TASK)
    moves = chunks.repartition(tasks, "chunk").mapInArrow(_reduce_rows, "at bigint, moved binary")
    led = chunks.join(_starts(moves, count), F.col("chunk") == F.col("at")).select("chunk", "first", "last", "start")
    return led.repartition(tasks, "chunk").mapInArrow(_name, "p_partkey bigint, p_name string")
