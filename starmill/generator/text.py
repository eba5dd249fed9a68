"""Comment text: substrings of one pool of random sentences.

The pool is a chain of sentences drawn from a single stream, each using as many
draws as its words need, so where a sentence starts depends on all before it. It is
still made in parallel. Cut the draws into blocks: for every place a sentence could
enter a block, one pass computes where the chain leaves the block and how many
characters it adds. Joining these small tables end to end gives each block's true
entry, and a second pass writes the text.

The finished pool has a fixed size whatever the scale factor. It is also written as one file
of fixed lines, which Spark ships to each executor once; workers read comments out of it in
Arrow batches. So comments need no join and no row moves.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.generator import words
from starmill.generator.streams import MODULUS, MULTIPLIER, draw, draw_at, uniform

BLOCK_DRAWS = 50_000
# Blocks that a task makes, one after the other.
TASK_BLOCKS = 5
# No sentence uses more draws: form, five phrases of at most five draws, terminator.
SENTENCE_DRAWS = 32
PIECE = 1024
OVERLAP = 256
# Characters of a line of the pool's file, and the largest share of a comment batch.
LINE = 1 << 20


@dataclass(frozen=True)
class Pool:
    """Pieces of the pool, ``piece`` number and ``text`` with the start of the next piece, and
    the name of the file shipped to executors, which holds lines of ``LINE`` characters."""

    pieces: DataFrame
    characters: int
    file: str


def _draws(first: int, count: int) -> np.ndarray:
    """Draws ``first`` (zero-based) onward of the text stream."""
    seed = words.STREAMS["text_pool"][0]
    out = np.empty(count, dtype=np.int64)
    out[0] = seed * pow(MULTIPLIER, first + 1, MODULUS) % MODULUS
    filled = 1
    while filled < count:  # double the known prefix by one big jump
        width = min(filled, count - filled)
        out[filled:filled + width] = out[:width] * pow(MULTIPLIER, filled, MODULUS) % MODULUS
        filled += width
    return out


def _choose(draws: np.ndarray, weighted: list[tuple[str, int]]) -> np.ndarray:
    ends = np.cumsum([w for _, w in weighted])
    value = 1 + (draws / float(MODULUS) * float(ends[-1])).astype(np.int64)
    return np.searchsorted(ends, value)


class _Block:
    """What a phrase or sentence starting at any draw of a block would be."""

    _PHRASES = {"N": words.NOUN_PHRASES, "V": words.VERB_PHRASES}
    _WORDS = {"N": words.NOUNS, "V": words.VERBS, "J": words.ADJECTIVES, "D": words.ADVERBS,
              "X": words.AUXILIARIES}

    def __init__(self, first: int, count: int):
        # Sentences that start in the block may end beyond it.
        self.count = count
        self.size = count + 2 * SENTENCE_DRAWS
        draws = _draws(first, self.size)
        self.word = {k: _choose(draws, v) for k, v in self._WORDS.items()}
        self.prep = _choose(draws, words.PREPOSITIONS)
        self.stop = _choose(draws, words.TERMINATORS)
        self.form = _choose(draws, words.SENTENCES)
        self.phrase = {k: _choose(draws, v) for k, v in self._PHRASES.items()}

    @staticmethod
    def _lengths(weighted: list[tuple[str, int]]) -> np.ndarray:
        return np.array([len(w) for w, _ in weighted])

    def _at(self, values: np.ndarray, index: np.ndarray) -> np.ndarray:
        return values[np.minimum(index, self.size - 1)]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """For each draw: where a sentence starting there ends, and its characters with
        the space that follows it."""
        here = np.arange(self.size)
        used, chars = {}, {}
        for kind, forms in self._PHRASES.items():
            used[kind] = np.zeros(self.size, np.int64)
            chars[kind] = np.zeros(self.size, np.int64)
            for number, (form, _) in enumerate(forms):
                total = np.zeros(self.size, np.int64)
                for step, token in enumerate(form.split(), 1):
                    length = self._lengths(self._WORDS[token[0]])[self.word[token[0]]]
                    total += self._at(length, here + step) + len(token)  # word, mark, space
                chosen = self.phrase[kind] == number
                used[kind][chosen] = 1 + len(form.split())
                chars[kind][chosen] = total[chosen]
        prep = self._lengths(words.PREPOSITIONS)[self.prep] + len(" the ")
        stop = self._lengths(words.TERMINATORS)[self.stop]
        end, length = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for number, (form, _) in enumerate(words.SENTENCES):
            at, total = here + 1, np.zeros(self.size, np.int64)
            for token in form.split():
                if token == "T":
                    total += self._at(stop, at)  # takes the place of the last space
                    at = at + 1
                    continue
                if token == "P":
                    total += self._at(prep, at)
                    at = at + 1
                    token = "N"
                total += self._at(chars[token], at)
                at = at + self._at(used[token], at)
            chosen = self.form == number
            end[chosen], length[chosen] = at[chosen], total[chosen]
        return end, length

    def text(self, entry: int) -> str:
        """Sentences from ``entry`` to the end of the block, a space after each."""
        said = {k: [self._WORDS[k][i][0] for i in index.tolist()] for k, index in self.word.items()}
        prep = [words.PREPOSITIONS[i][0] + " the" for i in self.prep.tolist()]
        stop = [words.TERMINATORS[i][0] for i in self.stop.tolist()]
        form = self.form.tolist()
        phrase = {k: index.tolist() for k, index in self.phrase.items()}
        sentence_forms = [f.split() for f, _ in words.SENTENCES]
        phrase_forms = {k: [[(t[0], t[1:]) for t in f.split()] for f, _ in forms]
                        for k, forms in self._PHRASES.items()}
        sentences, at = [], entry
        while at < self.count:
            out: list[str] = []
            tokens = sentence_forms[form[at]]
            at += 1
            for token in tokens:
                if token == "T":
                    out[-1] += stop[at]
                    at += 1
                    continue
                if token == "P":
                    out.append(prep[at])
                    at += 1
                    token = "N"
                for kind, mark in phrase_forms[token][phrase[token][at]]:
                    at += 1
                    out.append(said[kind][at] + mark)
                at += 1
            sentences.append(" ".join(out))
        return " ".join(sentences) + " " if sentences else ""


def _chain(block: int) -> tuple[list[int], list[int]]:
    """Per possible entry of a block: entry into the next block, and characters added."""
    whole = _Block(block * BLOCK_DRAWS, BLOCK_DRAWS)
    end, length = (a[:BLOCK_DRAWS].tolist() for a in whole.spans())
    exits, chars = [0] * BLOCK_DRAWS, [0] * BLOCK_DRAWS
    for start in range(BLOCK_DRAWS - 1, -1, -1):
        after = end[start]
        if after >= BLOCK_DRAWS:
            exits[start], chars[start] = after - BLOCK_DRAWS, length[start]
        else:
            exits[start], chars[start] = exits[after], chars[after] + length[start]
    return exits[:SENTENCE_DRAWS], chars[:SENTENCE_DRAWS]


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(int(b), *_chain(int(b))) for b in batch["block"]]
        yield pd.DataFrame(found, columns=["block", "exits", "chars"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Text of each block, cut at the piece bounds.

    A piece also takes the first OVERLAP characters of the next one.
    """
    for batch in batches:
        for row in batch.itertuples():
            block = _Block(int(row.block) * BLOCK_DRAWS, BLOCK_DRAWS)
            first = int(row.first)
            text = block.text(int(row.entry))[:int(row.stop) - first]
            stop = first + len(text)
            numbers = range(max(0, (first - OVERLAP) // PIECE), (stop - 1) // PIECE + 1)
            starts = [max(first, n * PIECE) for n in numbers]
            yield pd.DataFrame({
                "piece": numbers,
                "at": starts,
                "part": [text[at - first:n * PIECE + PIECE + OVERLAP - first]
                         for n, at in zip(numbers, starts)],
            })


def build_pool(spark: SparkSession, path: str, characters: int = words.POOL_CHARACTERS) -> Pool:
    """Write the pool to ``path`` as pieces and return it.

    A shorter pool moves the comments of all rows; it serves tests only.
    """
    blocks = int(characters / 4.8) // BLOCK_DRAWS + 1  # a draw adds about five characters
    while True:
        # One row per block, some 1,300: the pool has a fixed size.
        chains = sorted(
            spark.range(0, blocks, 1, -(-blocks // TASK_BLOCKS)).withColumnRenamed("id", "block")
            .mapInPandas(_chains, "block bigint, exits array<bigint>, chars array<bigint>")
            .collect(), key=lambda r: r["block"])
        entry, first, plan = 0, 0, []
        for row in chains:
            plan.append((row["block"], entry, first, characters))
            first += row["chars"][entry]
            entry = row["exits"][entry]
            if first >= characters:
                break
        if first >= characters:
            break
        blocks *= 2
    parts = (
        spark.createDataFrame(plan, "block bigint, entry bigint, first bigint, stop bigint")
        .repartitionByRange(-(-len(plan) // TASK_BLOCKS), "block")
        .mapInPandas(_texts, "piece bigint, at bigint, part string")
    )
    pieces = parts.groupBy("piece").agg(
        F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts")
    ).select("piece", F.array_join(F.col("parts.part"), "").alias("text"))
    pieces.write.mode("overwrite").parquet(path)
    _write_file(spark.read.parquet(path), f"{path}-file")
    return read_pool(spark, path, characters)


def _write_file(pieces: DataFrame, path: str) -> None:
    """One text file of the whole pool, which has a fixed size: 300 lines by a single task."""
    per_line = LINE // PIECE
    lines = pieces.groupBy(F.floor(F.col("piece") / per_line).alias("line")).agg(
        F.array_sort(F.collect_list(F.struct("piece", F.substring("text", 1, PIECE).alias("text")))).alias("parts"))
    whole = lines.select("line", F.array_join(F.col("parts.text"), "").alias("value"))
    whole.coalesce(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def read_pool(spark: SparkSession, path: str, characters: int = words.POOL_CHARACTERS) -> Pool:
    """The pool written to ``path``; its file is shipped to all executors."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-file")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    file, = (str(f.getPath()) for f in files if f.getPath().getName().startswith("part-"))
    spark.sparkContext.addFile(file)
    return Pool(spark.read.parquet(path), characters, file.rpartition("/")[2])


def comment_span(stream: str, jumped: Column, characters: int,
                 before: Column | int = 0) -> tuple[Column, Column]:
    """Offset and length of a comment: two draws, or two per line when ``before`` is a
    one-based line column."""
    average = words.COMMENT_AVERAGE[stream]
    low, high = int(average * 0.4), int(average * 1.6)
    if isinstance(before, int):
        at, size = draw(stream, jumped, 1), draw(stream, jumped, 2)
    else:
        most = words.STREAMS[stream][1] // 2
        at = draw_at(stream, jumped, before, most, stride=2, first=-1)
        size = draw_at(stream, jumped, before, most, stride=2)
    return uniform(at, 0, characters - high), uniform(size, low, high)


def _cutter(file: str, out: str):
    """Replace the columns _at and _size by the text there."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # reads, not a map: pages of a map would add up to the whole pool in each worker
        with open(SparkFiles.get(file), "rb", buffering=0) as pool:
            for batch in batches:
                at, size = (batch.column(c).cast(pa.int64()).to_numpy() for c in ("_at", "_size"))
                last = at + size - 1
                first, count = at + at // LINE, size + last // LINE - at // LINE  # a line break follows each line
                data = b"".join(map(os.pread, repeat(pool.fileno()), count.tolist(), first.tolist())).replace(b"\n", b"")
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                text = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data))
                kept = [c for c in batch.schema.names if c not in ("_at", "_size")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text], names=[*kept, out])

    return cut


def with_comment(df: DataFrame, pool: Pool, span: tuple[Column, Column], out: str) -> DataFrame:
    """Cut the comment out of the pool's file, within the row's own task."""
    at, size = span
    located = df.withColumns({"_at": at, "_size": size})
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return located.mapInArrow(_cutter(pool.file, out), schema)
