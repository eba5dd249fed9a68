"""Text quality by a factorisation machine.

A text's features are its words, hashed to ``WORDS`` buckets, each with its share of the
text's words; structure statistics (shares of byte classes, word and line repetition,
lengths), standardised; and metadata, the stored number of characters where a row has one.
Every feature has a weight and a vector of ``FACTORS`` numbers, and the score is the
logistic of

    w0 + sum(w_i x_i) + 1/2 sum_f((sum(v_if x_i))^2 - sum(v_if^2 x_i^2)),

the sum-of-squares form of all pairwise interactions, linear in the number of features.

Learning reads a bounded sample: about ``PER_CLASS`` labelled texts of each class, drawn by
a hash of the id, featurised in tasks; the driver fits by Adagrad, with rows weighted by the
number of labelled rows that they stand for. Labels of one id that
disagree, nulls and other values than 0 and 1 are not learned from. Labels, language, source
and id are never features. Every row gets a score, null and empty texts too (no words, zero
shares); without both classes in the sample all scores are 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.kernel import text_slices, words

WORDS, FACTORS, PER_CLASS = 1 << 15, 6, 1500
_LINES = np.zeros(256, bool)
_LINES[10] = True
#: Byte classes: 0 other ASCII, 1 A-Z, 2 a-z, 3 digits, 4 blank and tab, 5 line feed, 6 usual signs, 7 odd signs, 8 beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 32]], _CLASS[10] = 1, 2, 3, 4, 5
_CLASS[[*b".,;:'\"-()?"]] = 6
_CLASS[[*b"#$%&*!|@^_~`<>{}[]=+/\\"]] = 7
_CLASS[128:] = 8
STATISTICS = 17


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    base: float
    linear: np.ndarray  # words, then statistics
    factors: np.ndarray  # the same, times FACTORS


def _features(data: np.ndarray, offsets: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, bucket, share) of each row's words, and the statistics of each row."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    row_of = np.repeat(np.arange(rows), size)
    classes = np.bincount(row_of * 9 + _CLASS[data], minlength=rows * 9).reshape(rows, 9)
    hashes, length, bounds = words(data, offsets)
    n = np.diff(bounds)
    word_row = np.repeat(np.arange(rows), n)
    bucket = (hashes >> np.uint64(64 - 15)).astype(np.int64)
    key = np.sort(word_row * WORDS + bucket)
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(key)))
    row, bucket = key[at] // WORDS, key[at] % WORDS
    share = times / n[row]
    again = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    again = np.bincount(word_row[1:][again], minlength=rows)
    lines, _, line_bounds = words(data, offsets, _LINES)
    n_lines = np.diff(line_bounds)
    line_row = np.repeat(np.arange(rows), n_lines)
    order = np.lexsort((lines, line_row))
    a, b = lines[order], line_row[order]
    repeated = np.bincount(b[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])], minlength=rows)
    some, one = np.maximum(size, 1), np.maximum(n, 1)
    letters = np.maximum(classes[:, 1] + classes[:, 2], 1)
    trails = classes[:, 8]
    chars = np.where(np.isnan(stored), size - trails / 2, stored)
    statistics = np.column_stack((
        classes[:, 1] / letters, classes[:, 2] / some, classes[:, 3] / some, classes[:, 4] / some, classes[:, 5] / some,
        classes[:, 6] / some, classes[:, 7] / some, classes[:, 8] / some, classes[:, 7] / one, np.log1p(n),
        np.bincount(word_row, weights=length, minlength=rows) / one, np.bincount(row, minlength=rows) / one,
        again / one, repeated / np.maximum(n_lines, 1), np.log1p(n_lines),
        np.sqrt(np.bincount(row, weights=share * share, minlength=rows)), np.log1p(np.maximum(chars, 0))))
    return row, bucket, share, statistics


def _score(model: Model, data: np.ndarray, offsets: np.ndarray, stored: np.ndarray) -> np.ndarray:
    row, bucket, share, statistics = _features(data, offsets, stored)
    x = np.clip((statistics - model.mean) / model.deviation, -4, 4)
    rows = len(x)
    linear, factors = model.linear, model.factors
    total = model.base + x @ linear[WORDS:] + np.bincount(row, weights=share * linear[bucket], minlength=rows)
    sums, squares = x @ factors[WORDS:], (x * x) @ factors[WORDS:] ** 2
    for f in range(FACTORS):
        part = share * factors[bucket, f]
        sums[:, f] += np.bincount(row, weights=part, minlength=rows)
        squares[:, f] += np.bincount(row, weights=part * part, minlength=rows)
    total += 0.5 * (sums * sums - squares).sum(1)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the id's remainder keeps the row out of learning; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _stored(docs: DataFrame) -> Column:
    """The stored number of characters; null if there is no such column or it holds no numbers."""
    kind = dict(docs.dtypes).get("n_chars", "")
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    return (F.col("n_chars") if number else F.lit(None)).cast("double")


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stored = _numbers(batch.column("stored"))
        for a, b, data, offsets in text_slices(batch.column("text")):
            row, bucket, share, statistics = _features(data, offsets, stored[a:b])
            cut = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(share)),
                 pa.array(list(statistics), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "buckets", "shares", "statistics"])


def fit(docs: DataFrame, labels: DataFrame, text_column: str = "text") -> Model | None:
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other")).where("quality = other")
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("quality") == 1, min(PER_CLASS / counts[1], 1.0)).otherwise(min(PER_CLASS / counts[0], 1.0))
    drawn = marked.where(draw < rate).select("doc_id", "quality").limit(4 * PER_CLASS)
    texts = docs.select("doc_id", F.col(text_column).alias("text"), _stored(docs).alias("stored"))
    # the drawn ids are at most 4 * PER_CLASS rows of two numbers
    rows = texts.join(F.broadcast(drawn), "doc_id").limit(8 * PER_CLASS).select("doc_id", "quality", "text", "stored").mapInArrow(
        _featuriser, "doc_id bigint, quality int, buckets array<int>, shares array<double>, statistics array<double>"
    ).toArrow().combine_chunks()
    if len(rows.column("quality").unique()) < 2:
        return None
    model = _learn(rows, counts)
    del rows
    pa.default_memory_pool().release_unused()  # else the driver holds the drawn rows' memory from here on
    return model


def _learn(rows: pa.Table, counts: dict[int, int], rounds: int = 12, batch: int = 64, rate: float = 0.08) -> Model:
    def flat(name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy()

    raw = flat("statistics").reshape(rows.num_rows, -1)
    order = np.lexsort((*raw.T, rows.column("doc_id").to_numpy()))  # as tasks end in any order
    rows, raw = rows.take(pa.array(order)), raw[order]
    label = rows.column("quality").to_numpy().astype(float)
    mean, deviation = raw.mean(0), raw.std(0) + 1e-6
    x = np.clip((raw - mean) / deviation, -4, 4)
    size = pc.list_value_length(rows.column("buckets")).to_numpy()
    begin = np.concatenate(([0], np.cumsum(size)))
    bucket, share = flat("buckets").astype(np.int64), flat("shares")
    rng = np.random.default_rng(7)
    n = WORDS + x.shape[1]
    linear, factors, base = np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)), 0.0
    seen_linear, seen_factors, seen_base = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    # a row weighs as many labelled rows as it stands for
    whole = counts[0] + counts[1]
    weight = np.where(label == 1, counts[1] / whole / label.mean(), counts[0] / whole / (1 - label.mean()))
    for _ in range(rounds):
        for some in np.array_split(rng.permutation(rows.num_rows), max(rows.num_rows // batch, 1)):
            pick = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in some])
            row, col, val = np.repeat(np.arange(len(some)), size[some]), bucket[pick], share[pick]
            dense = x[some]
            sums = dense @ factors[WORDS:]
            np.add.at(sums, row, val[:, None] * factors[col])
            squares = (dense ** 2) @ factors[WORDS:] ** 2
            np.add.at(squares, row, (val[:, None] * factors[col]) ** 2)
            total = base + dense @ linear[WORDS:] + np.bincount(row, weights=val * linear[col], minlength=len(some))
            total += 0.5 * (sums ** 2 - squares).sum(1)
            slope = weight[some] * (1 / (1 + np.exp(-np.clip(total, -30, 30))) - label[some]) / len(some)
            grad_linear, grad_factors = np.zeros(n), np.zeros((n, FACTORS))
            np.add.at(grad_linear, col, slope[row] * val)
            grad_linear[WORDS:] = slope @ dense
            np.add.at(grad_factors, col, (slope[row] * val)[:, None] * (sums[row] - val[:, None] * factors[col]))
            grad_factors[WORDS:] = dense.T @ (slope[:, None] * sums) - (slope @ dense ** 2)[:, None] * factors[WORDS:]
            grad_linear += 1e-5 * linear * (grad_linear != 0)
            grad_factors += 1e-4 * factors * (grad_factors != 0)
            seen_linear += grad_linear ** 2
            seen_factors += grad_factors ** 2
            linear -= rate * grad_linear / np.sqrt(seen_linear)
            factors -= rate * grad_factors / np.sqrt(seen_factors)
            seen_base += slope.sum() ** 2
            base -= rate * slope.sum() / np.sqrt(seen_base)
    return Model(mean, deviation, base, linear, factors)


def score_column(docs: DataFrame, model: Model | None, text_column: str = "text") -> Column:
    """The score of each row as a column: an Arrow function of text and stored length."""
    if model is None:
        return F.lit(1.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(text: pa.Array, stored: pa.Array) -> pa.Array:
        known = _numbers(stored)
        return pa.concat_arrays([pa.array(_score(sent.value, data, offsets, known[a:b]))
                                 for a, b, data, offsets in text_slices(text)] or [pa.array([], pa.float64())])

    return scores(F.col(text_column), _stored(docs))


def predict(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(docs, model, text_column).alias("score"))
    return scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    return docs.where(score_column(docs, model, text_column) >= 0.5)
