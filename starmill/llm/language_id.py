"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier per bit, over hashed
2- to 4-grams of bytes (A-Z folded, other ASCII but letters a blank), tells the languages
with +1 from those with -1 by the log ratio of their gram shares. Decoding sums the
logistic losses of a codeword's bits, each weighted by how well its classifier does on the
learning sample, and chooses the nearest codeword. A small lead over the next one is flagged
as ambiguous.

Learning reads a bounded sample: about ``PER_LANG`` whole texts of each language, ``SAMPLE``
in all or one per language if they are more, drawn by a hash of the id. A language of which
none was drawn gives the text with its least hash, so every language that has a row to learn
from is learned. Gram counts are made in tasks; the driver gets one row of ``GRAMS`` counts per
drawn text, and the model holds ``GRAMS`` shares per language. Prediction sees the
text only: rows with null text or without a letter are ``und`` with score 0, as is every
row if nothing could be learned. Repeated rows are predicted alike; a null id is not held
out and not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.kernel import text_slices

GRAMS, SIZES = 1 << 15, (2, 3, 4)
PER_LANG, SAMPLE = 300, 4000
LEAD = 0.2


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # (GRAMS + 1) x bits; the last row is zero
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def codewords(n: int) -> np.ndarray:
    """n codewords: all splits up to 5 languages, else the widest apart of some drawn ones."""
    if n <= 5:
        bits = max(2 ** (n - 1) - 1, 1)
        return np.array([[1 if k == 0 or (b + 1) >> (k - 1) & 1 == 0 else -1 for b in range(bits)] for k in range(n)])
    rng, best, apart = np.random.default_rng(n), None, -1
    for _ in range(40):
        drawn = rng.choice([-1, 1], size=(n, math.ceil(10 * math.log2(n))))
        drawn = drawn[:, (drawn != drawn[0]).any(0)]
        gaps = (drawn.shape[1] - drawn @ drawn.T) // 2 + np.eye(n, dtype=int) * drawn.shape[1]
        if gaps.min() > apart:
            best, apart = drawn, gaps.min()
    return best


_folded = np.full(256, 32, np.uint32)
_folded[97:123] = _folded[65:91] = np.arange(97, 123)
_folded[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each gram size the bucket of the gram at every byte; GRAMS where a text ends."""
    folded, n = _folded[data], len(data)
    for size in SIZES:
        value = np.zeros(n, np.uint32)
        for j in range(min(size, n)):
            value[: n - j] = (value[: n - j] + folded[j:] + np.uint32(size)) * np.uint32(0x9E3779B1)
        bucket = (value ^ value >> np.uint32(13)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 15)
        for j in range(1, size):
            ends = offsets[1:] - j
            bucket[ends[ends >= offsets[:-1]]] = GRAMS
        yield bucket


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column("text")):
            rows = np.repeat(np.arange(b - a), np.diff(offsets))
            made = sum(np.bincount(rows * (GRAMS + 1) + bucket, minlength=(b - a) * (GRAMS + 1))
                       for bucket in _grams(data, offsets)) if len(data) else np.zeros((b - a) * (GRAMS + 1), np.int64)
            counts = made.reshape(b - a, GRAMS + 1)[:, :GRAMS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(a, b - a),
                 pa.array([np.flatnonzero(x).astype(np.int32) for x in counts], pa.list_(pa.int32())),
                 pa.array([x[x > 0].astype(np.int32) for x in counts], pa.list_(pa.int32()))],
                names=["lang", "grams", "counts"])


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the id's remainder keeps the row out of learning; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(texts: DataFrame) -> list[dict]:
    return texts.mapInArrow(_counter, "lang string, grams array<int>, counts array<int>").toArrow().to_pylist()


def fit(docs: DataFrame, text_column: str = "text") -> Model | None:
    known = docs.select("doc_id", F.col(text_column).alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "doc_id is not null and text is not null and lang is not null").where(~held_out())
    spark = docs.sparkSession
    counts = known.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return None
    each = min(PER_LANG, max(SAMPLE // len(counts), 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(draw < F.try_element_at(F.create_map(*(
        F.lit(x) for r in counts for x in (r["lang"], min(each / r["count"], 1.0)))), F.col("lang")))
    rows = _counted(drawn.select("lang", "text").limit(2 * max(SAMPLE, len(counts))))
    missing = sorted({r["lang"] for r in counts} - {r["lang"] for r in rows})
    if missing:
        wanted = spark.createDataFrame([(x,) for x in missing], "lang string")
        rows += _counted(known.join(wanted, "lang", "left_semi").groupBy("lang").agg(
            F.min_by("text", F.struct(draw, "text")).alias("text")))
    rows.sort(key=lambda r: (r["lang"], r["grams"], r["counts"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    place = {name: k for k, name in enumerate(languages)}
    shares = np.zeros((len(languages), GRAMS))
    for r in rows:
        x = np.array(r["counts"], float)
        shares[place[r["lang"]], r["grams"]] += x / x.sum() if len(x) else 0
    shares = shares / np.maximum(shares.sum(1, keepdims=True), 1e-12) + 0.2 / GRAMS
    codes = codewords(len(languages))
    weights, bias = np.zeros((GRAMS + 1, codes.shape[1]), np.float32), np.zeros(codes.shape[1])
    for b in range(codes.shape[1]):
        plus, minus = (shares[codes[:, b] == s].mean(0) if (codes[:, b] == s).any() else np.full(GRAMS, 1 / GRAMS) for s in (1, -1))
        weights[:GRAMS, b] = np.log(plus / minus)
    right = np.zeros(codes.shape[1])
    for r in rows:
        margin = np.array(r["counts"], float) @ weights[r["grams"]] if r["grams"] else bias
        right += (margin * codes[place[r["lang"]]] > 0)
    wrong = 1 - right / len(rows)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01))
    return Model(languages, codes, weights, bias, np.maximum(trust, 0.01))


def _decoded(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, its probability, lead over the next) of each text of a slice."""
    rows, bits = len(offsets) - 1, model.codes.shape[1]
    margin, full = np.zeros((rows, bits)), np.flatnonzero(np.diff(offsets))
    if len(full):
        total = None
        for bucket in _grams(data, offsets):
            part = model.weights[bucket]
            total = part if total is None else total + part
        margin[full] = np.add.reduceat(total, offsets[:-1][full], axis=0, dtype=np.float64)
    length = np.maximum(np.diff(offsets), 1)[:, None]
    margin = margin / np.sqrt(length)
    plus = model.codes.T > 0
    loss = (np.logaddexp(0, -margin) * model.trust) @ plus + (np.logaddexp(0, margin) * model.trust) @ ~plus
    near = np.exp(loss.min(1, keepdims=True) - loss)
    near /= near.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = near[np.arange(rows), best]
    near[np.arange(rows), best] = 0
    return best, top, top - near.max(1)


def _lettered(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def _predictor(model: Model | None):
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                seen = np.concatenate(([0], np.cumsum(letters[data])))
                has = seen[offsets[1:]] > seen[offsets[:-1]]
                for k in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
                    has[k] = _lettered(data[offsets[k]: offsets[k + 1]].tobytes())
                if model is None:
                    name, score, close = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a, bool)
                else:
                    best, top, lead = _decoded(model, data, offsets)
                    name = [model.languages[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                    score, close = np.where(has, top, 0.0), has & (lead < LEAD)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a),
                     pa.array(name), pa.array(score), pa.array(close)],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return predict


def predict(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, one row per row of ``docs``."""
    rows = docs.select("doc_id", F.col(text_column).alias("text"), held_out().alias("held_out"))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "held_out").mapInArrow(
        _predictor(model), "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
