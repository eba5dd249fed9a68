import numpy as np
import pytest
from pyspark.sql import functions as F

from starmill.llm import language_id, quality
from tests.conftest import DATA

ODD = [(None, "hello there"), (900001, None), (900002, ""), (900003, "12 34 !!"), (900004, "é"), (900005, "a"),
       (900006, "word " * 30000), (900006, "word " * 30000), (900007, "\n\n \t"), (900008, "日本語の文")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(*r, "en", "s", 5, 0) for r in ODD], "doc_id bigint, text string, lang string, source string, held_out int, score int")


def test_languages_of_held_out_rows(docs):
    got = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    kept = got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert kept > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edge_cases(spark, docs):
    rows = language_id.predict(odd(spark), language_id.fit(docs)).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert [got[k].lang_pred for k in (900001, 900002, 900003, 900007)] == ["und"] * 4
    assert got[900003].score == 0 and not got[None].held_out
    assert got[900004].lang_pred != "und" and got[900008].lang_pred != "und"
    empty = odd(spark).limit(0)
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.predict(odd(spark), None).collect()} == {"und"}
    assert language_id.predict(empty, None).count() == 0


def test_every_language_is_learned(spark):
    """More languages than a fixed number, some of one row, one with most of the rows."""
    rows = [(100_000 * n + k, f"{'abcdefghijklmnop'[k % 16]}{'qrstuvwxyz'[k // 16 % 10]}{k % 7}{'éàü'[k % 3]} " * 20, f"l{k:03d}")
            for k in range(230) for n in range(1, 9 if k % 2 else 5)]
    rows += [(50_000_000 + k, "common words here", "big") for k in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    wanted = {r.lang for r in frame.where(~language_id.held_out()).select("lang").distinct().collect()}
    model = language_id.fit(frame)
    assert len(wanted) > 200 and set(model.languages) == wanted
    got = language_id.predict(frame, model).join(frame.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = 'big' and lang_pred != 'big'").count() == 0


def test_rare_language_beside_a_common_one(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 2)
    rows = [(k, f"text number {k}", f"l{k % 40}") for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len(language_id.fit(frame).languages) == 40


def test_learning_ignores_held_out_rows(docs):
    flipped = docs.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    one, two = language_id.fit(docs), language_id.fit(flipped)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 12, 60])
def test_codewords_differ(n):
    codes = language_id.codewords(n)
    assert len({tuple(c) for c in codes.tolist()}) == n
    if n > 5:
        gaps = (codes.shape[1] - codes @ codes.T) // 2
        assert gaps[~np.eye(n, dtype=bool)].min() >= codes.shape[1] // 4


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(3)
    n = quality.WORDS + quality.STATISTICS
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), 0.1, rng.normal(0, 0.3, n),
                          rng.normal(0, 0.3, (n, quality.FACTORS)))
    text = "some words some more words here A&B".encode()
    data, offsets, stored = np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([np.nan])
    _, bucket, share, statistics = quality._features(data, offsets, stored)
    x = np.zeros(n)
    x[bucket], x[quality.WORDS:] = share, np.clip(statistics[0], -4, 4)
    total = model.base + x @ model.linear
    used = np.flatnonzero(x)
    for k, i in enumerate(used):
        for j in used[k + 1:]:
            total += x[i] * x[j] * (model.factors[i] @ model.factors[j])
    assert quality._score(model, data, offsets, stored)[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_held_out_rows(docs, labels):
    model = quality.fit(docs, labels)
    got = quality.predict(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    good = quality.keep_good(docs, model)
    assert good.columns == docs.columns


def test_quality_edge_cases(spark, docs, labels):
    model = quality.fit(docs, labels)
    rows = quality.predict(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    twice = [r.score for r in rows if r.doc_id == 900006]
    assert twice[0] == twice[1]
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.predict(odd(spark), None).collect()} == {1.0}
    assert quality.predict(odd(spark).limit(0), model).count() == 0
    marked = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, marked.unionByName(labels.limit(3).withColumn("quality", F.lit(None).cast("int"))))
    assert np.array_equal(model.linear, again.linear)
