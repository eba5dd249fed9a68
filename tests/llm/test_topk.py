import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmill.llm import topk

COLUMNS = "vec_id bigint, embedding array<float>, leaf int, query string, score int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k=5, every=5):
    clean = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and sound(v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in clean if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in clean if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, every=5):
    frame = spark.createDataFrame([(*r, 0, "q", 1) for r in rows], COLUMNS)
    got = topk.search(frame, F.col("vec_id") % every == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()))


def clustered(rng, n, width=8):
    centres = [[rng.gauss(0, 4) for _ in range(width)] for _ in range(6)]
    return [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for k in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "LEAVES", 24)
    rng = random.Random(3)
    rows = clustered(rng, 400)
    hot = rows[7][1]
    rows += [(1000 + k, hot) for k in range(200)]
    rows += [(None, hot), (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8),
             (2005, []), (2010, [0.0] * 8), (2015, [1.0, 2.0])]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [-1.0, 0.5])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == []
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []


def test_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0])]
    assert found(spark, rows) == [(0, 1, 1, 768 * 256 + 256 * 512), (0, 2, 1, 768 * 256 + 256 * 512)]


def test_pruning_drops_far_leaves_and_keeps_the_best():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 4, (6, 8)) * 256
    sample = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(0, 10, (360, 8)))
    tree = topk.build(sample, 30)
    leaf = ((sample[:, None] - tree.centres[None]) ** 2).sum(2).argmin(1)
    away = np.linalg.norm(sample - tree.centres[leaf], axis=1)
    radius = np.full(len(tree.centres), -np.inf)
    np.maximum.at(radius, leaf, away)
    scores = sample @ sample.T
    kth = np.sort(scores, axis=1)[:, -5]
    floor = np.full(len(tree.centres), np.inf)
    np.minimum.at(floor, leaf, kth)
    pairs = topk.surviving(tree, radius, radius, floor)
    assert len(pairs) < 0.6 * (np.isfinite(radius).sum()) ** 2
    for q in range(len(sample)):
        for c in np.argsort(scores[q])[-5:]:
            assert (leaf[q], leaf[c]) in pairs


@pytest.mark.parametrize("counts", [{0: 5}, {0: 100, 1: 7, 2: 4, 9: 30}, {k: 1 for k in range(50)}])
def test_blocks_are_bounded(counts):
    laid = topk._laid_out(counts, 10)
    load = {}
    for leaf, first, cuts in laid:
        for c in range(cuts):
            load[first + c] = load.get(first + c, 0) + counts[leaf] / cuts
    assert {leaf for leaf, *_ in laid} == set(counts) and max(load.values()) <= 10
