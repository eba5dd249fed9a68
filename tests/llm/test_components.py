"""Components against union-find, and how little of the driver a run of the pipeline's steps takes."""

import random

import corpus_pipeline
from starmill.llm import components as module
from tests.conftest import DATA


def by_hand(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = (find(parent.setdefault(e, e)) for e in (a, b))
            parent[max(x, y)] = min(x, y)
    return sorted((u, find(u)) for u in parent)


def frame(spark, edges):
    return spark.createDataFrame(edges, "a bigint, b bigint")


def test_components_by_hand(spark):
    rng = random.Random(3)
    path = rng.sample(range(-500, 500), 200)
    cases = [[], [(None, 3), (4, None), (5, 5)], list(zip(path, path[1:], strict=False)),
             [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(1, 0), (0, 1), (None, 1)],
             [(7, k) for k in range(2000)] + [(k, k + 5000) for k in range(2000)]]
    for edges in cases:
        assert sorted(map(tuple, module.components(frame(spark, edges)).collect())) == by_hand(edges)


def test_a_round_is_one_query_of_few_exchanges(spark, monkeypatch, plan):
    queries, written = spark._jsparkSession.sharedState().statusStore(), []
    bus = spark.sparkContext._jsc.sc().listenerBus()

    def stored_at(df, purpose, write=module.stored_at):
        written.append(plan(df).split("Initial Plan")[0].count("Exchange"))
        return write(df, purpose)

    monkeypatch.setattr(module, "stored_at", stored_at)
    edges = frame(spark, [(k, k + 1) for k in range(40)])
    bus.waitUntilEmpty(10_000)
    before = queries.executionsCount()
    module.components(edges)
    bus.waitUntilEmpty(10_000)
    assert queries.executionsCount() - before == len(written) > 3  # edges, parents, then one for each round
    assert max(written) <= 6


def test_stages_end_in_queries_of_few_exchanges(spark, plan):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    most = {"near_duplicates": 6, "decontamination": 8, "mixing": 5}
    for name, stage in corpus_pipeline.STAGES:
        if name in most:
            assert plan(stage(spark, docs, DATA)).split("Initial Plan")[0].count("Exchange") <= most[name], name
