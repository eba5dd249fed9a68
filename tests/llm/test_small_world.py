import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from starmill.llm import small_world

COLUMNS = "vec_id bigint, embedding array<{}>, node string, c int, label int"


def brute(rows, kind=np.float32):
    """(vec_id, n_links, component_id, kept) of all rows by all pairs."""
    good = [i is not None and v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
            for i, v in rows]
    points = [np.array([kind(c) for c in v], float) if ok else None for ok, (_, v) in zip(good, rows, strict=True)]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(points[a]) == len(points[b]):
                x, y = (p / np.abs(p).max() for p in (points[a], points[b]))
                if (points[a] == points[b]).all() or x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                    links[a] += 1
                    links[b] += 1
                    one, two = top(a), top(b)
                    root[max(one, two)] = min(one, two)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i if i is not None else -1, n, least.get(top(k)), i is None or least[top(k)] == i)
                  for k, ((i, _), n) in enumerate(zip(rows, links, strict=True)))


def found(spark, rows, kind="float"):
    frame = spark.createDataFrame([(*r, "clash", 3, 1) for r in rows], COLUMNS.format(kind))
    got = small_world.near_duplicates(frame)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in got.collect())


def vectors(seed, loose, tight, groups, width=16):
    """Rows far from each other, groups of near copies of several widths, a chain."""
    rng = np.random.default_rng(seed)
    made = [rng.standard_normal(width) for _ in range(loose)]
    for g in range(groups):
        centre = rng.standard_normal(width)
        centre /= np.linalg.norm(centre)
        made += [centre + (0.02 + 0.02 * (g % 4)) * rng.standard_normal(width) for _ in range(tight)]
    turn = [np.cos(0.2 * k) * np.eye(width)[0] + np.sin(0.2 * k) * np.eye(width)[1] for k in range(12)]
    return [[float(c) for c in v] for v in made + turn]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(small_world, "SHARD", 150)
    monkeypatch.setattr(small_world, "BLOCK", 200)
    rows = list(enumerate(vectors(1, 300, 25, 10)))
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_copies_are_linked_whatever_their_number(spark):
    rows = list(enumerate(vectors(2, 40, 5, 3)))
    rows += [(1000 + k, rows[3][1]) for k in range(150)] + [(2000 + k, rows[45][1]) for k in range(30)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = list(enumerate(vectors(3, 20, 4, 2)))
    rows += [(None, rows[25][1]), (None, None), (100, None), (101, []), (102, [0.0] * 16), (103, [-0.0] * 16), (104, [None] * 16),
             (105, [float("nan")] * 16), (106, [float("inf")] + [0.0] * 15), (25, rows[26][1]), (25, rows[26][1]), (7, rows[25][1]),
             (107, [1.0, 2.0]), (108, [2.0, 4.0]), (109, [1.0, 2.0, 0.0]), (110, [3e38] * 16), (111, [1e-44] * 16),
             (112, [2e38] * 16), (113, [5.0]), (114, [-5.0]), (115, [0.0, 3.0]), (116, [-0.0, 3.0])]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]
    assert found(spark, [(4, [1.0, 0.0])]) == [(4, 0, 4, True)]
    assert found(spark, [(9, [1.0, 0.0]), (4, [1.0, 0.1])]) == [(4, 1, 4, True), (9, 1, 4, False)]


def test_double_vectors_keep_their_precision(spark):
    edge = math.acos(0.95)
    rows = [(1, [1.0, 0.0]), (2, [math.cos(edge - 1e-9), math.sin(edge - 1e-9)]), (3, [math.cos(edge + 1e-9), -math.sin(edge + 1e-9)])]
    assert found(spark, rows, "double") == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_narrow_beams_are_widened_until_the_audit_passes(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(small_world, "ASK", 1)
    monkeypatch.setattr(small_world, "_audited", lambda classes, links, f=small_world._audited: asked.append(f(classes, links)) or asked[-1])
    rows = list(enumerate(vectors(4, 1500, 2, 150)))
    got = found(spark, rows)
    assert asked[-1][0] >= small_world.RECALL * asked[-1][1] > 0 and asked == sorted(asked)
    want = {r[0]: r for r in brute(rows)}
    assert all(r[1] <= want[r[0]][1] for r in got)  # no link that is none
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want.values())


def test_a_group_of_near_copies_is_one_node():
    points = small_world.unit(np.array(vectors(5, 200, 400, 1)))
    graph, ball, heads = small_world.build(points)
    assert len(heads) == len(graph.points) < 260
    assert (np.einsum("qd,qd->q", points, points[heads[ball]]) >= math.cos(math.acos(0.95) / 2) - 1e-6).all()


@pytest.mark.parametrize("n", [1, 2, 5, 700])
def test_every_node_is_reached(n):
    points = small_world.unit(np.random.default_rng(n).standard_normal((n, 8)))
    graph, _, heads = small_world.build(points)
    reached, edge = set(), {0}
    while edge:
        reached |= edge
        edge = {int(y) for x in edge for y in graph.near[0][x] if y >= 0} - reached
    assert len(reached) == len(heads)
    nodes, cosines = graph.search(graph.points, 16)
    assert (nodes[:, 0] == np.arange(len(heads))).mean() > 0.97 and (np.diff(cosines[:, :1], axis=1) <= 0).all()


def test_forest_connects_the_same():
    a, b = np.array([5, 5, 3, 1, 9, 3]), np.array([3, 1, 1, 5, 8, 5])
    assert len(small_world.forest(a, b)) == 3


def given(points, size=500, shard=3):
    """Batches of a shard's classes."""
    for a in range(0, len(points), size):
        part = points[a: a + size]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
        yield pa.RecordBatch.from_pydict({
            "c": np.arange(a, a + len(part)), "size": np.ones(len(part), np.int64), "vector": lists,
            "width": np.full(len(part), part.shape[1], np.int32), "shard": np.full(len(part), shard, np.int32)})


def test_a_graph_travels_as_rows(monkeypatch):
    monkeypatch.setattr(small_world, "BATCH", 100)
    points = np.array(vectors(6, 500, 40, 3), np.float32)
    graph, ball, heads = small_world.build(points)
    made = list(small_world._indexed(given(points)))
    assert len(made) == -(-len(points) // 100) and max(b.nbytes for b in made) < 100_000
    loading = small_world._Loading(made[0])
    for batch in made:
        loading.add(batch)
    shard = loading.shard()
    assert (shard.ids[: len(heads)] == heads).all() and (shard.raw == points[shard.ids]).all() and (shard.ball == ball[shard.ids]).all()
    assert len(shard.graph.near) == len(graph.near) and all((a == b).all() for a, b in zip(shard.graph.near, graph.near, strict=True))
    assert np.abs(shard.graph.points - graph.points).max() < 1e-6


def test_a_task_holds_a_shard_about_twice():
    points = np.random.default_rng(7).standard_normal((6000, 512)).astype(np.float32)
    batches = list(given(points))
    tracemalloc.start()
    made = list(small_world._indexed(iter(batches)))
    built = tracemalloc.get_traced_memory()[1]
    tracemalloc.clear_traces()
    loading = small_world._Loading(made[0])
    for batch in made:
        loading.add(batch)
    small_world._answers(loading.shard(), np.arange(600), points[:600], 16)
    asked = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(built, asked) < 2 * points.nbytes + 40e6  # 12.3 MB of vectors


def test_each_task_is_a_partition_and_no_vector_is_shuffled(spark, plan, tmp_path):
    made = [b for s in range(3) for b in small_world._indexed(given(np.array(vectors(s, 20, 3, 2), np.float32), shard=s))]
    at = str(tmp_path / "index")
    spark.createDataFrame(pa.Table.from_batches(made)).write.partitionBy("shard").parquet(at)
    index = spark.read.schema(small_world.INDEX.format("float")).parquet(at)
    tasks = small_world._tasks(index, [(0, [0, 2]), (1, [0]), (2, [1, 2]), (5, [0])])
    assert [n for n in tasks.rdd.glom().map(len).collect() if n] == [38 * 3, 38 * 2, 38 * 3, 38]
    assert "Exchange" not in plan(tasks)
    first = tasks.rdd.glom().collect()[0] or tasks.rdd.glom().collect()[1]
    assert [r.place for r in first] == [*range(38), *[None] * 76] and {r.shard for r in first} == {0}


def test_many_small_shards_and_jobs_of_two_widths(spark, monkeypatch):
    monkeypatch.setattr(small_world, "BYTES", 1_000)
    monkeypatch.setattr(small_world, "BLOCK", 40)
    monkeypatch.setattr(small_world, "JOB", 1)
    rows = list(enumerate(vectors(8, 80, 10, 4) + vectors(9, 40, 5, 2, 8)))
    random.Random(2).shuffle(rows)
    assert found(spark, rows) == brute(rows)
