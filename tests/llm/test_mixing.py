import pytest

from starmill.llm import mixing

COLUMNS = "doc_id bigint, text string, source string, size int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], COLUMNS)


def by_hand(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(k, "w " * (k % 9 + 1), f"s{k % 4}") for k in range(300)]
    rows += [(1000 + k, "hot words here now", "hot") for k in range(900)]
    rows += [(5000, "tiny", None), (None, "x y", "s1"), (5001, None, "s1"), (5002, "", "s2"), (7, "w w", "s3")]
    got = mixing.mix(frame(spark, rows), per_range=20).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = by_hand(sizes)
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert mine[0].source_size == sizes[source]
        assert mine[0].target == pytest.approx(want[source])
        assert sum(r.taken for r in mine) == int(want[source] + 0.5)
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(7), per_range=20).collect()))


def test_positions_follow_the_schedule(spark):
    rows = [(k, "a b c d", f"s{k % 2}") for k in range(2000)]
    used = mixing.training_order(mixing.mix(frame(spark, rows))).collect()
    times = [r.position for r in used]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1_000_000
    early = [r for r in used if r.source == "s0"]
    # weight falls from 2 to 0: three quarters of the demand lies in the first half
    assert sum(r.position < 500_000 for r in early) / len(early) == pytest.approx(0.75, abs=0.02)


def test_inverse_demand(spark):
    knots = ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0))
    for u, t in ((0.0, 0.0), (0.25, 0.5), (1.0, 1.0)):
        got = spark.range(1).select(mixing.inverse_demand(mixing.F.lit(u), knots).alias("t")).first().t
        assert got == pytest.approx(t)
    with pytest.raises(ValueError):
        mixing.inverse_demand(mixing.F.lit(0.5), ((0.0, 1.0), (0.0, 2.0)))


def test_empty_and_wordless(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_training_set_repeats_whole_rows(spark):
    rows = [(k, "a b c", f"s{k % 3}") for k in range(300)] + [(900, None, "s1"), (901, "", "s2"), (5, "a b c", "s2")]
    docs = frame(spark, rows)
    got = mixing.training_set(docs, per_range=20)
    assert got.columns == docs.columns
    used = got.collect()
    planned = {(r.doc_id, r.source): r for r in mixing.mix(docs, per_range=20).collect()}
    assert all(r.text for r in used)
    for source in ("s0", "s1", "s2"):
        words = 3 * sum(r.source == source for r in used)
        target = next(r.target for r in planned.values() if r.source == source)
        assert abs(words - target) <= 3


def test_rows_without_an_id_are_split_and_their_copies_counted(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, f"w{k} " * (k % 5 + 1), "s0") for k in range(600)] + [(k, "a b c", "s0") for k in range(600)]
    rows += [(None, "the same words", "s1")] * 500 + [(3, "x", "s1"), (3, "x", "s1"), (4, "y y y y", "s1")]
    got = mixing.mix(frame(spark, rows), per_range=20).collect()
    assert len(got) == len(rows)
    for source in ("s0", "s1"):
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) and all(0 <= r.taken <= 3 * r.size for r in mine)
    sized = mixing._sized(frame(spark, rows), "text")
    part = mixing.F.conv(mixing.F.substring("draw", 1, 8), 16, 10).cast("bigint") * 16 / (1 << 32)
    loads = [r["count"] for r in sized.where("source = 's0'").groupBy(mixing.F.floor(part)).count().collect()]
    assert max(loads) < 2 * 1200 / 16
    again = mixing.mix(frame(spark, rows).repartition(5), per_range=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_come_in_training_order(spark):
    rows = [(k if k % 5 else None, "a b " * (k % 4), f"s{k % 3}") for k in range(900)]
    got = [r.position for r in mixing.mix(frame(spark, rows), per_range=20).collect()]
    used = [p for p in got if p is not None]
    assert used == sorted(used) and got[len(used):] == [None] * (len(got) - len(used)) and len(used) < len(got)


def test_order_is_that_of_the_sql_and_rows_of_one_id_are_classes(spark):
    duckdb = pytest.importorskip("duckdb")
    from starmill.llm.oracles import ORACLES

    rows = [(k if k % 3 else None, "w " * (k % 7), f"s{k % 4}" if k % 4 else None) for k in range(1200)]
    rows += [(7, f"x{k} y", "s1") for k in range(300)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string").toPandas()
    con = duckdb.connect()
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    cursor = con.execute(ORACLES["op5_mixing"])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    mixed = mixing.mix(frame(spark, rows), per_range=20).select(*names).collect()
    assert sorted(str(tuple(r)) for r in mixed) == want
    # 400 rows without an id and 300 of id 7 have seven sizes and four sources at most
    counted = mixing._classes(mixing._sized(frame(spark, rows), "text"))
    assert counted.where("doc_id is null or doc_id = 7").count() <= 2 * 7 * 4
    used = mixing.training_set(frame(spark, rows), per_range=20).groupBy("source").count().collect()
    targets = {r.source: r.target for r in mixing.mix(frame(spark, rows)).collect()}
    assert {r.source for r in used} == set(targets)
