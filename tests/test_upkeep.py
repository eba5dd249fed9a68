"""Batch changes, constraint checks, joins with nulls and layouts on small tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from starmill.functions.shared import shared_dir
from starmill.operators import checks, dml, layout
from starmill.operators.joins import null_aware_anti
from starmill.operators.scalars import int_range


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_update_set_takes_the_last_change_even_to_null(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame(
        [(1, "x", 1), (1, "y", 2), (2, "z", 5), (2, None, 9), (7, "q", 1)], "k int, v string, seq int")
    after = {r.k: r.v for r in dml.update_set(table, changes, "k", "v").collect()}
    assert after == {1: "y", 2: None, 3: "c"}


def test_update_delta_equals_serial_updates(spark):
    table = spark.createDataFrame([(i, 0) for i in range(5)], "k int, v bigint")
    changes = [(i * 7 % 6, i - 20) for i in range(60)]
    expected = {k: sum(d for c, d in changes if c == k) for k in range(5)}
    batch = spark.createDataFrame(changes, "k int, delta bigint")
    assert dict(rows(dml.update_delta(table, batch, "k", "v"))) == expected


def test_insert_on_conflict_keeps_the_first(spark):
    table = spark.createDataFrame([(1, "old")], "k int, v string")
    batch = spark.createDataFrame([(1, "no", 1), (2, "first", 2), (2, "second", 3)],
                                  "k int, v string, seq int")
    assert rows(dml.insert_on_conflict(table, batch, "k", "seq")) == [(1, "old"), (2, "first")]


def test_insert_fills_missing_columns(spark):
    table = spark.createDataFrame([(1, 2, "x")], "a int, b int, c string")
    more = spark.createDataFrame([(5,)], "a int")
    got = dml.insert(table, more, {"b": F.lit(10)})
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, 2, "x"), (5, 10, None)]


@pytest.mark.parametrize("right,expected", [
    ([1, 2], [3]), ([1, None], []), ([], [None, 1, 2, 3]), ([9], [1, 2, 3]),
])
def test_null_aware_anti(spark, right, expected):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    keys = spark.createDataFrame([(v,) for v in right], "r int")
    got = [r.k for r in null_aware_anti(left, keys, "k", "r").collect()]
    assert sorted(got, key=lambda v: (v is not None, v)) == expected


def test_checks(spark):
    df = spark.createDataFrame([(1, 5), (1, 20), (2, None), (None, 11)], "k int, v int")
    assert rows(checks.primary_key(df, ["k"]).select(F.coalesce("k", F.lit(-1)), "n")) == [(-1, 1), (1, 2)]
    assert rows(checks.check(df, F.col("v") > 10)) == [(1, 5)]
    parents = spark.createDataFrame([(1,)], "p int")
    assert rows(checks.foreign_key(df, ["k"], parents, ["p"])) == [(2, 1)]
    assert rows(checks.not_null(df, ["k", "v"])) == [("k", 1), ("v", 1)]


def test_int_range_rejects_reversed_bounds(spark):
    df = spark.range(1)
    with pytest.raises(Exception, match="lower bound"):
        df.select(int_range(F.lit(2), F.col("id").cast("int"))).collect()


def test_hot_key_is_reduced_before_the_join(spark, plan):
    """A third of the batch on one key: the join input is one row per key."""
    table = spark.range(100).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("v"))
    batch = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"),
        F.lit(1).cast("bigint").alias("delta"))
    after = {r.k: r.v for r in dml.update_delta(table, batch, "k", "v").collect()}
    assert sum(after.values()) == 30_000 and after[7] > 10_000
    text = plan(dml.update_delta(table, batch, "k", "v"))
    assert "partial_sum" in text


def test_layouts_answer_alike(spark, star):
    source = star.orders.select("o_orderkey", "o_orderstatus")
    counts = []
    for kind in ("hash", "reference", "append"):
        stored = layout.table_distribute(
            source, kind, shared_dir(spark, kind), f"t_{uuid.uuid4().hex[:8]}", "o_orderkey", 4)
        counts.append(rows(stored.groupBy("o_orderstatus").count()))
    assert counts[0] == counts[1] == counts[2]


def test_tenant_point_read_prunes(spark, plan):
    path = shared_dir(spark, "tenants")
    df = spark.range(1000).select(
        "id", (F.col("id") % 5).cast("int").alias("tenant"), (F.col("id") % 3).cast("int").alias("tbl"))
    layout.write_tenants(df, path)
    one = layout.read_tenant(spark, path, 2, 1, 7)
    assert one.count() == 1
    text = plan(one)
    assert "PartitionFilters: [isnotnull(tenant" in text and "EqualTo(id,7)" in text
