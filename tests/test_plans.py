"""Plans that must hold at scale, checked with automatic broadcast switched off."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from starmill.functions.money import exact_sum
from starmill.generator import parameters, refresh
from starmill.generator.scale import Scale
from starmill.operators import joining
from starmill.plans import star_suite
from tests.conftest import DATA

SUITES = [n for n in entry.queries()
          if n.startswith(("tpch_", "ch_q", "join_", "jdbc_", "agg_", "subq_", "dml_", "dq_"))
          and n != "join_colocated"]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", SUITES)
def test_no_product_joins(spark, no_broadcast, plan, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_date_filter_and_columns_reach_the_scan(star, plan):
    text = plan(star_suite.q06(star), "formatted")
    assert "LessThan(l_shipdate" in text and "GreaterThanOrEqual(l_shipdate" in text
    schema = text[text.index("ReadSchema"):].splitlines()[0]
    assert "l_comment" not in schema and "l_orderkey" not in schema


def test_lines_are_read_once(star, plan):
    for query in (star_suite.q17, star_suite.q18, star_suite.q21):
        assert plan(query(star), "formatted").count("lineitem.parquet") == 1


def test_offers_are_joined_once(star, plan):
    assert plan(star_suite.q02(star), "formatted").count("lineitem.parquet") == 1


def test_large_refresh_sets_stay_out_of_the_plan(spark, plan):
    sets = spark.range(1, 3).withColumnRenamed("id", "set_number")
    text = plan(refresh.set_rows(sets, Scale.of(100_000)))
    assert len(text) < 20_000
    rows = refresh.set_rows(sets, Scale.of(1)).groupBy("set_number").agg(
        F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"),
        F.countDistinct("position").alias("different"))
    assert {tuple(r) for r in rows.collect()} == {(1, 1500, 0, 1499, 1500), (2, 1500, 0, 1499, 1500)}


def test_sums_beyond_64_bits_are_exact(spark):
    big = (1 << 43) - 7
    rows = spark.range(3_000_000).select(F.when(F.col("id") % 3 == 0, -5).otherwise(big).alias("x"))
    got = rows.agg(exact_sum("x", 2).alias("s")).first().s
    assert got == Decimal(2_000_000 * big - 5_000_000) / 100


def test_unknown_stream_is_an_error(spark):
    from starmill.generator import words

    known = len(words.QUERY_ORDERS)
    assert parameters.query_order(spark.range(known).withColumnRenamed("id", "stream")).count() == 22 * known
    with pytest.raises(Exception, match="streams only"):
        parameters.query_order(spark.range(known, known + 1).withColumnRenamed("id", "stream")).collect()


def test_colocated_join_has_no_exchange_below_it(star, plan):
    text = plan(joining.join_colocated(star, 4))
    below = text[text.index("SortMergeJoin"):]
    assert "Exchange" not in below


def test_top_k_is_not_a_global_sort(star, plan):
    assert "TakeOrderedAndProject" in plan(star_suite.q03(star))
