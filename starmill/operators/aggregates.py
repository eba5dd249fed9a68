"""Aggregation, ordering and subquery operators, one small plan each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.operators import paging
from starmill.functions.money import exact_sum, mean, net_price, net_sum, rounded
from starmill.sources.star import Star


# --- aggregation -------------------------------------------------------------

def agg_group_multi(star: Star) -> DataFrame:
    return star.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        rounded(F.sum("l_extendedprice")).alias("total"), mean("l_quantity").alias("average"),
        F.count(F.lit(1)).alias("n"))


def agg_global(star: Star) -> DataFrame:
    return star.facts().agg(
        rounded(net_sum()).alias("revenue"), F.count(F.lit(1)).alias("n"))


def agg_count_col(star: Star) -> DataFrame:
    """count(column) skips the nulls an outer join makes."""
    orders = star.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return (
        star.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("customers"), F.count("k").alias("with_orders"))
    )


def agg_count_distinct(star: Star) -> DataFrame:
    return star.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.countDistinct(F.col("l_partkey") % 100).alias("part_groups"))


def agg_min_max(star: Star) -> DataFrame:
    return star.lineitem.groupBy("l_suppkey").agg(
        F.min("l_extendedprice").cast("double").alias("lowest"),
        F.max("l_extendedprice").cast("double").alias("highest"),
        F.max("l_shipdate").alias("last_ship"))


def agg_conditional(star: Star) -> DataFrame:
    promo = exact_sum(F.when(F.col("p_type").startswith("PROMO"), net_price()).otherwise(0), 4)
    return (
        star.facts().join(star.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_returnflag")
        .agg(rounded(promo).alias("promo"),
             F.round(100.0 * promo.cast("double") / net_sum().cast("double"), 4)
             .alias("percent"))
    )


def agg_of_agg(star: Star) -> DataFrame:
    return (
        star.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
        .groupBy("orders").agg(F.count(F.lit(1)).alias("customers"))
    )


def agg_having(star: Star) -> DataFrame:
    return (
        star.lineitem.groupBy("l_orderkey").agg(rounded(F.sum("l_quantity")).alias("quantity"))
        .filter(F.col("quantity") > 180)
    )


def agg_having_subquery(star: Star) -> DataFrame:
    """Groups above a fraction of the total; the total reuses the grouped rows."""
    values = star.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    threshold = values.agg(F.sum("q") * F.lit("0.0101").cast("decimal(5,4)")).scalar()
    return values.filter(F.col("q") > threshold).select(
        "l_suppkey", rounded(F.col("q")).alias("quantity"))


def agg_group_expr(star: Star) -> DataFrame:
    return star.orders.groupBy(
        F.year("o_orderdate").alias("o_year"),
        F.substring("o_orderpriority", 1, 1).alias("level"),
        (F.col("o_custkey") % 10).alias("bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))


def agg_group_hidden(star: Star) -> DataFrame:
    return star.orders.groupBy("o_custkey", "o_orderstatus").agg(
        rounded(F.sum("o_totalprice")).alias("total")).select("o_orderstatus", "total")


def agg_distinct_by_group(star: Star) -> DataFrame:
    return star.lineitem.select("l_partkey").distinct()


def text_checksum(column: Column | str) -> Column:
    """Sum of the character codes of a text."""
    return F.aggregate(
        F.split(column, ""), F.lit(0).cast("bigint"), lambda total, c: total + F.ascii(c))


def agg_checksum(star: Star) -> DataFrame:
    """Verification totals of all eight tables, over the key and all text columns."""
    out = None
    for name in ("region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem"):
        df = getattr(star, name)
        texts = [F.coalesce(F.col(c), F.lit("")) for c, kind in df.dtypes if kind == "string"]
        text = F.sum(text_checksum(F.concat(*texts))) if texts else F.lit(0).cast("bigint")
        row = df.agg(F.sum(F.col(df.columns[0]).cast("bigint")).alias("key_total"), text.alias("text_total")).select(
            F.lit(name).alias("tbl"), "key_total", "text_total")
        out = row if out is None else out.unionByName(row)
    return out


def agg_param_batch(star: Star) -> DataFrame:
    """Count and average per requested id; an id without rows keeps a zero count.

    The requests are the distinct users of the event table, the rows the orders of
    the customer with that key.
    """
    calls = star.raw("events").select(F.col("user_id").alias("id")).distinct()
    found = star.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), mean("o_totalprice", None).alias("average"))
    return calls.join(found, F.col("id") == F.col("o_custkey"), "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("n"), "average")


# --- ordering ----------------------------------------------------------------

def sort_multi(star: Star) -> DataFrame:
    return star.supplier.select(
        F.col("s_acctbal").cast("double").alias("s_acctbal"), "s_nationkey", "s_name"
    ).orderBy(F.desc("s_acctbal"), F.asc("s_nationkey"), F.desc("s_name"))


def sort_by_agg(star: Star) -> DataFrame:
    return star.orders.groupBy("o_orderpriority").agg(
        rounded(F.sum("o_totalprice")).alias("total")).orderBy(F.desc("total"))


def topk(star: Star, k: int = 100) -> DataFrame:
    return star.orders.select(
        "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")
    ).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(k)


def limit_unordered(star: Star, k: int = 10) -> DataFrame:
    return star.orders.select("o_orderkey", "o_orderstatus").limit(k)


def limit_unordered_count(star: Star, k: int = 10) -> DataFrame:
    """How many rows a limit without an order gives, and how many of them the table has."""
    some = limit_unordered(star, k)
    there = some.join(star.orders.select("o_orderkey", F.lit(1).alias("there")), "o_orderkey", "left")
    return there.agg(F.countDistinct("o_orderkey").alias("rows"), F.count("there").alias("members"))


def limit_offset(star: Star) -> DataFrame:
    return star.orders.select("o_orderkey").orderBy(F.desc("o_orderkey")).offset(1).limit(3)


def limit_offset_deep(star: Star, k: int = 5) -> DataFrame:
    """The ``k`` orders after the dearer half."""
    orders = star.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    half = orders.agg(F.floor(F.count(F.lit(1)) / 2)).first()[0]
    return paging.page(orders, [("o_totalprice", False), ("o_orderkey", True)], half, k)


# --- subqueries --------------------------------------------------------------

def subq_scalar(star: Star) -> DataFrame:
    average = star.customer.agg(
        F.sum("c_acctbal").cast("double") / F.count("c_acctbal")).scalar()
    return star.customer.filter(F.col("c_acctbal").cast("double") > average).select("c_custkey")


def subq_scalar_correlated(star: Star) -> DataFrame:
    """Offers at their part's lowest cost: the correlated minimum as a grouped one."""
    lowest = star.partsupp.groupBy(F.col("ps_partkey").alias("k")).agg(
        F.min("ps_supplycost").alias("lowest"))
    return star.partsupp.join(
        lowest, (F.col("ps_partkey") == F.col("k")) & (F.col("ps_supplycost") == F.col("lowest")),
        "left_semi",
    ).select("ps_partkey", "ps_suppkey")


def subq_from(star: Star) -> DataFrame:
    per_order = star.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("q"))
    return per_order.groupBy("lines").agg(
        F.count(F.lit(1)).alias("orders"), F.max("q").cast("double").alias("largest"))


def cte(star: Star) -> DataFrame:
    """A common table expression used twice."""
    return star.spark.sql(
        """
        with spending as (
            select o_custkey, sum(o_totalprice) as total from {orders} group by o_custkey)
        select o_custkey, round(cast(total as double), 2) as total
        from spending
        where total > (select cast(max(total) as double) * 0.75 from spending)
        """,
        orders=star.orders,
    )


def view(star: Star) -> DataFrame:
    """Create a view, bind a query to it, drop the view."""
    name = f"priority_counts_{uuid.uuid4().hex}"
    star.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")).createOrReplaceTempView(name)
    try:
        return star.spark.sql(f"select o_orderpriority, n from {name} where n > 10")
    finally:
        star.spark.catalog.dropTempView(name)


PLANS = {
    plan.__name__: plan
    for plan in (
        agg_group_multi, agg_global, agg_count_col, agg_count_distinct, agg_min_max,
        agg_conditional, agg_of_agg, agg_having, agg_having_subquery, agg_group_expr,
        agg_group_hidden, agg_distinct_by_group, agg_checksum, agg_param_batch,
        sort_multi, sort_by_agg, topk, limit_unordered, limit_unordered_count, limit_offset, limit_offset_deep,
        subq_scalar, subq_scalar_correlated, subq_from, cte, view,
    )
}
