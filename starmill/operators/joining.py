"""Join operators, one small plan each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions.money import net_sum, rounded
from starmill.functions.shared import shared_dir
from starmill.operators.joins import null_aware_anti, opposite_pairs, with_match, without_match
from starmill.operators.layout import write_colocated
from starmill.sources.desk import Desk, supplier_key
from starmill.sources.star import Star


def join_inner_equi(star: Star) -> DataFrame:
    return (
        star.orders.join(star.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    )


def join_composite_key(star: Star) -> DataFrame:
    cost = F.col("ps_supplycost") * F.col("l_quantity")
    return (
        star.lineitem.join(
            star.partsupp,
            (F.col("l_partkey") == F.col("ps_partkey"))
            & (F.col("l_suppkey") == F.col("ps_suppkey")),
        )
        .groupBy("l_returnflag").agg(rounded(F.sum(cost)).alias("cost"))
    )


def join_multiway(star: Star) -> DataFrame:
    """Seven tables, dimensions first so that each fact row is widened once."""
    buyers = (
        star.customer
        .join(F.broadcast(star.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(star.region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    orders = star.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "r_name")
    return (
        star.facts()
        .join(star.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(star.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"),
              "left_semi")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("r_name", "p_type")
        .agg(rounded(net_sum()).alias("revenue"), F.count(F.lit(1)).alias("n"))
    )


def join_self(star: Star) -> DataFrame:
    """Nation under two aliases: where the supplier is and where the customer is."""
    here, there = F.broadcast(star.nation).alias("here"), F.broadcast(star.nation).alias("there")
    orders = star.orders.join(star.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_nationkey")
    return (
        star.lineitem
        .join(star.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
        .join(here, F.col("s_nationkey") == F.col("here.n_nationkey"))
        .join(there, F.col("c_nationkey") == F.col("there.n_nationkey"))
        .select(F.col("here.n_name").alias("supp_nation"),
                F.col("there.n_name").alias("cust_nation"), "n")
    )


def join_left_outer(star: Star) -> DataFrame:
    """Outer join whose extra condition belongs to ON: it never drops a customer.

    An outer join cannot split a hot customer's orders over tasks, so they are
    counted before it; a customer without a match still makes one joined row.
    """
    large = star.orders.filter(F.col("o_totalprice") > 200_000).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"))
    matched = star.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left")
    return matched.groupBy("c_mktsegment").agg(
        F.sum(F.coalesce("n", F.lit(1))).alias("joined_rows"),
        F.sum(F.coalesce("n", F.lit(0))).alias("matches"))


def join_expr_key(star: Star) -> DataFrame:
    desk = Desk(star.spark, star.path)
    return (
        desk.stock.join(F.broadcast(desk.supplier), supplier_key() == F.col("su_suppkey"))
        .groupBy("su_nationkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("s_quantity").alias("quantity"))
    )


def join_semi_exists(star: Star) -> DataFrame:
    late = star.lineitem.filter(
        (F.col("l_commitdate") < F.col("l_receiptdate")) & (F.col("l_quantity") > 30))
    return with_match(star.orders, late, {"o_orderkey": "l_orderkey"}).select("o_orderkey")


def join_semi_in(star: Star) -> DataFrame:
    """IN three levels deep, with a grouped HAVING inside."""
    parts = star.part.filter(F.col("p_size") < 20)
    offers = star.partsupp.join(parts, F.col("ps_partkey") == F.col("p_partkey"), "left_semi")
    large = (
        with_match(star.lineitem, offers, {"l_suppkey": "ps_suppkey"})
        .groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter(F.col("q") > 150)
    )
    return star.orders.join(
        large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


def join_anti_not_exists(star: Star) -> DataFrame:
    return without_match(star.customer, star.orders, {"c_custkey": "o_custkey"}).select("c_custkey")


def join_anti_not_in(star: Star) -> DataFrame:
    returned = star.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return null_aware_anti(star.part, returned, "p_partkey", "l_partkey").select("p_partkey")


def join_anti_not_in_null(star: Star) -> DataFrame:
    """A null among the listed keys leaves no row."""
    keys = star.lineitem.select(F.nullif(F.col("l_partkey"), F.lit(1)).alias("k"))
    return null_aware_anti(star.part, keys, "p_partkey", "k").agg(F.count(F.lit(1)).alias("n"))


def join_semi_anti_nonequi(star: Star) -> DataFrame:
    """Late lines of orders with another supplier, none of the others late.

    Both conditions compare a line's supplier with the order's other suppliers,
    which the smallest and largest supplier key per order decide.
    """
    late = F.col("l_receiptdate") > F.col("l_commitdate")
    supp = F.col("l_suppkey")
    return (
        star.lineitem.groupBy("l_orderkey")
        .agg(F.min(supp).alias("lo"), F.max(supp).alias("hi"),
             F.min(F.when(late, supp)).alias("late_lo"), F.max(F.when(late, supp)).alias("late_hi"),
             F.count(F.when(late, 1)).alias("late_lines"))
        .filter((F.col("lo") != F.col("hi")) & (F.col("late_lo") == F.col("late_hi")))
        .select("l_orderkey", F.col("late_lo").alias("l_suppkey"), "late_lines")
    )


def join_cartesian_filter(star: Star) -> DataFrame:
    """Pairs of two nations out of a self product; the OR filter is an equality join."""
    pairs = F.broadcast(
        opposite_pairs(star.nation, "n_nationkey", "n_name", "NATION_6", "NATION_9"))
    return (
        star.supplier.join(pairs, F.col("s_nationkey") == F.col("first_key"))
        .groupBy("first_name", "second_name").agg(F.count(F.lit(1)).alias("suppliers"))
    )


def join_non_key_equi(star: Star) -> DataFrame:
    """Equality of unrelated columns, l_suppkey = o_shippriority.

    Nearly all orders share one ship priority, so both sides are counted per key
    before they meet: the join sees one row per key, not every pair.
    """
    lines = star.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = star.orders.groupBy("o_shippriority").agg(F.count(F.lit(1)).alias("orders"))
    return lines.join(orders, F.col("l_suppkey") == F.col("o_shippriority")).select(
        "l_suppkey", (F.col("lines") * F.col("orders")).alias("n"))


def join_broadcast_ref(star: Star) -> DataFrame:
    return (
        star.customer.join(F.broadcast(star.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(rounded(F.sum("c_acctbal")).alias("balance"))
    )


def join_colocated(star: Star, buckets: int | None = None) -> DataFrame:
    """Join of two tables bucketed alike on the order key: no exchange before the join.

    Order keys with many lines are cut, and their orders copied to each cut.
    """
    lines, orders = write_colocated(
        star.lineitem.select("l_orderkey", "l_quantity"), "l_orderkey",
        star.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey",
        shared_dir(star.spark, "colocated"), uuid.uuid4().hex[:8], buckets)
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (orders["_salt"] == lines["_salt"])
    return (
        orders.hint("merge").join(lines, on)
        .groupBy("o_orderstatus").agg(rounded(F.sum("l_quantity")).alias("quantity"))
    )


def join_repartition(star: Star) -> DataFrame:
    """Join off the distribution key; rows move by customer."""
    return (
        star.orders.join(star.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment").agg(rounded(F.sum("o_totalprice")).alias("total"))
    )


PLANS = {
    plan.__name__: plan
    for plan in (
        join_inner_equi, join_composite_key, join_multiway, join_self, join_left_outer,
        join_expr_key, join_semi_exists, join_semi_in, join_anti_not_exists, join_anti_not_in,
        join_anti_not_in_null, join_semi_anti_nonequi, join_cartesian_filter, join_non_key_equi,
        join_broadcast_ref, join_colocated, join_repartition,
    )
}
