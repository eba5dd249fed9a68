"""Registered runs of the prepared-statement and random-procedure workloads.

The random procedures act on tables (a, b): here a is an order's customer and b the
order. Each template answers for a whole batch of ids, the users of the events.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starmill.functions.money import mean, net_sum, rounded
from starmill.operators import dml
from starmill.operators.joins import opposite_pairs, spread
from starmill.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]


# --- prepared statements -----------------------------------------------------

def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def jdbc_count_orders(star: Star) -> DataFrame:
    return _count(star.orders)


def jdbc_join2(star: Star) -> DataFrame:
    return _count(star.orders.join(star.lineitem, F.col("o_orderkey") == F.col("l_orderkey")))


def jdbc_join2_cust(star: Star) -> DataFrame:
    return _count(star.orders.join(star.customer, F.col("o_custkey") == F.col("c_custkey")))


def jdbc_join3(star: Star) -> DataFrame:
    return _count(
        star.lineitem.join(star.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(star.customer, F.col("o_custkey") == F.col("c_custkey")))


def jdbc_join_param(star: Star, suppliers: tuple[int, ...] = (15, 155, 1555)) -> DataFrame:
    """One count per bound supplier key, all from one read of the lines."""
    joined = star.lineitem.join(star.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    counts = joined.agg(*[
        F.count(F.when(F.col("l_suppkey") > s, 1)).alias(str(s)) for s in suppliers])
    return counts.unpivot([], [str(s) for s in suppliers], "supplier", "n")


def jdbc_nation_pairs(star: Star, pairs_wanted: tuple[tuple[str, str], ...] = (
        ("NATION_6", "NATION_9"), ("NATION_3", "NATION_7"))) -> DataFrame:
    """Trade within each pair of nations; all pairs in one pass over the lines."""
    pairs = None
    for one, other in pairs_wanted:
        pair = opposite_pairs(star.nation, "n_nationkey", "n_name", one, other)
        pairs = pair if pairs is None else pairs.unionByName(pair)
    pairs = F.broadcast(pairs)
    orders = star.orders.join(star.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_nationkey")
    return (
        star.facts("1995-01-01", "1997-01-01")
        .join(star.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(pairs, (F.col("s_nationkey") == F.col("first_key"))
              & (F.col("c_nationkey") == F.col("second_key")))
        .groupBy(F.col("first_name").cast("string").alias("supp_nation"),
                 F.col("second_name").cast("string").alias("cust_nation"),
                 F.year("l_shipdate").cast("int").alias("l_year"))
        .agg(rounded(net_sum()).alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year")
    )


def _after_statements(star: Star) -> DataFrame:
    table = star.orders.select("o_orderkey", "o_totalprice")
    return dml.update_like(
        dml.delete_like(table, "o_orderkey", "%88"), "o_orderkey", "%89", "o_totalprice",
        F.col("o_totalprice") + 2)


def jdbc_delete_update_like(star: Star) -> DataFrame:
    return _after_statements(star).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice")).alias("total"))


def jdbc_sum_like(star: Star) -> DataFrame:
    """Sum over the keys just deleted: null, not zero."""
    deleted = _after_statements(star).filter(F.col("o_orderkey").cast("string").like("%88"))
    return deleted.agg(rounded(F.sum("o_totalprice")).alias("total"))


def jdbc_suppkey_prio(star: Star, values: tuple[int, ...] = tuple(range(10))) -> DataFrame:
    """Lines joined to orders on l_suppkey = o_shippriority, counted per part, for lines below
    and orders not at each value; all values in one pass.

    All orders share a ship priority, so listing each (part, order) would repeat the
    orders for every part. Both sides are counted per key before the join instead; a
    part's rows pair with each of ``orders``.
    """
    names = [f"v{v}" for v in values]
    lines = star.lineitem.groupBy("l_suppkey", "l_partkey").agg(*[
        F.count(F.when(F.col("l_quantity") < v, 1)).alias(f"v{v}") for v in values])
    orders = star.orders.groupBy("o_shippriority").agg(*[
        F.count(F.when(F.col("o_totalprice") != v, 1)).alias(f"v{v}") for v in values])
    value = F.substring("name", 2, 10).cast("int").alias("value")
    lines = lines.unpivot(["l_suppkey", "l_partkey"], names, "name", "lines").filter("lines > 0")
    orders = orders.unpivot(["o_shippriority"], names, "name", "orders").filter("orders > 0")
    return lines.join(
        orders.withColumnRenamed("name", "other"),
        (F.col("l_suppkey") == F.col("o_shippriority")) & (F.col("name") == F.col("other"))
    ).select(value, "l_partkey", "orders", (F.col("lines") * F.col("orders")).alias("n"))


def jdbc_join4_params(star: Star, quantity: int = 5, extended: int = 7, total: int = 5000,
                      balance: int = 6000) -> DataFrame:
    lines = star.lineitem.filter((F.col("l_quantity") > quantity) | (F.col("l_extendedprice") > extended)).join(
        star.part.filter(F.col("p_size") > 8), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    orders = star.orders.filter(F.col("o_totalprice") > total).join(
        star.customer.filter(F.col("c_acctbal") < balance), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return (
        spread(lines, star.tasks, "l_orderkey")
        .join(spread(orders, star.tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_partkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("l_partkey", "o_orderkey").limit(3000)
    )


def jdbc_join4_draws(star: Star, seed: int = 5, calls: int = 10, limit: int = 3000) -> DataFrame:
    """Rows that each of some drawn calls of the four-table join returns; one pass for all."""
    drawn = random.Random(seed)
    draws = [(drawn.randrange(10), drawn.randrange(10), drawn.randrange(10_000), drawn.randrange(10_000))
             for _ in range(calls)]
    lines = star.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").join(
        star.part.filter(F.col("p_size") > 8), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    orders = star.orders.join(star.customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = spread(lines, star.tasks, "l_orderkey").join(
        spread(orders, star.tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    meets = [
        ((F.col("l_quantity") > q) | (F.col("l_extendedprice") > e)) & (F.col("o_totalprice") > t)
        & (F.col("c_acctbal") < b) for q, e, t, b in draws]
    pairs = joined.groupBy("l_partkey", "o_orderkey").agg(*[
        F.max(m.cast("int")).alias(f"c{k}") for k, m in enumerate(meets)])
    counts = pairs.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(calls)])
    return counts.unpivot([], [f"c{k}" for k in range(calls)], "call", "found").select(
        F.substring("call", 2, 10).cast("int").alias("call"),
        F.least("found", F.lit(limit)).cast("bigint").alias("rows"))


# --- random procedure templates ----------------------------------------------

def _table(star: Star) -> DataFrame:
    return star.orders.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))


def _ids(star: Star) -> DataFrame:
    return star.raw("events").select(F.col("user_id").alias("id")).distinct()


def _per_id(ids: DataFrame, table: DataFrame, condition: Column, **outputs: Column) -> DataFrame:
    """Outputs per id over ``a = id and condition``; the table is reduced per a first."""
    found = table.filter(condition).groupBy("a").agg(
        *[column.alias(name) for name, column in outputs.items()])
    return ids.join(found, F.col("id") == F.col("a"), "left").drop("a")


def _counts(ids: DataFrame, table: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = _per_id(ids, table, F.lit(True) if condition is None else condition,
                   n=F.count(F.lit(1)))
    return rows.select("id", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_id(ids: DataFrame, table: DataFrame) -> DataFrame:
    return _counts(ids, table)


def count_never(ids: DataFrame, table: DataFrame) -> DataFrame:
    """``and false``: every id counts zero."""
    return _counts(ids, table, F.lit(False))


def update_by_id(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Set b to the id where a is one; shown as the sum of b per a."""
    changes = ids.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("seq"))
    return dml.update_set(table, changes, "a", "b").groupBy(F.col("a").alias("id")).agg(
        F.sum("b").alias("n"))


def insert_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    grown = dml.insert(table, ids.select(F.col("id").alias("a"), F.col("id").alias("b")))
    return grown.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def rows_by_id(ids: DataFrame, table: DataFrame) -> DataFrame:
    """All matching rows; an id without rows gives none."""
    return table.join(ids, F.col("a") == F.col("id"), "left_semi").select(F.col("a").alias("id"))


def _cut(answers: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` and ``offset`` within the answer of each id.

    Spark pushes the upper rank below the shuffle, so an id with very many rows sends a
    few per task.
    """
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("id")))
    return answers.withColumn("place", place).filter(
        (F.col("place") <= limit + offset) & (F.col("place") > offset)).drop("place")


def count_limited(ids: DataFrame, table: DataFrame) -> DataFrame:
    """A limit of three on an answer of one row."""
    return _cut(_counts(ids, table), 3)


def count_skipped(ids: DataFrame, table: DataFrame) -> DataFrame:
    """An offset of one on an answer of one row."""
    return _cut(_counts(ids, table), 3, 1)


def rows_skipped(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Per id, rows two to four of its equal rows, counted."""
    return _cut(rows_by_id(ids, table), 3, 1).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def distinct_by_id(ids: DataFrame, table: DataFrame) -> DataFrame:
    return _counts(ids, table).filter(F.col("n") > 0).select("id")


def average_by_id(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Grouped average: an id without rows gives no row."""
    return _per_id(ids, table, F.lit(True), average=mean("b", None)).filter(
        F.col("average").isNotNull())


TEMPLATES = (
    count_by_id, count_never, update_by_id, insert_ids, rows_by_id, count_limited,
    count_skipped, rows_skipped, distinct_by_id, average_by_id, count_never,
)


def rand_suite(star: Star, seed: int = 11, calls: int = 12) -> DataFrame:
    """A seeded choice of reading templates: rows and total of each call.

    Plans are pure functions of the tables, so a repeated call answers alike.
    """
    chosen = random.Random(seed)
    reading = [i for i, t in enumerate(TEMPLATES) if t not in (update_by_id, insert_ids)]
    ids, table = _ids(star), _table(star)
    out = None
    for call in range(calls):
        number = chosen.choice(reading)
        answer = TEMPLATES[number](ids, table)
        value = "n" if "n" in answer.columns else "id"
        row = answer.agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(value), F.lit(0)).alias("total")
        ).select(F.lit(call).alias("call"), F.lit(number + 1).alias("template"), "rows", "total")
        out = row if out is None else out.unionByName(row)
    return out


PLANS = (
    jdbc_count_orders, jdbc_join2, jdbc_join2_cust, jdbc_join3, jdbc_join_param,
    jdbc_nation_pairs, jdbc_delete_update_like, jdbc_sum_like, jdbc_suppkey_prio,
    jdbc_join4_params, jdbc_join4_draws, rand_suite,
)


def workload_queries() -> dict[str, Query]:
    def run(plan: Callable[[Star], DataFrame]) -> Query:
        return lambda spark, path: plan(Star(spark, path, idle_customers=True))

    def template(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        def answer(spark: SparkSession, path: str) -> DataFrame:
            star = Star(spark, path, idle_customers=True)
            return plan(_ids(star), _table(star))
        return answer

    out = {plan.__name__: run(plan) for plan in PLANS}
    out |= {f"rand_tpl_{i:02d}": template(plan) for i, plan in enumerate(TEMPLATES, 1)}
    return out
