"""Registered runs of table upkeep, constraint checks and layouts on the given tables.

Events act as the batches of changes: their time gives the order of changes, their
user the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.money import rounded
from starmill.functions.shared import shared_dir
from starmill.operators import checks, dml, layout
from starmill.operators.joins import in_order
from starmill.operators.scalars import row_json
from starmill.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]


def _accounts(star: Star) -> DataFrame:
    return star.customer.select(
        F.col("c_custkey").alias("aid"), F.lit(0).cast("bigint").alias("abalance"))


def _batch(star: Star) -> DataFrame:
    """Transactions out of the events: account, teller, branch and amount."""
    return star.raw("events").select(
        F.col("user_id").alias("aid"), (F.col("user_id") % 10).alias("tid"),
        (F.col("user_id") % 3).alias("bid"),
        (F.col("event_id") * 7919 % 10_001 - 5000).alias("delta"), F.col("event_id").alias("seq"))


def _keyed(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(
        F.col("id").alias(key), F.lit(0).cast("bigint").alias(f"{key[0]}balance"))


def dml_insert(star: Star) -> DataFrame:
    """Events become new customers with a key beyond the table and a default segment."""
    table = star.customer.select("c_custkey", "c_name", "c_mktsegment")
    first = table.agg(F.max("c_custkey") + 1).scalar()
    rows = star.raw("events").select((F.col("event_id") + first).alias("c_custkey"))
    return dml.insert(table, rows, {"c_mktsegment": F.lit("NEW")})


def dml_update_set(star: Star) -> DataFrame:
    changes = star.raw("events").select(
        F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"),
        F.col("event_id").alias("seq"))
    return dml.update_set(
        star.customer.select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment")


def dml_update_delta(star: Star) -> DataFrame:
    """Balances of accounts, tellers and branches and the history size after a batch."""
    batch = _batch(star)
    history = batch.filter(F.lit(False)).select("tid", "bid", "aid", "delta").withColumn(
        "mtime", F.current_timestamp())
    after = dml.post_transactions(
        _accounts(star), _keyed(batch, "tid", 10), _keyed(batch, "bid", 3), history, batch,
        F.current_timestamp())
    return (
        after["accounts"].select(F.lit("account").alias("kind"), F.col("aid").alias("id"),
                                 F.col("abalance").alias("value"))
        .unionByName(after["tellers"].select(
            F.lit("teller").alias("kind"), F.col("tid").alias("id"), F.col("tbalance").alias("value")))
        .unionByName(after["branches"].select(
            F.lit("branch").alias("kind"), F.col("bid").alias("id"), F.col("bbalance").alias("value")))
        .unionByName(after["history"].groupBy(F.col("tid").alias("id")).agg(
            F.count("mtime").alias("value")).select(F.lit("history").alias("kind"), "id", "value"))
    )


def dml_update_all_but(star: Star) -> DataFrame:
    return dml.update_all_but(
        star.supplier.select("s_suppkey", "s_name"), "s_suppkey", 7, "s_name", F.lit("moved"))


def dml_update_like(star: Star) -> DataFrame:
    table = star.orders.select("o_orderkey", "o_totalprice")
    changed = dml.update_like(
        dml.delete_like(table, "o_orderkey", "%88"), "o_orderkey", "%89", "o_totalprice",
        F.col("o_totalprice") + 2)
    return changed.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def dml_delete_keys(star: Star) -> DataFrame:
    gone = star.raw("events").select(F.col("event_id").alias("k"))
    return dml.delete_keys(star.lineitem, gone, "l_orderkey", "k", star.tasks).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"))


def dml_insert_select(star: Star) -> DataFrame:
    """Insert-select with a condition on rows and with a constant that holds for none."""
    table = star.orders.select("o_orderkey", "o_orderstatus")
    more = dml.insert_select(table, table, F.col("o_orderstatus") == "F")
    none = dml.insert_select(more, table, F.lit(2000) < F.lit(1000))
    return none.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def dml_insert_select_limit(star: Star, limit: int = 10) -> DataFrame:
    """At most ten rows of two keys, the smallest and the largest, copied into the table."""
    table = star.orders.select("o_orderkey", "o_orderstatus")
    ends = table.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    wanted = (F.col("o_orderkey") == ends.select("low").scalar()) | (F.col("o_orderkey") == ends.select("high").scalar())
    return dml.insert_select(table, table, wanted, limit).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def dml_insert_on_conflict(star: Star) -> DataFrame:
    table = star.supplier.select("s_suppkey", "s_name")
    rows = star.raw("events").select(
        F.col("user_id").alias("s_suppkey"), F.col("event_type").alias("s_name"),
        F.col("event_id").alias("seq"))
    return dml.insert_on_conflict(table, rows, "s_suppkey", "seq")


def dml_refresh_pair(star: Star) -> DataFrame:
    """Orders and lines after a set: every tenth order again under a new key, then the
    orders named by the events are deleted."""
    orders = star.orders.select("o_orderkey", "o_orderstatus")
    lines = star.lineitem.select("l_orderkey", "l_quantity")
    shift = orders.agg(F.max("o_orderkey") + 1).scalar()
    new_orders = orders.filter(F.col("o_orderkey") % 10 == 0).withColumn(
        "o_orderkey", F.col("o_orderkey") + shift)
    new_lines = lines.filter(F.col("l_orderkey") % 10 == 0).withColumn(
        "l_orderkey", F.col("l_orderkey") + shift)
    deleted = star.raw("events").select(F.col("event_id").alias("o_orderkey"))
    after_orders, after_lines = dml.refresh(orders, lines, new_orders, new_lines, deleted, star.tasks)
    per_order = after_lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return (
        after_orders.join(in_order(per_order, star.tasks), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("orders"), rounded(F.sum("q")).alias("quantity"))
    )


def dq_primary_key(star: Star) -> DataFrame:
    """Line keys that repeat."""
    return checks.primary_key(star.lineitem, checks.PRIMARY_KEYS["lineitem"])


def dq_foreign_key(star: Star) -> DataFrame:
    return checks.star_foreign_keys(star)


def dq_orphans(star: Star) -> DataFrame:
    """Event users that are no customers with orders."""
    return checks.foreign_key(star.raw("events"), ["user_id"], star.orders, ["o_custkey"])


def dq_check(star: Star) -> DataFrame:
    rows = star.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("value_3"))
    return checks.check(rows, F.col("value_3") > 10)


def dq_defaults_notnull(star: Star) -> DataFrame:
    rows = star.raw("events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("value_1"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("value_2"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("value_3"))
    filled = checks.fill_defaults(rows, {"value_1": F.lit(5), "value_2": F.lit(10)})
    return checks.not_null(filled, ["value_1", "value_2", "value_3"])


def dq_referencing_insert(star: Star) -> DataFrame:
    """Events put into a table that refers to the customers with orders, with defaults and a check.

    ``value_1`` is left out by odd events and takes its default, ``value_2`` by all;
    ``value_3`` must be above ten and the key must exist. Rows per outcome, and their sums.
    """
    rows = star.raw("events").select(
        F.col("user_id").alias("key"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("value_1"),
        F.lit(None).cast("bigint").alias("value_2"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100).alias("value_3"))
    judged = checks.referencing_insert(
        checks.fill_defaults(rows, {"value_1": F.lit(5), "value_2": F.lit(10)}),
        "key", star.orders, "o_custkey", F.col("value_3") > 10)
    return judged.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_1").alias("value_1"), F.sum("value_2").alias("value_2"),
        F.sum("value_3").alias("value_3"))


def dq_tenant_keys(star: Star) -> DataFrame:
    """Per tenant, rows of tables 1 to 3 whose number is no id of the tenant's own table 0."""
    rows = _tenants(star).withColumn("number", F.floor(F.col("id") / 8) * 8)
    orphans = checks.foreign_key(
        rows.filter("tbl > 0"), ["tenant", "number"],
        rows.filter("tbl = 0").select(F.col("tenant").alias("_tenant"), F.col("id").alias("_id")), ["_tenant", "_id"])
    return orphans.groupBy("tenant").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))


def table_distribute(star: Star) -> DataFrame:
    """The same count per status from the hash, reference and append layouts."""
    spark, tag = star.spark, uuid.uuid4().hex[:8]
    source = star.orders.select("o_orderkey", "o_orderstatus")
    out = None
    for kind in ("hash", "reference", "append"):
        stored = layout.table_distribute(
            source, kind, shared_dir(spark, kind), f"orders_{kind}_{tag}", "o_orderkey")
        rows = stored.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("layout"), "o_orderstatus", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def _tenants(star: Star) -> DataFrame:
    return star.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data"),
        (F.col("o_custkey") % 10).cast("int").alias("tenant"),
        (F.col("o_orderkey") % 4).cast("int").alias("tbl"))


def tenant_read(star: Star, tenant: int = 4, tbl: int = 1) -> DataFrame:
    """The row with the largest key of one tenant's table, read by that key from its folder."""
    path = shared_dir(star.spark, "tenants")
    rows = _tenants(star)
    layout.write_tenants(rows, path)
    own = rows.filter((F.col("tenant") == tenant) & (F.col("tbl") == tbl))
    key = own.agg(F.max("id").alias("id")).first()["id"]
    return layout.read_tenant(star.spark, path, tenant, tbl, key).select("id", "data")


def tenant_layout(star: Star) -> DataFrame:
    """Orders stored per tenant and table, counted per folder."""
    path = shared_dir(star.spark, "tenants")
    layout.write_tenants(_tenants(star), path)
    whole = star.spark.read.parquet(path)
    return whole.groupBy("tenant", "tbl").agg(F.count("id").alias("n"))


def wide_table(star: Star) -> DataFrame:
    """A 100-column table with few columns filled; a query reads two of them."""
    path = shared_dir(star.spark, "wide")
    filled = {
        "key": F.col("o_orderkey"), "value_1": F.col("o_custkey"),
        "value_4": F.col("o_orderpriority"), "value_94": F.expr(row_json()),
    }
    columns = [filled.get("key").alias("key")]
    for number in range(1, 100):
        name = f"value_{number}"
        kind = "int" if number <= 3 else "string"
        columns.append(filled.get(name, F.lit(None)).cast(kind).alias(name))
    star.orders.select(*columns).write.mode("overwrite").parquet(path)
    wide = star.spark.read.parquet(path)
    return wide.groupBy("value_4").agg(F.count("key").alias("n"))


PLANS = (
    dml_insert, dml_update_set, dml_update_delta, dml_update_all_but, dml_update_like,
    dml_delete_keys, dml_insert_select, dml_insert_select_limit, dml_insert_on_conflict, dml_refresh_pair,
    dq_primary_key, dq_foreign_key, dq_orphans, dq_check, dq_defaults_notnull, dq_referencing_insert, dq_tenant_keys,
    table_distribute, tenant_layout, tenant_read, wide_table,
)


def upkeep_queries() -> dict[str, Query]:
    def run(plan: Callable[[Star], DataFrame]) -> Query:
        return lambda spark, path: plan(Star(spark, path, idle_customers=True))

    return {plan.__name__: run(plan) for plan in PLANS}
