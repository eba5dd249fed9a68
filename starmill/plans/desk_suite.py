"""The 22 analytic queries over the order-desk schema.

``supplier`` has 10,000 rows, ``nation`` 25 and ``region`` 5 by definition of the
schema, so these three are broadcast. Every list is cut at ten rows, as the suite
asks; a unique key ends each sort so that the cut is well defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starmill.functions.money import exact_mean, exact_sum, mean, rounded, share
from starmill.operators.joins import (
    in_order, null_aware_anti, opposite_pairs, spread, with_match, without_match)
from starmill.sources.desk import Desk, supplier_key

TOP = 10



def _home() -> Column:
    """Nation key of a customer: the code of the first letter of its state."""
    return F.ascii(F.substring("c_state", 1, 1))


def _orders_with_lines(desk: Desk, orders: DataFrame | None = None) -> DataFrame:
    return spread(desk.orders if orders is None else orders, desk.tasks, "o_w_id", "o_d_id", "o_id").join(
        spread(desk.order_line, desk.tasks, "ol_w_id", "ol_d_id", "ol_o_id"),
        (F.col("ol_w_id") == F.col("o_w_id"))
        & (F.col("ol_d_id") == F.col("o_d_id"))
        & (F.col("ol_o_id") == F.col("o_id")),
    )


def _customers_with_orders(desk: Desk) -> DataFrame:
    return in_order(desk.customer, desk.tasks).join(
        in_order(desk.orders, desk.tasks),
        (F.col("c_id") == F.col("o_c_id"))
        & (F.col("c_w_id") == F.col("o_w_id"))
        & (F.col("c_d_id") == F.col("o_d_id")),
    )


def _lines_with_stock(desk: Desk, warehouse: str = "ol_supply_w_id") -> DataFrame:
    """Order lines with a warehouse's stock row of their item, and its supplier key.

    ``warehouse`` names the supplying warehouse or the home one, ``ol_w_id``.
    """
    stock = desk.stock.select("s_w_id", "s_i_id", supplier_key().alias("s_suppkey"))
    return in_order(desk.order_line, desk.tasks).join(
        in_order(stock, desk.tasks),
        (F.col(warehouse) == F.col("s_w_id")) & (F.col("ol_i_id") == F.col("s_i_id")),
    )


def _suppliers_in(desk: Desk, region: Column) -> DataFrame:
    nations = desk.nation.join(
        F.broadcast(desk.region.filter(region)), F.col("n_regionkey") == F.col("r_regionkey"))
    return F.broadcast(
        desk.supplier.join(F.broadcast(nations), F.col("su_nationkey") == F.col("n_nationkey")))


def _suppliers_of(desk: Desk, nation: str) -> DataFrame:
    wanted = F.broadcast(desk.nation.filter(F.col("n_name") == nation))
    return F.broadcast(
        desk.supplier.join(wanted, F.col("su_nationkey") == F.col("n_nationkey"), "left_semi"))


def q01(desk: Desk) -> DataFrame:
    return (
        desk.order_line.groupBy("ol_number")
        .agg(
            F.sum("ol_quantity").alias("sum_qty"),
            rounded(exact_sum("ol_cents", 2)).alias("sum_amount"),
            mean("ol_quantity").alias("avg_qty"),
            exact_mean("ol_cents", 2).alias("avg_amount"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("ol_number").limit(TOP)
    )


def q02(desk: Desk) -> DataFrame:
    """Lowest stock of each item among European suppliers."""
    suppliers = _suppliers_in(desk, F.col("r_name").like("Europ%"))
    stocked = desk.stock.withColumn("s_suppkey", supplier_key()).join(
        suppliers, F.col("s_suppkey") == F.col("su_suppkey"))
    items = desk.item.filter(F.col("i_data").like("%b")).select("i_id", "i_name")
    offers = stocked.join(items, F.col("s_i_id") == F.col("i_id"))
    # An item has one offer per warehouse, so the join runs once and a window compares them.
    lowest = F.min("s_quantity").over(W.partitionBy("i_id"))
    return (
        offers.withColumn("_lowest", lowest).filter(F.col("s_quantity") == F.col("_lowest"))
        .select("su_suppkey", "su_name", "n_name", "i_id", "i_name", "su_address", "su_phone",
                "su_comment")
        .orderBy("n_name", "su_name", "i_id").limit(TOP)
    )


def q03(desk: Desk) -> DataFrame:
    customers = desk.customer.filter(F.col("c_state").like("A%"))
    open_orders = (
        desk.orders
        .join(
            customers,
            (F.col("c_id") == F.col("o_c_id")) & (F.col("c_w_id") == F.col("o_w_id"))
            & (F.col("c_d_id") == F.col("o_d_id")),
            "left_semi",
        )
        .join(
            desk.new_order,
            (F.col("no_w_id") == F.col("o_w_id")) & (F.col("no_d_id") == F.col("o_d_id"))
            & (F.col("no_o_id") == F.col("o_id")),
        )
    )
    totals = desk.order_line.groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(
        exact_sum("ol_cents", 2).alias("total"))
    return (
        totals.join(
            open_orders,
            (F.col("ol_w_id") == F.col("o_w_id")) & (F.col("ol_d_id") == F.col("o_d_id"))
            & (F.col("ol_o_id") == F.col("o_id")),
        )
        .select("ol_o_id", "ol_w_id", "ol_d_id", rounded(F.col("total")).alias("revenue"),
                "o_entry_d")
        .orderBy(F.desc("revenue"), "o_entry_d", "ol_o_id", "ol_w_id", "ol_d_id").limit(TOP)
    )


def q04(desk: Desk) -> DataFrame:
    """Orders with a line delivered on or after entry: one whose last delivery is."""
    last = desk.order_line.groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(
        F.max("ol_delivery_d").alias("last_delivery"))
    return (
        desk.orders.join(
            last,
            (F.col("o_id") == F.col("ol_o_id")) & (F.col("o_w_id") == F.col("ol_w_id"))
            & (F.col("o_d_id") == F.col("ol_d_id"))
            & (F.col("last_delivery") >= F.col("o_entry_d")),
            "left_semi",
        )
        .groupBy("o_ol_cnt").agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("o_ol_cnt").limit(TOP)
    )


def q05(desk: Desk) -> DataFrame:
    recent = _customers_with_orders(desk).filter(
        F.col("o_entry_d") >= F.lit("2015-01-02").cast("date")
    ).select("o_id", "o_w_id", "o_d_id", _home().alias("home"))
    lines = spread(recent, desk.tasks, "o_w_id", "o_d_id", "o_id").join(
        spread(_lines_with_stock(desk, "ol_w_id"), desk.tasks, "ol_w_id", "ol_d_id", "ol_o_id"),
        (F.col("ol_o_id") == F.col("o_id")) & (F.col("ol_w_id") == F.col("o_w_id"))
        & (F.col("ol_d_id") == F.col("o_d_id")),
    )
    suppliers = _suppliers_in(desk, F.col("r_name") == "Europe")
    return (
        lines.join(
            suppliers,
            (F.col("s_suppkey") == F.col("su_suppkey")) & (F.col("home") == F.col("su_nationkey")),
        )
        .groupBy("n_name").agg(rounded(exact_sum("ol_cents", 2)).alias("revenue"))
        .orderBy(F.desc("revenue"), "n_name").limit(TOP)
    )


def q06(desk: Desk) -> DataFrame:
    return desk.order_line.filter(F.col("ol_quantity").between(1, 100_000)).agg(
        rounded(exact_sum("ol_cents", 2)).alias("revenue")).limit(TOP)


def q07(desk: Desk) -> DataFrame:
    pairs = F.broadcast(
        opposite_pairs(desk.nation, "n_nationkey", "n_name", "Germany", "Cambodia"))
    ends = F.broadcast(
        desk.nation.filter(F.col("n_name").isin("Germany", "Cambodia")).select("n_nationkey"))
    suppliers = F.broadcast(
        desk.supplier.join(ends, F.col("su_nationkey") == F.col("n_nationkey"), "left_semi"))
    lines = _lines_with_stock(desk).join(suppliers, F.col("s_suppkey") == F.col("su_suppkey"))
    buyers = _customers_with_orders(desk).select(
        "o_id", "o_w_id", "o_d_id", "o_entry_d", _home().alias("home"),
        F.substring("c_state", 1, 1).alias("cust_nation"))
    return (
        spread(buyers, desk.tasks, "o_w_id", "o_d_id", "o_id").join(
            spread(lines, desk.tasks, "ol_w_id", "ol_d_id", "ol_o_id"),
            (F.col("ol_w_id") == F.col("o_w_id")) & (F.col("ol_d_id") == F.col("o_d_id"))
            & (F.col("ol_o_id") == F.col("o_id")),
        )
        .join(
            pairs,
            (F.col("su_nationkey") == F.col("first_key")) & (F.col("home") == F.col("second_key")),
            "left_semi",
        )
        .groupBy(F.col("su_nationkey").alias("supp_nation"), "cust_nation",
                 F.year("o_entry_d").alias("l_year"))
        .agg(rounded(exact_sum("ol_cents", 2)).alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year").limit(TOP)
    )


def q08(desk: Desk) -> DataFrame:
    items = desk.item.filter((F.col("i_id") < 1000) & F.col("i_data").like("%b")).select("i_id")
    europe = F.broadcast(
        desk.nation.join(
            F.broadcast(desk.region.filter(F.col("r_name") == "Europe")),
            F.col("n_regionkey") == F.col("r_regionkey"),
        ).select(F.col("n_nationkey").alias("home_key")))
    suppliers = F.broadcast(
        desk.supplier.join(
            F.broadcast(desk.nation), F.col("su_nationkey") == F.col("n_nationkey")
        ).select("su_suppkey", "n_name"))
    buyers = _customers_with_orders(desk).join(
        europe, _home() == F.col("home_key"), "left_semi"
    ).select("o_id", "o_w_id", "o_d_id", "o_entry_d")
    lines = (
        _lines_with_stock(desk)
        .join(in_order(items, desk.tasks), F.col("ol_i_id") == F.col("i_id"), "left_semi")
        .join(suppliers, F.col("s_suppkey") == F.col("su_suppkey"))
    )
    own = exact_sum(
        F.when(F.col("n_name") == "Germany", F.col("ol_cents")).otherwise(0), 2)
    return (
        spread(buyers, desk.tasks, "o_w_id", "o_d_id", "o_id").join(
            spread(lines, desk.tasks, "ol_w_id", "ol_d_id", "ol_o_id"),
            (F.col("ol_w_id") == F.col("o_w_id")) & (F.col("ol_d_id") == F.col("o_d_id"))
            & (F.col("ol_o_id") == F.col("o_id")),
        )
        .groupBy(F.year("o_entry_d").alias("l_year"))
        .agg(share(own, exact_sum("ol_cents", 2)).alias("mkt_share"))
        .orderBy("l_year").limit(TOP)
    )


def q09(desk: Desk) -> DataFrame:
    items = desk.item.filter(F.col("i_data").like("%BB")).select("i_id")
    suppliers = F.broadcast(
        desk.supplier.join(
            F.broadcast(desk.nation), F.col("su_nationkey") == F.col("n_nationkey")
        ).select("su_suppkey", "n_name"))
    lines = (
        _lines_with_stock(desk)
        .join(in_order(items, desk.tasks), F.col("ol_i_id") == F.col("i_id"), "left_semi")
        .join(suppliers, F.col("s_suppkey") == F.col("su_suppkey"))
    )
    return (
        spread(lines, desk.tasks, "ol_w_id", "ol_d_id", "ol_o_id").join(
            spread(desk.orders, desk.tasks, "o_w_id", "o_d_id", "o_id"),
            (F.col("ol_w_id") == F.col("o_w_id")) & (F.col("ol_d_id") == F.col("o_d_id"))
            & (F.col("ol_o_id") == F.col("o_id")),
        )
        .groupBy("n_name", F.year("o_entry_d").alias("l_year"))
        .agg(rounded(exact_sum("ol_cents", 2)).alias("sum_profit"))
        .orderBy("n_name", F.desc("l_year")).limit(TOP)
    )


def q10(desk: Desk) -> DataFrame:
    # The output keys do not include the warehouse, so two customers that share
    # all shown values form one row.
    spent = (
        _orders_with_lines(desk)
        .filter(F.col("o_entry_d") <= F.col("ol_delivery_d"))
        .groupBy("o_c_id", "o_w_id", "o_d_id")
        .agg(exact_sum("ol_cents", 2).alias("spent"))
    )
    buyers = desk.customer.join(
        spent,
        (F.col("c_id") == F.col("o_c_id")) & (F.col("c_w_id") == F.col("o_w_id"))
        & (F.col("c_d_id") == F.col("o_d_id")),
    ).join(F.broadcast(desk.nation), F.col("n_nationkey") == _home())
    return (
        buyers.groupBy("c_id", "c_last", "c_city", "c_phone", "n_name")
        .agg(rounded(F.sum("spent")).alias("revenue"))
        .select("c_id", "c_last", "revenue", "c_city", "c_phone", "n_name")
        .orderBy(F.desc("revenue"), "c_id", "c_last").limit(TOP)
    )


def q11(desk: Desk) -> DataFrame:
    counts = (
        desk.stock.withColumn("s_suppkey", supplier_key())
        .join(_suppliers_of(desk, "Germany"), F.col("s_suppkey") == F.col("su_suppkey"), "left_semi")
        .groupBy("s_i_id").agg(F.sum("s_order_cnt").alias("ordercount"))
    )
    threshold = counts.agg(F.sum("ordercount") * F.lit("0.005").cast("decimal(4,3)")).scalar()
    return counts.filter(F.col("ordercount") > threshold).orderBy(
        F.desc("ordercount"), "s_i_id").limit(TOP)


def q12(desk: Desk) -> DataFrame:
    high = F.col("o_carrier_id").isin(1, 2)
    return (
        _orders_with_lines(desk)
        .filter(F.col("o_entry_d") <= F.col("ol_delivery_d"))
        .groupBy("o_ol_cnt")
        .agg(F.count(F.when(high, 1)).alias("high_line_count"),
             F.count(F.when(~high, 1)).alias("low_line_count"))
        .orderBy("o_ol_cnt").limit(TOP)
    )


def q13(desk: Desk) -> DataFrame:
    # Orders are counted before the outer join, so a customer with very many
    # orders reaches the join as one row.
    counts = (
        desk.orders.filter(F.col("o_carrier_id") > 8)
        .groupBy("o_c_id", "o_w_id", "o_d_id").agg(F.count("o_id").alias("n"))
    )
    per_customer = (
        desk.customer.join(
            counts,
            (F.col("c_id") == F.col("o_c_id")) & (F.col("c_w_id") == F.col("o_w_id"))
            & (F.col("c_d_id") == F.col("o_d_id")),
            "left",
        )
        .groupBy("c_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("c_count"))
    )
    return (
        per_customer.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(F.desc("custdist"), F.desc("c_count")).limit(TOP)
    )


def q14(desk: Desk) -> DataFrame:
    promo = exact_sum(
        F.when(F.col("i_data").like("PR%"), F.col("ol_cents")).otherwise(0), 2)
    return (
        desk.order_line.join(desk.item, F.col("ol_i_id") == F.col("i_id"))
        .agg(F.round(100.0 * promo.cast("double") / (1 + exact_sum("ol_cents", 2)).cast("double"), 4)
             .alias("promo_revenue"))
        .limit(TOP)
    )


def q15(desk: Desk) -> DataFrame:
    revenue = (
        _lines_with_stock(desk).groupBy(F.col("s_suppkey").alias("supplier_no"))
        .agg(exact_sum("ol_cents", 2).alias("total_revenue"))
    )
    best = revenue.filter(
        F.col("total_revenue") == revenue.agg(F.max("total_revenue")).scalar())
    return (
        desk.supplier.join(best, F.col("su_suppkey") == F.col("supplier_no"))
        .select("su_suppkey", "su_name", "su_address", "su_phone",
                rounded(F.col("total_revenue")).alias("total_revenue"))
        .orderBy("su_suppkey").limit(TOP)
    )


def q16(desk: Desk) -> DataFrame:
    bad = desk.supplier.filter(F.col("su_comment").like("%bad%"))
    stock = null_aware_anti(
        desk.stock.select("s_i_id", supplier_key().alias("s_suppkey")), bad,
        "s_suppkey", "su_suppkey")
    items = desk.item.filter(~F.col("i_data").like("zz%"))
    return (
        stock.join(items, F.col("s_i_id") == F.col("i_id"))
        .groupBy("i_name", F.substring("i_data", 1, 3).alias("brand"), "i_price")
        .agg(F.countDistinct("s_suppkey").alias("supplier_cnt"))
        .select("i_name", "brand", F.col("i_price").cast("double").alias("i_price"), "supplier_cnt")
        .orderBy(F.desc("supplier_cnt"), "i_name", "brand", "i_price").limit(TOP)
    )


def q17(desk: Desk) -> DataFrame:
    """Half the value of lines below their item's average quantity.

    Lines are summed per (item, quantity) first; see the star suite's query 17.
    """
    items = desk.item.filter(F.col("i_data").like("%b")).select("i_id")
    by_quantity = (
        desk.order_line.join(items, F.col("ol_i_id") == F.col("i_id"), "left_semi")
        .groupBy("ol_i_id", "ol_quantity")
        .agg(exact_sum("ol_cents", 2).alias("amount"), F.count(F.lit(1)).alias("n"))
    )
    item = W.partitionBy("ol_i_id")
    below = F.col("ol_quantity") * F.sum("n").over(item) < F.sum(
        F.col("ol_quantity") * F.col("n")).over(item)
    return (
        by_quantity.withColumn("below", below).filter("below")
        .agg(F.round(F.sum("amount").cast("double") / 2.0, 4).alias("avg_yearly"))
        .limit(TOP)
    )


def q18(desk: Desk) -> DataFrame:
    """Largest orders; the shown ``o_id`` is the customer id, the group key is the order's."""
    totals = desk.order_line.groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(
        exact_sum("ol_cents", 2).alias("total")).filter(F.col("total") > 200)
    return (
        _customers_with_orders(desk)
        .join(
            totals,
            (F.col("ol_w_id") == F.col("o_w_id")) & (F.col("ol_d_id") == F.col("o_d_id"))
            & (F.col("ol_o_id") == F.col("o_id")),
        )
        .orderBy(F.desc("total"), "o_entry_d", "ol_o_id", "c_id").limit(TOP)
        .select("c_last", F.col("c_id").alias("o_id"), "o_entry_d", "o_ol_cnt",
                rounded(F.col("total")).alias("sum_amount"))
    )


def q19(desk: Desk) -> DataFrame:
    kind = F.lit(False)
    for letter, warehouses in (("a", (1, 2, 3)), ("b", (1, 2, 4)), ("c", (1, 5, 3))):
        kind = kind | (F.col("i_data").like(f"%{letter}") & F.col("ol_w_id").isin(*warehouses))
    items = desk.item.filter(
        F.col("i_price").between(1, 400_000) & F.col("i_data").rlike("[abc]$"))
    lines = desk.order_line.filter(F.col("ol_quantity").between(1, 10))
    return (
        lines.join(items, F.col("ol_i_id") == F.col("i_id")).filter(kind)
        .agg(rounded(exact_sum("ol_cents", 2)).alias("revenue")).limit(TOP)
    )


def q20(desk: Desk) -> DataFrame:
    """German suppliers whose stock is large against the sales of its items.

    Sales are summed per item before they meet the warehouses that stock it.
    """
    items = desk.item.filter(F.col("i_data").like("co%")).select("i_id")
    sold = (
        desk.order_line.join(items, F.col("ol_i_id") == F.col("i_id"), "left_semi")
        .groupBy("ol_i_id").agg(F.sum("ol_quantity").alias("sold"))
    )
    ample = desk.stock.withColumn("s_suppkey", supplier_key()).join(
        sold, (F.col("s_i_id") == F.col("ol_i_id")) & (F.col("s_quantity") * 2 > F.col("sold")))
    wanted = F.broadcast(desk.nation.filter(F.col("n_name") == "Germany"))
    suppliers = desk.supplier.join(
        wanted, F.col("su_nationkey") == F.col("n_nationkey"), "left_semi")
    return (
        with_match(suppliers, ample, {"su_suppkey": "s_suppkey"})
        .select("su_name", "su_address").orderBy("su_name").limit(TOP)
    )


def q21(desk: Desk) -> DataFrame:
    """German suppliers of the last delivered lines of late orders."""
    last = desk.order_line.groupBy(
        F.col("ol_o_id").alias("m_o_id"), F.col("ol_w_id").alias("m_w_id"),
        F.col("ol_d_id").alias("m_d_id"),
    ).agg(F.max("ol_delivery_d").alias("m_delivery_d"))
    lines = (
        _lines_with_stock(desk, "ol_w_id")
        .join(_suppliers_of(desk, "Germany"), F.col("s_suppkey") == F.col("su_suppkey"))
    )
    return (
        lines.join(
            last,
            (F.col("ol_o_id") == F.col("m_o_id")) & (F.col("ol_w_id") == F.col("m_w_id"))
            & (F.col("ol_d_id") == F.col("m_d_id"))
            & (F.col("ol_delivery_d") == F.col("m_delivery_d")),
            "left_semi",
        )
        .join(
            desk.orders,
            (F.col("ol_o_id") == F.col("o_id")) & (F.col("ol_w_id") == F.col("o_w_id"))
            & (F.col("ol_d_id") == F.col("o_d_id"))
            & (F.col("ol_delivery_d") > F.col("o_entry_d")),
            "left_semi",
        )
        .groupBy("su_name").agg(F.count(F.lit(1)).alias("numwait"))
        .orderBy(F.desc("numwait"), "su_name").limit(TOP)
    )


def q22(desk: Desk) -> DataFrame:
    candidates = desk.customer.filter(F.substring("c_phone", 1, 1).isin(*"1234567"))
    average = (
        candidates.filter(F.col("c_balance") > 0)
        .agg(F.sum("c_balance").cast("double") / F.count("c_balance")).scalar()
    )
    return (
        without_match(
            candidates.filter(F.col("c_balance").cast("double") > average), desk.orders,
            {"c_id": "o_c_id", "c_w_id": "o_w_id", "c_d_id": "o_d_id"})
        .groupBy(F.substring("c_state", 1, 1).alias("country"))
        .agg(F.count(F.lit(1)).alias("numcust"), rounded(F.sum("c_balance")).alias("totacctbal"))
        .orderBy("country").limit(TOP)
    )


def desk_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(plan: Callable[[Desk], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, path: plan(Desk(spark, path, idle_customers=True))

    return {f"ch_q{n:02d}": run(globals()[f"q{n:02d}"]) for n in range(1, 23)}
