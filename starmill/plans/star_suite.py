"""The 22 decision-support queries and their variants over the star schema.

Every plan takes a ``Star`` and its substitution parameters; the defaults are
the validation parameters of the public benchmark specification.

Only ``region`` and ``nation`` are broadcast by hint: the schema fixes them at 5
and 25 rows. All other build sides are left to Spark, which broadcasts them only
when their measured size allows and shuffles them otherwise.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starmill.functions.money import (
    exact_mean, exact_sum, net_price, net_sum, rounded, share)
from starmill.operators.joins import (
    null_aware_anti, opposite_pairs, with_match, without_match)
from starmill.sources.star import Star


def _months_after(day: str, months: int) -> str:
    d = date.fromisoformat(day)
    total = d.year * 12 + d.month - 1 + months
    return date(total // 12, total % 12 + 1, d.day).isoformat()


def _days_after(day: str, days: int) -> str:
    return date.fromordinal(date.fromisoformat(day).toordinal() + days).isoformat()


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _nations_of(star: Star, region: str) -> DataFrame:
    """Nations of one region; at most 25 rows."""
    wanted = star.region.filter(F.col("r_name") == region)
    return F.broadcast(
        star.nation.join(F.broadcast(wanted), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name")
    )


def _one_nation(star: Star, name: str) -> DataFrame:
    return F.broadcast(
        star.nation.filter(F.col("n_name") == name).select("n_nationkey", "n_name"))


def q01(star: Star, days: int = 90) -> DataFrame:
    """Pricing summary per return flag and line status."""
    lines = star.facts(ship_before=_days_after("1998-12-01", 1 - days))
    charge = net_price() * (100 + F.col("l_tax_percent"))
    return (
        lines.groupBy("l_returnflag", "l_linestatus")
        .agg(
            rounded(exact_sum("l_quantity_cents", 2)).alias("sum_qty"),
            rounded(exact_sum("l_price_cents", 2)).alias("sum_base_price"),
            rounded(net_sum()).alias("sum_disc_price"),
            rounded(exact_sum(charge, 6)).alias("sum_charge"),
            exact_mean("l_quantity_cents", 2).alias("avg_qty"),
            exact_mean("l_price_cents", 2).alias("avg_price"),
            exact_mean("l_discount_percent", 2).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def q02(star: Star, size: int = 15, type_suffix: str = "BRASS", region: str = "EUROPE",
        limit: int | None = 100) -> DataFrame:
    """Cheapest supplier of a region for parts of one size and type."""
    parts = (
        star.part.filter((F.col("p_size") == size) & F.col("p_type").endswith(type_suffix))
        .select("p_partkey", "p_mfgr")
    )
    suppliers = star.supplier.join(
        _nations_of(star, region), F.col("s_nationkey") == F.col("n_nationkey"))
    offers = (
        star.partsupp.select("ps_partkey", "ps_suppkey", "ps_supplycost")
        .join(parts, F.col("ps_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("ps_suppkey") == F.col("s_suppkey"))
    )
    # A part has a handful of offers, so the join runs once and a window compares them.
    lowest = F.min("ps_supplycost").over(W.partitionBy("p_partkey"))
    best = offers.withColumn("_lowest", lowest).filter(F.col("ps_supplycost") == F.col("_lowest"))
    return _top(
        best.select(
            F.col("s_acctbal").cast("double").alias("s_acctbal"), "s_name", "n_name",
            "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment",
        ).orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey"),
        limit,
    )


def q03(star: Star, segment: str = "BUILDING", day: str = "1995-03-15",
        limit: int | None = 10) -> DataFrame:
    """Unshipped orders of highest value."""
    customers = star.customer.filter(F.col("c_mktsegment") == segment).select("c_custkey")
    orders = (
        star.orders_between(None, day)
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_shippriority")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    )
    # The order key decides the other group columns, so lines are summed before
    # the join and the join reuses the partitioning of that sum.
    revenue = (
        star.facts(ship_from=_days_after(day, 1))
        .groupBy("l_orderkey")
        .agg(net_sum().alias("_revenue"))
    )
    return _top(
        revenue.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", rounded(F.col("_revenue")).alias("revenue"), "o_orderdate",
                "o_shippriority")
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey"),
        limit,
    )


def q04(star: Star, day: str = "1993-07-01") -> DataFrame:
    """Orders of a quarter with at least one late line, per priority."""
    late = star.facts().filter(F.col("l_commitdate") < F.col("l_receiptdate"))
    return (
        with_match(star.orders_between(day, _months_after(day, 3)), late,
                   {"o_orderkey": "l_orderkey"})
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("o_orderpriority")
    )


def q05(star: Star, region: str = "ASIA", day: str = "1994-01-01") -> DataFrame:
    """Revenue by nation from local suppliers."""
    nations = _nations_of(star, region)
    suppliers = star.supplier.join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", "s_nationkey", "n_name")
    orders = star.orders_between(day, _months_after(day, 12)).join(
        star.customer, F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "c_nationkey")
    return (
        star.facts()
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(
            suppliers,
            (F.col("l_suppkey") == F.col("s_suppkey"))
            & (F.col("c_nationkey") == F.col("s_nationkey")),
        )
        .groupBy("n_name")
        .agg(rounded(net_sum()).alias("revenue"))
        .orderBy(F.desc("revenue"))
    )


def q06(star: Star, day: str = "1994-01-01", discount: str = "0.06",
        quantity: int = 24) -> DataFrame:
    """Revenue gain from small discounted lines."""
    percent = int(Decimal(discount) * 100)
    return (
        star.facts(ship_from=day, ship_before=_months_after(day, 12))
        .filter(F.col("l_discount_percent").between(percent - 1, percent + 1))
        .filter(F.col("l_quantity_cents") < quantity * 100)
        .agg(rounded(exact_sum(F.col("l_price_cents") * F.col("l_discount_percent"), 4))
             .alias("revenue"))
    )


def _two_nation_volume(star: Star, one: str, other: str) -> DataFrame:
    """Line volumes shipped between two nations in 1995 and 1996."""
    pairs = F.broadcast(opposite_pairs(star.nation, "n_nationkey", "n_name", one, other))
    ends = star.nation.filter(F.col("n_name").isin(one, other)).select("n_nationkey")
    suppliers = star.supplier.join(
        F.broadcast(ends), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select("s_suppkey", "s_nationkey")
    customers = star.customer.join(
        F.broadcast(ends), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select("c_custkey", "c_nationkey")
    orders = star.orders.join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "c_nationkey")
    return (
        star.facts("1995-01-01", "1997-01-01")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(
            pairs,
            (F.col("s_nationkey") == F.col("first_key"))
            & (F.col("c_nationkey") == F.col("second_key")),
        )
        .select(
            F.col("first_name").alias("supp_nation"),
            F.col("second_name").alias("cust_nation"),
            F.year("l_shipdate").alias("l_year"),
            net_price().alias("volume"),
        )
    )


def q07(star: Star, nation1: str = "FRANCE", nation2: str = "GERMANY") -> DataFrame:
    """Trade volume between two nations per year."""
    return (
        _two_nation_volume(star, nation1, nation2)
        .groupBy("supp_nation", "cust_nation", "l_year")
        .agg(rounded(exact_sum("volume", 4)).alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year")
    )


def _market_volumes(star: Star, region: str, part_type: str) -> DataFrame:
    parts = star.part.filter(F.col("p_type") == part_type).select("p_partkey")
    customers = star.customer.join(
        _nations_of(star, region), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select("c_custkey")
    orders = star.orders_between("1995-01-01", "1997-01-01").join(
        customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    suppliers = star.supplier.join(
        F.broadcast(star.nation), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", "n_name")
    return (
        star.facts()
        .join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.year("o_orderdate").alias("o_year"),
            net_price().alias("volume"),
            F.col("n_name").alias("nation"),
        )
    )


def q08(star: Star, nation: str = "BRAZIL", region: str = "AMERICA",
        part_type: str = "ECONOMY ANODIZED STEEL") -> DataFrame:
    """Market share of a nation within a region for one part type."""
    own = exact_sum(F.when(F.col("nation") == nation, F.col("volume")).otherwise(0), 4)
    return (
        _market_volumes(star, region, part_type)
        .groupBy("o_year")
        .agg(share(own, exact_sum("volume", 4)).alias("mkt_share"))
        .orderBy("o_year")
    )


def q08a(star: Star, nation: str = "BRAZIL", region: str = "AMERICA",
         part_type: str = "ECONOMY ANODIZED STEEL") -> DataFrame:
    """``q08`` spelled with DECODE."""
    own = exact_sum(F.expr(f"decode(nation, '{nation}', volume, 0L)"), 4)
    return (
        _market_volumes(star, region, part_type)
        .groupBy("o_year")
        .agg(share(own, exact_sum("volume", 4)).alias("mkt_share"))
        .orderBy("o_year")
    )


def q09(star: Star, colour: str = "green", limit: int | None = None) -> DataFrame:
    """Profit per nation and year on parts whose name holds a word."""
    parts = star.part.filter(F.col("p_name").contains(colour)).select("p_partkey")
    suppliers = star.supplier.join(
        F.broadcast(star.nation), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", "n_name")
    lines = star.facts().join(
        parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    cost_cents = (F.col("ps_supplycost") * 100).cast("bigint").alias("cost_cents")
    costs = star.partsupp.select("ps_partkey", "ps_suppkey", cost_cents).join(
        parts, F.col("ps_partkey") == F.col("p_partkey"), "left_semi")
    # Both terms are in ten-thousandths.
    amount = net_price() - F.col("cost_cents") * F.col("l_quantity_cents")
    return _top(
        lines
        .join(
            costs,
            (F.col("l_partkey") == F.col("ps_partkey"))
            & (F.col("l_suppkey") == F.col("ps_suppkey")),
        )
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(star.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("n_name").alias("nation"),
            F.year("o_orderdate").alias("o_year"),
            amount.alias("amount"),
        )
        .groupBy("nation", "o_year")
        .agg(rounded(exact_sum("amount", 4)).alias("sum_profit"))
        .orderBy("nation", F.desc("o_year")),
        limit,
    )


def q10(star: Star, day: str = "1993-10-01", limit: int | None = 20) -> DataFrame:
    """Customers who returned the most value in a quarter."""
    returned = (
        star.facts().filter(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(net_sum().alias("_returned"))
    )
    spent = (
        star.orders_between(day, _months_after(day, 3))
        .join(returned, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("_returned").alias("_spent"))
    )
    # Customer columns depend on the key, so they are attached after the sum.
    return _top(
        spent.join(star.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(star.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", "c_name", rounded(F.col("_spent")).alias("revenue"),
            F.col("c_acctbal").cast("double").alias("c_acctbal"), "n_name", "c_address",
            "c_phone", "c_comment",
        )
        .orderBy(F.desc("revenue"), "c_custkey"),
        limit,
    )


def q11(star: Star, nation: str = "GERMANY", fraction: float = 0.0001) -> DataFrame:
    """Parts that make up a notable share of a nation's stock value."""
    suppliers = star.supplier.join(
        _one_nation(star, nation), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    values = (
        star.partsupp
        .join(suppliers, F.col("ps_suppkey") == F.col("s_suppkey"), "left_semi")
        .groupBy("ps_partkey")
        .agg(F.sum(F.col("ps_supplycost") * F.col("ps_availqty")).alias("value"))
    )
    # The exact total is taken over the grouped rows, so both uses share one shuffle.
    threshold = values.agg(F.sum("value").cast("double") * F.lit(fraction)).scalar()
    return (
        values.filter(F.col("value").cast("double") > threshold)
        .select("ps_partkey", F.round(F.col("value").cast("double"), 2).alias("value"))
        .orderBy(F.desc("value"), "ps_partkey")
    )


def _mode_lines(star: Star, mode1: str, mode2: str, day: str) -> DataFrame:
    late = star.facts().filter(
        F.col("l_shipmode").isin(mode1, mode2)
        & (F.col("l_commitdate") < F.col("l_receiptdate"))
        & (F.col("l_shipdate") < F.col("l_commitdate"))
        & (F.col("l_receiptdate") >= F.lit(day).cast("date"))
        & (F.col("l_receiptdate") < F.lit(_months_after(day, 12)).cast("date"))
    )
    return late.join(star.orders, F.col("l_orderkey") == F.col("o_orderkey"))


def q12(star: Star, mode1: str = "MAIL", mode2: str = "SHIP", day: str = "1994-01-01",
        limit: int | None = None) -> DataFrame:
    """Late lines of two ship modes by order priority."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return _top(
        _mode_lines(star, mode1, mode2, day)
        .groupBy("l_shipmode")
        .agg(
            F.count(F.when(urgent, 1)).alias("high_line_count"),
            F.count(F.when(~urgent, 1)).alias("low_line_count"),
        )
        .orderBy("l_shipmode"),
        limit,
    )


def q12a(star: Star, mode1: str = "MAIL", mode2: str = "SHIP",
         day: str = "1994-01-01") -> DataFrame:
    """``q12`` spelled with DECODE."""
    return (
        _mode_lines(star, mode1, mode2, day)
        .groupBy("l_shipmode")
        .agg(
            F.expr("sum(decode(o_orderpriority, '1-URGENT', 1, '2-HIGH', 1, 0))")
            .alias("high_line_count"),
            F.expr("sum(decode(o_orderpriority, '1-URGENT', 0, '2-HIGH', 0, 1))")
            .alias("low_line_count"),
        )
        .orderBy("l_shipmode")
    )


def _orders_per_customer(star: Star, word1: str, word2: str) -> DataFrame:
    """Customers with their count of orders not mentioning the two words.

    Orders are counted per customer before the join, so a customer that holds a
    large part of all orders is reduced map-side.
    """
    counts = (
        star.orders.filter(~F.col("o_comment").like(f"%{word1}%{word2}%"))
        .groupBy("o_custkey")
        .agg(F.count("o_orderkey").alias("_n"))
    )
    return star.customer.join(
        counts, F.col("c_custkey") == F.col("o_custkey"), "left"
    ).select("c_custkey", F.coalesce("_n", F.lit(0)).cast("bigint").alias("c_count"))


def q13(star: Star, word1: str = "special", word2: str = "requests") -> DataFrame:
    """Histogram of customers by order count."""
    return (
        _orders_per_customer(star, word1, word2)
        .groupBy("c_count")
        .agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(F.desc("custdist"), F.desc("c_count"))
    )


def q13a(star: Star, word1: str = "special", word2: str = "requests") -> DataFrame:
    """``q13`` through a view of its own that is dropped once the plan is bound."""
    return star.spark.sql(
        "select c_count as ordercount, count(*) as custdist from {orders_per_cust}"
        " group by c_count order by custdist desc, ordercount desc",
        orders_per_cust=_orders_per_customer(star, word1, word2),
    )


def _month_lines_with_type(star: Star, day: str) -> DataFrame:
    return star.facts(day, _months_after(day, 1)).join(
        star.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))


def q14(star: Star, day: str = "1995-09-01", limit: int | None = None) -> DataFrame:
    """Share of revenue from promotional parts in a month."""
    promo = exact_sum(F.when(F.col("p_type").startswith("PROMO"), net_price()).otherwise(0), 4)
    return _top(
        _month_lines_with_type(star, day).agg(
            F.round(100.0 * promo.cast("double") / net_sum().cast("double"), 4)
            .alias("promo_revenue")),
        limit,
    )


def q14a(star: Star, day: str = "1995-09-01") -> DataFrame:
    """``q14`` spelled with DECODE over a prefix."""
    promo = exact_sum(F.expr(
        "decode(substring(p_type, 1, 5), 'PROMO', l_price_cents * (100 - l_discount_percent), 0L)"
    ), 4)
    return _month_lines_with_type(star, day).agg(
        F.round(100.0 * promo.cast("double") / net_sum().cast("double"), 4)
        .alias("promo_revenue"))


def _quarter_revenue(star: Star, day: str) -> DataFrame:
    return (
        star.facts(day, _months_after(day, 3))
        .groupBy(F.col("l_suppkey").alias("supplier_no"))
        .agg(net_sum().alias("total_revenue"))
    )


def q15(star: Star, day: str = "1996-01-01") -> DataFrame:
    """Suppliers with the highest revenue of a quarter."""
    revenue = _quarter_revenue(star, day)
    best = revenue.filter(
        F.col("total_revenue") == revenue.agg(F.max("total_revenue")).scalar())
    return (
        star.supplier.join(best, F.col("s_suppkey") == F.col("supplier_no"))
        .select("s_suppkey", "s_name", "s_address", "s_phone",
                rounded(F.col("total_revenue")).alias("total_revenue"))
        .orderBy("s_suppkey")
    )


def q15a(star: Star, day: str = "1996-01-01") -> DataFrame:
    """``q15`` with a common table expression."""
    return star.spark.sql(
        """
        with best as (
            select supplier_no, total_revenue from {revenue}
            where total_revenue = (select max(total_revenue) from {revenue}))
        select s_suppkey, s_name, s_address, s_phone,
               round(cast(total_revenue as double), 2) as total_revenue
        from {supplier} join best on s_suppkey = supplier_no
        order by s_suppkey
        """,
        revenue=_quarter_revenue(star, day), supplier=star.supplier,
    )


def q16(star: Star, brand: str = "Brand#45", type_prefix: str = "MEDIUM POLISHED",
        sizes: tuple[int, ...] = (49, 14, 23, 45, 19, 3, 36, 9)) -> DataFrame:
    """Suppliers per part group, without suppliers that drew complaints."""
    parts = star.part.filter(
        (F.col("p_brand") != brand)
        & ~F.col("p_type").startswith(type_prefix)
        & F.col("p_size").isin(*sizes)
    ).select("p_partkey", "p_brand", "p_type", "p_size")
    complaints = star.supplier.filter(F.col("s_comment").like("%Customer%Complaints%"))
    offers = star.partsupp.select("ps_partkey", "ps_suppkey").join(
        parts, F.col("ps_partkey") == F.col("p_partkey"))
    return (
        null_aware_anti(offers, complaints, "ps_suppkey", "s_suppkey")
        .groupBy("p_brand", "p_type", "p_size")
        .agg(F.countDistinct("ps_suppkey").alias("supplier_cnt"))
        .orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")
    )


def q17(star: Star, brand: str = "Brand#23", container: str = "MED BOX") -> DataFrame:
    """Yearly loss if orders below a fifth of the average quantity were refused.

    Lines are first summed per (part, quantity). A part has few distinct
    quantities, so the window that compares them with the part's average sees
    small groups however many lines a part has, and lines are read once.
    """
    parts = star.part.filter(
        (F.col("p_brand") == brand) & (F.col("p_container") == container)).select("p_partkey")
    by_quantity = (
        star.facts().join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .groupBy("l_partkey", "l_quantity_cents")
        .agg(exact_sum("l_price_cents", 2).alias("price"), F.count(F.lit(1)).alias("n"))
    )
    part = W.partitionBy("l_partkey")
    # quantity < 0.2 * sum / count, kept exact by multiplying out
    small = F.col("l_quantity_cents") * F.sum("n").over(part) * 5 < F.sum(
        F.col("l_quantity_cents") * F.col("n")).over(part)
    return (
        by_quantity.withColumn("small", small)
        .filter("small")
        .agg(F.round(F.sum("price").cast("double") / 7.0, 4).alias("avg_yearly"))
    )


def q18(star: Star, quantity: int = 300, limit: int | None = 100) -> DataFrame:
    """Customers with very large orders.

    The quantity per order is needed both for the test and for the output, so
    lines are read and summed once.
    """
    large = (
        star.facts().groupBy("l_orderkey")
        .agg(exact_sum("l_quantity_cents", 2).alias("_quantity"))
        .filter(F.col("_quantity") > quantity)
    )
    return _top(
        star.orders.join(large, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(star.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "c_name", "c_custkey", "o_orderkey", "o_orderdate",
            F.col("o_totalprice").cast("double").alias("o_totalprice"),
            rounded(F.col("_quantity")).alias("sum_qty"),
        )
        .orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey"),
        limit,
    )


def q19(star: Star, brand1: str = "Brand#12", brand2: str = "Brand#23",
        brand3: str = "Brand#34", quantity1: int = 1, quantity2: int = 10,
        quantity3: int = 20, limit: int | None = None) -> DataFrame:
    """Discounted revenue of three kinds of air-shipped parts."""
    kinds = (
        (brand1, ("SM CASE", "SM BOX", "SM PACK", "SM PKG"), quantity1, 5),
        (brand2, ("MED BAG", "MED BOX", "MED PKG", "MED PACK"), quantity2, 10),
        (brand3, ("LG CASE", "LG BOX", "LG PACK", "LG PKG"), quantity3, 15),
    )
    on_part = on_both = F.lit(False)
    for brand, containers, quantity, size in kinds:
        part = (
            (F.col("p_brand") == brand)
            & F.col("p_container").isin(*containers)
            & F.col("p_size").between(1, size)
        )
        on_part = on_part | part
        on_both = on_both | (part & F.col("l_quantity_cents").between(quantity * 100, quantity * 100 + 1000))
    lines = star.facts().filter(
        F.col("l_shipmode").isin("AIR", "AIR REG")
        & (F.col("l_shipinstruct") == "DELIVER IN PERSON"))
    return _top(
        lines.join(star.part.filter(on_part), F.col("l_partkey") == F.col("p_partkey"))
        .filter(on_both)
        .agg(rounded(net_sum()).alias("revenue")),
        limit,
    )


def q20(star: Star, colour: str = "forest", day: str = "1994-01-01",
        nation: str = "CANADA") -> DataFrame:
    """Suppliers of a nation with excess stock of parts of one colour."""
    parts = star.part.filter(F.col("p_name").startswith(colour)).select("p_partkey")
    sold = (
        star.facts(day, _months_after(day, 12))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .groupBy("l_partkey", "l_suppkey")
        .agg(exact_sum("l_quantity_cents", 2).alias("_sold"))
    )
    excess = star.partsupp.select("ps_partkey", "ps_suppkey", "ps_availqty").join(
        sold,
        (F.col("ps_partkey") == F.col("l_partkey"))
        & (F.col("ps_suppkey") == F.col("l_suppkey"))
        & (F.col("ps_availqty") * 2 > F.col("_sold")),
        "left_semi",
    )
    suppliers = star.supplier.join(
        _one_nation(star, nation), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return (
        with_match(suppliers, excess, {"s_suppkey": "ps_suppkey"})
        .select("s_name", "s_address")
        .orderBy("s_name")
    )


def q21(star: Star, nation: str = "SAUDI ARABIA", limit: int | None = 100) -> DataFrame:
    """Suppliers who alone kept multi-supplier orders waiting.

    "Another supplier exists" and "no other supplier was late" are facts about
    the set of suppliers of an order, and the set has one member exactly when its
    smallest and largest keys agree. One aggregation per order replaces the two
    self joins of the line table.
    """
    late = F.col("l_receiptdate") > F.col("l_commitdate")
    supp = F.col("l_suppkey")
    per_order = (
        star.facts().groupBy("l_orderkey")
        .agg(
            F.min(supp).alias("lowest"),
            F.max(supp).alias("highest"),
            F.min(F.when(late, supp)).alias("late_lowest"),
            F.max(F.when(late, supp)).alias("late_highest"),
            F.count(F.when(late, 1)).alias("late_lines"),
        )
        .filter((F.col("lowest") != F.col("highest"))
                & (F.col("late_lowest") == F.col("late_highest")))
    )
    finished = star.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    suppliers = star.supplier.join(
        _one_nation(star, nation), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select("s_suppkey", "s_name")
    return _top(
        per_order.join(finished, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .join(suppliers, F.col("late_lowest") == F.col("s_suppkey"))
        .groupBy("s_name")
        .agg(F.sum("late_lines").alias("numwait"))
        .orderBy(F.desc("numwait"), "s_name"),
        limit,
    )


def q22(star: Star,
        codes: tuple[str, ...] = ("13", "31", "23", "29", "30", "18", "17")) -> DataFrame:
    """Well-funded customers without orders, per country code."""
    candidates = star.customer.withColumn(
        "cntrycode", F.substring("c_phone", 1, 2)
    ).filter(F.col("cntrycode").isin(*codes)).select("c_custkey", "cntrycode", "c_acctbal")
    average = (
        candidates.filter(F.col("c_acctbal") > 0)
        .agg(F.sum("c_acctbal").cast("double") / F.count("c_acctbal"))
        .scalar()
    )
    return (
        without_match(
            candidates.filter(F.col("c_acctbal").cast("double") > average),
            star.orders, {"c_custkey": "o_custkey"})
        .groupBy("cntrycode")
        .agg(F.count(F.lit(1)).alias("numcust"),
             rounded(F.sum("c_acctbal")).alias("totacctbal"))
        .orderBy("cntrycode")
    )
