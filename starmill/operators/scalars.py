"""Projections, predicates and scalar functions, one small plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.functions.money import rounded
from starmill.sources.star import Star

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --- projections -------------------------------------------------------------

def proj_arith(star: Star) -> DataFrame:
    """Discounted and taxed prices, percentages and fractions, from exact decimals."""
    price = F.col("l_extendedprice").cast("double")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return star.lineitem.select(
        *_LINE,
        net.cast("double").alias("disc_price"),
        (net * (1 + F.col("l_tax"))).cast("double").alias("charge"),
        F.round(100.00 * F.col("l_tax").cast("double") / price, 6).alias("tax_percent"),
        F.round(price / 7.0, 4).alias("weekly"),
        F.round(price / 2.0, 4).alias("half"),
    )


def proj_case(star: Star) -> DataFrame:
    return star.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high")
        .when(F.col("o_orderpriority") == "5-LOW", "low")
        .otherwise("normal").alias("level"),
    )


def proj_decode(star: Star) -> DataFrame:
    return star.orders.selectExpr(
        "o_orderkey",
        "decode(o_orderstatus, 'F', 'finished', 'O', 'open', 'partial') as status",
        "decode(o_orderpriority, '1-URGENT', 1, '2-HIGH', 1, 0) as is_high",
    )


def proj_cast_text(star: Star) -> DataFrame:
    return star.orders.filter(F.col("o_orderkey").cast("string").like("%88")).select("o_orderkey")


def proj_cast_out(star: Star) -> DataFrame:
    return star.orders.select(
        F.col("o_orderkey").cast("string").alias("orderkey_text"),
        F.year("o_orderdate").cast("int").alias("o_year"),
        F.col("o_totalprice").cast("double").alias("price"),
    )


def proj_alias(star: Star) -> DataFrame:
    """An output name equal to an input column; grouping binds the input column."""
    return (
        star.orders.groupBy("o_orderkey", "o_custkey")
        .agg(rounded(F.sum("o_totalprice")).alias("total"))
        .select(F.col("o_custkey").alias("o_orderkey"), "total")
    )


# --- filters -----------------------------------------------------------------

def filter_compare(star: Star) -> DataFrame:
    return star.lines(ship_before="1998-09-03").filter(
        (F.col("l_quantity") >= 10) & (F.col("l_quantity") < 40) & (F.col("l_returnflag") != "N")
        & (F.col("l_linenumber") > 1) & (F.col("l_linestatus") == "O")
    ).select(*_LINE)


def filter_between(star: Star) -> DataFrame:
    return star.lines("1996-01-01", "1997-07-01").filter(
        F.col("l_discount").between(F.lit("0.05").cast("decimal(4,2)"),
                                    F.lit("0.07").cast("decimal(4,2)"))
        & F.col("l_quantity").between(5, 25)
    ).select(*_LINE)


def filter_in_list(star: Star) -> DataFrame:
    return star.customer.filter(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
        & F.col("c_nationkey").isin(1, 3, 5, 7, 9, 11)
        & F.substring("c_phone", 1, 2).isin("11", "13", "15", "17", "29")
    ).select("c_custkey")


def filter_like(star: Star) -> DataFrame:
    name = F.col("p_name")
    return star.part.select(
        "p_partkey",
        name.like("red%").alias("by_prefix"),
        name.like("%widget").alias("by_suffix"),
        name.like("%d w%").alias("by_part"),
        name.like("%e%i%").alias("by_two_parts"),
        (~name.like("%blue%")).alias("without"),
    )


def filter_or_groups(star: Star) -> DataFrame:
    """OR of AND groups over a shared join key; part-side terms run before the join."""
    small = (F.col("p_size") <= 15) & F.col("p_container").like("SM%")
    large = (F.col("p_size") > 15) & F.col("p_container").like("LG%")
    return (
        star.lineitem.join(star.part.filter(small | large), F.col("l_partkey") == F.col("p_partkey"))
        .filter((small & (F.col("l_quantity") < 10)) | (large & (F.col("l_quantity") > 30)))
        .select(*_LINE)
    )


def filter_col_col(star: Star) -> DataFrame:
    return star.lineitem.filter(
        (F.col("l_shipdate") < F.col("l_commitdate"))
        & (F.col("l_commitdate") < F.col("l_receiptdate"))
    ).select(*_LINE)


def filter_constant_false(star: Star) -> DataFrame:
    return star.orders.filter((F.col("o_orderkey") >= 0) & F.lit(False)).agg(
        F.count(F.lit(1)).alias("n"))


def filter_parameter(star: Star) -> DataFrame:
    """Bound parameters, one of them inside an OR."""
    return star.spark.sql(
        "select l_orderkey, l_linenumber, l_partkey, l_suppkey from {lines}"
        " where (l_quantity > :quantity or l_extendedprice > :price) and l_suppkey > :supplier",
        args={"quantity": 45, "price": 90000, "supplier": 5},
        lines=star.lineitem,
    )


def filter_point(star: Star) -> DataFrame:
    return star.orders.filter(F.col("o_orderkey") == 155).agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions --------------------------------------------------------

def fn_extract_year(star: Star) -> DataFrame:
    return star.orders.select(
        "o_orderkey", F.extract(F.lit("year"), F.col("o_orderdate")).cast("int").alias("o_year"))


def fn_date_interval(star: Star) -> DataFrame:
    return star.orders.selectExpr(
        "o_orderkey",
        "cast(o_orderdate - interval '90' day as date) as days_before",
        "cast(o_orderdate + interval '3' month as date) as months_after",
        "cast(o_orderdate + interval '1' year as date) as year_after",
    )


def fn_substring(star: Star) -> DataFrame:
    return star.customer.selectExpr(
        "c_custkey",
        "substring(c_phone from 1 for 2) as country",
        "substr(c_mktsegment, 1, 3) as segment",
        "substr(c_name, 5, 4) as middle",
    )


def fn_ascii(star: Star) -> DataFrame:
    return star.customer.select(
        "c_custkey", F.ascii(F.substring("c_mktsegment", 1, 1)).alias("code"))


def fn_mod(star: Star) -> DataFrame:
    return star.part.select(
        "p_partkey", ((F.col("p_partkey") * (F.col("p_size") + 1)) % 10_000).alias("bucket"))


def fn_now(star: Star, now: Column | None = None) -> DataFrame:
    """Default timestamp; one value for the whole statement."""
    stamped = star.orders.withColumn(
        "occurred_at", now if now is not None else F.current_timestamp())
    return stamped.groupBy("o_orderstatus").agg(
        F.count("occurred_at").alias("n"),
        (F.min("occurred_at") == F.max("occurred_at")).alias("same"),
        (F.min("occurred_at") > F.to_timestamp(F.lit("2020-01-01"))).alias("recent"),
    )


def row_json() -> str:
    """Nested row as JSON; anonymous fields are named f1, f2, ..."""
    return (
        "to_json(named_struct('f1', o_orderkey, 'f2', o_custkey,"
        " 'f3', named_struct('f1', o_orderkey + 10, 'f2', o_custkey + 500, 'f3', o_orderkey * 7)))"
    )


def fn_row_to_json(star: Star) -> DataFrame:
    made = star.orders.selectExpr("o_orderkey", f"{row_json()} as value_1")
    return made.selectExpr(
        "o_orderkey",
        "cast(get_json_object(value_1, '$.f2') as bigint) as f2",
        "cast(get_json_object(value_1, '$.f3.f3') as bigint) as f3_f3",
    )


def fn_array_build(star: Star) -> DataFrame:
    made = star.orders.select(
        "o_orderkey",
        F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
                F.lit("first note"), F.lit("second note")).alias("value_2"),
    )
    return made.select(
        "o_orderkey", F.size("value_2").alias("n"), F.array_join("value_2", "|").alias("items"))


def int_range(lower: Column, upper: Column) -> Column:
    """Half-open integer range; a lower bound above the upper one is an error."""
    return F.when(
        lower <= upper, F.struct(lower.alias("lower"), upper.alias("upper"))
    ).otherwise(F.raise_error(F.lit("range lower bound must not exceed the upper bound")))


def fn_int_range(star: Star) -> DataFrame:
    """Ranges [custkey, custkey + orderkey), tested for containment and overlap."""
    made = star.orders.select(
        "o_orderkey",
        int_range(F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey")).alias("value_3"))
    lower, upper = F.col("value_3.lower"), F.col("value_3.upper")
    return made.select(
        "o_orderkey",
        (lower == upper).alias("is_empty"),
        ((lower <= 1000) & (F.lit(1000) < upper)).alias("holds_1000"),
        ((lower < upper) & (lower < 700) & (F.lit(500) < upper)).alias("overlaps"),
    )


def fn_composite(star: Star) -> DataFrame:
    made = star.orders.selectExpr(
        "o_orderkey",
        "named_struct('r', cast(o_orderkey as double), 'i', cast(o_totalprice as double)) as value_4")
    return made.select("o_orderkey", F.col("value_4.r").alias("r"), F.col("value_4.i").alias("i"))


def fn_citext(star: Star) -> DataFrame:
    """Case-insensitive grouping and comparison."""
    mixed = star.customer.selectExpr(
        "c_custkey",
        "case when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end"
        " collate UTF8_LCASE as segment",
    )
    return mixed.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.max((F.col("segment") == F.lit("Building"))).alias("is_building"),
    ).select(F.expr("lower(cast(segment as string collate UTF8_BINARY))").alias("segment"), "n",
             "is_building")


PLANS = {
    plan.__name__: plan
    for plan in (
        proj_arith, proj_case, proj_decode, proj_cast_text, proj_cast_out, proj_alias,
        filter_compare, filter_between, filter_in_list, filter_like, filter_or_groups,
        filter_col_col, filter_constant_false, filter_parameter, filter_point,
        fn_extract_year, fn_date_interval, fn_substring, fn_ascii, fn_mod, fn_now,
        fn_row_to_json, fn_array_build, fn_int_range, fn_composite, fn_citext,
    )
}
