"""The eight tables as expressions over row numbers.

Each function takes a DataFrame with a one-based ``row`` column, so any subset of
rows can be made anywhere: a whole table, one chunk, or the rows another table
names. Money is computed in integer cents. ``pool`` is the comment pool of
``text.py``; without it the comment columns are left out.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.generator import words
from starmill.generator.scale import SUPPLIERS_PER_PART, Scale, row_numbers
from starmill.generator.streams import (
    alphanumeric, draw, draw_at, jump, phone, pick, pick_index, uniform)
from starmill.generator.text import Pool, comment_span, with_comment

MOST_LINES = 7
DAYS_OF_ORDERS = words.DAYS - (121 + 30)  # the last order can still ship and arrive
_CUTOFF = (date.fromisoformat(words.CUTOFF_DATE) - date.fromisoformat(words.START_DATE)).days


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")


def _hundredths(value: Column) -> Column:
    return (value.cast("decimal(4,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(4,2)")


def _day(offset: Column) -> Column:
    return F.date_add(F.lit(words.START_DATE).cast("date"), offset.cast("int"))


def _tag(prefix: str, number: Column, width: int = 9) -> Column:
    """Prefix and zero-padded number; a longer number is kept whole."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), padded)


def retail_price(part: Column) -> Column:
    """Price of a part in cents."""
    return 90_000 + F.floor(part / 10) % 20_001 + (part % 1000) * 100


def offered_supplier(part: Column, slot: Column, suppliers: int) -> Column:
    """Supplier in one of the four slots of a part."""
    shift = suppliers // SUPPLIERS_PER_PART + F.floor((part - 1) / suppliers)
    return (part + slot * shift) % suppliers + 1


def sparse_key(row: Column, set_number: int | Column = 0) -> Column:
    """Order key: eight of every 32 keys are used, by set number in groups of eight."""
    group = F.shiftleft(F.shiftright(row, 3), 2) + set_number
    return F.shiftleft(group, 3) + row.bitwiseAND(7)


def _with_comment(df: DataFrame, pool: Pool | None, stream: str, jumped: Column, out: str,
                  before: Column | int = 0) -> DataFrame:
    if pool is None:
        return df
    return with_comment(df, pool, comment_span(stream, jumped, pool.characters, before), out)


def region(spark: SparkSession, pool: Pool | None = None) -> DataFrame:
    names = F.array(*[F.lit(n) for n in words.REGIONS])
    rows = row_numbers(spark, 1, len(words.REGIONS), 1).withColumn("j2", jump(F.col("row"), 2))
    made = rows.select(
        (F.col("row") - 1).cast("int").alias("r_regionkey"),
        F.get(names, (F.col("row") - 1).cast("int")).alias("r_name"), "j2")
    return _with_comment(made, pool, "region_comment", F.col("j2"), "r_comment").drop("j2")


def nation(spark: SparkSession, pool: Pool | None = None) -> DataFrame:
    names = F.array(*[F.lit(n) for n in words.NATIONS])
    regions, region_key = [], 0
    for _, step in words.NATION_STEPS:
        region_key += step
        regions.append(region_key)
    rows = row_numbers(spark, 1, len(words.NATIONS), 1).withColumn(
        "j2", jump(F.col("row"), 2))
    index = (F.col("row") - 1).cast("int")
    made = rows.select(
        index.alias("n_nationkey"), F.get(names, index).alias("n_name"),
        F.get(F.array(*[F.lit(r) for r in regions]), index).alias("n_regionkey"), "j2")
    return _with_comment(made, pool, "nation_comment", F.col("j2"), "n_comment").drop("j2")


def supplier(rows: DataFrame, pool: Pool | None = None) -> DataFrame:
    jumped = rows.select(
        "row", *[jump(F.col("row"), n).alias(f"j{n}") for n in (1, 2, 3, 9)])
    j1 = F.col("j1")
    nation_key = pick_index(draw("supplier_nation", j1, 1), len(words.NATIONS))
    made = jumped.select(
        F.col("row").alias("s_suppkey"),
        _tag("Supplier#", F.col("row")).alias("s_name"),
        alphanumeric("supplier_address", F.col("j9"), words.ADDRESS_AVERAGE).alias("s_address"),
        nation_key.cast("int").alias("s_nationkey"),
        phone("supplier_phone", F.col("j3"), nation_key).alias("s_phone"),
        _money(uniform(draw("supplier_balance", j1, 1), -99_999, 999_999)).alias("s_acctbal"),
        "j1", "j2",
    )
    made = _with_comment(made, pool, "supplier_comment", F.col("j2"), "s_comment")
    if pool is not None:
        made = made.withColumn("s_comment", _notice(F.col("s_comment"), j1))
    return made.drop("j1", "j2")


def _notice(comment: Column, jumped: Column) -> Column:
    """Put "Customer ... Complaints" or "... Recommends" into ten of 10,000 comments."""
    head, tails = "Customer ", ("Complaints", "Recommends")
    room = F.length(comment) - len(head) - len(tails[0])
    gap = uniform(draw("notice_gap", jumped, 1), 0, room)
    offset = uniform(draw("notice_offset", jumped, 1), 0, room - gap)
    kind = F.when(uniform(draw("notice_kind", jumped, 1), 0, 100) < 50, tails[0]).otherwise(tails[1])
    marked = F.overlay(
        F.overlay(comment, F.lit(head), (offset + 1).cast("int")),
        kind, (offset + len(head) + gap + 1).cast("int"))
    return F.when(uniform(draw("notice_pick", jumped, 1), 1, 10_000) <= 10, marked).otherwise(comment)


def customer(rows: DataFrame, pool: Pool | None = None) -> DataFrame:
    jumped = rows.select(
        "row", *[jump(F.col("row"), n).alias(f"j{n}") for n in (1, 2, 3, 9)])
    j1 = F.col("j1")
    nation_key = pick_index(draw("customer_nation", j1, 1), len(words.NATIONS))
    made = jumped.select(
        F.col("row").alias("c_custkey"),
        _tag("Customer#", F.col("row")).alias("c_name"),
        alphanumeric("customer_address", F.col("j9"), words.ADDRESS_AVERAGE).alias("c_address"),
        nation_key.cast("int").alias("c_nationkey"),
        phone("customer_phone", F.col("j3"), nation_key).alias("c_phone"),
        _money(uniform(draw("customer_balance", j1, 1), -99_999, 999_999)).alias("c_acctbal"),
        pick(draw("customer_segment", j1, 1), words.SEGMENTS).alias("c_mktsegment"),
        "j2",
    )
    return _with_comment(made, pool, "customer_comment", F.col("j2"), "c_comment").drop("j2")


def part(rows: DataFrame, pool: Pool | None = None) -> DataFrame:
    """Parts without their names, which ``names.part_names`` makes."""
    jumped = rows.select("row", *[jump(F.col("row"), n).alias(f"j{n}") for n in (1, 2)])
    j1 = F.col("j1")
    maker = uniform(draw("part_mfgr", j1, 1), 1, 5)
    brand = maker * 10 + uniform(draw("part_brand", j1, 1), 1, 5)
    made = jumped.select(
        F.col("row").alias("p_partkey"),
        F.concat(F.lit("Manufacturer#"), maker.cast("string")).alias("p_mfgr"),
        F.concat(F.lit("Brand#"), brand.cast("string")).alias("p_brand"),
        pick(draw("part_type", j1, 1), words.PART_TYPES).alias("p_type"),
        uniform(draw("part_size", j1, 1), 1, 50).cast("int").alias("p_size"),
        pick(draw("part_container", j1, 1), words.CONTAINERS).alias("p_container"),
        _money(retail_price(F.col("row"))).alias("p_retailprice"),
        "j2",
    )
    return _with_comment(made, pool, "part_comment", F.col("j2"), "p_comment").drop("j2")


def partsupp(rows: DataFrame, scale: Scale, pool: Pool | None = None) -> DataFrame:
    jumped = rows.select("row", *[jump(F.col("row"), n).alias(f"j{n}") for n in (4, 8)])
    slots = jumped.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(SUPPLIERS_PER_PART))))
    slot, j4 = F.col("slot"), F.col("j4")
    made = slots.select(
        F.col("row").alias("ps_partkey"),
        offered_supplier(F.col("row"), slot - 1, scale.suppliers).alias("ps_suppkey"),
        uniform(draw_at("partsupp_quantity", j4, slot, SUPPLIERS_PER_PART), 1, 9999)
        .cast("int").alias("ps_availqty"),
        _money(uniform(draw_at("partsupp_cost", j4, slot, SUPPLIERS_PER_PART), 100, 100_000))
        .alias("ps_supplycost"),
        "j8", "slot",
    )
    return _with_comment(
        made, pool, "partsupp_comment", F.col("j8"), "ps_comment", F.col("slot")).drop("j8", "slot")


# --- orders and line items ---------------------------------------------------

def _order_draws(rows: DataFrame, key: Column | None) -> DataFrame:
    """Key, powers, date and line count of each order."""
    key = sparse_key(F.col("row")) if key is None else key
    jumped = rows.select("*", key.alias("key"), *[jump(F.col("row"), n).alias(f"j{n}") for n in (1, 2, 7, 14)])
    return jumped.select(
        "*",
        uniform(draw("order_date", F.col("j1"), 1), 0, DAYS_OF_ORDERS - 1).alias("day"),
        uniform(draw("order_lines", F.col("j1"), 1), 1, MOST_LINES).alias("lines"),
    )


def _line_draw(stream: str, line: Column) -> Column:
    return draw_at(stream, F.col("j7"), line, MOST_LINES)


def _line_part(scale: Scale, line: Column) -> Column:
    return uniform(_line_draw("line_part", line), 1, scale.parts)


def _line_quantity(line: Column) -> Column:
    return uniform(_line_draw("line_quantity", line), 1, 50)


def _line_discount(line: Column) -> Column:
    return uniform(_line_draw("line_discount", line), 0, 10)


def _line_tax(line: Column) -> Column:
    return uniform(_line_draw("line_tax", line), 0, 8)


def _line_ship(line: Column) -> Column:
    """Day a line ships, counted from the start date."""
    return F.col("day") + uniform(_line_draw("line_ship", line), 1, 121)


def orders(rows: DataFrame, scale: Scale, pool: Pool | None = None,
           key: Column | None = None) -> DataFrame:
    """Orders with status and total from their own lines, without a join.

    The (at most seven) lines of an order depend on its row number only, so the
    rollup is an expression over the row. ``key`` replaces the order key made from
    the row number.
    """
    drawn = _order_draws(rows, key)

    def add_line(so_far: Column, line: Column) -> Column:
        price = retail_price(_line_part(scale, line)) * _line_quantity(line)
        net = F.floor(price * (100 - _line_discount(line)) / 100)
        cents = F.floor(net * (100 + _line_tax(line)) / 100)
        return F.struct(
            (so_far["total"] + cents).alias("total"),
            (so_far["shipped"] + F.when(_line_ship(line) <= _CUTOFF, 1).otherwise(0))
            .alias("shipped"))

    nothing = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("shipped"))
    drawn = drawn.withColumn("sum", F.aggregate(
        F.sequence(F.lit(1), F.col("lines").cast("int")), nothing, add_line))
    j1 = F.col("j1")
    buyer = uniform(draw("order_customer", j1, 1), 1, scale.customers)
    # A third of customers place no orders: multiples of three move to a neighbour.
    buyer = F.when(buyer % 3 != 0, buyer).when(
        buyer < scale.customers, buyer + 1).otherwise(buyer - 1)
    made = drawn.select(
        F.col("key").alias("o_orderkey"),
        buyer.alias("o_custkey"),
        F.when(F.col("sum.shipped") == F.col("lines"), "F").when(F.col("sum.shipped") > 0, "P")
        .otherwise("O").alias("o_orderstatus"),
        _money(F.col("sum.total")).alias("o_totalprice"),
        _day(F.col("day")).alias("o_orderdate"),
        pick(draw("order_priority", j1, 1), words.PRIORITIES).alias("o_orderpriority"),
        _tag("Clerk#", uniform(draw("order_clerk", j1, 1), 1, scale.clerks)).alias("o_clerk"),
        F.lit(0).alias("o_shippriority"),
        "j2",
    )
    return _with_comment(made, pool, "order_comment", F.col("j2"), "o_comment").drop("j2")


def lineitem(rows: DataFrame, scale: Scale, pool: Pool | None = None,
             key: Column | None = None) -> DataFrame:
    """Line items of the orders with the given row numbers.

    Only lines received by the cutoff draw a return flag, and they draw in turn. A
    bit per received line gives each line its place in that turn.
    """
    drawn = _order_draws(rows, key)
    received = F.lit(0)
    for line in range(1, MOST_LINES + 1):
        receipt = (
            F.col("day") + uniform(draw("line_ship", F.col("j7"), line), 1, 121)
            + uniform(draw("line_receipt", F.col("j7"), line), 1, 30))
        received = received + F.when(receipt <= _CUTOFF, 1 << line).otherwise(0)
    lines = drawn.withColumn("received", received).withColumn(
        "line", F.explode(F.sequence(F.lit(1), F.col("lines").cast("int"))))
    earlier = F.col("received").bitwiseAND(F.expr("shiftleft(1, line) - 1"))
    turn = F.bit_count(earlier) + 1
    line = F.col("line")
    spread = lines.select(
        "key", "line", "j7", "j14", "day", turn.alias("turn"),
        _line_part(scale, line).alias("part"),
        uniform(_line_draw("line_supplier", line), 0, 3).alias("slot"),
        _line_quantity(line).alias("quantity"),
        _line_ship(line).alias("ship"),
    ).withColumn("receipt", F.col("ship") + uniform(_line_draw("line_receipt", line), 1, 30))
    flag = pick(draw_at("line_return", F.col("j7"), F.col("turn"), MOST_LINES), words.RETURN_FLAGS)
    made = spread.select(
        F.col("key").alias("l_orderkey"),
        F.col("part").alias("l_partkey"),
        offered_supplier(F.col("part"), F.col("slot"), scale.suppliers).alias("l_suppkey"),
        F.col("line").alias("l_linenumber"),
        F.col("quantity").cast("decimal(12,2)").alias("l_quantity"),
        _money(retail_price(F.col("part")) * F.col("quantity")).alias("l_extendedprice"),
        _hundredths(_line_discount(line)).alias("l_discount"),
        _hundredths(_line_tax(line)).alias("l_tax"),
        F.when(F.col("receipt") <= _CUTOFF, flag).otherwise("N").alias("l_returnflag"),
        F.when(F.col("ship") <= _CUTOFF, "F").otherwise("O").alias("l_linestatus"),
        _day(F.col("ship")).alias("l_shipdate"),
        _day(F.col("day") + uniform(_line_draw("line_commit", line), 30, 90))
        .alias("l_commitdate"),
        _day(F.col("receipt")).alias("l_receiptdate"),
        pick(_line_draw("line_instruction", line), words.INSTRUCTIONS).alias("l_shipinstruct"),
        pick(_line_draw("line_mode", line), words.SHIP_MODES).alias("l_shipmode"),
        "j14", "line",
    )
    return _with_comment(
        made, pool, "line_comment", F.col("j14"), "l_comment", F.col("line")).drop("j14", "line")


# --- calendar ----------------------------------------------------------------

def time_dimension(days: DataFrame) -> DataFrame:
    """Calendar rows for one-based day numbers in column ``row``; day 1 is 1992-01-01."""
    day = _day(F.col("row") - 1)
    return days.select(
        (F.col("row") + 8035).alias("t_timekey"),
        day.alias("t_date"),
        F.year(day).alias("t_year"),
        (F.month(day) + 12 * (F.year(day) - 1970)).alias("t_month"),
        (F.floor((F.dayofyear(day) + 2) / 7) + 1).cast("int").alias("t_week"),
        F.dayofmonth(day).alias("t_day"),
    )
