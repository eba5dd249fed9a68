"""The eight-table star schema as lazily built DataFrames.

A directory may hold the full schema (as the generator writes it) or a reduced
one that lacks some columns and the ``partsupp`` table. Columns that are present
are used as they are; a missing column gets a value computed from the row's own
keys, so every plan runs on either kind of directory.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.operators.joins import line_tasks

MONEY = "decimal(12,2)"
# Rates are below 100, so price * (1 - rate) stays within 18 digits and Spark
# keeps the product in a long instead of a BigDecimal.
RATE = "decimal(4,2)"

_LINE_HASH = "(l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3)"

_SHIP_INSTRUCT = "array('DELIVER IN PERSON', 'COLLECT COD', 'NONE', 'TAKE BACK RETURN')"
_SHIP_MODE = "array('REG AIR', 'AIR', 'RAIL', 'TRUCK', 'MAIL', 'FOB', 'SHIP')"
_BOX_SIZE = "array('SM', 'LG', 'MED', 'JUMBO', 'WRAP')"
_BOX_KIND = "array('CASE', 'BOX', 'BAG', 'JAR', 'PKG', 'PACK', 'CAN', 'DRUM')"


class Star:
    """Star-schema tables read from the parquet files of one directory.

    ``idle_customers`` conforms reduced test data, where every customer has orders: those
    of each third customer go to the next one. It changes no directory with the full
    schema, and is off unless asked for.
    """

    def __init__(self, spark: SparkSession, path: str, idle_customers: bool = False):
        self.spark = spark
        self.path = path.rstrip("/")
        self._idle_customers = idle_customers
        self._stored: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._stored[name]

    @staticmethod
    def _project(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
        """Select ``columns`` (name -> (type, fallback expression))."""
        present = set(df.columns)
        return df.selectExpr(*[
            f"cast({name if name in present else fallback} as {dtype}) as {name}"
            for name, (dtype, fallback) in columns.items()])

    @cached_property
    def region(self) -> DataFrame:
        return self._project(self.raw("region"), {
            "r_regionkey": ("int", "null"),
            "r_name": ("string", "null"),
            "r_comment": ("string", "''"),
        })

    @cached_property
    def nation(self) -> DataFrame:
        return self._project(self.raw("nation"), {
            "n_nationkey": ("int", "null"),
            "n_name": ("string", "null"),
            "n_regionkey": ("int", "null"),
            "n_comment": ("string", "''"),
        })

    @cached_property
    def customer(self) -> DataFrame:
        return self._project(self.raw("customer"), {
            "c_custkey": ("bigint", "null"),
            "c_name": ("string", "null"),
            "c_address": ("string", "concat('Street ', c_custkey)"),
            "c_nationkey": ("int", "null"),
            "c_phone": (
                "string",
                "concat(10 + c_nationkey, '-', lpad(cast(c_custkey % 1000 as string), 3, '0'))",
            ),
            "c_acctbal": (MONEY, "null"),
            "c_mktsegment": ("string", "null"),
            "c_comment": ("string", "concat('customer note ', c_custkey % 17)"),
        })

    @cached_property
    def supplier(self) -> DataFrame:
        return self._project(self.raw("supplier"), {
            "s_suppkey": ("bigint", "null"),
            "s_name": ("string", "null"),
            "s_address": ("string", "concat('Dock ', s_suppkey)"),
            "s_nationkey": ("int", "null"),
            "s_phone": (
                "string",
                "concat(10 + s_nationkey, '-', lpad(cast(s_suppkey % 1000 as string), 3, '0'))",
            ),
            "s_acctbal": (MONEY, "null"),
            "s_comment": (
                "string",
                "case when s_suppkey % 20 = 7 then 'slow Customer many Complaints'"
                " else concat('supplier note ', s_suppkey % 11) end",
            ),
        })

    @cached_property
    def part(self) -> DataFrame:
        return self._project(self.raw("part"), {
            "p_partkey": ("bigint", "null"),
            "p_name": ("string", "null"),
            "p_mfgr": ("string", "concat('Manufacturer#', p_partkey % 5 + 1)"),
            "p_brand": ("string", "null"),
            "p_type": ("string", "null"),
            "p_size": ("int", "null"),
            "p_container": (
                "string",
                f"concat({_BOX_SIZE}[cast(p_partkey % 5 as int)], ' ',"
                f" {_BOX_KIND}[cast(floor(p_partkey / 5) % 8 as int)])",
            ),
            "p_retailprice": (MONEY, "null"),
            "p_comment": ("string", "''"),
        })

    @cached_property
    def _reduced(self) -> bool:
        """True when the orders table lacks the columns of the full schema."""
        return "o_comment" not in self.raw("orders").columns

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders(self.raw("orders"))

    def _orders(self, df: DataFrame) -> DataFrame:
        if self._idle_customers and self._reduced:
            # A third of all customers place no orders in the full schema.
            df = df.withColumn(
                "o_custkey",
                F.expr("case when o_custkey % 3 = 0 then o_custkey + 1 else o_custkey end"),
            )
        return self._project(df, {
            "o_orderkey": ("bigint", "null"),
            "o_custkey": ("bigint", "null"),
            "o_orderstatus": ("string", "null"),
            "o_totalprice": (MONEY, "null"),
            "o_orderdate": ("date", "null"),
            "o_orderpriority": ("string", "null"),
            "o_clerk": ("string", "concat('Clerk#', o_orderkey % 1000)"),
            "o_shippriority": ("int", "o_orderkey * 0"),
            "o_comment": (
                "string",
                "case when o_orderkey % 13 = 0 then 'the special packages requests'"
                " else concat('order note ', o_orderkey % 19) end",
            ),
        })

    @cached_property
    def tasks(self) -> int:
        """Tasks for joins on order keys; the rows are counted in the files' footers."""
        return line_tasks(self.spark, self.raw("lineitem").count())

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.lines()

    def facts(self, ship_from: str | None = None, ship_before: str | None = None) -> DataFrame:
        """Line items with amounts as whole numbers as well: cents and percents.

        Products of these stay in 64-bit integers, several times cheaper per row than
        decimal arithmetic on amounts that are stored as doubles, and as exact.
        """
        return self.lines(ship_from, ship_before, {
            "l_quantity_cents": ("bigint", "rint(l_quantity * 100)"),
            "l_price_cents": ("bigint", "rint(l_extendedprice * 100)"),
            "l_discount_percent": ("bigint", "rint(l_discount * 100)"),
            "l_tax_percent": ("bigint", "rint(l_tax * 100)"),
        })

    def lines(self, ship_from: str | None = None, ship_before: str | None = None,
              more: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """Line items, optionally limited to ship dates in [ship_from, ship_before).

        The bounds are compared with the stored column, before any cast, so they
        reach the Parquet reader. ``more`` names further columns to compute.
        """
        df = self.raw("lineitem")
        stored = dict(df.dtypes)["l_shipdate"]
        if ship_from is not None:
            df = df.filter(F.col("l_shipdate") >= F.lit(ship_from).cast(stored))
        if ship_before is not None:
            df = df.filter(F.col("l_shipdate") < F.lit(ship_before).cast(stored))
        ship = "cast(l_shipdate as date)"
        return self._project(df, {
            "l_orderkey": ("bigint", "null"),
            "l_partkey": ("bigint", "null"),
            "l_suppkey": ("bigint", "null"),
            "l_linenumber": ("int", "null"),
            "l_quantity": (MONEY, "null"),
            "l_extendedprice": (MONEY, "null"),
            "l_discount": (RATE, "null"),
            "l_tax": (RATE, "null"),
            "l_returnflag": ("string", "null"),
            "l_linestatus": ("string", "null"),
            "l_shipdate": ("date", "null"),
            "l_commitdate": (
                "date", f"date_add({ship}, cast({_LINE_HASH} % 61 - 30 as int))"),
            "l_receiptdate": (
                "date", f"date_add({ship}, cast(1 + ({_LINE_HASH} * 5) % 30 as int))"),
            "l_shipinstruct": ("string", f"{_SHIP_INSTRUCT}[cast({_LINE_HASH} % 4 as int)]"),
            "l_shipmode": (
                "string", f"{_SHIP_MODE}[cast(({_LINE_HASH} + l_suppkey) % 7 as int)]"),
            "l_comment": ("string", "''"),
            **(more or {}),
        })

    def orders_between(self, date_from: str | None, date_before: str | None) -> DataFrame:
        """Orders dated in [date_from, date_before).

        Spark keeps a comparison on a cast column out of the Parquet filters, so
        the range is repeated on the stored column.
        """
        df = self.raw("orders")
        stored = dict(df.dtypes)["o_orderdate"]
        if date_from is not None:
            df = df.filter(F.col("o_orderdate") >= F.lit(date_from).cast(stored))
        if date_before is not None:
            df = df.filter(F.col("o_orderdate") < F.lit(date_before).cast(stored))
        return self._orders(df)

    @cached_property
    def has_partsupp(self) -> bool:
        """False in the reduced schema, where the lines' keys stand for the table."""
        try:
            self.raw("partsupp")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return False
        return True

    @cached_property
    def partsupp(self) -> DataFrame:
        stored = self.raw("partsupp") if self.has_partsupp else (
            self.raw("lineitem")
            .select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
            .distinct()
        )
        return self._project(stored, {
            "ps_partkey": ("bigint", "null"),
            "ps_suppkey": ("bigint", "null"),
            "ps_availqty": ("int", "(ps_partkey * 31 + ps_suppkey * 17) % 9999 + 1"),
            "ps_supplycost": (
                MONEY,
                "((ps_partkey * 37 + ps_suppkey * 101) % 99901 + 100) * cast(0.01 as decimal(3,2))",
            ),
            "ps_comment": ("string", "''"),
        })

    def register(self) -> None:
        """Expose the tables as temp views for plans written in SQL."""
        for name in ("region", "nation", "customer", "supplier", "part", "partsupp",
                     "orders", "lineitem"):
            getattr(self, name).createOrReplaceTempView(name)
