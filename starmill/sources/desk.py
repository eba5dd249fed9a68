"""The order-desk schema: customers, orders and stock keyed by warehouse.

A directory that holds ``order_line.parquet`` is read as it is. Otherwise the
tables are computed from the star-schema files: five warehouses of ten
districts, every part stocked in each warehouse, and dates moved by twenty years
so that the date predicates of the query suite select rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.operators.joins import line_tasks, spread
from starmill.sources.star import Star

WAREHOUSES = 5
SUPPLIERS = 10_000  # fixed by the schema: supplier keys are taken modulo this
DAYS_MOVED = 7305


def supplier_key() -> Column:
    """Supplier of a stock row."""
    return (F.col("s_w_id") * F.col("s_i_id")) % SUPPLIERS


class Desk:
    """Order-desk tables of one directory."""

    def __init__(self, spark: SparkSession, path: str, idle_customers: bool = False):
        self.spark = spark
        self.star = Star(spark, path, idle_customers)

    @cached_property
    def _complete(self) -> bool:
        try:
            self.star.raw("order_line")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return False
        return True

    def _table(self, name: str) -> DataFrame:
        return self.star.raw(name) if self._complete else getattr(self, f"_derived_{name}")()

    @cached_property
    def tasks(self) -> int:
        """Tasks for joins on order keys; the rows are counted in the files' footers."""
        return line_tasks(self.spark, self.star.raw("order_line").count()) if self._complete else self.star.tasks

    customer = cached_property(lambda self: self._table("customer"))
    orders = cached_property(lambda self: self._table("orders"))
    order_line = cached_property(lambda self: self._with_cents(self._table("order_line")))
    new_order = cached_property(lambda self: self._table("new_order"))
    item = cached_property(lambda self: self._table("item"))
    stock = cached_property(lambda self: self._table("stock"))
    supplier = cached_property(lambda self: self._table("supplier"))
    nation = cached_property(lambda self: self._table("nation"))
    region = cached_property(lambda self: self._table("region"))

    @staticmethod
    def _with_cents(lines: DataFrame) -> DataFrame:
        """The amount of a line as whole cents too, for exact sums in integers."""
        if "ol_cents" in lines.columns:
            return lines
        return lines.withColumn("ol_cents", F.expr("cast(rint(ol_amount * 100) as bigint)"))

    def _derived_customer(self) -> DataFrame:
        return self.star.customer.selectExpr(
            "c_custkey + 1 as c_id",
            "cast(c_custkey % 5 + 1 as int) as c_w_id",
            "cast(floor(c_custkey / 5) % 10 + 1 as int) as c_d_id",
            "c_name as c_last",
            "concat('City ', c_custkey % 100) as c_city",
            "concat(char(65 + c_nationkey), 'X') as c_state",
            "concat(c_custkey % 10, '-', c_phone) as c_phone",
            "c_acctbal as c_balance",
        )

    def _derived_orders(self) -> DataFrame:
        return self.star.orders.selectExpr(
            "o_orderkey as o_id",
            "cast(o_custkey % 5 + 1 as int) as o_w_id",
            "cast(floor(o_custkey / 5) % 10 + 1 as int) as o_d_id",
            "o_custkey + 1 as o_c_id",
            f"date_add(o_orderdate, {DAYS_MOVED}) as o_entry_d",
            "cast(o_orderkey % 10 + 1 as int) as o_carrier_id",
            "cast(o_orderkey % 11 + 5 as int) as o_ol_cnt",
        )

    def _derived_order_line(self) -> DataFrame:
        owners = self._derived_orders().select("o_id", "o_w_id", "o_d_id")
        return spread(self.star.facts(), self.tasks, "l_orderkey").join(
            spread(owners, self.tasks, "o_id"), F.col("l_orderkey") == F.col("o_id")
        ).selectExpr(
            "o_id as ol_o_id",
            "o_w_id as ol_w_id",
            "o_d_id as ol_d_id",
            "l_linenumber as ol_number",
            "l_partkey + 1 as ol_i_id",
            # about one line in a hundred comes from another warehouse
            "case when (l_orderkey + l_linenumber * 7 + l_partkey) % 100 = 3"
            f" then cast(o_w_id % {WAREHOUSES} + 1 as int) else o_w_id end as ol_supply_w_id",
            f"date_add(l_shipdate, {DAYS_MOVED}) as ol_delivery_d",
            "cast(l_quantity as int) as ol_quantity",
            "l_extendedprice as ol_amount",
            "l_price_cents as ol_cents",
        )

    def _derived_new_order(self) -> DataFrame:
        open_orders = self.star.orders.filter(F.col("o_orderstatus") == "O")
        return open_orders.selectExpr(
            "o_orderkey as no_o_id",
            "cast(o_custkey % 5 + 1 as int) as no_w_id",
            "cast(floor(o_custkey / 5) % 10 + 1 as int) as no_d_id",
        )

    def _derived_item(self) -> DataFrame:
        return self.star.part.selectExpr(
            "p_partkey + 1 as i_id",
            "p_name as i_name",
            "p_retailprice as i_price",
            "concat(case when p_partkey % 7 = 3 then 'co' else '' end, p_type, ' ', p_brand, ' ',"
            " case p_partkey % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'BB' end)"
            " as i_data",
        )

    def _derived_stock(self) -> DataFrame:
        return (
            self.star.part.select("p_partkey")
            .withColumn("s_w_id", F.explode(F.sequence(F.lit(1), F.lit(WAREHOUSES))))
            .selectExpr(
                "p_partkey + 1 as s_i_id",
                "s_w_id",
                "cast(((p_partkey * 7 + s_w_id * 13) % 91 + 10) * 5 as int) as s_quantity",
                "cast((p_partkey * 3 + s_w_id * 11) % 50 as int) as s_order_cnt",
            )
        )

    def _derived_supplier(self) -> DataFrame:
        return self.spark.range(SUPPLIERS).selectExpr(
            "id as su_suppkey",
            "concat('Supplier', lpad(cast(id as string), 5, '0')) as su_name",
            "concat('Dock ', id) as su_address",
            "cast(65 + id % 25 as int) as su_nationkey",
            "concat('44-', id) as su_phone",
            "case when id % 50 = 0 then 'a bad record' else concat('note ', id % 13) end"
            " as su_comment",
        )

    def _derived_nation(self) -> DataFrame:
        return self.star.nation.selectExpr(
            "n_nationkey + 65 as n_nationkey",
            "case n_nationkey when 3 then 'Germany' when 4 then 'Cambodia' else n_name end as n_name",
            "n_regionkey",
        )

    def _derived_region(self) -> DataFrame:
        return self.star.region.selectExpr("r_regionkey", "initcap(r_name) as r_name")
