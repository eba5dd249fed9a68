"""Refresh sets: new orders with their lines, and the keys of orders to delete.

A set holds 0.1 % of the orders. New orders take keys in slots the base data leaves
free, and their draws go on where the base data and the earlier sets stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.generator import tables
from starmill.generator.scale import Scale
from starmill.generator.text import Pool

SETS_PER_SLOT = 1000
BLOCK = 4096


def orders_per_set(scale: Scale) -> int:
    return scale.orders // 10_000 * 10


def set_rows(sets: DataFrame, scale: Scale) -> DataFrame:
    """Rows of the sets numbered in column ``set_number``: the position in the set
    (from 0), the row among all new orders and the row that draws."""
    size = orders_per_set(scale)
    # Below 10,000 orders a set is empty, and a sequence must not run backwards. Sets grow
    # in two steps, blocks of positions and the positions of a block, with the blocks dealt
    # out between, so no task makes a whole set. The bounds hang on a column: the optimizer
    # would put an array of all positions into the plan otherwise.
    blocks = F.sequence(F.col("set_number") * 0, F.lit(max(size - 1, 0) // BLOCK).cast("bigint"))
    first = F.col("block") * BLOCK
    return (
        sets.filter(F.lit(size > 0)).withColumn("block", F.explode(blocks))
        .repartition("set_number", "block")
        .withColumn("position", F.explode(F.sequence(first, F.least(first + BLOCK, F.lit(size).cast("bigint")) - 1)))
        .drop("block")
        .withColumn("new_row", (F.col("set_number") - 1) * size + F.col("position") + 1)
        .withColumn("row", F.col("new_row") + scale.orders)
    )


def _slot() -> Column:
    return F.floor(F.col("set_number") / SETS_PER_SLOT).cast("bigint")


def _new_key() -> Column:
    return tables.sparse_key(F.col("new_row"), _slot() + 1)


def new_orders(rows: DataFrame, scale: Scale, pool: Pool | None = None) -> DataFrame:
    return tables.orders(rows, scale, pool, _new_key())


def new_lines(rows: DataFrame, scale: Scale, pool: Pool | None = None) -> DataFrame:
    return tables.lineitem(rows, scale, pool, _new_key())


def deleted_keys(rows: DataFrame) -> DataFrame:
    return rows.select(
        "set_number", "position",
        tables.sparse_key(F.col("new_row"), _slot().bitwiseAND(3)).alias("o_orderkey"))


def insert_segment(position: Column, rows: int, segments: int) -> Column:
    """Segment (from 0) of a row; earlier segments take one of the left-over rows each."""
    size, left = divmod(rows, segments)
    longer = left * (size + 1)
    return F.when(position < longer, F.floor(position / (size + 1))).otherwise(
        left + F.floor((position - longer) / max(size, 1)))


def delete_segment(position: Column, rows: int, segments: int) -> Column:
    return F.floor(position / (rows // segments + 1))
