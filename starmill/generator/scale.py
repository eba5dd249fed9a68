"""Row counts of a scale factor, and the split of a table into chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ORDERS_PER_CUSTOMER = 10
SUPPLIERS_PER_PART = 4
_BASE = {"part": 200_000, "supplier": 10_000, "customer": 150_000}


@dataclass(frozen=True)
class Scale:
    parts: int
    suppliers: int
    customers: int
    orders: int
    clerks: int = 1000

    @classmethod
    def of(cls, factor: float) -> Scale:
        """Counts of a scale factor; below one, bases shrink in thousandths."""
        if factor < 1:
            thousandths = int(1000 * factor)
            count = {t: max(1, thousandths * base // 1000) for t, base in _BASE.items()}
            whole = 1
        else:
            whole = int(factor)
            count = {t: base * whole for t, base in _BASE.items()}
        return cls(count["part"], count["supplier"], count["customer"],
                   count["customer"] * ORDERS_PER_CUSTOMER, max(1000, 1000 * whole))


def chunk_bounds(rows: int, chunks: int, chunk: int) -> tuple[int, int]:
    """Rows [first, last] (one-based) of chunk 1..chunks; the last takes the remainder."""
    size = rows // chunks
    first = size * (chunk - 1) + 1
    return first, (rows if chunk == chunks else first + size - 1)


def row_numbers(spark: SparkSession, first: int, last: int, tasks: int | None = None) -> DataFrame:
    """One-based row numbers first..last as column ``row``."""
    return spark.range(first, last + 1, 1, tasks).withColumnRenamed("id", "row")
