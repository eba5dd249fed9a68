"""Table upkeep by batches: a table and a batch of changes give the next version.

Changes are reduced to one row per key before they meet the table, so a key that
fills a large part of a batch is combined map-side and joins as a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.operators.joins import without_match


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Append rows; columns they lack take their default or null."""
    for name, value in (defaults or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def update_set(table: DataFrame, changes: DataFrame, key: str, column: str,
               sequence: str = "seq") -> DataFrame:
    """Set ``column`` from changes (key, column, sequence); the last change of a key wins.

    A change to null counts, so a matched row is told by the key, not by the value.
    """
    last = changes.groupBy(F.col(key).alias("_k")).agg(
        F.max_by(F.struct(F.col(column).alias("v")), sequence).alias("_new"))
    return (
        table.join(last, F.col(key) == F.col("_k"), "left")
        .withColumn(column, F.when(F.col("_k").isNotNull(), F.col("_new.v"))
                    .otherwise(F.col(column)))
        .select(*table.columns)
    )


def update_delta(table: DataFrame, changes: DataFrame, key: str, column: str,
                 delta: str = "delta") -> DataFrame:
    """Add the changes of a key to ``column``; sums do not depend on their order."""
    sums = changes.groupBy(F.col(key).alias("_k")).agg(F.sum(delta).alias("_sum"))
    kind = dict(table.dtypes)[column]
    return (
        table.join(sums, F.col(key) == F.col("_k"), "left")
        .withColumn(column, (F.col(column) + F.coalesce("_sum", F.lit(0))).cast(kind))
        .select(*table.columns)
    )


def update_all_but(table: DataFrame, key: str, kept: object, column: str, value: Column) -> DataFrame:
    return table.withColumn(
        column, F.when(F.col(key) != F.lit(kept), value).otherwise(F.col(column)))


def update_like(table: DataFrame, key: str, pattern: str, column: str, value: Column) -> DataFrame:
    matches = F.col(key).cast("string").like(pattern)
    return table.withColumn(column, F.when(matches, value).otherwise(F.col(column)))


def delete_like(table: DataFrame, key: str, pattern: str) -> DataFrame:
    matches = F.col(key).cast("string").like(pattern)
    return table.filter(F.coalesce(~matches, F.lit(True)))


def delete_keys(table: DataFrame, keys: DataFrame, key: str, batch_key: str | None = None,
                tasks: int = 0) -> DataFrame:
    return without_match(table, keys, {key: batch_key or key}, tasks)


def insert_select(target: DataFrame, source: DataFrame, condition: Column | None = None,
                  limit: int | None = None) -> DataFrame:
    rows = source if condition is None else source.filter(condition)
    return target.unionByName(rows if limit is None else rows.limit(limit))


def insert_on_conflict(table: DataFrame, rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Insert rows whose key is new; of several with one key, the first is kept."""
    payload = [c for c in rows.columns if c not in (key, sequence)]
    first = rows.groupBy(key).agg(
        F.min_by(F.struct(*payload, F.lit(0).alias("_")), sequence).alias("_row")
    ).select(key, *[F.col(f"_row.{c}").alias(c) for c in payload])
    return table.unionByName(
        without_match(first, table, {key: key}), allowMissingColumns=True).select(*table.columns)


def post_transactions(accounts: DataFrame, tellers: DataFrame, branches: DataFrame,
                      history: DataFrame, batch: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Apply a batch (aid, tid, bid, delta): three balances and the history."""
    return {
        "accounts": update_delta(accounts, batch, "aid", "abalance"),
        "tellers": update_delta(tellers, batch, "tid", "tbalance"),
        "branches": update_delta(branches, batch, "bid", "bbalance"),
        "history": insert(history, batch.select("tid", "bid", "aid", "delta"), {"mtime": now}),
    }


def refresh(orders: DataFrame, lines: DataFrame, new_orders: DataFrame, new_lines: DataFrame,
            deleted: DataFrame, tasks: int = 0) -> tuple[DataFrame, DataFrame]:
    """One refresh set: insert orders with their lines, then delete by order key.

    With ``tasks`` both tables come dealt by order key over so many tasks.
    """
    return (
        delete_keys(insert(orders, new_orders), deleted, "o_orderkey", tasks=tasks),
        delete_keys(insert(lines, new_lines), deleted, "l_orderkey", "o_orderkey", tasks),
    )
