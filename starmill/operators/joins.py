"""Join forms that Spark has no direct, scalable spelling for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Order lines that one task of a join on order keys holds.
TASK_LINES = 400_000


def line_tasks(spark: SparkSession, lines: int) -> int:
    """Tasks that hold about ``TASK_LINES`` of so many lines each; 0 (Spark's choice) if two would do."""
    wanted = lines // TASK_LINES
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted) if wanted > 1 else 0


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over so many tasks and joined by sorting, which can spill.

    Spark merges shuffle partitions up to a size in compressed bytes, and it copies a side to
    all tasks that is small in its compressed file; either way the memory of a task grows with
    the input. For keys that few rows share, such as those of orders: a partition dealt by
    request is not split again. With no ``tasks`` the rows are left to Spark.
    """
    return in_order(df.repartition(tasks, *keys), tasks) if tasks else df


def in_order(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` for a join by sorting, whose hot partitions Spark may split; see ``spread``."""
    return df.hint("merge") if tasks else df


def with_match(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` with at least one row of ``right``; ``on`` maps left to right columns.

    The right keys are made distinct first. That dedups them on the map side, so
    a key that repeats in a large part of ``right`` costs one row per task, and the
    join reuses the partitioning of the distinct.
    """
    return _by_keys(left, right, on, "left_semi")


def without_match(left: DataFrame, right: DataFrame, on: dict[str, str], tasks: int = 0) -> DataFrame:
    """Rows of ``left`` without any row of ``right``; see ``with_match`` and, for ``tasks``, ``spread``."""
    if not tasks:
        return _by_keys(left, right, on, "left_anti")
    keys, condition = _keys(right, on)
    # an anti join would be pushed below the deal, to where Spark chooses the tasks
    marked = spread(keys, tasks, *keys.columns).withColumn("_found", F.lit(True))
    return spread(left, tasks, *on).join(marked, condition, "left").where("_found is null").select(*left.columns)


def _by_keys(left: DataFrame, right: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    keys, condition = _keys(right, on)
    return left.join(keys, condition, how)


def _keys(right: DataFrame, on: dict[str, str]) -> tuple[DataFrame, Column]:
    """The distinct keys of ``right`` and the condition that a left row has one."""
    keys = right.select(*[F.col(r).alias(f"_key_{l}") for l, r in on.items()]).distinct()
    condition = F.lit(True)
    for column in on:
        condition = condition & (F.col(column) == F.col(f"_key_{column}"))
    return keys, condition


def null_aware_anti(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """``left.key NOT IN (select right_key from right)`` with SQL's null rules.

    Spark runs NOT IN as a broadcast of the whole right side. Here the anti join
    stays an ordinary one, and the null rules need one word about the right side:
    whether it is empty or holds a null.
    """
    keys, rows = F.count(right_key), F.count(F.lit(1))
    state = right.agg(
        F.when(rows == 0, "empty").when(keys == rows, "no nulls").otherwise("nulls").alias("state")
    ).scalar()
    kept = without_match(left, right.filter(F.col(right_key).isNotNull()), {key: right_key})
    return kept.filter(
        F.when(state == "empty", True).when(state == "no nulls", F.col(key).isNotNull())
        .otherwise(False))


def opposite_pairs(keys: DataFrame, key: str, name: str, one: str, other: str) -> DataFrame:
    """Pairs of rows of ``keys`` named (one, other) or (other, one), as an equality join."""
    wanted = keys.filter(F.col(name).isin(one, other))
    first = wanted.select(
        F.col(key).alias("first_key"),
        F.col(name).alias("first_name"),
        F.when(F.col(name) == one, other).otherwise(one).alias("_partner"),
    )
    second = wanted.select(F.col(key).alias("second_key"), F.col(name).alias("second_name"))
    return first.join(second, F.col("_partner") == F.col("second_name")).drop("_partner")
