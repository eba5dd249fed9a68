"""Physical layouts: bucketed by key with heavy keys cut, copied to all tasks, appended, per tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REFERENCE_LIMIT_BYTES = 64 * 1024 * 1024
BUCKET_BYTES = 128 * 1024 * 1024


def default_buckets(df: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES``, at least as many as a shuffle has partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(df) // BUCKET_BYTES))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n): keys that hold more than ``share`` of all rows; null may be one.

    A sketch of bounded size (``approx_top_k``) names candidates in one pass with partial
    sums; a second pass counts those exactly. There are at most ``1 / share`` heavy keys.
    """
    spark, most = df.sparkSession, int(1 / share) + 1
    kind = df.select(key).schema[0].dataType.simpleString()
    found = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(key).alias("known"),
        F.expr(f"approx_top_k({key}, {most}, {8 * most})").alias("top")).first()
    rows = found["rows"]
    named = [(r["item"],) for r in found["top"] or []] + ([(None,)] if rows > found["known"] else [])
    names = spark.createDataFrame(named, f"_key {kind}")
    counted = df.join(F.broadcast(names), F.col(key).eqNullSafe(F.col("_key")), "left_semi").groupBy(
        F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > share * rows).withColumnRenamed("_key", "key")


def salts(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key, salts): for each heavy key, salts that deal its rows evenly over buckets.

    Keys with more than half a bucket's mean rows are heavy. One gets a salt per half
    bucket of its rows. Spark places a row by a hash of (key, salt), so for each bucket
    aimed at, the smallest salt that leads there is looked up; heavy keys take turns through
    the buckets, so none gets more than its part.
    """
    share = 0.5 / buckets
    rows = df.count()
    heavy = heavy_keys(df, key, share).withColumn(
        "cuts", F.least(F.ceil(F.col("n") / (share * rows)), F.lit(buckets)).cast("bigint"))
    # at most 2 * buckets small rows: a running total of cuts says whose turn comes when
    turns = W.orderBy(F.desc("n"), "key").rowsBetween(W.unboundedPreceding, -1)
    dealt = heavy.withColumn("first", F.coalesce(F.sum("cuts").over(turns), F.lit(0)))
    # a bucket is missed by this many tries with a chance of exp(-32)
    tried = dealt.withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(32 * buckets))))
    to = F.pmod(F.hash("key", "salt"), F.lit(buckets))
    aimed = F.pmod(to - F.col("first"), F.lit(buckets)) < F.col("cuts")
    smallest = tried.withColumn("bucket", to).filter(aimed).groupBy("key", "bucket").agg(F.min("salt").alias("salt"))
    return smallest.groupBy("key").agg(F.array_sort(F.collect_list("salt")).alias("salts"))


def _salted(df: DataFrame, key: str, salted: DataFrame, copied: bool) -> DataFrame:
    """``df`` with ``_salt``: one of its key's salts per row, or, if copied, the row once for each."""
    joined = df.join(F.broadcast(salted), F.col(key).eqNullSafe(F.col("key")), "left")
    if copied:
        salt = F.explode(F.coalesce("salts", F.array(F.lit(0))))
    else:
        turn = F.pmod(F.monotonically_increasing_id(), F.size("salts")).cast("int")
        salt = F.when(F.col("salts").isNull(), 0).otherwise(F.get("salts", turn))
    return joined.select(*df.columns, salt.alias("_salt"))


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int,
                   salted: DataFrame | None = None, copied: bool = False) -> DataFrame:
    """Write ``df`` hash-distributed on (``key``, ``_salt``); like buckets join without a shuffle.

    Rows are moved to their bucket before the write, so a bucket is one file, not one file
    per task. ``salted`` (from ``salts``) cuts heavy keys: a row takes one of its key's salts,
    or, on the ``copied`` side of an inner join, is written once for each. A copied table
    serves that join alone; the other is the table with a column ``_salt`` more.

    The catalog entry only serves to read the buckets. It goes once the table's plan is
    bound; the files stay at ``path``.
    """
    own = df.withColumn("_salt", F.lit(0)) if salted is None else _salted(df, key, salted, copied)
    (
        own.repartition(buckets, key, "_salt").write.mode("overwrite").format("parquet")
        .option("path", path).bucketBy(buckets, key, "_salt").sortBy(key).saveAsTable(table)
    )
    bound = df.sparkSession.table(table)
    bound.schema  # binds the plan to the files
    df.sparkSession.sql(f"drop table {table}")
    return bound


def write_colocated(large: DataFrame, large_key: str, small: DataFrame, small_key: str, base: str,
                    tag: str, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables bucketed alike, heavy keys of ``large`` cut and their rows of ``small`` copied.

    An inner join on the key and ``_salt`` then needs no exchange, and no bucket of ``large``
    holds much more than the mean. Salts are written down first, since both writes use them.
    """
    buckets = buckets or default_buckets(large)
    where = f"{base}/salts"
    salts(large, large_key, buckets).write.mode("overwrite").parquet(where)
    salted = large.sparkSession.read.parquet(where)
    return (write_bucketed(large, f"large_{tag}", f"{base}/large", large_key, buckets, salted),
            write_bucketed(small, f"small_{tag}", f"{base}/small", small_key, buckets, salted, copied=True))


def estimated_bytes(df: DataFrame) -> int:
    """Spark's size estimate; for a stored table it comes from the file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def reference_copy(df: DataFrame, limit_bytes: int = REFERENCE_LIMIT_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its estimated size is below the limit, else leave it."""
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def table_distribute(df: DataFrame, layout: str, path: str, table: str, key: str = "",
                     buckets: int | None = None) -> DataFrame:
    """Store ``df`` in one of the three layouts and read it back."""
    if layout == "hash":
        buckets = buckets or default_buckets(df)
        return write_bucketed(df, table, path, key, buckets, salts(df, key, buckets)).drop("_salt")
    if layout == "reference":
        df.write.mode("overwrite").parquet(path)
        return reference_copy(df.sparkSession.read.parquet(path))
    if layout == "append":
        append(df, path)
        return df.sparkSession.read.parquet(path)
    raise ValueError(f"unknown layout: {layout}")


def write_tenants(df: DataFrame, path: str, row_group_bytes: int = 128 * 1024 * 1024) -> None:
    """One folder per (tenant, tbl), its files sorted by key; a point read touches one row group.

    Rows go to tasks by ranges of (tenant, tbl, id), so a tenant that holds a large part of
    the rows is spread over several files, each with keys of its own. Bounds of row groups and
    pages, and a Bloom filter on the key, tell a point read where to look.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tenant", "tbl", "id"]
    df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "parquet.bloom.filter.enabled#id", "true").option("parquet.block.size", row_group_bytes).option(
        "parquet.page.row.count.limit", 20_000).partitionBy("tenant", "tbl").parquet(path)


def read_tenant(spark: SparkSession, path: str, tenant: int, tbl: int, key: int) -> DataFrame:
    return spark.read.parquet(path).filter(
        (F.col("tenant") == tenant) & (F.col("tbl") == tbl) & (F.col("id") == key))
