"""Delimited files, golden answers and whole-table file reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from starmill.functions.shared import shared_dir

# Column order and types of the delimited files.
_DDL = {
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string,"
            " p_size int, p_container string, p_retailprice decimal(12,2), p_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int,"
                " s_phone string, s_acctbal decimal(12,2), s_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty int,"
                " ps_supplycost decimal(12,2), ps_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int,"
                " c_phone string, c_acctbal decimal(12,2), c_mktsegment string, c_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
              " o_totalprice decimal(12,2), o_orderdate date, o_orderpriority string,"
              " o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
                " l_quantity decimal(12,2), l_extendedprice decimal(12,2),"
                " l_discount decimal(4,2), l_tax decimal(4,2), l_returnflag string,"
                " l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date,"
                " l_shipinstruct string, l_shipmode string, l_comment string",
    "delete": "o_orderkey bigint",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


def _delimited(reader, columns: T.StructType):
    # A quote is an ordinary character in these files, and a trailing separator is an
    # extra empty column, which the schema leaves out.
    return (reader.schema(columns).option("sep", "|").option("quote", "").option("escape", "")
            .option("emptyValue", "").option("mode", "PERMISSIVE"))


def read_tbl(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All files of a table: ``table.tbl``, ``table.tbl.1``, ..."""
    return _delimited(spark.read, schema(table)).csv(f"{folder}/{table}.tbl*")


def _line(df: DataFrame) -> Column:
    """One text line per row, each value followed by the separator."""
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in df.columns]
    return F.concat(F.concat_ws("|", *cells), F.lit("|"))


def write_tbl(df: DataFrame, path: str) -> None:
    """Separator-delimited text; decimals print as d.cc and dates as ISO."""
    df.select(_line(df).alias("value")).write.mode("overwrite").text(path)


def write_tbl_chunks(df: DataFrame, path: str, chunk: Column, chunks: int) -> None:
    """One folder per chunk, refresh set or segment.

    Rows are spread by chunk and a hash of the line, so that a chunk holding most rows
    is written by several tasks.
    """
    lines = df.select(chunk.alias("chunk"), _line(df).alias("value"))
    tasks = max(chunks, df.sparkSession.sparkContext.defaultParallelism)
    (
        lines.repartition(tasks, "chunk", F.pmod(F.xxhash64("value"), F.lit(max(1, tasks // chunks))))
        .write.mode("overwrite").partitionBy("chunk").text(path)
    )


def csv_export(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Write as CSV; nested columns become JSON text."""
    out = df if limit is None else df.limit(limit)
    flat = [
        F.to_json(name).alias(name) if kind.startswith(("struct", "array", "map")) else F.col(name)
        for name, kind in out.dtypes]
    out.select(*flat).write.mode("overwrite").csv(path)


def csv_import(spark: SparkSession, path: str, columns: T.StructType, target: str) -> DataFrame:
    """Append CSV rows to a stored table and return the table."""
    spark.read.schema(columns).csv(path).write.mode("append").parquet(target)
    return spark.read.parquet(target)


def read_golden(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """Answers with a header line and `` | `` between cells; columns go by position."""
    return (
        spark.read.schema(columns).option("sep", " | ").option("header", True)
        .option("enforceSchema", True).option("quote", "").option("escape", "").csv(path)
    )


def ranked(df: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """``df`` with ``place``: the rank of a row by ``numbers`` among the rows alike in ``keys``.

    Rows are cut into ranges by (key, numbers, a tie-breaker), so no task holds a whole key,
    let alone a whole answer without keys. The ranges are written down; a place is the rank
    within one's range plus the rows of that key in earlier ranges.
    """
    spark = df.sparkSession
    key = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("bigint")
    order = ["_key", *numbers, "_tie"]
    # equal rows are interchangeable; their tie-breaker lets a range end between them
    cut = df.withColumn("_key", key).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order)
    path = shared_dir(spark, "ranked")
    cut.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ahead = sizes.select("_key", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(W.partitionBy("_key", "_range").orderBy(*numbers, "_tie"))
    return rows.withColumn("place", inside).join(ahead, ["_key", "_range"]).withColumn(
        "place", F.col("place") + F.col("_ahead")).drop("_key", "_tie", "_range", "_ahead")


def compare_answers(result: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows found on one side only, or with a number further apart than ``tolerance``.

    Row order does not count, nor does the number of blanks in a text. Rows pair up on
    their other columns; rows alike in those pair in the order of their numbers.
    """
    kinds = dict(expected.dtypes)
    numbers = [n for n, kind in kinds.items() if kind in ("double", "float") or kind.startswith("decimal")]
    keys = [n for n in expected.columns if n not in numbers]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        cells = [F.col(k).cast(kinds[k]) for k in keys]
        cells = [F.trim(F.regexp_replace(c, " +", " ")) if kinds[k] == "string" else c for k, c in zip(keys, cells)]
        plain = df.select(*[c.alias(f"{prefix}{k}") for k, c in zip(keys, cells)],
                          *[F.col(n).cast("double").alias(f"{prefix}{n}") for n in numbers])
        return ranked(plain, [f"{prefix}{k}" for k in keys], [f"{prefix}{n}" for n in numbers]).withColumnRenamed(
            "place", f"{prefix}_place")

    left, right = side(result, "got_"), side(expected, "want_")
    on = F.col("got__place") == F.col("want__place")
    for key in keys:
        on = on & F.col(f"got_{key}").eqNullSafe(F.col(f"want_{key}"))
    apart = F.col("got__place").isNull() | F.col("want__place").isNull()
    for name in numbers:
        apart = apart | (F.abs(F.col(f"got_{name}") - F.col(f"want_{name}")) > tolerance)
        apart = apart | (F.col(f"got_{name}").isNull() != F.col(f"want_{name}").isNull())
    return left.join(right, on, "full").filter(apart)


def write_metrics_csv(rows: DataFrame, path: str) -> None:
    """Metric rows with a header, one file per task."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def split_columns(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """Values of a delimited file by column position, ready for one output per column."""
    lines = spark.read.text(path)
    cells = F.split(F.regexp_replace("value", f"\\{separator}$", ""), f"\\{separator}")
    return lines.select(F.posexplode(cells).alias("position", "cell"))


def write_split_columns(cells: DataFrame, path: str) -> None:
    cells.select("position", "cell").write.mode("overwrite").partitionBy("position").text(path)


def head_per_file(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` lines of every file.

    A file read by several tasks has its lines ordered by the start of the task's block
    and their order within it. The rank limit is pushed below the shuffle, so a task
    sends at most ``n`` lines per file however long the file is.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(W.partitionBy("file").orderBy("block", "at"))
    return lines.withColumn("place", place).filter(F.col("place") <= n).select(
        "file", "place", "value")


def last_row_per_chunk(df: DataFrame, chunk: Column, key: str) -> DataFrame:
    """The row with the largest key of every chunk."""
    return (
        df.withColumn("chunk", chunk).groupBy("chunk")
        .agg(F.max_by(F.struct(*df.columns), key).alias("row")).select("chunk", "row.*")
    )


def table_size(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows and file bytes of each table folder, and a ``total`` row."""
    sizes = None
    for name, path in tables.items():
        stored = spark.read.parquet(path)
        files = stored.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        per_file = files.groupBy("file", "size").agg(F.count(F.lit(1)).alias("rows"))
        row = per_file.agg(F.sum("rows").alias("rows"), F.sum("size").alias("bytes")).select(
            F.lit(name).alias("tbl"), "rows", "bytes")
        sizes = row if sizes is None else sizes.unionByName(row)
    return sizes.rollup("tbl").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).select(
        F.coalesce("tbl", F.lit("total")).alias("tbl"), "rows", "bytes")


# Types that Spark takes no column statistics of.
_NESTED = ("array", "struct", "map", "variant")


def analyzed(spark: SparkSession, tables: dict[str, str]) -> dict[str, DataFrame]:
    """The tables stored at the given paths, with statistics of every column that is not nested.

    ``ANALYZE TABLE`` counts rows, nulls, distinct values, bounds and lengths of each column;
    with ``spark.sql.cbo.enabled`` the optimizer estimates rows of filters and joins by them.
    Spark keeps statistics with a catalog entry, so each table gets one for the time being;
    the returned DataFrames are bound to it, and it is dropped again.
    """
    made = {}
    for name, path in tables.items():
        entry = f"analyzed_{name}_{uuid.uuid4().hex[:8]}"
        spark.catalog.createTable(entry, path=path, source="parquet")
        try:
            plain = [f"`{c}`" for c, kind in spark.table(entry).dtypes if not kind.startswith(_NESTED)]
            spark.sql(f"analyze table {entry} compute statistics" + (f" for columns {', '.join(plain)}" if plain else ""))
            made[name] = spark.table(entry)
            made[name]._jdf.queryExecution().optimizedPlan().stats()  # binds plan and statistics
        finally:
            spark.sql(f"drop table {entry}")
    return made


@contextmanager
def warmed(tables: dict[str, DataFrame]) -> Iterator[dict[str, int]]:
    """Rows of every table, which stay cached, in memory as far as that goes, while the block runs."""
    kept = {name: df.persist(StorageLevel.MEMORY_AND_DISK) for name, df in tables.items()}
    try:
        yield {name: df.count() for name, df in kept.items()}
    finally:
        for df in kept.values():
            df.unpersist()


def warm_cache(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Statistics of every table, then its rows counted through the cache, which is let go again."""
    with warmed(analyzed(spark, tables)) as counts:
        return spark.createDataFrame(sorted(counts.items()), "tbl string, n bigint")
