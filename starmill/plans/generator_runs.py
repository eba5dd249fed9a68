"""Registered generator runs: the rows named by the keys of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.shared import shared_dir
from starmill.generator import names, parameters, refresh, tables, text, words
from starmill.generator.scale import Scale
from starmill.generator.streams import alphanumeric, draw, jump, phone, pick, uniform
from starmill.generator.words import CONTAINERS, NATIONS, NOUNS
from starmill.sources.star import Star

#: Seeds of query parameters that a task draws from.
SEEDS = 5_000

Query = Callable[[SparkSession, str], DataFrame]


def _rows(star: Star, table: str, key: str) -> DataFrame:
    """One-based row numbers from the zero-based keys of a given table."""
    return star.raw(table).select((F.col(key) + 1).cast("bigint").alias("row"))


def _scale(star: Star) -> Scale:
    return Scale(star.raw("part").count(), star.raw("supplier").count(),
                 star.raw("customer").count(), star.raw("orders").count())


def _amounts(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for output."""
    return df.select(*[
        F.col(name).cast("double").alias(name) if kind.startswith("decimal") else F.col(name)
        for name, kind in df.dtypes])


def _pool(star: Star, characters: int = words.POOL_CHARACTERS) -> text.Pool:
    return text.build_pool(star.spark, shared_dir(star.spark, "pool"), characters)


def gen_rng_stream(star: Star) -> DataFrame:
    rows = _rows(star, "orders", "o_orderkey").select("row", jump(F.col("row"), 7).alias("j"))
    return rows.select(
        "row",
        draw("line_quantity", F.col("j"), 1).alias("first"),
        draw("line_quantity", F.col("j"), 7).alias("seventh"),
        uniform(draw("line_quantity", F.col("j"), 1), 1, 50).alias("quantity"))


def gen_weighted_choice(star: Star) -> DataFrame:
    rows = _rows(star, "part", "p_partkey").select("row", jump(F.col("row"), 1).alias("j"))
    value = draw("part_container", F.col("j"), 1)
    return rows.select("row", pick(value, CONTAINERS).alias("container"),
                       pick(value, NOUNS).alias("noun"))


def gen_permuted_string(star: Star) -> DataFrame:
    return names.part_names(_rows(star, "part", "p_partkey"))


def gen_alnum_string(star: Star) -> DataFrame:
    rows = _rows(star, "customer", "c_custkey")
    return rows.select(
        "row", alphanumeric("customer_address", jump(F.col("row"), 9), 25).alias("address"))


def gen_phone(star: Star) -> DataFrame:
    rows = _rows(star, "customer", "c_custkey")
    nation = uniform(draw("customer_nation", jump(F.col("row"), 1), 1), 1, len(NATIONS)) - 1
    return rows.select(
        "row", phone("customer_phone", jump(F.col("row"), 3), nation).alias("phone"))


def gen_text_comment(star: Star, characters: int = words.POOL_CHARACTERS) -> DataFrame:
    """Order comments from the exact pool."""
    pool = _pool(star, characters)
    rows = _rows(star, "orders", "o_orderkey").withColumn("j2", jump(F.col("row"), 2))
    span = text.comment_span("order_comment", F.col("j2"), characters)
    return text.with_comment(rows, pool, span, "comment").drop("j2")


def gen_comment_span(star: Star) -> DataFrame:
    """Where in the exact pool each order's comment lies."""
    rows = _rows(star, "orders", "o_orderkey").withColumn("j2", jump(F.col("row"), 2))
    at, size = text.comment_span("order_comment", F.col("j2"), text.words.POOL_CHARACTERS)
    return rows.select("row", at.alias("at"), size.alias("size"))


def gen_dates(star: Star) -> DataFrame:
    rows = _rows(star, "orders", "o_orderkey")
    day = uniform(draw("order_date", jump(F.col("row"), 1), 1), 0, tables.DAYS_OF_ORDERS - 1)
    return rows.select(
        "row", F.date_add(F.lit("1992-01-01").cast("date"), day.cast("int")).alias("order_date"))


def gen_time_dim(star: Star) -> DataFrame:
    """Calendar rows for the days on which the given orders were placed, moved to 1992 on."""
    days = star.orders.select(
        (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) + 1).cast("bigint")
        .alias("row")).distinct()
    return tables.time_dimension(days)


def gen_region(star: Star, pool: text.Pool | None = None) -> DataFrame:
    """Generated regions beside the given ones."""
    return tables.region(star.spark, pool).join(
        star.region.select("r_regionkey", F.col("r_name").alias("given_name")), "r_regionkey")


def gen_nation(star: Star, pool: text.Pool | None = None) -> DataFrame:
    return tables.nation(star.spark, pool).join(
        star.nation.select("n_nationkey", F.col("n_name").alias("given_name")), "n_nationkey")


def gen_supplier(star: Star, pool: text.Pool | None = None) -> DataFrame:
    return _amounts(tables.supplier(_rows(star, "supplier", "s_suppkey"), pool))


def gen_customer(star: Star, pool: text.Pool | None = None) -> DataFrame:
    return _amounts(tables.customer(_rows(star, "customer", "c_custkey"), pool))


def gen_part(star: Star, pool: text.Pool | None = None) -> DataFrame:
    rows = _rows(star, "part", "p_partkey")
    made = tables.part(rows, pool)
    return _amounts(made if pool is None else made.join(names.part_names(rows), "p_partkey"))


def gen_retail_price(star: Star) -> DataFrame:
    rows = _rows(star, "part", "p_partkey")
    return rows.select("row", tables.retail_price(F.col("row")).cast("bigint").alias("cents"))


def gen_partsupp(star: Star, pool: text.Pool | None = None) -> DataFrame:
    return _amounts(tables.partsupp(_rows(star, "part", "p_partkey"), _scale(star), pool))


def gen_orders(star: Star, pool: text.Pool | None = None) -> DataFrame:
    return _amounts(tables.orders(_rows(star, "orders", "o_orderkey"), _scale(star), pool))


def gen_lineitem(star: Star, pool: text.Pool | None = None) -> DataFrame:
    return _amounts(tables.lineitem(_rows(star, "orders", "o_orderkey"), _scale(star), pool))


def gen_sparse_key(star: Star) -> DataFrame:
    rows = _rows(star, "orders", "o_orderkey")
    return rows.select("row", tables.sparse_key(F.col("row")).alias("base_key"),
                       tables.sparse_key(F.col("row"), 1).alias("new_key"))


def gen_chunk(star: Star, chunks: int = 7) -> DataFrame:
    """Chunk of each row when the orders are made in equal chunks."""
    rows = _rows(star, "orders", "o_orderkey")
    size = star.raw("orders").count() // chunks
    chunk: Column = F.least(F.floor((F.col("row") - 1) / size) + 1, F.lit(chunks))
    return rows.groupBy(chunk.cast("int").alias("chunk")).agg(
        F.min("row").alias("first"), F.max("row").alias("last"), F.count("row").alias("n"))


def _sets(star: Star) -> DataFrame:
    """One refresh set per given nation."""
    return star.raw("nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("set_number"))


def gen_refresh_inserts(star: Star, pool: text.Pool | None = None) -> DataFrame:
    scale = _scale(star)
    return _amounts(refresh.new_orders(refresh.set_rows(_sets(star), scale), scale, pool))


def gen_refresh_lines(star: Star, pool: text.Pool | None = None) -> DataFrame:
    scale = _scale(star)
    return _amounts(refresh.new_lines(refresh.set_rows(_sets(star), scale), scale, pool))


def gen_refresh_deletes(star: Star) -> DataFrame:
    return refresh.deleted_keys(refresh.set_rows(_sets(star), _scale(star)))


def gen_refresh_segments(star: Star, segments: int = 4) -> DataFrame:
    scale = _scale(star)
    size = refresh.orders_per_set(scale)
    return refresh.set_rows(_sets(star), scale).select(
        "set_number", "position",
        refresh.insert_segment(F.col("position"), size, segments).cast("bigint").alias("inserts"),
        refresh.delete_segment(F.col("position"), size, segments).cast("bigint").alias("deletes"))


def gen_series(star: Star) -> DataFrame:
    """Rows 1..n with expressions, one per given order."""
    rows = _rows(star, "orders", "o_orderkey")
    n = rows.agg(F.count(F.lit(1))).scalar()
    return rows.select(
        F.col("row").alias("a"), (F.col("row") * 2).alias("b"), (F.col("row") % 100).alias("c"),
        (n - F.col("row")).alias("d"))


def random_tables(spark: SparkSession, tables_wanted: int, seed: int, low: int = 1_000,
                  high: int = 1_000_000) -> list[DataFrame]:
    """Tables (a, b) with a = b = 1..n for seeded random sizes."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10)
    sizes = spark.range(tables_wanted).select(
        (drawn.cast("bigint") % F.lit(high - low + 1) + low).alias("n")).collect()
    return [
        spark.range(1, row["n"] + 1).select(F.col("id").alias("a"), F.col("id").alias("b"))
        for row in sizes]


def gen_random_tables(star: Star) -> DataFrame:
    """One table per given region; sizes follow the number of customers."""
    n = star.raw("customer").count()
    wanted = star.raw("region").count()
    made = random_tables(star.spark, wanted, seed=7, low=n, high=2 * n)
    out = made[0].withColumn("tbl", F.lit(0))
    for number, table in enumerate(made[1:], 1):
        out = out.unionByName(table.withColumn("tbl", F.lit(number)))
    return out.groupBy("tbl").agg(
        F.count("a").alias("n"), F.max("a").alias("largest"), F.sum("b").alias("total"))


def gen_query_params(star: Star) -> DataFrame:
    """Parameters of all queries, one seed per given customer."""
    seeds = _rows(star, "customer", "c_custkey").withColumnRenamed("row", "seed")
    # a seed makes 22 rows, and the file of the keys is too small for Spark to cut it
    seeds = seeds.repartition(max(1, star.raw("customer").count() // SEEDS), "seed")
    return parameters.query_parameters(seeds).select(
        "seed", "query", F.array_join("parameters", "|").alias("parameters"))


def gen_query_order(star: Star) -> DataFrame:
    """Query order of one stream per given customer; they run the known streams in turn."""
    known = len(words.QUERY_ORDERS)
    return parameters.query_order(
        star.raw("customer").select((F.col("c_custkey") % known).cast("bigint").alias("stream")))


PLANS = (
    gen_rng_stream, gen_weighted_choice, gen_permuted_string, gen_alnum_string, gen_phone,
    gen_text_comment, gen_comment_span, gen_dates, gen_time_dim, gen_region, gen_nation,
    gen_supplier, gen_customer, gen_part, gen_retail_price, gen_partsupp, gen_orders,
    gen_lineitem, gen_sparse_key, gen_chunk, gen_refresh_inserts, gen_refresh_lines,
    gen_refresh_deletes, gen_refresh_segments, gen_series, gen_random_tables,
    gen_query_params, gen_query_order,
)

#: Registered again as ``..._full``, with comments from the exact pool (and names of parts), which have no SQL.
COMMENTED = (
    gen_region, gen_nation, gen_supplier, gen_customer, gen_part, gen_partsupp, gen_orders,
    gen_lineitem, gen_refresh_inserts, gen_refresh_lines,
)


def generator_queries() -> dict[str, Query]:
    def run(plan: Callable[[Star], DataFrame]) -> Query:
        return lambda spark, path: plan(Star(spark, path, idle_customers=True))

    def full(plan: Callable[[Star, text.Pool], DataFrame]) -> Query:
        return run(lambda star: plan(star, _pool(star)))

    return {**{plan.__name__: run(plan) for plan in PLANS},
            **{f"{plan.__name__}_full": full(plan) for plan in COMMENTED}}
