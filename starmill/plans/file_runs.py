"""Registered runs of file sources and sinks, log reducers, the refresh stream and the
query-stream run. Files are written to the shared folder from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions import logs
from starmill.functions.money import rounded
from starmill.functions.shared import shared_dir
from starmill.generator.parameters import query_order, query_parameters
from starmill.plans import star_suite
from starmill.plans.star_runs import drawn_arguments
from starmill.sources import files
from starmill.sources.star import Star
from starmill.streaming.refresh import apply_arrived

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
GIVEN = (*TABLES, "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# --- scans, sources, sinks ---------------------------------------------------

def scan_parquet(star: Star) -> DataFrame:
    """Rows of every given table and the sum of its first column, a key."""
    out = None
    for name in GIVEN:
        rows = star.raw(name)
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(rows.columns[0]).cast("bigint")).alias("key_total")).select(
            F.lit(name).alias("tbl"), "n", "key_total")
        out = row if out is None else out.unionByName(row)
    return out


def _written_orders(star: Star, chunks: int = 4) -> str:
    folder = shared_dir(star.spark, "tbl")
    for chunk in range(chunks):
        files.write_tbl(star.orders.filter(F.col("o_orderkey") % chunks == chunk),
                        f"{folder}/orders.tbl.{chunk + 1}")
    return folder


def read_tbl(star: Star) -> DataFrame:
    """Orders written as four delimited files and read back with types."""
    return files.read_tbl(star.spark, _written_orders(star), "orders").withColumn(
        "o_totalprice", F.col("o_totalprice").cast("double"))


def write_tbl(star: Star) -> DataFrame:
    path = f"{shared_dir(star.spark, 'tbl')}/orders.tbl"
    files.write_tbl(star.orders, path)
    return star.spark.read.text(path).select(F.col("value").alias("line"))


def write_tbl_chunks(star: Star, chunks: int = 7) -> DataFrame:
    path = shared_dir(star.spark, "chunks")
    files.write_tbl_chunks(
        star.orders, path, (F.col("o_orderkey") % chunks).cast("int"), chunks)
    return star.spark.read.text(path).groupBy("chunk").agg(F.count("value").alias("n"))


def csv_export(star: Star) -> DataFrame:
    """The hundred largest orders with a nested column, written as CSV and read back."""
    path = shared_dir(star.spark, "csv")
    rows = star.orders.select(
        "o_orderkey", F.struct(F.col("o_custkey").alias("f1")).alias("detail"), "o_totalprice")
    files.csv_export(rows.orderBy(F.desc("o_totalprice"), "o_orderkey"), path, 100)
    back = star.spark.read.schema("o_orderkey bigint, detail string, price double").csv(path)
    return back.select(
        "o_orderkey", F.get_json_object("detail", "$.f1").cast("bigint").alias("f1"), "price")


def csv_import(star: Star) -> DataFrame:
    """Four integers per line appended to a stored table that already holds them."""
    spark, base = star.spark, shared_dir(star.spark, "import")
    columns = T.StructType.fromDDL("a bigint, b bigint, c bigint, d bigint")
    rows = star.orders.selectExpr(
        "o_orderkey as a", "o_custkey as b", "o_orderkey % 100 as c", "o_custkey % 100 as d")
    files.csv_export(rows, f"{base}/csv")
    rows.write.mode("overwrite").parquet(f"{base}/table")
    return files.csv_import(spark, f"{base}/csv", columns, f"{base}/table").groupBy("c").agg(
        F.count("a").alias("n"), F.sum("b").alias("total"))


def _answers(star: Star) -> DataFrame:
    return star.orders.groupBy("o_orderpriority").agg(
        rounded(F.sum("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n"))


def _written_answers(star: Star) -> DataFrame:
    """Answers written in the golden layout and read back."""
    path = shared_dir(star.spark, "golden")
    lines = _answers(star).select(F.lit(1).alias("at"), F.concat_ws(
        " | ", "o_orderpriority", F.format_string("%.2f", "total"), "n").alias("value"))
    header = star.spark.range(1).select(
        F.lit(0).alias("at"), F.lit("o_orderpriorit | total | n").alias("value"))
    # One file whose first line is the header; there is one row per priority.
    header.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    columns = T.StructType.fromDDL("o_orderpriority string, total double, n bigint")
    return files.read_golden(star.spark, path, columns)


def read_golden(star: Star) -> DataFrame:
    return _written_answers(star)


def compare_answers(star: Star) -> DataFrame:
    """Answers against a golden file; one priority is off by one to show as different."""
    off = F.when(F.col("o_orderpriority") == "5-LOW", F.col("total") + 1).otherwise(F.col("total"))
    return files.compare_answers(
        _answers(star).withColumn("total", off), _written_answers(star)
    ).select("got_o_orderpriority", "got_n", F.round(F.col("got_total") - F.col("want_total"), 2)
             .alias("apart"))


def write_metrics_csv(star: Star) -> DataFrame:
    path = shared_dir(star.spark, "metrics")
    files.write_metrics_csv(logs.parse_bench_log(_bench_lines(star)), path)
    columns = "run bigint, latency_ms double, tps_excluding double, tps_including double, failed boolean"
    return star.spark.read.schema(columns).option("header", True).csv(path)


def split_columns(star: Star) -> DataFrame:
    cells = files.split_columns(star.spark, f"{_written_orders(star)}/orders.tbl*")
    return cells.groupBy("position").agg(
        F.count("cell").alias("n"), F.countDistinct("cell").alias("different"))


def head_per_file(star: Star, n: int = 3) -> DataFrame:
    """Three first lines of each file; a file has the orders of a thousand keys in order."""
    folder = shared_dir(star.spark, "head")
    rows = star.orders.select(
        F.floor(F.col("o_orderkey") / 1000).alias("chunk"), "o_orderkey",
        F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    rows.repartition("chunk").sortWithinPartitions("chunk", "o_orderkey").select(
        "chunk", "value").write.partitionBy("chunk").text(folder)
    return files.head_per_file(star.spark, folder, n).select(
        "place", F.split("value", r"\|")[0].cast("bigint").alias("o_orderkey"))


def last_row_per_chunk(star: Star, chunks: int = 13) -> DataFrame:
    return files.last_row_per_chunk(
        star.orders.select("o_orderkey", "o_custkey", "o_orderdate"),
        (F.col("o_orderkey") % chunks).cast("int"), "o_orderkey")


def table_size(star: Star) -> DataFrame:
    """Rows of each given table and in all, and whether its files have bytes."""
    return files.table_size(
        star.spark, {name: f"{star.path}/{name}.parquet" for name in GIVEN}
    ).select("tbl", "rows", (F.col("bytes") > 0).alias("stored"))


def warm_cache(star: Star) -> DataFrame:
    """Rows of each given table, counted through the cache after its statistics are taken."""
    return files.warm_cache(star.spark, {name: f"{star.path}/{name}.parquet" for name in GIVEN})


# --- log reducers ------------------------------------------------------------

def _lines(events: DataFrame, run: Column, *texts: Column) -> DataFrame:
    return events.select(run.alias("run"), F.explode(F.array(*texts)).alias("value"))


def _bench_lines(star: Star) -> DataFrame:
    """One benchmark log per event: old and new layout in turn, every seventh failed."""
    latency = (F.col("event_id") % 1000 / 8).cast("string")
    tps = (F.col("event_id") % 5000 + 0.25).cast("string")
    n = F.col("event_id")
    return _lines(
        star.raw("events"), n,
        F.when(n % 7 == 0, "BENCH FAILED").otherwise(
            F.concat(F.lit("latency average = "), latency, F.lit(" ms"))),
        F.when(n % 7 == 0, "").when(n % 2 == 0, F.concat(
            F.lit("tps = "), tps, F.lit(" (excluding connections establishing)"))).otherwise(
            F.concat(F.lit("tps = "), tps, F.lit(" (without initial connection time)"))),
        F.when((n % 7 != 0) & (n % 2 == 0), F.concat(
            F.lit("tps = "), (n % 5000).cast("string"),
            F.lit(".0 (including connections establishing)"))).otherwise("done"),
    )


def parse_bench_log(star: Star) -> DataFrame:
    return logs.parse_bench_log(_bench_lines(star))


def ch_timings(star: Star) -> DataFrame:
    query, ms = F.col("event_id") % 22 + 1, F.col("event_id") * 37 % 90_000
    return logs.query_timings(_lines(
        star.raw("events"), F.lit(0),
        F.concat(query.cast("string"), F.lit(" started at "), F.col("ts").cast("string")),
        F.concat(query.cast("string"), F.lit(" finished in "), ms.cast("string"),
                 F.lit(" milliseconds"))))


def ch_qph(star: Star) -> DataFrame:
    return logs.queries_per_hour(_lines(
        star.raw("events"), F.col("event_id"),
        F.concat(F.lit("queries "), (F.col("event_id") % 500).cast("string"), F.lit(" in "),
                 (F.col("user_id") + 100).cast("string"), F.lit(" seconds")),
        F.lit("QPH 0")))


def nopm(star: Star) -> DataFrame:
    return logs.new_orders_per_minute(_lines(
        star.raw("events"), F.col("event_id"), F.lit("Vuser 1:TEST RESULT"),
        F.concat(F.lit("System achieved "), (F.col("event_id") * 3).cast("string"),
                 F.lit(" NOPM from 99 TPM"))))


def _traces(star: Star) -> DataFrame:
    return star.raw("events").select(
        F.col("event_id").alias("line"),
        F.concat(F.lit("=="), F.col("user_id").cast("string"), F.lit("== at "),
                 F.when(F.col("event_id") % 997 == 5, "SHARD_call").otherwise(F.col("event_type")),
                 F.lit(" in "), F.col("props")).alias("value"))


def log_trace_filter(star: Star) -> DataFrame:
    return logs.log_trace_filter(_traces(star), "shard").select("line")


def log_success(star: Star) -> DataFrame:
    return logs.no_traces(_traces(star), "shard")


# --- refresh stream and query streams ----------------------------------------

def stream_refresh_apply(star: Star, sets: int = 3) -> DataFrame:
    """Sets of new orders with their lines and of deletes, taken in as a stream.

    Set s inserts the orders with key % 30 = s under shifted keys and deletes those of
    the event ids with remainder s.
    """
    spark = star.spark
    incoming, work = shared_dir(spark, "incoming"), shared_dir(spark, "refresh")
    orders, lines = star.orders, star.lineitem
    shift = orders.agg(F.max("o_orderkey") + 1).scalar()
    for number in range(1, sets + 1):
        files.write_tbl(
            orders.filter(F.col("o_orderkey") % 30 == number).withColumn(
                "o_orderkey", F.col("o_orderkey") + shift), f"{incoming}/orders.tbl.u{number}")
        files.write_tbl(
            lines.filter(F.col("l_orderkey") % 30 == number).withColumn(
                "l_orderkey", F.col("l_orderkey") + shift), f"{incoming}/lineitem.tbl.u{number}")
        files.write_tbl(
            star.raw("events").filter(F.col("event_id") % 30 == number).select("event_id"),
            f"{incoming}/delete.{number}")
    after_orders, after_lines = apply_arrived(spark, incoming, work, orders, lines)
    per_order = after_lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return (
        after_orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("orders"), rounded(F.sum("q")).alias("quantity"))
    )


def run_stream(star: Star, stream: int, parameters: dict[str, dict],
               orders: list[tuple[int, ...]] | None = None) -> DataFrame:
    """All queries in the order of a stream: rows and a checksum of each.

    ``parameters`` holds the arguments per query, as ``drawn_arguments`` makes them from
    the parameters drawn for the stream's seed.
    """
    order = query_order(
        star.spark.range(stream, stream + 1).withColumnRenamed("id", "stream"), orders)
    out = None
    for row in sorted(order.collect(), key=lambda r: r["position"]):  # 22 rows
        name = f"q{row['query']:02d}"
        answer = getattr(star_suite, name)(star, **parameters[name])
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in answer.columns]
        # crc32 values sum without overflow and do not depend on the row order
        summary = answer.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.crc32(F.concat_ws("|", *cells))), F.lit(0)).alias("checksum"))
        line = summary.select(
            F.lit(stream).alias("stream"), F.lit(row["position"]).alias("position"),
            F.lit(row["query"]).alias("query"), "rows", "checksum")
        out = line if out is None else out.unionByName(line)
    return out


def stream_run(star: Star, stream: int = 1, seed: int = 19_620_718) -> DataFrame:
    """A stream with the parameters that its seed draws."""
    seeds = star.spark.range(seed, seed + 1).withColumnRenamed("id", "seed")
    drawn = query_parameters(seeds).collect()  # 22 rows
    return run_stream(star, stream, {
        f"q{row['query']:02d}": drawn_arguments(row["query"], list(row["parameters"])) for row in drawn})


PLANS = (
    scan_parquet, read_tbl, write_tbl, write_tbl_chunks, csv_export, csv_import, read_golden,
    compare_answers, write_metrics_csv, split_columns, head_per_file, last_row_per_chunk,
    table_size, warm_cache, parse_bench_log, ch_timings, ch_qph, nopm, log_trace_filter,
    log_success, stream_refresh_apply, stream_run,
)


def file_queries() -> dict[str, Query]:
    def run(plan: Callable[[Star], DataFrame]) -> Query:
        return lambda spark, path: plan(Star(spark, path, idle_customers=True))

    return {plan.__name__: run(plan) for plan in PLANS}
