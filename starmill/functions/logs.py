"""Reducers from log lines to metrics.

A log is a DataFrame with a text column ``value``; ``run`` tells runs apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.functions import substrings


def _found(pattern: str) -> Column:
    """First group of the pattern, or null if a line does not match."""
    text = F.regexp_extract("value", pattern, 1)
    return F.when(F.col("value").rlike(pattern), text)


def parse_bench_log(lines: DataFrame) -> DataFrame:
    """Latency and transaction rates per run.

    A run without a latency line failed. Newer logs give only the rate without the
    initial connection time, which counts as the one excluding connections.
    """
    reduced = lines.groupBy("run").agg(
        F.max(_found(r"latency average = (.+?) ms")).alias("latency"),
        F.max(_found(r"tps = (.+?) \(including connections establishing\)")).alias("including"),
        F.max(_found(r"tps = (.+?) \(excluding connections establishing\)")).alias("excluding"),
        F.max(_found(r"tps = (.+?) \(without initial connection time\)")).alias("without"),
    )
    return reduced.select(
        "run", F.col("latency").cast("double").alias("latency_ms"),
        F.coalesce("excluding", "without").cast("double").alias("tps_excluding"),
        F.col("including").cast("double").alias("tps_including"),
        F.col("latency").isNull().alias("failed"))


def query_timings(lines: DataFrame) -> DataFrame:
    """Runs and milliseconds per query from "N finished in M milliseconds"."""
    pattern = r"^(\d+) finished in (\d+) milliseconds$"
    timed = lines.filter(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("query"),
        F.regexp_extract("value", pattern, 2).cast("bigint").alias("ms"))
    return timed.groupBy("query").agg(
        F.count("ms").alias("runs"), F.sum("ms").alias("total_ms"), F.min("ms").alias("fastest_ms"),
        F.max("ms").alias("slowest_ms"))


def queries_per_hour(lines: DataFrame) -> DataFrame:
    """3600 n / s per run from "queries N in S seconds"."""
    pattern = r"^queries (\d+) in ([0-9.]+) seconds$"
    return lines.filter(F.col("value").rlike(pattern)).select(
        "run",
        F.round(3600.0 * F.regexp_extract("value", pattern, 1).cast("double")
                / F.regexp_extract("value", pattern, 2).cast("double"), 4).alias("qph"))


def new_orders_per_minute(lines: DataFrame) -> DataFrame:
    """The number in front of NOPM per run."""
    pattern = r"([0-9]+)(?= NOPM)"
    return lines.filter(F.col("value").rlike(pattern)).select(
        "run", F.regexp_extract("value", pattern, 1).cast("bigint").alias("nopm"))


def log_trace_filter(lines: DataFrame, word: str) -> DataFrame:
    """Lines that contain the id (first token) of some line mentioning ``word``.

    An id may stand anywhere in a line, also inside a longer token. ``substrings`` finds
    them through Bloom filters sized by the number of ids.
    """
    ids = (
        lines.filter(F.lower("value").contains(word.lower()))
        .select(F.split(F.ltrim("value"), r"\s+")[0].alias("id"))
        .filter(F.col("id") != "").distinct()
    )
    return lines.join(substrings.containing(lines, ids), "line", "left_semi")


def no_traces(lines: DataFrame, word: str) -> DataFrame:
    """One row: true when no line mentions ``word``."""
    return lines.agg(
        (F.count(F.when(F.lower("value").contains(word.lower()), 1)) == 0).alias("success"))
