"""File sources and sinks, log reducers and the refresh stream."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.functions import logs
from starmill.functions.shared import shared_dir
from starmill.generator import refresh, tables
from starmill.generator.scale import Scale, row_numbers
from starmill.operators import dml
from starmill.sources import files
from starmill.streaming.refresh import apply_arrived, collect_changes


def test_tbl_round_trip(spark, tmp_path):
    scale = Scale.of(0.001)
    made = tables.customer(row_numbers(spark, 1, scale.customers)).withColumn(
        "c_comment", F.lit('a "quoted" word'))
    files.write_tbl(made, str(tmp_path / "customer.tbl"))
    back = files.read_tbl(spark, str(tmp_path), "customer")
    assert back.exceptAll(made.select(back.columns)).count() == 0
    assert back.count() == scale.customers
    line = spark.read.text(str(tmp_path / "customer.tbl")).first().value
    assert line.endswith("|") and line.count("|") == 8


def test_head_per_file_keeps_the_first_lines(spark, tmp_path):
    for name, count in (("a.txt", 10), ("b.txt", 2)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(count)))
    got = files.head_per_file(spark, str(tmp_path), 3).collect()
    assert sorted(r.value for r in got) == [
        "a.txt 0", "a.txt 1", "a.txt 2", "b.txt 0", "b.txt 1"]


def test_head_per_file_limits_before_the_shuffle(spark, tmp_path, plan):
    (tmp_path / "a.txt").write_text("x\n")
    text = plan(files.head_per_file(spark, str(tmp_path), 3))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_golden_comparison(spark, tmp_path):
    path = tmp_path / "q.out"
    path.write_text("name | total | n\nalpha  x | 10.50 | 3\nbeta | 2.00 | 1\n")
    columns = T.StructType.fromDDL("name string, total double, n bigint")
    want = files.read_golden(spark, str(path), columns)
    near = spark.createDataFrame([("beta", 2.005, 1), ("alpha x ", 10.5, 3)], columns)
    assert files.compare_answers(near, want).count() == 0
    far = spark.createDataFrame([("beta", 2.5, 1), ("gamma", 1.0, 3)], columns)
    assert files.compare_answers(far, want).count() == 3


def test_table_size(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(3).write.parquet(path)
    total = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)
                if f.endswith(".parquet"))
    got = {r.tbl: (r.rows, r.bytes) for r in files.table_size(spark, {"t": path}).collect()}
    assert got == {"t": (1000, total), "total": (1000, total)}


def test_logs(spark):
    lines = spark.createDataFrame([
        (1, "latency average = 12.5 ms"), (1, "tps = 80.1 (including connections establishing)"),
        (1, "tps = 81.2 (excluding connections establishing)"),
        (2, "latency average = 3.0 ms"), (2, "tps = 7.5 (without initial connection time)"),
        (3, "BENCH FAILED"),
    ], "run int, value string")
    got = {r.run: tuple(r)[1:] for r in logs.parse_bench_log(lines).collect()}
    assert got == {1: (12.5, 81.2, 80.1, False), 2: (3.0, 7.5, None, False),
                   3: (None, None, None, True)}


def test_trace_filter_matches_substring_search(spark):
    texts = ["==7== at shard_a", "==7== next", "by ==7==x", "==77== other", "==8== SHARD",
             "z==8==", "plain", ""]
    lines = spark.createDataFrame(list(enumerate(texts)), "line int, value string")
    ids = {t.split()[0] for t in texts if "shard" in t.lower()}
    expected = [i for i, t in enumerate(texts) if any(x in t for x in ids)]
    assert sorted(r.line for r in logs.log_trace_filter(lines, "shard").collect()) == expected
    assert not logs.no_traces(lines, "shard").first().success
    assert logs.no_traces(lines, "absent").first().success
    assert logs.log_trace_filter(lines, "absent").count() == 0


def test_refresh_stream_equals_batch(spark, tmp_path):
    """Generated sets that arrive in two runs, one of them delivered twice."""
    scale = Scale.of(0.01)
    base = row_numbers(spark, 1, 400)
    orders = tables.orders(base, scale).withColumn("o_comment", F.lit(""))
    lines = tables.lineitem(base, scale).withColumn("l_comment", F.lit(""))
    incoming, work = str(tmp_path / "in"), str(tmp_path / "work")

    def one_set(number):
        rows = refresh.set_rows(
            spark.range(number, number + 1).withColumnRenamed("id", "set_number"), scale)
        return (refresh.new_orders(rows, scale).withColumn("o_comment", F.lit("")),
                refresh.new_lines(rows, scale).withColumn("l_comment", F.lit("")),
                refresh.deleted_keys(rows).select("o_orderkey"))

    def deliver(number, folder=""):
        new_orders, new_lines, deleted = one_set(number)
        files.write_tbl(new_orders, f"{incoming}{folder}/orders.tbl.u{number}")
        files.write_tbl(new_lines, f"{incoming}{folder}/lineitem.tbl.u{number}")
        files.write_tbl(deleted, f"{incoming}{folder}/delete.{number}")

    deliver(1)
    deliver(2)
    collect_changes(spark, incoming, work)
    deliver(2, "/again")
    deliver(3)
    got_orders, got_lines = apply_arrived(spark, incoming, work, orders, lines)
    want_orders, want_lines = orders, lines
    for number in (1, 2, 3):
        want_orders, want_lines = dml.refresh(want_orders, want_lines, *one_set(number))
    assert got_orders.exceptAll(want_orders).count() == 0
    assert want_orders.exceptAll(got_orders).count() == 0
    assert got_lines.count() == want_lines.count()
    assert got_lines.exceptAll(want_lines).count() == 0


def test_a_set_may_arrive_in_parts(spark, tmp_path):
    """Parts of one set in two batches, and a part that comes again, equal the whole set."""
    scale = Scale.of(0.01)
    base = row_numbers(spark, 1, 300)
    orders = tables.orders(base, scale).withColumn("o_comment", F.lit(""))
    lines = tables.lineitem(base, scale).withColumn("l_comment", F.lit(""))
    more = row_numbers(spark, 301, 400)
    new_orders = tables.orders(more, scale).withColumn("o_comment", F.lit(""))
    new_lines = tables.lineitem(more, scale).withColumn("l_comment", F.lit(""))
    incoming, work = str(tmp_path / "in"), str(tmp_path / "work")
    first, second = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1
    files.write_tbl(new_orders.filter(first), f"{incoming}/a/orders.tbl.u1")
    files.write_tbl(new_lines, f"{incoming}/a/lineitem.tbl.u1")
    files.write_tbl(orders.filter("o_orderkey < 40").select("o_orderkey"), f"{incoming}/a/delete.1")
    collect_changes(spark, incoming, work)
    files.write_tbl(new_orders.filter(second), f"{incoming}/b/orders.tbl.u1")
    files.write_tbl(new_orders.filter(first).repartition(3), f"{incoming}/c/orders.tbl.u1")
    got_orders, got_lines = apply_arrived(spark, incoming, work, orders, lines)
    deleted = orders.filter("o_orderkey < 40").select("o_orderkey")
    want_orders, want_lines = dml.refresh(orders, lines, new_orders, new_lines, deleted)
    assert got_orders.count() == want_orders.count() and got_orders.exceptAll(want_orders).count() == 0
    assert got_lines.count() == want_lines.count() and got_lines.exceptAll(want_lines).count() == 0


def test_shared_dir_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    one, other = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one != other
    if named:
        assert one.startswith(f"{named.rstrip('/')}/x-")
