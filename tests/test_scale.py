"""Features whose point is size: many ids, hot keys, long scans, deep logs."""

import os
import random
import uuid

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from starmill.functions import logs, substrings
from starmill.functions.shared import shared_dir
from starmill.generator import names
from starmill.generator.scale import row_numbers
from starmill.operators import checks, layout, paging
from starmill.plans import upkeep_runs
from starmill.sources import files
from starmill.sources.star import Star
from starmill.streaming import refresh


# --- many ids in many lines ---------------------------------------------------

def test_a_million_ids_explode_little_more_than_their_hits(spark):
    ids, others = 1_000_000, 300_000
    token = F.concat(F.lit("=="), F.hex(F.xxhash64("id")), F.lit("=="))
    own = spark.range(ids).select(F.col("id").alias("line"), F.concat(token, F.lit(" at SHARD_call here")).alias("value"))
    plain = spark.range(ids, ids + others).select(
        F.col("id").alias("line"), F.concat(F.lit("no id but much text, "), F.hex(F.xxhash64("id")), F.lit("==")).alias("value"))
    known = spark.range(ids).select(token.alias("id"))
    lines = own.union(plain)
    found = substrings.candidates(lines, known)
    seen = found.agg(F.count("*").alias("n"), F.countDistinct("line").alias("lines")).first()
    assert ids <= seen.n <= 1.02 * ids and seen.lines >= ids
    assert logs.log_trace_filter(lines, "shard").agg(F.count("*"), F.max("line")).first() == (ids, ids - 1)


@pytest.mark.parametrize("most", [substrings.SLICE, 40])
def test_containing_equals_a_search_of_each(spark, most):
    rng = random.Random(5)
    letters = "ab=é\U0001f600 "
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(300)] + [None, "", "x" * 3_000_000 + "ab=ab=ab"]
    wanted = {"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(120)} | {"ab=ab=ab"}
    lines = spark.createDataFrame(list(enumerate(texts)), "line int, value string")
    for more in (set(), {""}):
        ids = spark.createDataFrame([(x,) for x in sorted(wanted | more)] + [(None,)], "id string")
        want = [k for k, t in enumerate(texts) if t is not None and any(x in t for x in wanted | more)]
        assert sorted(r.line for r in substrings.containing(lines, ids, most).collect()) == want
    assert substrings.containing(lines, ids.where("false")).count() == 0


# --- hot keys in stored layouts -----------------------------------------------

def hot_rows(spark, n=60_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 30 == 1, F.lit(None)).otherwise(F.col("id") % 3001)
        .cast("bigint").alias("k"), F.lit(1).alias("v"))


def test_a_hot_key_fills_no_bucket(spark, plan):
    buckets, rows = 16, hot_rows(spark)
    heavy = {r.key: r.n for r in layout.heavy_keys(rows, "k", 0.5 / buckets).collect()}
    assert set(heavy) == {5, None} and heavy[5] == rows.where("k = 5").count()
    path = shared_dir(spark, "hot")
    stored = layout.table_distribute(rows, "hash", path, f"t_{uuid.uuid4().hex[:8]}", "k", buckets)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 2 * 60_000 / buckets and len(sizes) == buckets
    assert stored.columns == ["k", "v"] and stored.exceptAll(rows).count() == 0


def test_the_other_side_meets_every_cut_without_an_exchange(spark, plan):
    rows = hot_rows(spark)
    keys = spark.range(0, 6000, 2).select(F.col("id").alias("p"), (F.col("id") * 10).alias("w")).union(
        spark.createDataFrame([(5, 7), (5, 8), (None, 9)], "p bigint, w bigint"))
    large, small = layout.write_colocated(rows, "k", keys, "p", shared_dir(spark, "pair"), uuid.uuid4().hex[:8], 16)
    joined = small.hint("merge").join(large, (F.col("k") == F.col("p")) & (large["_salt"] == small["_salt"]))
    got = joined.groupBy("p").agg(F.sum("v").alias("n"), F.sum("w").alias("w"))
    want = rows.join(keys, F.col("k") == F.col("p")).groupBy("p").agg(F.sum("v").alias("n"), F.sum("w").alias("w"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    text = plan(joined)
    assert "Exchange" not in text[text.index("SortMergeJoin"):]


def test_no_heavy_key_means_no_salt(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"))
    assert layout.salts(rows, "k", 8).count() == 0
    assert layout.salts(rows.where("false"), "k", 8).count() == 0


# --- names --------------------------------------------------------------------

def test_names_of_three_million_parts_do_not_depend_on_chunks(spark):
    sums = [names.part_names(row_numbers(spark, 1, 3_000_000), size).agg(
        F.count("*"), F.sum(F.xxhash64("p_partkey", "p_name").cast("decimal(38,0)"))).first() for size in (4096, 5000)]
    assert sums[0] == sums[1] and sums[0][0] == 3_000_000


def test_names_need_several_levels(spark, monkeypatch):
    want = [r.p_name for r in names.part_names(row_numbers(spark, 1, 700)).orderBy("p_partkey").collect()]
    moves = row_numbers(spark, 1, 700).select((F.col("row") - 1).alias("at"), F.col("row").alias("first"), F.col("row").alias("last"))
    single = moves.select(F.col("at").alias("chunk"), "first", "last").mapInArrow(names._reduce_rows, "at bigint, moved binary")
    starts = {r.at: np.frombuffer(bytes(r.start), np.uint8) for r in names._starts(single, 700).collect()}
    after = {r.at: starts[r.at][np.frombuffer(bytes(r.moved), np.uint8)] for r in single.collect()}
    assert [" ".join(names.words.COLOURS[i] for i in after[k][:5]) for k in range(700)] == want


# --- constraints --------------------------------------------------------------

def test_foreign_keys_read_each_table_once(spark, star, plan):
    text = plan(checks.star_foreign_keys(star), "formatted")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        assert text.count(f"/{name}.parquet]") == 1, name
    assert plan(checks.star_foreign_keys(star)).count("Exchange ") == 3


def test_foreign_keys_of_a_full_schema_take_two_exchanges(spark, star, tmp_path, plan):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        os.symlink(f"{star.path}/{name}.parquet", tmp_path / f"{name}.parquet")
    star.partsupp.where("ps_partkey > 3").union(
        star.partsupp.selectExpr("-ps_partkey", "ps_suppkey", "ps_availqty", "ps_supplycost", "ps_comment")).write.parquet(
        str(tmp_path / "partsupp.parquet"))
    full = Star(spark, str(tmp_path), idle_customers=True)
    got = {r.foreign_key: (r["keys"], r.n) for r in checks.star_foreign_keys(full).collect()}
    for child, columns, parent, parent_columns in checks.FOREIGN_KEYS:
        orphans = checks.foreign_key(getattr(full, child), columns, getattr(full, parent), parent_columns)
        want = orphans.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        assert got[f"{child}.{'+'.join(columns)}"] == tuple(want)
    assert got["partsupp.ps_partkey"][0] > 0 and got["lineitem.l_partkey+l_suppkey"][0] > 0
    assert plan(checks.star_foreign_keys(full)).count("Exchange ") == 2


# --- answers ------------------------------------------------------------------

def test_answers_of_numbers_only_are_compared_in_many_tasks(spark, monkeypatch):
    n = 2_000_000
    one = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") * 1.25).alias("x"))
    other = one.select(F.when(F.col("x") == 1.25, 1.5).otherwise(F.col("x") + 0.001).alias("x")).repartition(7)
    apart = files.compare_answers(one, other).collect()
    assert [(r.got_x, r.want_x) for r in apart] == [(1.25, 1.5)]
    kept = []
    monkeypatch.setattr(files, "shared_dir", lambda s, p: kept.append(shared_dir(s, p)) or kept[-1])
    files.ranked(one, [], ["x"])
    sizes = [r["count"] for r in spark.read.parquet(kept[-1]).groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * n / 4  # a third of the rows are alike and still cut


def test_ranks_count_within_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(5)) if rng.random() > 0.1 else None) for _ in range(500)]
    got = files.ranked(spark.createDataFrame(rows, "k string, x double"), ["k"], ["x"]).collect()
    for k in ("a", "b", None):
        own = sorted((r.place, r.x is not None, r.x) for r in got if r.k == k)
        assert [p for p, *_ in own] == list(range(1, len(own) + 1)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


# --- the refresh log ----------------------------------------------------------

def test_after_many_batches_only_the_snapshot_and_newer_sets_are_read(spark, tmp_path):
    orders = spark.createDataFrame([(k, 1, "O") for k in range(50)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    lines = spark.createDataFrame([(k, 1) for k in range(50)], "l_orderkey bigint, l_linenumber int")
    incoming, work = tmp_path / "in", str(tmp_path / "work")
    incoming.mkdir()

    def deliver(number, folder=incoming):
        (folder / f"orders.tbl.u{number}").write_text(f"{1000 + number}|7|N|1.00|1995-01-01|x|c|0|t|\n")
        (folder / f"lineitem.tbl.u{number}").write_text("".join(
            f"{1000 + number}|1|1|{i}|1.00|1.00|0.00|0.00|N|O|1995-01-01|1995-01-01|1995-01-01|a|b|c|\n" for i in (1, 2)))
        (folder / f"delete.{number}").write_text(f"{number if number < 50 else 1000 + number - 50}|\n")

    for last in range(1, 101):
        deliver(last)
        refresh.collect_changes(spark, str(incoming), work)
        if last % 20 == 0:
            after, after_lines = refresh.apply_arrived(spark, str(incoming), work, orders, lines, open_sets=4)
    assert refresh.snapshot(spark, work) == 96
    read = {f.partition("/work/")[2].rpartition("/")[0] for f in after.inputFiles()}
    assert read == {"snapshots/through=96/orders"} | {f"log/batch={n - 1}/set_number={n}" for n in range(97, 101)}
    kept = {0} | {k for k in range(50, 50)}
    want = kept | {1000 + n for n in range(51, 101)}
    assert {r.o_orderkey for r in after.collect()} == want and after.count() == len(want)
    assert after_lines.where("l_orderkey > 1000").count() == 100
    assert refresh.late_sets(spark, work) == []
    late = tmp_path / "in" / "more"
    late.mkdir()
    deliver(30, late)
    again, _ = refresh.apply_arrived(spark, str(incoming), work, orders, lines, open_sets=4)
    assert {r.o_orderkey for r in again.collect()} == want and refresh.late_sets(spark, work) == [30]


def test_a_broken_snapshot_is_made_again(spark, tmp_path):
    orders = spark.createDataFrame([(k,) for k in range(9)], "o_orderkey bigint")
    lines = spark.createDataFrame([(k,) for k in range(9)], "l_orderkey bigint")
    incoming, work = tmp_path / "in", str(tmp_path / "work")
    incoming.mkdir()
    for n in range(1, 5):
        (incoming / f"delete.{n}").write_text(f"{n}|\n")
    refresh.collect_changes(spark, str(incoming), work)
    refresh.fold(spark, work, orders, lines, 2)
    os.remove(f"{work}/snapshots/through=2/lineitem/_SUCCESS")
    assert refresh.snapshot(spark, work) == -1
    got, _ = refresh.apply_arrived(spark, str(incoming), work, orders, lines, open_sets=2)
    assert refresh.snapshot(spark, work) == 2 and sorted(r.o_orderkey for r in got.collect()) == [0, 5, 6, 7, 8]


# --- statistics and cache -----------------------------------------------------

def test_statistics_reach_the_optimizer_and_nothing_stays_cached(spark, star):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    counts = {r.tbl: r.n for r in files.warm_cache(spark, {"orders": f"{star.path}/orders.parquet"}).collect()}
    assert counts == {"orders": star.raw("orders").count()}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held and not spark.catalog.listTables("default")
    spark.conf.set("spark.sql.cbo.enabled", "true")
    try:
        table = files.analyzed(spark, {"orders": f"{star.path}/orders.parquet"})["orders"]
        def estimate(df):
            return int(str(df._jdf.queryExecution().optimizedPlan().stats().rowCount().get()))

        assert estimate(table) == counts["orders"] and estimate(table.where("o_orderkey = 3")) < counts["orders"] / 100
    finally:
        spark.conf.unset("spark.sql.cbo.enabled")


# --- deep pages ---------------------------------------------------------------

@pytest.mark.parametrize("offset", [0, 3, 1_000_000, 2_999_990, 3_000_005])
def test_a_deep_page_is_found_without_a_sort_of_all(spark, offset):
    rows = spark.range(3_000_000).select((F.col("id") * 7 % 3_000_000).alias("k"), F.lit("x").alias("more"))
    got = paging.page(rows, [("k", False)], offset, 10)
    assert [r.k for r in got.collect()] == [3_000_000 - 1 - n for n in range(offset, min(offset + 10, 3_000_000))]


def test_pages_with_ties_nulls_and_directions(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, k int")
    for order in ([("a", True), ("b", False), ("k", True)], [("a", False), ("b", True), ("k", False)]):
        want = [tuple(r) for r in df.orderBy(*paging.sorting(order)).collect()]
        for offset, count in ((0, 5), (37, 11), (390, 20), (500, 3)):
            assert [tuple(r) for r in paging.page(df, order, offset, count, 8, 10).collect()] == want[offset: offset + count]
    alike = spark.range(5000).select(F.lit(1).alias("a"), "id")
    assert paging.page(alike, [("a", True)], 2000, 7, 8, 10).distinct().count() == 7


# --- point reads --------------------------------------------------------------

def test_a_point_read_touches_one_row_group(spark):
    path = shared_dir(spark, "tenants")
    df = spark.range(400_000).select(
        (F.col("id") * 7919 % 400_000).alias("id"), F.hex(F.xxhash64("id")).alias("data"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).cast("int").alias("tenant"), F.lit(0).alias("tbl"))
    layout.write_tenants(df, path, row_group_bytes=256 * 1024)
    folder = next(p for p in os.scandir(f"{path.removeprefix('file:')}/tenant=1") if p.name == "tbl=0").path
    key, groups, files_ = df.where("tenant = 1").agg(F.max("id")).first()[0] // 2, [], 0
    key = df.where(f"tenant = 1 and id >= {key}").agg(F.min("id")).first()[0]
    for name in (f for f in os.listdir(folder) if f.endswith(".parquet")):
        meta, files_ = pq.ParquetFile(f"{folder}/{name}").metadata, files_ + 1
        column = meta.schema.to_arrow_schema().names.index("id")
        groups += [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
    assert files_ > 1 and len(groups) > 10 and sum(g.min <= key <= g.max for g in groups) == 1
    one = layout.read_tenant(spark, path, 1, 0, key)
    assert one.count() == 1


def test_a_query_on_a_wide_table_reads_its_columns_only(spark, star, plan):
    text = plan(upkeep_runs.wide_table(star), "formatted")
    assert "ReadSchema: struct<key:bigint,value_4:string>" in text
