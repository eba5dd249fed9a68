"""Joins on order keys of large tables: a bounded number of lines for each task, and the same rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from starmill.operators import joins
from tests.conftest import DATA
from tests.test_queries import normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
LARGE = ("jdbc_join4_draws", "jdbc_join4_params", "dml_refresh_pair", "dml_delete_keys", "ch_q05", "ch_q07", "ch_q08",
         "ch_q09", "ch_q10", "ch_q12", "ch_q15", "ch_q18")


def test_tasks_follow_the_lines(spark):
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert joins.line_tasks(spark, 600_000) == 0 and joins.line_tasks(spark, 3 * joins.TASK_LINES) >= default
    assert joins.line_tasks(spark, 216_000_000) == 216_000_000 // joins.TASK_LINES


@pytest.mark.parametrize("name", LARGE)
def test_large_tables_are_dealt_and_give_the_same_rows(spark, plan, monkeypatch, name):
    monkeypatch.setattr(joins, "TASK_LINES", 500)
    df = QUERIES[name](spark, DATA)
    text = plan(df)
    assert "REPARTITION_BY_NUM" in text and "SortMergeJoin" in text
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file[:-8]} as select * from read_parquet('{DATA}/{file}')")
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    named = [d[0] for d in cursor.description]
    assert got == sorted(tuple(normal(row[named.index(c)]) for c in columns) for row in cursor.fetchall())


def test_without_match_keeps_null_and_repeated_keys(spark):
    left = spark.createDataFrame([(None, 1), (1, 2), (2, 3), (2, 4), (3, 5)], "k bigint, v int")
    right = spark.createDataFrame([(2,), (2,), (None,), (9,)], "r bigint")
    for tasks in (0, 3):
        kept = joins.without_match(left, right, {"k": "r"}, tasks).collect()
        assert sorted(r.v for r in kept) == [1, 2, 5]


def test_the_names_of_refresh_files_are_not_searched(spark, tmp_path):
    """A line's set and table come from its file's name by splitting; a pattern with two open ends took 0.6 ms a line."""
    import inspect

    from starmill.streaming import refresh

    incoming, work = tmp_path / "in", tmp_path / "work"
    (incoming / "orders.tbl.u3").mkdir(parents=True)
    (incoming / "orders.tbl.u3" / "part-0.txt").write_text("1|a|\n2|b|\n")
    (incoming / "delete.4").write_text("7\n")
    (incoming / "notes.txt").write_text("x\n")
    refresh.collect_changes(spark, str(incoming), str(work))
    log = spark.read.parquet(f"{work}/log/batch=0").collect()
    assert sorted((r.kind, r.set_number, r.value, r.delivery.rpartition("/")[2]) for r in log) == [
        ("delete", 4, "7", "delete.4"), ("orders", 3, "1|a|", "orders.tbl.u3"), ("orders", 3, "2|b|", "orders.tbl.u3")]
    assert '"([^/]+)$"' not in inspect.getsource(refresh) and '"^(.*)/' not in inspect.getsource(refresh)


def test_query_parameters_are_drawn_by_several_tasks(spark, monkeypatch):
    from starmill.plans import generator_runs

    monkeypatch.setattr(generator_runs, "SEEDS", 10)
    df = QUERIES["gen_query_params"](spark, DATA)
    assert df.rdd.getNumPartitions() == spark.read.parquet(f"{DATA}/customer.parquet").count() // 10


def test_a_pool_block_is_small_and_comments_are_read(spark):
    import inspect

    from starmill.generator import text

    assert text.BLOCK_DRAWS <= 50_000 and "memmap" not in inspect.getsource(text)
