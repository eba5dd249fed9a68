"""Queries against their SQL on data in which one key of each kind holds a third of the rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tests.test_queries import normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
HOT = {
    "lineitem": "select * exclude (rn) replace (case when rn % 3 = 0 then 1 else l_orderkey end as l_orderkey,"
                " case when rn % 3 = 1 then 2 else l_partkey end as l_partkey,"
                " case when rn % 3 = 2 then 3 else l_suppkey end as l_suppkey)"
                " from (select *, row_number() over () as rn from source)",
    "orders": "select * replace (case when o_orderkey % 3 = 0 then 1 else o_custkey end as o_custkey)"
              " from source",
    "events": "select * replace (case when event_id % 3 = 0 then 2 else user_id end as user_id)"
              " from source",
}
NAMES = [
    "tpch_q03", "tpch_q04", "tpch_q09", "tpch_q10", "tpch_q13", "tpch_q16", "tpch_q17", "tpch_q18",
    "tpch_q20", "tpch_q21", "tpch_q22", "ch_q04", "ch_q13", "ch_q17", "ch_q20", "ch_q21",
    "join_semi_in", "join_left_outer", "join_anti_not_in", "join_semi_anti_nonequi",
    "join_non_key_equi", "agg_count_distinct", "agg_param_batch", "dml_update_set",
    "dml_update_delta", "dml_delete_keys", "dml_insert_on_conflict", "dq_primary_key",
    "dq_foreign_key", "jdbc_join4_params", "log_trace_filter", "rand_tpl_08",
]


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("hot")), duckdb.connect()
    for file in os.listdir(DATA):
        name = file[:-8]
        sql = HOT.get(name, "select * from source").replace(
            "from source", f"from read_parquet('{DATA}/{file}')")
        con.execute(f"copy ({sql}) to '{folder}/{file}' (format parquet)")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{file}')")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, hot, name):
    folder, con = hot
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    named = [d[0] for d in cursor.description]
    want = sorted(tuple(normal(row[named.index(c)]) for c in columns) for row in cursor.fetchall())
    assert got == want
