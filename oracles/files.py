"""Oracles of file sources and sinks, log reducers and the refresh stream."""

from oracles.star import star

_LINE = ("o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_totalprice || '|' ||"
         " o_orderdate || '|' || o_orderpriority || '|' || o_clerk || '|' || o_shippriority"
         " || '|' || o_comment || '|'")

_BENCH = """
    select event_id as run,
           case when event_id % 7 <> 0 then (event_id % 1000) / 8.0::double end as latency_ms,
           case when event_id % 7 <> 0 then event_id % 5000 + 0.25::double end as tps_excluding,
           case when event_id % 7 <> 0 and event_id % 2 = 0 then cast(event_id % 5000 as double)
               end as tps_including,
           event_id % 7 = 0 as failed
    from events"""

_TRACES = """
    (select event_id as line, '==' || user_id || '== at '
            || case when event_id % 997 = 5 then 'SHARD_call' else event_type end
            || ' in ' || props as value from events)"""

_POSITIONS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority", "o_clerk", "o_shippriority", "o_comment"]

_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
    "conversations": "conv_id",
}

_RAW = {
    "scan_parquet": " union all ".join(
        f"select '{t}' as tbl, count(*) as n, cast(sum({k}) as bigint) as key_total from {t}"
        for t, k in _KEYS.items()),
    "read_tbl": """
        select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice,
               o_orderdate, o_orderpriority, o_clerk, o_shippriority, o_comment
        from x_orders""",
    "write_tbl": f"select {_LINE} as line from x_orders",
    "write_tbl_chunks": """
        select cast(o_orderkey % 7 as int) as chunk, count(*) as n from x_orders group by 1""",
    "csv_export": """
        select o_orderkey, o_custkey as f1, cast(o_totalprice as double) as price
        from x_orders order by o_totalprice desc, o_orderkey limit 100""",
    "csv_import": """
        select o_orderkey % 100 as c, 2 * count(*) as n, cast(2 * sum(o_custkey) as bigint) as total
        from x_orders group by 1""",
    "read_golden": """
        select o_orderpriority, round(cast(sum(o_totalprice) as double), 2) as total, count(*) as n
        from x_orders group by o_orderpriority""",
    "compare_answers": """
        select o_orderpriority as got_o_orderpriority, count(*) as got_n, 1.0::double as apart
        from x_orders where o_orderpriority = '5-LOW' group by o_orderpriority""",
    "write_metrics_csv": _BENCH,
    "split_columns": " union all ".join(
        f"select {i} as position, count(*) as n, count(distinct {c}) as different from x_orders"
        for i, c in enumerate(_POSITIONS)),
    "head_per_file": """
        select place, o_orderkey
        from (select o_orderkey, cast(row_number() over (
                  partition by o_orderkey // 1000 order by o_orderkey) as int) as place from x_orders)
        where place <= 3""",
    "last_row_per_chunk": """
        select cast(o_orderkey % 13 as int) as chunk, o_orderkey, o_custkey, o_orderdate
        from x_orders
        qualify row_number() over (partition by o_orderkey % 13 order by o_orderkey desc) = 1""",
    "warm_cache": " union all ".join(
        f"select '{t}' as tbl, count(*) as n from {t}" for t in _KEYS),
    "table_size": "with s as (" + " union all ".join(
        f"select '{t}' as tbl, count(*) as n from {t}" for t in _KEYS)
        + ") select tbl, n as rows, true as stored from s"
        " union all select 'total', cast(sum(n) as bigint), true from s",
    "parse_bench_log": _BENCH,
    "ch_timings": """
        select cast(event_id % 22 + 1 as int) as query, count(*) as runs,
               cast(sum(event_id * 37 % 90000) as bigint) as total_ms,
               min(event_id * 37 % 90000) as fastest_ms, max(event_id * 37 % 90000) as slowest_ms
        from events group by 1""",
    "ch_qph": """
        select event_id as run,
               round(3600.0::double * (event_id % 500)::double / (user_id + 100)::double, 4) as qph
        from events""",
    "nopm": "select event_id as run, event_id * 3 as nopm from events",
    "log_trace_filter": f"""
        select line from {_TRACES} a where exists (
            select 1 from (select distinct string_split(value, ' ')[1] as id from {_TRACES}
                           where lower(value) like '%shard%') where contains(a.value, id))""",
    "log_success": f"select not bool_or(lower(value) like '%shard%') as success from {_TRACES}",
    "stream_refresh_apply": """
        select o_orderstatus, count(*) as orders, round(cast(sum(q) as double), 2) as quantity
        from (
            select k, o_orderstatus, (select sum(l_quantity) from x_lineitem
                                      where l_orderkey = old) as q
            from (select o_orderkey as k, o_orderkey as old, o_orderstatus from x_orders
                  union all
                  select o_orderkey + (select max(o_orderkey) + 1 from x_orders), o_orderkey, o_orderstatus
                  from x_orders where o_orderkey % 30 in (1, 2, 3))
            where k not in (select event_id from events where event_id % 30 in (1, 2, 3)))
        group by o_orderstatus""",
}

ORACLES = {name: star(body) for name, body in _RAW.items()}
