"""Oracles of the prepared-statement and random-procedure workloads."""

import random

from oracles.star import star

_IDS = "(select distinct user_id as id from events)"
_JOIN = f"{_IDS} left join x_orders on o_custkey = id"

_TEMPLATES = [
    f"select id, count(o_orderkey) as n from {_JOIN} group by id",
    f"select id, count(o_orderkey) as n from {_JOIN} and false group by id",
    f"""select o_custkey as id,
               cast(sum(case when o_custkey in (select id from {_IDS}) then o_custkey
                             else o_orderkey end) as bigint) as n
        from x_orders group by o_custkey""",
    f"""select id, count(*) as n
        from (select o_custkey as id from x_orders union all select id from {_IDS}) group by id""",
    f"select o_custkey as id from x_orders where o_custkey in (select id from {_IDS})",
    f"select id, count(o_orderkey) as n from {_JOIN} group by id",
    f"select id, count(o_orderkey) as n from {_JOIN} group by id having false",
    f"""select id, count(*) as n
        from (select o_custkey as id,
                     row_number() over (partition by o_custkey order by o_orderkey) as pos
              from x_orders where o_custkey in (select id from {_IDS}))
        where pos between 2 and 4 group by id""",
    f"select distinct o_custkey as id from x_orders where o_custkey in (select id from {_IDS})",
    f"""select o_custkey as id, cast(sum(o_orderkey) as double) / count(*) as average
        from x_orders where o_custkey in (select id from {_IDS}) group by o_custkey""",
    f"select id, count(o_orderkey) as n from {_JOIN} and 1 = 0 group by id",
]


def _suite(seed=11, calls=12):
    chosen = random.Random(seed)
    rows = []
    for call in range(calls):
        number = chosen.choice([0, 1, 4, 5, 6, 7, 8, 9, 10])
        value = "n" if " as n" in _TEMPLATES[number] else "id"
        rows.append(
            f"select {call} as call, {number + 1} as template, count(*) as rows,"
            f" cast(coalesce(sum({value}), 0) as bigint) as total from ({_TEMPLATES[number]})")
    return " union all ".join(rows)


def _draws(seed=5, calls=10):
    drawn = random.Random(seed)
    return [(drawn.randrange(10), drawn.randrange(10), drawn.randrange(10_000), drawn.randrange(10_000))
            for _ in range(calls)]


_STATEMENTS = """
    (select o_orderkey, case when cast(o_orderkey as varchar) like '%89' then o_totalprice + 2
                             else o_totalprice end as o_totalprice
     from x_orders where cast(o_orderkey as varchar) not like '%88')"""

_RAW = {
    "jdbc_count_orders": "select count(*) as n from x_orders",
    "jdbc_join2": "select count(*) as n from x_orders join x_lineitem on l_orderkey = o_orderkey",
    "jdbc_join2_cust": "select count(*) as n from x_orders join x_customer on c_custkey = o_custkey",
    "jdbc_join3": """
        select count(*) as n from x_orders join x_customer on c_custkey = o_custkey
        join x_lineitem on l_orderkey = o_orderkey""",
    "jdbc_join_param": " union all ".join(
        f"select '{s}' as supplier, count(*) as n from x_orders"
        f" join x_lineitem on l_orderkey = o_orderkey where l_suppkey > {s}"
        for s in (15, 155, 1555)),
    "jdbc_nation_pairs": """
        select a.n_name as supp_nation, b.n_name as cust_nation,
               cast(year(l_shipdate) as int) as l_year,
               round(cast(sum(l_extendedprice * (1 - l_discount)) as double), 2) as revenue
        from x_lineitem join x_supplier on s_suppkey = l_suppkey
        join x_orders on o_orderkey = l_orderkey join x_customer on c_custkey = o_custkey
        join x_nation a on a.n_nationkey = s_nationkey
        join x_nation b on b.n_nationkey = c_nationkey
        where l_shipdate between date '1995-01-01' and date '1996-12-31'
          and (a.n_name, b.n_name) in (('NATION_6', 'NATION_9'), ('NATION_9', 'NATION_6'),
                                       ('NATION_3', 'NATION_7'), ('NATION_7', 'NATION_3'))
        group by 1, 2, 3""",
    "jdbc_delete_update_like": f"""
        select count(*) as n, round(cast(sum(o_totalprice) as double), 2) as total
        from {_STATEMENTS}""",
    "jdbc_sum_like": f"""
        select round(cast(sum(o_totalprice) as double), 2) as total
        from {_STATEMENTS} where cast(o_orderkey as varchar) like '%88'""",
    "jdbc_suppkey_prio": " union all ".join(f"""
        select {v} as value, l_partkey, count(distinct o_orderkey) as orders, count(*) as n
        from x_lineitem join x_orders on l_suppkey = o_shippriority
        where l_quantity < {v} and o_totalprice <> {v} group by l_partkey""" for v in range(10)),
    "jdbc_join4_draws": " union all ".join(
        f"""select {k} as call, least(count(*), 3000) as rows from (
            select distinct l_partkey, o_orderkey
            from x_lineitem join x_part on p_partkey = l_partkey
            join x_orders on o_orderkey = l_orderkey join x_customer on c_custkey = o_custkey
            where (l_quantity > {q} or l_extendedprice > {e}) and p_size > 8
              and o_totalprice > {t} and c_acctbal < {b})"""
        for k, (q, e, t, b) in enumerate(_draws())),
    "jdbc_join4_params": """
        select l_partkey, o_orderkey, count(*) as n
        from x_lineitem join x_part on p_partkey = l_partkey
        join x_orders on o_orderkey = l_orderkey join x_customer on c_custkey = o_custkey
        where (l_quantity > 5 or l_extendedprice > 7) and p_size > 8 and o_totalprice > 5000
          and c_acctbal < 6000
        group by l_partkey, o_orderkey order by l_partkey, o_orderkey limit 3000""",
    "rand_suite": _suite(),
}
_RAW |= {f"rand_tpl_{i:02d}": body for i, body in enumerate(_TEMPLATES, 1)}

ORACLES = {name: star(body) for name, body in _RAW.items()}
