"""Oracles of table upkeep and constraint checks."""

from oracles.star import star

_DELTA = "event_id * 7919 % 10001 - 5000"


def _orphans(name, child, columns, parent, parent_columns):
    on = " and ".join(f"p.{b} = c.{a}" for a, b in zip(columns, parent_columns))
    return (f"select '{name}' as foreign_key, count(distinct ({', '.join(columns)})) as keys,"
            f" count(*) as n from {child} c"
            f" where not exists (select 1 from {parent} p where {on})")


_FOREIGN = [
    ("nation.n_regionkey", "x_nation", ["n_regionkey"], "x_region", ["r_regionkey"]),
    ("supplier.s_nationkey", "x_supplier", ["s_nationkey"], "x_nation", ["n_nationkey"]),
    ("customer.c_nationkey", "x_customer", ["c_nationkey"], "x_nation", ["n_nationkey"]),
    ("partsupp.ps_suppkey", "x_partsupp", ["ps_suppkey"], "x_supplier", ["s_suppkey"]),
    ("partsupp.ps_partkey", "x_partsupp", ["ps_partkey"], "x_part", ["p_partkey"]),
    ("orders.o_custkey", "x_orders", ["o_custkey"], "x_customer", ["c_custkey"]),
    ("lineitem.l_orderkey", "x_lineitem", ["l_orderkey"], "x_orders", ["o_orderkey"]),
    ("lineitem.l_partkey+l_suppkey", "x_lineitem", ["l_partkey", "l_suppkey"], "x_partsupp",
     ["ps_partkey", "ps_suppkey"]),
]

_RAW = {
    "tenant_read": """
        select o_orderkey as id, o_orderpriority as data from x_orders
        where o_custkey % 10 = 4 and o_orderkey % 4 = 1
        order by o_orderkey desc limit 1""",
    "dml_insert": """
        select c_custkey, c_name, c_mktsegment from x_customer
        union all select event_id + (select max(c_custkey) + 1 from x_customer), null, 'NEW' from events""",
    "dml_update_set": """
        select c_custkey, coalesce(new, c_mktsegment) as c_mktsegment
        from x_customer left join (
            select user_id, event_type as new from events
            qualify row_number() over (partition by user_id order by event_id desc) = 1)
          on user_id = c_custkey""",
    "dml_update_delta": f"""
        select 'account' as kind, c_custkey as id,
               cast(coalesce((select sum({_DELTA}) from events where user_id = c_custkey), 0)
                    as bigint) as value
        from x_customer
        union all
        select 'teller', t, cast(coalesce((select sum({_DELTA}) from events
                                           where user_id % 10 = t), 0) as bigint)
        from (select range as t from range(10))
        union all
        select 'branch', b, cast(coalesce((select sum({_DELTA}) from events
                                           where user_id % 3 = b), 0) as bigint)
        from (select range as b from range(3))
        union all
        select 'history', user_id % 10, count(*) from events group by user_id % 10""",
    "dml_update_all_but": """
        select s_suppkey, case when s_suppkey <> 7 then 'moved' else s_name end as s_name
        from x_supplier""",
    "dml_update_like": """
        select o_orderkey,
               cast(case when cast(o_orderkey as varchar) like '%89' then o_totalprice + 2
                         else o_totalprice end as double) as o_totalprice
        from x_orders where cast(o_orderkey as varchar) not like '%88'""",
    "dml_delete_keys": """
        select l_orderkey, count(*) as n from x_lineitem
        where l_orderkey not in (select event_id from events) group by l_orderkey""",
    "dml_insert_select": """
        select o_orderstatus, cast(sum(case when o_orderstatus = 'F' then 2 else 1 end) as bigint)
            as n
        from x_orders group by o_orderstatus""",
    "dml_insert_select_limit": """
        select o_orderstatus, count(*) as n
        from (select o_orderkey, o_orderstatus from x_orders
              union all
              (select o_orderkey, o_orderstatus from x_orders
               where o_orderkey = (select min(o_orderkey) from x_orders)
                  or o_orderkey = (select max(o_orderkey) from x_orders) limit 10))
        group by o_orderstatus""",
    "dml_insert_on_conflict": """
        select s_suppkey, s_name from x_supplier
        union all
        select user_id, event_type from events
        where user_id not in (select s_suppkey from x_supplier)
        qualify row_number() over (partition by user_id order by event_id) = 1""",
    "dml_refresh_pair": """
        select o_orderstatus, count(*) as orders, round(cast(sum(q) as double), 2) as quantity
        from (
            select k, o_orderstatus, (select sum(l_quantity) from x_lineitem
                                      where l_orderkey = old) as q
            from (select o_orderkey as k, o_orderkey as old, o_orderstatus from x_orders
                  union all
                  select o_orderkey + (select max(o_orderkey) + 1 from x_orders), o_orderkey, o_orderstatus
                  from x_orders where o_orderkey % 10 = 0)
            where k not in (select event_id from events))
        group by o_orderstatus""",
    "dq_primary_key": """
        select l_orderkey, l_linenumber, count(*) as n from x_lineitem
        group by l_orderkey, l_linenumber having count(*) > 1""",
    "dq_foreign_key": " union all ".join(_orphans(*key) for key in _FOREIGN),
    "dq_orphans": """
        select user_id, count(*) as n from events
        where not exists (select 1 from x_orders where o_custkey = user_id) group by user_id""",
    "dq_check": """
        select l_orderkey, l_linenumber, l_partkey as value_3 from x_lineitem
        where l_linenumber <> 3 and not l_partkey > 10""",
    "dq_defaults_notnull": """
        select 'value_1' as column_name, 0::bigint as nulls
        union all select 'value_2', 0
        union all select 'value_3', count(*) from events where event_id % 5 = 0""",
    "dq_referencing_insert": """
        select outcome, count(*) as n, cast(sum(value_1) as bigint) as value_1, cast(sum(value_2) as bigint) as value_2,
            cast(sum(value_3) as bigint) as value_3
        from (
            select *, case when value_3 <= 10 then 'check'
                when key is not null and key not in (select o_custkey from x_orders where o_custkey is not null)
                    then 'foreign key' else 'inserted' end as outcome
            from (
                select user_id as key, case when event_id % 2 = 0 then user_id else 5 end as value_1, 10 as value_2,
                    case when event_id % 5 <> 0 then event_id % 100 end as value_3
                from events))
        group by outcome""",
    "dq_tenant_keys": """
        select cast(tenant as int) as tenant, count(distinct number) as keys, count(*) as n
        from (select o_custkey % 10 as tenant, o_orderkey // 8 * 8 as number from x_orders where o_orderkey % 4 > 0) r
        where not exists (
            select 1 from x_orders p
            where p.o_orderkey % 4 = 0 and p.o_custkey % 10 = r.tenant and p.o_orderkey = r.number)
        group by tenant""",
    "table_distribute": """
        select layout, o_orderstatus, count(*) as n
        from x_orders cross join (select unnest(['hash', 'reference', 'append']) as layout)
        group by 1, 2""",
    "tenant_layout": """
        select cast(o_custkey % 10 as int) as tenant, cast(o_orderkey % 4 as int) as tbl,
               count(*) as n
        from x_orders group by 1, 2""",
    "wide_table": "select o_orderpriority as value_4, count(*) as n from x_orders group by 1",
}

ORACLES = {name: star(body) for name, body in _RAW.items()}
