"""Oracles of the single-operator plans."""

from oracles.desk_suite import desk
from oracles.star import star

_NET = "l_extendedprice * (1 - l_discount)"
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_PROMO = f"sum(case when p_type like 'PROMO%' then {_NET} else 0 end)"
_OUTSIDE = "least(o_custkey, o_custkey + o_orderkey)"


def _codes(column):
    return f"list_sum(list_transform(string_split({column}, ''), lambda c: ascii(c)))"


def _totals(name, table, key, *texts):
    text = " || ".join(f"coalesce({t}, '')" for t in texts) or "''"
    return (f"select '{name}' as tbl, cast(sum({key}) as bigint) as key_total,"
            f" cast(sum({_codes(text)}) as bigint) as text_total from {table}")


_RAW = {
    "proj_arith": f"""
        select {_LINE}, cast({_NET} as double) as disc_price,
               cast({_NET} * (1 + l_tax) as double) as charge,
               round(100.00::double * cast(l_tax as double) / cast(l_extendedprice as double), 6)
                   as tax_percent,
               round(cast(l_extendedprice as double) / 7.0::double, 4) as weekly,
               round(cast(l_extendedprice as double) / 2.0::double, 4) as half
        from x_lineitem""",
    "proj_case": """
        select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high'
                                when o_orderpriority = '5-LOW' then 'low' else 'normal' end as level
        from x_orders""",
    "proj_decode": """
        select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open'
                                              else 'partial' end as status,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as is_high
        from x_orders""",
    "proj_cast_text": """
        select o_orderkey from x_orders where cast(o_orderkey as varchar) like '%88'""",
    "proj_cast_out": """
        select cast(o_orderkey as varchar) as orderkey_text,
               cast(extract(year from o_orderdate) as int) as o_year,
               cast(o_totalprice as double) as price
        from x_orders""",
    "proj_alias": """
        select o_custkey as o_orderkey, round(cast(sum(o_totalprice) as double), 2) as total
        from x_orders group by x_orders.o_orderkey, o_custkey""",
    "filter_compare": f"""
        select {_LINE} from x_lineitem
        where l_quantity >= 10 and l_quantity < 40 and l_returnflag <> 'N' and l_linenumber > 1
          and l_linestatus = 'O' and l_shipdate <= date '1998-09-02'""",
    "filter_between": f"""
        select {_LINE} from x_lineitem
        where l_discount between 0.05 and 0.07 and l_quantity between 5 and 25
          and l_shipdate between date '1996-01-01' and date '1997-06-30'""",
    "filter_in_list": """
        select c_custkey from x_customer
        where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey in (1, 3, 5, 7, 9, 11)
          and substring(c_phone, 1, 2) in ('11', '13', '15', '17', '29')""",
    "filter_like": """
        select p_partkey, p_name like 'red%' as by_prefix, p_name like '%widget' as by_suffix,
               p_name like '%d w%' as by_part, p_name like '%e%i%' as by_two_parts,
               p_name not like '%blue%' as without
        from x_part""",
    "filter_or_groups": f"""
        select {_LINE} from x_lineitem, x_part
        where (p_partkey = l_partkey and p_size <= 15 and p_container like 'SM%'
               and l_quantity < 10)
           or (p_partkey = l_partkey and p_size > 15 and p_container like 'LG%'
               and l_quantity > 30)""",
    "filter_col_col": f"""
        select {_LINE} from x_lineitem
        where l_shipdate < l_commitdate and l_commitdate < l_receiptdate""",
    "filter_constant_false": "select count(*) as n from x_orders where o_orderkey >= 0 and false",
    "filter_parameter": f"""
        select {_LINE} from x_lineitem
        where (l_quantity > 45 or l_extendedprice > 90000) and l_suppkey > 5""",
    "filter_point": "select count(*) as n from x_orders where o_orderkey = 155",
    "fn_extract_year": """
        select o_orderkey, cast(year(o_orderdate) as int) as o_year from x_orders""",
    "fn_date_interval": """
        select o_orderkey, cast(o_orderdate - interval 90 day as date) as days_before,
               cast(o_orderdate + interval 3 month as date) as months_after,
               cast(o_orderdate + interval 1 year as date) as year_after
        from x_orders""",
    "fn_substring": """
        select c_custkey, substring(c_phone, 1, 2) as country, substr(c_mktsegment, 1, 3) as segment,
               substr(c_name, 5, 4) as middle from x_customer""",
    "fn_ascii": "select c_custkey, ascii(substr(c_mktsegment, 1, 1)) as code from x_customer",
    "fn_mod": """
        select p_partkey, mod(p_partkey * (p_size + 1), 10000) as bucket from x_part""",
    "fn_now": """
        select o_orderstatus, count(*) as n, true as same, true as recent
        from x_orders group by o_orderstatus""",
    "fn_row_to_json": """
        select o_orderkey, o_custkey as f2, o_orderkey * 7 as f3_f3 from x_orders""",
    "fn_array_build": """
        select o_orderkey, 4 as n,
               o_orderkey || '|' || o_custkey || '|first note|second note' as items
        from x_orders""",
    "fn_int_range": f"""
        select o_orderkey, o_orderkey = 0 as is_empty,
               o_custkey <= 1000 and 1000 < o_custkey + o_orderkey as holds_1000,
               o_orderkey > 0 and {_OUTSIDE} < 700 and 500 < o_custkey + o_orderkey as overlaps
        from x_orders""",
    "fn_composite": """
        select o_orderkey, cast(o_orderkey as double) as r, cast(o_totalprice as double) as i
        from x_orders""",
    "fn_citext": """
        select lower(c_mktsegment) as segment, count(*) as n,
               max(lower(c_mktsegment) = 'building') as is_building
        from x_customer group by lower(c_mktsegment)""",
    "join_inner_equi": """
        select o_orderpriority, count(*) as n from x_orders
        join x_lineitem on l_orderkey = o_orderkey group by o_orderpriority""",
    "join_composite_key": """
        select l_returnflag, round(cast(sum(ps_supplycost * l_quantity) as double), 2) as cost
        from x_lineitem join x_partsupp on ps_partkey = l_partkey and ps_suppkey = l_suppkey
        group by l_returnflag""",
    "join_multiway": f"""
        select r_name, p_type, round(cast(sum({_NET}) as double), 2) as revenue, count(*) as n
        from x_lineitem join x_part on p_partkey = l_partkey
        join x_supplier on s_suppkey = l_suppkey join x_orders on o_orderkey = l_orderkey
        join x_customer on c_custkey = o_custkey join x_nation on n_nationkey = c_nationkey
        join x_region on r_regionkey = n_regionkey
        group by r_name, p_type""",
    "join_self": """
        select a.n_name as supp_nation, b.n_name as cust_nation, count(*) as n
        from x_lineitem join x_supplier on s_suppkey = l_suppkey
        join x_orders on o_orderkey = l_orderkey join x_customer on c_custkey = o_custkey
        join x_nation a on a.n_nationkey = s_nationkey
        join x_nation b on b.n_nationkey = c_nationkey
        group by 1, 2""",
    "join_left_outer": """
        select c_mktsegment, count(*) as joined_rows, count(o_orderkey) as matches
        from x_customer left join x_orders on o_custkey = c_custkey and o_totalprice > 200000
        group by c_mktsegment""",
    "join_semi_exists": """
        select o_orderkey from x_orders
        where exists (select 1 from x_lineitem where l_orderkey = o_orderkey
                      and l_commitdate < l_receiptdate and l_quantity > 30)""",
    "join_semi_in": """
        select o_orderkey from x_orders where o_orderkey in (
            select l_orderkey from x_lineitem
            where l_suppkey in (
                select ps_suppkey from x_partsupp
                where ps_partkey in (select p_partkey from x_part where p_size < 20))
            group by l_orderkey having sum(l_quantity) > 150)""",
    "join_anti_not_exists": """
        select c_custkey from x_customer
        where not exists (select 1 from x_orders where o_custkey = c_custkey)""",
    "join_anti_not_in": """
        select p_partkey from x_part where p_partkey not in (
            select l_partkey from x_lineitem where l_returnflag = 'R' and l_quantity > 45)""",
    "join_anti_not_in_null": """
        select count(*) as n from x_part
        where p_partkey not in (select nullif(l_partkey, 1) from x_lineitem)""",
    "join_semi_anti_nonequi": """
        select l_orderkey, l_suppkey, count(*) as late_lines from x_lineitem a
        where l_receiptdate > l_commitdate
          and exists (select 1 from x_lineitem b where b.l_orderkey = a.l_orderkey
                      and b.l_suppkey <> a.l_suppkey)
          and not exists (select 1 from x_lineitem c where c.l_orderkey = a.l_orderkey
                          and c.l_suppkey <> a.l_suppkey and c.l_receiptdate > c.l_commitdate)
        group by l_orderkey, l_suppkey""",
    "join_cartesian_filter": """
        select a.n_name as first_name, b.n_name as second_name, count(*) as suppliers
        from x_nation a cross join x_nation b join x_supplier on s_nationkey = a.n_nationkey
        where (a.n_name = 'NATION_6' and b.n_name = 'NATION_9')
           or (a.n_name = 'NATION_9' and b.n_name = 'NATION_6')
        group by 1, 2""",
    "join_non_key_equi": """
        select l_suppkey, count(*) as n from x_lineitem join x_orders on l_suppkey = o_shippriority
        group by l_suppkey""",
    "join_broadcast_ref": """
        select n_name, round(cast(sum(c_acctbal) as double), 2) as balance
        from x_customer join x_nation on n_nationkey = c_nationkey group by n_name""",
    "join_colocated": """
        select o_orderstatus, round(cast(sum(l_quantity) as double), 2) as quantity
        from x_orders join x_lineitem on l_orderkey = o_orderkey group by o_orderstatus""",
    "join_repartition": """
        select c_mktsegment, round(cast(sum(o_totalprice) as double), 2) as total
        from x_orders join x_customer on c_custkey = o_custkey group by c_mktsegment""",
    "agg_group_multi": """
        select l_returnflag, l_linestatus, l_linenumber,
               round(cast(sum(l_extendedprice) as double), 2) as total,
               round(cast(sum(l_quantity) as double) / count(*), 4) as average, count(*) as n
        from x_lineitem group by 1, 2, 3""",
    "agg_global": f"""
        select round(cast(sum({_NET}) as double), 2) as revenue, count(*) as n from x_lineitem""",
    "agg_count_col": """
        select c_nationkey, count(distinct c_custkey) as customers,
               count(distinct o_custkey) as with_orders
        from x_customer left join x_orders on o_custkey = c_custkey group by c_nationkey""",
    "agg_count_distinct": """
        select l_returnflag, count(distinct l_suppkey) as suppliers,
               count(distinct l_partkey % 100) as part_groups
        from x_lineitem group by l_returnflag""",
    "agg_min_max": """
        select l_suppkey, cast(min(l_extendedprice) as double) as lowest,
               cast(max(l_extendedprice) as double) as highest, max(l_shipdate) as last_ship
        from x_lineitem group by l_suppkey""",
    "agg_conditional": f"""
        select l_returnflag, round(cast({_PROMO} as double), 2) as promo,
               round(100.0 * cast({_PROMO} as double) / cast(sum({_NET}) as double), 4) as percent
        from x_lineitem join x_part on p_partkey = l_partkey group by l_returnflag""",
    "agg_of_agg": """
        select orders, count(*) as customers
        from (select o_custkey, count(*) as orders from x_orders group by o_custkey)
        group by orders""",
    "agg_having": """
        select l_orderkey, round(cast(sum(l_quantity) as double), 2) as quantity
        from x_lineitem group by l_orderkey having sum(l_quantity) > 180""",
    "agg_having_subquery": """
        select l_suppkey, round(cast(sum(l_quantity) as double), 2) as quantity
        from x_lineitem group by l_suppkey
        having sum(l_quantity) > (select sum(l_quantity) * 0.0101 from x_lineitem)""",
    "agg_group_expr": """
        select cast(year(o_orderdate) as int) as o_year, substr(o_orderpriority, 1, 1) as level,
               o_custkey % 10 as bucket, count(*) as n
        from x_orders group by 1, 2, 3""",
    "agg_group_hidden": """
        select o_orderstatus, round(cast(sum(o_totalprice) as double), 2) as total
        from x_orders group by o_custkey, o_orderstatus""",
    "agg_distinct_by_group": "select l_partkey from x_lineitem group by l_partkey",
    "agg_checksum": " union all ".join([
        _totals("region", "x_region", "r_regionkey", "r_name"),
        _totals("nation", "x_nation", "n_nationkey", "n_name"),
        _totals("supplier", "x_supplier", "s_suppkey", "s_name", "s_address", "s_phone", "s_comment"),
        _totals("customer", "x_customer", "c_custkey", "c_name", "c_address", "c_phone",
                "c_mktsegment", "c_comment"),
        _totals("part", "x_part", "p_partkey", "p_name", "p_mfgr", "p_brand", "p_type", "p_container"),
        "select 'partsupp' as tbl, cast(sum(ps_partkey) as bigint) as key_total,"
        " cast(0 as bigint) as text_total from x_partsupp",
        _totals("orders", "x_orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_clerk",
                "o_comment"),
        _totals("lineitem", "x_lineitem", "l_orderkey", "l_returnflag", "l_linestatus",
                "l_shipinstruct", "l_shipmode"),
    ]),
    "limit_unordered_count": """
        select least(count(*), 10) as rows, least(count(*), 10) as members from x_orders""",
    "agg_param_batch": """
        select id, count(o_orderkey) as n,
               cast(sum(o_totalprice) as double) / count(o_orderkey) as average
        from (select distinct user_id as id from events) left join x_orders on o_custkey = id
        group by id""",
    "sort_multi": """
        select cast(s_acctbal as double) as s_acctbal, s_nationkey, s_name from x_supplier
        order by s_acctbal desc, s_nationkey, s_name desc""",
    "sort_by_agg": """
        select o_orderpriority, round(cast(sum(o_totalprice) as double), 2) as total
        from x_orders group by o_orderpriority order by total desc""",
    "topk": """
        select o_orderkey, cast(o_totalprice as double) as o_totalprice from x_orders
        order by o_totalprice desc, o_orderkey limit 100""",
    "limit_offset": "select o_orderkey from x_orders order by o_orderkey desc limit 3 offset 1",
    "limit_offset_deep": """
        select o_orderkey, cast(o_totalprice as double) as o_totalprice from x_orders
        qualify row_number() over (order by o_totalprice desc, o_orderkey)
            between (select count(*) // 2 from x_orders) + 1 and (select count(*) // 2 from x_orders) + 5""",
    "subq_scalar": """
        select c_custkey from x_customer where cast(c_acctbal as double) >
            (select cast(sum(c_acctbal) as double) / count(*) from x_customer)""",
    "subq_scalar_correlated": """
        select ps_partkey, ps_suppkey from x_partsupp a where ps_supplycost =
            (select min(b.ps_supplycost) from x_partsupp b where b.ps_partkey = a.ps_partkey)""",
    "subq_from": """
        select lines, count(*) as orders, cast(max(q) as double) as largest
        from (select l_orderkey, count(*) as lines, sum(l_quantity) as q
              from x_lineitem group by l_orderkey)
        group by lines""",
    "cte": """
        select o_custkey, round(cast(total as double), 2) as total
        from (select o_custkey, sum(o_totalprice) as total from x_orders group by o_custkey)
        where cast(total as double) > 0.75 * (
            select cast(max(t) as double)
            from (select sum(o_totalprice) as t from x_orders group by o_custkey))""",
    "view": """
        select o_orderpriority, count(*) as n from x_orders
        group by o_orderpriority having count(*) > 10""",
}

ORACLES = {name: star(body) for name, body in _RAW.items()}
ORACLES["join_expr_key"] = desk("""
    select su_nationkey, count(*) as n, cast(sum(s_quantity) as bigint) as quantity
    from d_stock join d_supplier on su_suppkey = mod(s_w_id * s_i_id, 10000)
    group by su_nationkey""")
