"""Oracles of the order-desk suite."""

from oracles.star import star

_DESK = {
    "d_customer": """
        select c_custkey + 1 as c_id, cast(c_custkey % 5 + 1 as int) as c_w_id,
               cast((c_custkey // 5) % 10 + 1 as int) as c_d_id, c_name as c_last,
               'City ' || (c_custkey % 100) as c_city, chr(65 + c_nationkey) || 'X' as c_state,
               (c_custkey % 10) || '-' || c_phone as c_phone, c_acctbal as c_balance
        from x_customer""",
    "d_orders": """
        select o_orderkey as o_id, cast(o_custkey % 5 + 1 as int) as o_w_id,
               cast((o_custkey // 5) % 10 + 1 as int) as o_d_id, o_custkey + 1 as o_c_id,
               o_orderdate + 7305 as o_entry_d, cast(o_orderkey % 10 + 1 as int) as o_carrier_id,
               cast(o_orderkey % 11 + 5 as int) as o_ol_cnt, o_orderstatus as status
        from x_orders""",
    "d_order_line": """
        select o_id as ol_o_id, o_w_id as ol_w_id, o_d_id as ol_d_id, l_linenumber as ol_number,
               l_partkey + 1 as ol_i_id,
               case when (l_orderkey + l_linenumber * 7 + l_partkey) % 100 = 3
                    then cast(o_w_id % 5 + 1 as int) else o_w_id end as ol_supply_w_id,
               l_shipdate + 7305 as ol_delivery_d, cast(l_quantity as int) as ol_quantity,
               l_extendedprice as ol_amount
        from x_lineitem join d_orders on o_id = l_orderkey""",
    "d_new_order": """
        select o_id as no_o_id, o_w_id as no_w_id, o_d_id as no_d_id from d_orders
        where status = 'O'""",
    "d_item": """
        select p_partkey + 1 as i_id, p_name as i_name, p_retailprice as i_price,
               case when p_partkey % 7 = 3 then 'co' else '' end || p_type || ' ' || p_brand || ' '
               || case p_partkey % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'BB' end
                   as i_data
        from x_part""",
    "d_stock": """
        select p_partkey + 1 as s_i_id, w as s_w_id,
               cast(((p_partkey * 7 + w * 13) % 91 + 10) * 5 as int) as s_quantity,
               cast((p_partkey * 3 + w * 11) % 50 as int) as s_order_cnt,
               ((p_partkey + 1) * w) % 10000 as s_suppkey
        from x_part cross join (select cast(unnest([1, 2, 3, 4, 5]) as int) as w)""",
    "d_supplier": """
        select range as su_suppkey, 'Supplier' || lpad(cast(range as varchar), 5, '0') as su_name,
               'Dock ' || range as su_address, cast(65 + range % 25 as int) as su_nationkey,
               '44-' || range as su_phone,
               case when range % 50 = 0 then 'a bad record' else 'note ' || (range % 13) end
                   as su_comment
        from range(10000)""",
    "d_nation": """
        select n_nationkey + 65 as n_nationkey,
               case n_nationkey when 3 then 'Germany' when 4 then 'Cambodia' else n_name end
                   as n_name, n_regionkey
        from x_nation""",
    "d_region": """
        select r_regionkey,
               case r_name when 'EUROPE' then 'Europe' else r_name end as r_name from x_region""",
}


def desk(body: str) -> str:
    return star(body, **_DESK)


_CUST_ORDER = "c_id = o_c_id and c_w_id = o_w_id and c_d_id = o_d_id"
_ORDER_LINE = "ol_w_id = o_w_id and ol_d_id = o_d_id and ol_o_id = o_id"
_LINE_STOCK = "ol_i_id = s_i_id and ol_supply_w_id = s_w_id"

_RAW = {
    "q01": """
        select ol_number, cast(sum(ol_quantity) as bigint) as sum_qty,
               round(cast(sum(ol_amount) as double), 2) as sum_amount,
               round(cast(sum(ol_quantity) as double) / count(*), 4) as avg_qty,
               round(cast(sum(ol_amount) as double) / count(*), 4) as avg_amount,
               count(*) as count_order
        from d_order_line group by ol_number order by ol_number limit 10""",
    "q02": """
        select su_suppkey, su_name, n_name, i_id, i_name, su_address, su_phone, su_comment
        from d_stock
        join d_item on i_id = s_i_id
        join d_supplier on su_suppkey = s_suppkey
        join d_nation on n_nationkey = su_nationkey
        join d_region on r_regionkey = n_regionkey
        join (select s_i_id as m_i_id, min(s_quantity) as m_s_quantity
              from d_stock
              join d_supplier on su_suppkey = s_suppkey
              join d_nation on n_nationkey = su_nationkey
              join d_region on r_regionkey = n_regionkey
              where r_name like 'Europ%' group by 1)
          on m_i_id = i_id and m_s_quantity = s_quantity
        where i_data like '%b' and r_name like 'Europ%'
        order by n_name, su_name, i_id limit 10""",
    "q03": f"""
        select ol_o_id, ol_w_id, ol_d_id, round(cast(sum(ol_amount) as double), 2) as revenue,
               o_entry_d
        from d_customer join d_orders on {_CUST_ORDER}
        join d_new_order on no_w_id = o_w_id and no_d_id = o_d_id and no_o_id = o_id
        join d_order_line on {_ORDER_LINE}
        where c_state like 'A%'
        group by ol_o_id, ol_w_id, ol_d_id, o_entry_d
        order by revenue desc, o_entry_d, ol_o_id, ol_w_id, ol_d_id limit 10""",
    "q04": f"""
        select o_ol_cnt, count(*) as order_count from d_orders
        where exists (select 1 from d_order_line
                      where {_ORDER_LINE} and ol_delivery_d >= o_entry_d)
        group by o_ol_cnt order by o_ol_cnt limit 10""",
    "q05": f"""
        select n_name, round(cast(sum(ol_amount) as double), 2) as revenue
        from d_customer join d_orders on {_CUST_ORDER}
        join d_order_line on {_ORDER_LINE}
        join d_stock on ol_w_id = s_w_id and ol_i_id = s_i_id
        join d_supplier on su_suppkey = s_suppkey and su_nationkey = ascii(substr(c_state, 1, 1))
        join d_nation on n_nationkey = su_nationkey
        join d_region on r_regionkey = n_regionkey
        where r_name = 'Europe' and o_entry_d >= date '2015-01-02'
        group by n_name order by revenue desc, n_name limit 10""",
    "q06": """
        select round(cast(sum(ol_amount) as double), 2) as revenue from d_order_line
        where ol_quantity between 1 and 100000""",
    "q07": f"""
        select su_nationkey as supp_nation, substr(c_state, 1, 1) as cust_nation,
               cast(extract(year from o_entry_d) as int) as l_year,
               round(cast(sum(ol_amount) as double), 2) as revenue
        from d_order_line join d_stock on {_LINE_STOCK}
        join d_supplier on su_suppkey = s_suppkey
        join d_orders on {_ORDER_LINE} join d_customer on {_CUST_ORDER}
        join d_nation a on a.n_nationkey = su_nationkey
        join d_nation b on b.n_nationkey = ascii(substr(c_state, 1, 1))
        where (a.n_name = 'Germany' and b.n_name = 'Cambodia')
           or (a.n_name = 'Cambodia' and b.n_name = 'Germany')
        group by 1, 2, 3 order by 1, 2, 3 limit 10""",
    "q08": f"""
        select cast(extract(year from o_entry_d) as int) as l_year,
               round(cast(sum(case when b.n_name = 'Germany' then ol_amount else 0 end) as double)
                     / cast(sum(ol_amount) as double), 4) as mkt_share
        from d_order_line join d_item on i_id = ol_i_id join d_stock on {_LINE_STOCK}
        join d_supplier on su_suppkey = s_suppkey
        join d_orders on {_ORDER_LINE} join d_customer on {_CUST_ORDER}
        join d_nation a on a.n_nationkey = ascii(substr(c_state, 1, 1))
        join d_region on r_regionkey = a.n_regionkey
        join d_nation b on b.n_nationkey = su_nationkey
        where ol_i_id < 1000 and r_name = 'Europe' and i_data like '%b'
        group by 1 order by 1 limit 10""",
    "q09": f"""
        select n_name, cast(extract(year from o_entry_d) as int) as l_year,
               round(cast(sum(ol_amount) as double), 2) as sum_profit
        from d_order_line join d_item on i_id = ol_i_id join d_stock on {_LINE_STOCK}
        join d_supplier on su_suppkey = s_suppkey join d_orders on {_ORDER_LINE}
        join d_nation on n_nationkey = su_nationkey
        where i_data like '%BB'
        group by 1, 2 order by 1, 2 desc limit 10""",
    "q10": f"""
        select c_id, c_last, round(cast(sum(ol_amount) as double), 2) as revenue, c_city, c_phone,
               n_name
        from d_customer join d_orders on {_CUST_ORDER} join d_order_line on {_ORDER_LINE}
        join d_nation on n_nationkey = ascii(substr(c_state, 1, 1))
        where o_entry_d <= ol_delivery_d
        group by c_id, c_last, c_city, c_phone, n_name
        order by revenue desc, c_id, c_last limit 10""",
    "q11": """
        select s_i_id, cast(sum(s_order_cnt) as bigint) as ordercount
        from d_stock join d_supplier on su_suppkey = s_suppkey
        join d_nation on n_nationkey = su_nationkey
        where n_name = 'Germany' group by s_i_id
        having sum(s_order_cnt) > (
            select sum(s_order_cnt) * 0.005
            from d_stock join d_supplier on su_suppkey = s_suppkey
            join d_nation on n_nationkey = su_nationkey where n_name = 'Germany')
        order by ordercount desc, s_i_id limit 10""",
    "q12": f"""
        select o_ol_cnt, count(*) filter (o_carrier_id in (1, 2)) as high_line_count,
               count(*) filter (o_carrier_id not in (1, 2)) as low_line_count
        from d_orders join d_order_line on {_ORDER_LINE}
        where o_entry_d <= ol_delivery_d
        group by o_ol_cnt order by o_ol_cnt limit 10""",
    "q13": f"""
        select c_count, count(*) as custdist
        from (select c_id, count(o_id) as c_count
              from d_customer left join d_orders on {_CUST_ORDER} and o_carrier_id > 8
              group by c_id)
        group by c_count order by custdist desc, c_count desc limit 10""",
    "q14": """
        select round(100.0 * cast(sum(case when i_data like 'PR%' then ol_amount else 0 end)
                                  as double) / cast(1 + sum(ol_amount) as double), 4)
                   as promo_revenue
        from d_order_line join d_item on i_id = ol_i_id""",
    "q15": f"""
        select su_suppkey, su_name, su_address, su_phone,
               round(cast(total as double), 2) as total_revenue
        from (select s_suppkey, sum(ol_amount) as total,
                     max(sum(ol_amount)) over () as top
              from d_order_line join d_stock on {_LINE_STOCK} group by s_suppkey)
        join d_supplier on su_suppkey = s_suppkey
        where total = top order by su_suppkey limit 10""",
    "q16": """
        select i_name, substr(i_data, 1, 3) as brand, cast(i_price as double) as i_price,
               count(distinct s_suppkey) as supplier_cnt
        from d_stock join d_item on i_id = s_i_id
        where i_data not like 'zz%'
          and s_suppkey not in (select su_suppkey from d_supplier where su_comment like '%bad%')
        group by 1, 2, 3 order by supplier_cnt desc, i_name, brand, i_price limit 10""",
    "q17": """
        select round(cast(sum(ol_amount) as double) / 2.0, 4) as avg_yearly
        from d_order_line
        join (select i_id, count(*) as n, sum(ol_quantity) as q
              from d_item join d_order_line on ol_i_id = i_id
              where i_data like '%b' group by i_id) on i_id = ol_i_id
        where ol_quantity * n < q""",
    "q18": f"""
        select c_last, c_id as o_id, o_entry_d, o_ol_cnt,
               round(cast(sum(ol_amount) as double), 2) as sum_amount
        from d_customer join d_orders on {_CUST_ORDER} join d_order_line on {_ORDER_LINE}
        group by d_orders.o_id, o_w_id, o_d_id, c_id, c_last, o_entry_d, o_ol_cnt
        having sum(ol_amount) > 200
        order by sum(ol_amount) desc, o_entry_d, d_orders.o_id, c_id limit 10""",
    "q19": """
        select round(cast(sum(ol_amount) as double), 2) as revenue
        from d_order_line join d_item on i_id = ol_i_id
        where ol_quantity between 1 and 10 and i_price between 1 and 400000
          and ((i_data like '%a' and ol_w_id in (1, 2, 3))
            or (i_data like '%b' and ol_w_id in (1, 2, 4))
            or (i_data like '%c' and ol_w_id in (1, 5, 3)))""",
    "q20": """
        select su_name, su_address
        from d_supplier join d_nation on n_nationkey = su_nationkey
        where n_name = 'Germany' and su_suppkey in (
            select s_suppkey from d_stock join d_order_line on ol_i_id = s_i_id
            where s_i_id in (select i_id from d_item where i_data like 'co%')
            group by s_i_id, s_w_id, s_quantity, s_suppkey
            having 2 * s_quantity > sum(ol_quantity))
        order by su_name limit 10""",
    "q21": f"""
        select su_name, count(*) as numwait
        from d_order_line a join d_orders on {_ORDER_LINE}
        join d_stock on a.ol_w_id = s_w_id and a.ol_i_id = s_i_id
        join d_supplier on su_suppkey = s_suppkey
        join d_nation on n_nationkey = su_nationkey
        where a.ol_delivery_d > o_entry_d and n_name = 'Germany'
          and not exists (select 1 from d_order_line b
                          where b.ol_o_id = a.ol_o_id and b.ol_w_id = a.ol_w_id
                            and b.ol_d_id = a.ol_d_id and b.ol_delivery_d > a.ol_delivery_d)
        group by su_name order by numwait desc, su_name limit 10""",
    "q22": f"""
        select substr(c_state, 1, 1) as country, count(*) as numcust,
               round(cast(sum(c_balance) as double), 2) as totacctbal
        from d_customer
        where substr(c_phone, 1, 1) in ('1', '2', '3', '4', '5', '6', '7')
          and cast(c_balance as double) > (
              select cast(sum(c_balance) as double) / count(*) from d_customer
              where c_balance > 0 and substr(c_phone, 1, 1) in ('1','2','3','4','5','6','7'))
          and not exists (select 1 from d_orders where {_CUST_ORDER})
        group by 1 order by 1 limit 10""",
}

ORACLES = {f"ch_{name}": desk(body) for name, body in _RAW.items()}
