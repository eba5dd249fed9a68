"""Oracles of the star query suite, with the parameters of the registered runs."""

from oracles.star import star

_NET = "l_extendedprice * (1 - l_discount)"

_Q02 = """
select cast(s_acctbal as double) as s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address,
       s_phone, s_comment
from x_part
join x_partsupp on ps_partkey = p_partkey
join x_supplier on s_suppkey = ps_suppkey
join x_nation on n_nationkey = s_nationkey
join x_region on r_regionkey = n_regionkey
where p_size = 15 and p_type like '%ECONOMY' and r_name = 'EUROPE'
  and ps_supplycost = (
      select min(i.ps_supplycost)
      from x_partsupp i
      join x_supplier si on si.s_suppkey = i.ps_suppkey
      join x_nation ni on ni.n_nationkey = si.s_nationkey
      join x_region ri on ri.r_regionkey = ni.n_regionkey
      where i.ps_partkey = p_partkey and ri.r_name = 'EUROPE')
order by s_acctbal desc, n_name, s_name, p_partkey limit 100
"""


def _q03(limit):
    return star(f"""
select l_orderkey, round(cast(sum({_NET}) as double), 2) as revenue, o_orderdate, o_shippriority
from x_customer
join x_orders on o_custkey = c_custkey
join x_lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15'
  and l_shipdate > date '1998-03-15'
group by l_orderkey, o_orderdate, o_shippriority
order by revenue desc, o_orderdate, l_orderkey limit {limit}""")


_Q05 = f"""
select n_name, round(cast(sum({_NET}) as double), 2) as revenue
from x_lineitem
join x_orders on o_orderkey = l_orderkey
join x_customer on c_custkey = o_custkey
join x_supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey
join x_nation on n_nationkey = s_nationkey
join x_region on r_regionkey = n_regionkey
where r_name = 'ASIA' and o_orderdate >= date '1997-01-01' and o_orderdate < date '1998-01-01'
group by n_name
"""

_Q07 = f"""
select supp_nation, cust_nation, l_year, round(cast(sum(volume) as double), 2) as revenue
from (
    select a.n_name as supp_nation, b.n_name as cust_nation,
           cast(extract(year from l_shipdate) as int) as l_year, {_NET} as volume
    from x_lineitem
    join x_supplier on s_suppkey = l_suppkey
    join x_orders on o_orderkey = l_orderkey
    join x_customer on c_custkey = o_custkey
    join x_nation a on a.n_nationkey = s_nationkey
    join x_nation b on b.n_nationkey = c_nationkey
    where l_shipdate between date '1995-01-01' and date '1996-12-31'
      and ((a.n_name = 'NATION_6' and b.n_name = 'NATION_9')
        or (a.n_name = 'NATION_9' and b.n_name = 'NATION_6')))
group by all
"""

_Q08 = f"""
select o_year,
       round(cast(sum(case when nation = 'NATION_1' then volume else 0 end) as double)
             / cast(sum(volume) as double), 4) as mkt_share
from (
    select cast(extract(year from o_orderdate) as int) as o_year, {_NET} as volume,
           b.n_name as nation
    from x_part
    join x_lineitem on l_partkey = p_partkey
    join x_supplier on s_suppkey = l_suppkey
    join x_orders on o_orderkey = l_orderkey
    join x_customer on c_custkey = o_custkey
    join x_nation a on a.n_nationkey = c_nationkey
    join x_region on r_regionkey = a.n_regionkey
    join x_nation b on b.n_nationkey = s_nationkey
    where r_name = 'AMERICA' and p_type = 'ECONOMY'
      and o_orderdate between date '1995-01-01' and date '1996-12-31')
group by o_year
"""


def _q09(limit):
    return star(f"""
select n_name as nation, cast(extract(year from o_orderdate) as int) as o_year,
       round(cast(sum({_NET} - ps_supplycost * l_quantity) as double), 2) as sum_profit
from x_lineitem
join x_part on p_partkey = l_partkey
join x_supplier on s_suppkey = l_suppkey
join x_partsupp on ps_partkey = l_partkey and ps_suppkey = l_suppkey
join x_orders on o_orderkey = l_orderkey
join x_nation on n_nationkey = s_nationkey
where p_name like '%red%'
group by 1, 2
order by 1, 2 desc {limit}""")


def _q10(limit):
    return star(f"""
select c_custkey, c_name, round(cast(sum({_NET}) as double), 2) as revenue,
       cast(c_acctbal as double) as c_acctbal, n_name, c_address, c_phone, c_comment
from x_customer
join x_orders on o_custkey = c_custkey
join x_lineitem on l_orderkey = o_orderkey
join x_nation on n_nationkey = c_nationkey
where o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01'
  and l_returnflag = 'R'
group by c_custkey, c_name, c_acctbal, n_name, c_address, c_phone, c_comment
order by revenue desc, c_custkey limit {limit}""")


_Q11 = """
select ps_partkey, round(cast(sum(ps_supplycost * ps_availqty) as double), 2) as value
from x_partsupp
join x_supplier on s_suppkey = ps_suppkey
join x_nation on n_nationkey = s_nationkey
where n_name = 'NATION_9'
group by ps_partkey
having cast(sum(ps_supplycost * ps_availqty) as double) > (
    select cast(sum(ps_supplycost * ps_availqty) as double) * 0.001
    from x_partsupp
    join x_supplier on s_suppkey = ps_suppkey
    join x_nation on n_nationkey = s_nationkey
    where n_name = 'NATION_9')
"""

_Q12 = """
select l_shipmode,
       cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint)
           as high_line_count,
       cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0 else 1 end) as bigint)
           as low_line_count
from x_orders join x_lineitem on l_orderkey = o_orderkey
where l_shipmode in ('MAIL', 'SHIP') and l_commitdate < l_receiptdate
  and l_shipdate < l_commitdate and l_receiptdate >= date '1997-01-01'
  and l_receiptdate < date '1998-01-01'
group by l_shipmode
"""


def _q13(name):
    return star(f"""
select n as {name}, count(*) as custdist
from (select c_custkey, count(o_orderkey) as n
      from x_customer left join x_orders
        on o_custkey = c_custkey and o_comment not like '%special%requests%'
      group by c_custkey)
group by n""")


_Q14 = f"""
select round(100.0 * cast(sum(case when p_type like 'PROMO%' then {_NET} else 0 end) as double)
             / cast(sum({_NET}) as double), 4) as promo_revenue
from x_lineitem join x_part on p_partkey = l_partkey
where l_shipdate >= date '1997-09-01' and l_shipdate < date '1997-10-01'
"""

_REVENUE = f"""
select l_suppkey as supplier_no, sum({_NET}) as total_revenue
from x_lineitem
where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01'
group by l_suppkey"""

_Q15 = """
select s_suppkey, s_name, s_address, s_phone,
       round(cast(total_revenue as double), 2) as total_revenue
from x_supplier join revenue on supplier_no = s_suppkey
where total_revenue = (select max(total_revenue) from revenue)
"""

_Q16 = """
select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt
from x_partsupp join x_part on p_partkey = ps_partkey
where p_brand <> 'Brand#15' and p_type not like 'MEDIUM%'
  and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
  and ps_suppkey not in (
      select s_suppkey from x_supplier where s_comment like '%Customer%Complaints%')
group by p_brand, p_type, p_size
"""

_Q17 = """
select round(cast(sum(l_extendedprice) as double) / 7.0, 4) as avg_yearly
from x_lineitem l join x_part on p_partkey = l.l_partkey
where p_brand = 'Brand#23' and p_container = 'MED BOX'
  and l.l_quantity * 5 * (select count(*) from x_lineitem i where i.l_partkey = p_partkey)
      < (select sum(i.l_quantity) from x_lineitem i where i.l_partkey = p_partkey)
"""

_Q18 = """
select c_name, c_custkey, o_orderkey, o_orderdate, cast(o_totalprice as double) as o_totalprice,
       round(cast(sum(l_quantity) as double), 2) as sum_qty
from x_customer
join x_orders on o_custkey = c_custkey
join x_lineitem on l_orderkey = o_orderkey
where o_orderkey in (
    select l_orderkey from x_lineitem group by l_orderkey having sum(l_quantity) > 200)
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
order by o_totalprice desc, o_orderdate, o_orderkey limit 100
"""

_Q19 = f"""
select round(cast(sum({_NET}) as double), 2) as revenue
from x_lineitem join x_part on p_partkey = l_partkey
where l_shipmode in ('AIR', 'AIR REG') and l_shipinstruct = 'DELIVER IN PERSON'
  and ((p_brand = 'Brand#12' and p_container in ('SM CASE', 'SM BOX', 'SM PACK', 'SM PKG')
        and l_quantity between 1 and 11 and p_size between 1 and 5)
    or (p_brand = 'Brand#23' and p_container in ('MED BAG', 'MED BOX', 'MED PKG', 'MED PACK')
        and l_quantity between 10 and 20 and p_size between 1 and 10)
    or (p_brand = 'Brand#14' and p_container in ('LG CASE', 'LG BOX', 'LG PACK', 'LG PKG')
        and l_quantity between 20 and 30 and p_size between 1 and 15))
"""

_Q20 = """
select s_name, s_address
from x_supplier join x_nation on n_nationkey = s_nationkey
where n_name = 'NATION_9' and s_suppkey in (
    select ps_suppkey from x_partsupp
    where ps_partkey in (select p_partkey from x_part where p_name like 'red%')
      and ps_availqty > (
          select 0.5 * sum(l_quantity) from x_lineitem
          where l_partkey = ps_partkey and l_suppkey = ps_suppkey
            and l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-01-01'))
"""

_Q21 = """
select s_name, count(*) as numwait
from x_supplier
join x_lineitem a on a.l_suppkey = s_suppkey
join x_orders on o_orderkey = a.l_orderkey
join x_nation on n_nationkey = s_nationkey
where o_orderstatus = 'F' and a.l_receiptdate > a.l_commitdate and n_name = 'NATION_9'
  and exists (select 1 from x_lineitem b
              where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey)
  and not exists (select 1 from x_lineitem c
                  where c.l_orderkey = a.l_orderkey and c.l_suppkey <> a.l_suppkey
                    and c.l_receiptdate > c.l_commitdate)
group by s_name
order by numwait desc, s_name limit 100
"""

_CODES = "('13', '31', '23', '29', '30', '18', '17')"
_Q22 = f"""
select substring(c_phone, 1, 2) as cntrycode, count(*) as numcust,
       round(cast(sum(c_acctbal) as double), 2) as totacctbal
from x_customer
where substring(c_phone, 1, 2) in {_CODES}
  and cast(c_acctbal as double) > (
      select cast(sum(c_acctbal) as double) / count(*) from x_customer
      where c_acctbal > 0 and substring(c_phone, 1, 2) in {_CODES})
  and not exists (select 1 from x_orders where o_custkey = c_custkey)
group by 1
"""

_Q01 = f"""
select l_returnflag, l_linestatus,
       round(cast(sum(l_quantity) as double), 2) as sum_qty,
       round(cast(sum(l_extendedprice) as double), 2) as sum_base_price,
       round(cast(sum({_NET}) as double), 2) as sum_disc_price,
       round(cast(sum({_NET} * (1 + l_tax)) as double), 2) as sum_charge,
       round(cast(sum(l_quantity) as double) / count(*), 4) as avg_qty,
       round(cast(sum(l_extendedprice) as double) / count(*), 4) as avg_price,
       round(cast(sum(l_discount) as double) / count(*), 4) as avg_disc,
       count(*) as count_order
from x_lineitem
where l_shipdate <= date '1998-12-01' - interval '90' day
group by l_returnflag, l_linestatus
"""

_Q04 = """
select o_orderpriority, count(*) as order_count
from x_orders
where o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-10-01'
  and exists (select 1 from x_lineitem
              where l_orderkey = o_orderkey and l_commitdate < l_receiptdate)
group by o_orderpriority
"""

_Q06 = """
select round(cast(sum(l_extendedprice * l_discount) as double), 2) as revenue
from x_lineitem
where l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-01-01'
  and l_discount between 0.05 and 0.07 and l_quantity < 24
"""

ORACLES = {
    "tpch_q01": star(_Q01),
    "tpch_q02": star(_Q02),
    "tpch_q03": _q03(10),
    "tpch_q04": star(_Q04),
    "tpch_q05": star(_Q05),
    "tpch_q06": star(_Q06),
    "tpch_q07": star(_Q07),
    "tpch_q08": star(_Q08),
    "tpch_q08a": star(_Q08),
    "tpch_q09": _q09(""),
    "tpch_q10": _q10(20),
    "tpch_q11": star(_Q11),
    "tpch_q12": star(_Q12),
    "tpch_q12a": star(_Q12),
    "tpch_q13": _q13("c_count"),
    "tpch_q13a": _q13("ordercount"),
    "tpch_q14": star(_Q14),
    "tpch_q14a": star(_Q14),
    "tpch_q15": star(_Q15, revenue=_REVENUE),
    "tpch_q15a": star(_Q15, revenue=_REVENUE),
    "tpch_q16": star(_Q16),
    "tpch_q17": star(_Q17),
    "tpch_q18": star(_Q18),
    "tpch_q19": star(_Q19),
    "tpch_q20": star(_Q20),
    "tpch_q21": star(_Q21),
    "tpch_q22": star(_Q22),
    "dist_q01": star(_Q01),
    "dist_q03": _q03(20),
    "dist_q05": star(_Q05),
    "dist_q06": star(_Q06),
    "dist_q07": star(_Q07),
    "dist_q08": star(_Q08),
    "dist_q09": _q09("limit 20"),
    "dist_q10": _q10(4),
    "dist_q12": star(_Q12),
    "dist_q14": star(_Q14),
    "dist_q19": star(_Q19),
}
