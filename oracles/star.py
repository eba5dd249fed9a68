"""CTE prefix that gives the oracles the full star schema."""

_HASH = "(l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3)"

_TABLES = {
    "x_region": "select r_regionkey, r_name from region",
    "x_nation": "select n_nationkey, n_name, n_regionkey from nation",
    "x_customer": """
        select c_custkey, c_name, 'Street ' || c_custkey as c_address, c_nationkey,
               (10 + c_nationkey) || '-' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') as c_phone,
               cast(c_acctbal as decimal(12,2)) as c_acctbal, c_mktsegment,
               'customer note ' || (c_custkey % 17) as c_comment
        from customer""",
    "x_supplier": """
        select s_suppkey, s_name, 'Dock ' || s_suppkey as s_address, s_nationkey,
               (10 + s_nationkey) || '-' || lpad(cast(s_suppkey % 1000 as varchar), 3, '0') as s_phone,
               cast(s_acctbal as decimal(12,2)) as s_acctbal,
               case when s_suppkey % 20 = 7 then 'slow Customer many Complaints'
                    else 'supplier note ' || (s_suppkey % 11) end as s_comment
        from supplier""",
    "x_part": """
        select p_partkey, p_name, 'Manufacturer#' || (p_partkey % 5 + 1) as p_mfgr,
               p_brand, p_type, p_size,
               (['SM','LG','MED','JUMBO','WRAP'])[p_partkey % 5 + 1] || ' ' ||
               (['CASE','BOX','BAG','JAR','PKG','PACK','CAN','DRUM'])[(p_partkey // 5) % 8 + 1]
                   as p_container,
               cast(p_retailprice as decimal(12,2)) as p_retailprice
        from part""",
    "x_orders": """
        select o_orderkey,
               case when o_custkey % 3 = 0 then o_custkey + 1 else o_custkey end as o_custkey,
               o_orderstatus, cast(o_totalprice as decimal(12,2)) as o_totalprice,
               cast(o_orderdate as date) as o_orderdate, o_orderpriority,
               'Clerk#' || (o_orderkey % 1000) as o_clerk, 0 as o_shippriority,
               case when o_orderkey % 13 = 0 then 'the special packages requests'
                    else 'order note ' || (o_orderkey % 19) end as o_comment
        from orders""",
    "x_lineitem": f"""
        select l_orderkey, l_partkey, l_suppkey, l_linenumber,
               cast(l_quantity as decimal(12,2)) as l_quantity,
               cast(l_extendedprice as decimal(12,2)) as l_extendedprice,
               cast(l_discount as decimal(4,2)) as l_discount,
               cast(l_tax as decimal(4,2)) as l_tax,
               l_returnflag, l_linestatus, cast(l_shipdate as date) as l_shipdate,
               cast(l_shipdate as date) + cast({_HASH} % 61 - 30 as int) as l_commitdate,
               cast(l_shipdate as date) + cast(1 + ({_HASH} * 5) % 30 as int) as l_receiptdate,
               (['DELIVER IN PERSON','COLLECT COD','NONE','TAKE BACK RETURN'])[{_HASH} % 4 + 1]
                   as l_shipinstruct,
               (['REG AIR','AIR','RAIL','TRUCK','MAIL','FOB','SHIP'])[({_HASH} + l_suppkey) % 7 + 1]
                   as l_shipmode
        from lineitem""",
    "x_partsupp": """
        select ps_partkey, ps_suppkey,
               cast((ps_partkey * 31 + ps_suppkey * 17) % 9999 + 1 as int) as ps_availqty,
               cast(((ps_partkey * 37 + ps_suppkey * 101) % 99901 + 100)
                    * cast(0.01 as decimal(3,2)) as decimal(12,2)) as ps_supplycost
        from (select distinct l_partkey as ps_partkey, l_suppkey as ps_suppkey from lineitem)""",
}


def star(body: str, **extra: str) -> str:
    """Prefix ``body`` with the star-schema CTEs it mentions and ``extra`` ones."""
    text = body + " ".join(extra.values())
    used = {name: sql for name, sql in _TABLES.items() if name in text}
    used.update(extra)
    if not used:
        return body
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in used.items()) + "\n" + body
