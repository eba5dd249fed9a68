"""Oracles of the generator.

Draws are computed by repeated squaring over the bits of the exponent, unlike the
digit tables of the Spark side.
"""

from starmill.generator import words

P = 2**31 - 1
A = 16807
BITS = 36


def power(row, reserved):
    """SQL for 16807^((row - 1) * reserved) mod P."""
    factors = ", ".join(
        f"case when (({row} - 1) >> {b}) & 1 = 1 then {pow(pow(A, reserved, P), 1 << b, P)}::bigint"
        " else 1::bigint end" for b in range(BITS))
    return f"list_reduce([{factors}], lambda x, y: (x * y) % {P})"


def value(stream, j, k=1):
    return f"(({j} * {words.STREAMS[stream][0] * pow(A, k, P) % P}::bigint) % {P})"


def value_at(stream, j, line, most, stride=1, first=0):
    seed = words.STREAMS[stream][0]
    table = ", ".join(
        f"{seed * pow(A, first + stride * i, P) % P}::bigint" for i in range(1, most + 1))
    return f"(({j} * ([{table}])[{line}]) % {P})"


def trunc(x):
    return f"cast(trunc({x}) as bigint)"


def unif(v, low, high):
    return f"({low} + " + trunc(f"cast({v} as double) / {P}.0::double * ({high} - ({low}) + 1)::double") + ")"


def word(v, names):
    listed = ", ".join(f"'{n}'" for n in names)
    return f"([{listed}])[{unif(v, 1, len(names))}]"


def weighted(v, pairs):
    total, case = 0, "case"
    draw = unif(v, 1, sum(w for _, w in pairs))
    for name, weight in pairs:
        total += weight
        case += f" when {draw} <= {total} then '{name}'"
    return case + " end"


def money(cents):
    return f"(cast({cents} as double) / 100)"


def padded(tag, n):
    return f"'{tag}' || lpad(cast({n} as varchar), cast(greatest(9, length(cast({n} as varchar))) as int), '0')"


def phone_text(stream, j, nation):
    return (f"({nation} + 10) || '-' || {unif(value(stream, j, 1), 100, 999)} || '-' || "
            f"{unif(value(stream, j, 2), 100, 999)} || '-' || {unif(value(stream, j, 3), 1000, 9999)}")


def address(stream, j):
    text = f"'{words.ALPHABET}'"
    parts = []
    for group in range(8):
        v = trunc(f"cast({value(stream, j, group + 2)} as double) / {P}.0::double"
                  " * -2147483648.0::double")
        # two's complement low bits of a negative number, by flooring division
        for place in range(5):
            parts.append(f"substr({text}, cast((({v} // {64 ** place} - case when {v} < 0 and "
                         f"{v} % {64 ** place} <> 0 then 1 else 0 end) % 64 + 64) % 64 as int) + 1, 1)")
    return f"substr({' || '.join(parts)}, 1, cast({unif(value(stream, j, 1), 10, 40)} as int))"


def rows(table, key, *reserved):
    jumps = "".join(f", {power('row', n)} as j{n}" for n in reserved)
    return f"(select row{jumps} from (select {key} + 1 as row from {table}))"


N_PART, N_SUPP = "(select count(*) from part)", "(select count(*) from supplier)"
N_CUST, N_ORD = "(select count(*) from customer)", "(select count(*) from orders)"
PER_SET = f"({N_ORD} // 10000 * 10)"
CUTOFF = 1263
LAST_DAY = 2557 - 151 - 1


def price(part):
    return f"(90000 + ({part} // 10) % 20001 + ({part} % 1000) * 100)"


def bridge(part, slot):
    return (f"(({part} + {slot} * (n_supp // 4 + ({part} - 1) // n_supp)) % n_supp + 1)")


def sparse(row, group="0"):
    return f"(((({row} >> 3) * 4 + {group}) * 8) + ({row} & 7))"


_COUNTS = (f"(select {N_PART} as n_part, {N_SUPP} as n_supp, {N_CUST} as n_cust,"
           f" {N_ORD} as n_ord)")


def order_lines(source, key):
    """Lines of orders; ``source`` has row, and ``key`` is the order key expression."""
    def at(stream):
        return value_at(stream, "j7", "line", 7)

    return f"""
    select *, {sparse('1')} * 0 + order_key as k,
           {bridge('pk', 'slot')} as sk, {price('pk')} * qty as cents
    from (
        select *, {unif(at('line_part'), 1, 'n_part')} as pk,
               {unif(at('line_supplier'), 0, 3)} as slot,
               {unif(at('line_quantity'), 1, 50)} as qty,
               {unif(at('line_discount'), 0, 10)} as disc,
               {unif(at('line_tax'), 0, 8)} as tax,
               day + {unif(at('line_ship'), 1, 121)} as ship,
               day + {unif(at('line_commit'), 30, 90)} as com,
               day + {unif(at('line_ship'), 1, 121)} + {unif(at('line_receipt'), 1, 30)} as rec
        from (
            select *, unnest(range(1, lines + 1)) as line
            from (
                select *, {key} as order_key,
                       {unif(value('order_date', 'j1'), 0, LAST_DAY)} as day,
                       {unif(value('order_lines', 'j1'), 1, 7)} as lines
                from (select *, {power('row', 1)} as j1, {power('row', 7)} as j7
                      from {source}) cross join {_COUNTS})))"""


def orders_sql(source, key):
    return f"""
    with l as ({order_lines(source, key)}),
    t as (
        select row, k, day, j1, n_cust, n_ord, count(*) as n,
               count(*) filter (ship <= {CUTOFF}) as shipped,
               sum((cents * (100 - disc) // 100) * (100 + tax) // 100) as total
        from l group by row, k, day, j1, n_cust, n_ord),
    b as (select *, {unif(value('order_customer', 'j1'), 1, 'n_cust')} as c from t)
    select k as o_orderkey,
           case when c % 3 <> 0 then c when c < n_cust then c + 1 else c - 1 end as o_custkey,
           case when shipped = n then 'F' when shipped > 0 then 'P' else 'O' end as o_orderstatus,
           {money('total')} as o_totalprice,
           date '1992-01-01' + cast(day as int) as o_orderdate,
           {word(value('order_priority', 'j1'), words.PRIORITIES)} as o_orderpriority,
           {padded('Clerk#', unif(value('order_clerk', 'j1'), 1, 1000))} as o_clerk,
           0 as o_shippriority
    from b"""


def lines_sql(source, key):
    return f"""
    with l as ({order_lines(source, key)}),
    f as (
        select *, count(*) filter (rec <= {CUTOFF})
                      over (partition by row order by line) as turn
        from l)
    select k as l_orderkey, pk as l_partkey, sk as l_suppkey, cast(line as int) as l_linenumber,
           cast(qty as double) as l_quantity, {money('cents')} as l_extendedprice,
           {money('disc')} as l_discount, {money('tax')} as l_tax,
           case when rec <= {CUTOFF}
                then {word(value_at('line_return', 'j7', 'turn', 7), words.RETURN_FLAGS)}
                else 'N' end as l_returnflag,
           case when ship <= {CUTOFF} then 'F' else 'O' end as l_linestatus,
           date '1992-01-01' + cast(ship as int) as l_shipdate,
           date '1992-01-01' + cast(com as int) as l_commitdate,
           date '1992-01-01' + cast(rec as int) as l_receiptdate,
           {word(value_at('line_instruction', 'j7', 'line', 7), words.INSTRUCTIONS)}
               as l_shipinstruct,
           {word(value_at('line_mode', 'j7', 'line', 7), words.SHIP_MODES)} as l_shipmode
    from f"""


_ORDER_ROWS = "(select o_orderkey + 1 as row from orders)"
_SET_ROWS = f"""
    (select set_number, position, (set_number - 1) * {PER_SET} + position + 1 as new_row,
            {N_ORD} + (set_number - 1) * {PER_SET} + position + 1 as row
     from (select n_nationkey + 1 as set_number, unnest(range(0, {PER_SET})) as position
           from nation))"""


def _region_of_nation():
    key, out = 0, []
    for _, step in words.NATION_STEPS:
        key += step
        out.append(key)
    return ", ".join(map(str, out))


def _listed(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_NAMES = f"""
with recursive walk as (
    select 0 as row, {words.STREAMS['part_name'][0]}::bigint as state,
           [cast(x as bigint) for x in range(92)] as held
    union all
    select row + 1, (state * {pow(A, 92, P)}) % {P},
           list_reduce(
               list_prepend(held, list_transform(range(92), lambda i:
                   [cast(i as bigint),
                    i + cast(trunc(cast((state * ([{', '.join(str(pow(A, k, P)) for k in range(1, 93))}])[i + 1])
                        % {P} as double) / {P}.0::double * (92 - i)::double) as bigint)])),
               lambda a, s: list_transform(a, lambda x, pos:
                   case when pos = s[1] + 1 then a[s[2] + 1]
                        when pos = s[2] + 1 then a[s[1] + 1] else x end))
    from walk where row < {N_PART})
select cast(row as bigint) as p_partkey,
       array_to_string(list_transform(held[1:5], lambda x:
           ({_listed(words.COLOURS)})[x + 1]), ' ') as p_name
from walk where row > 0"""

_j = value


def _params_sql():
    """Parameters of all queries by recursion: redraws until a word differs, and shuffles swap by swap."""
    def d(q, k):
        return f"(seed % {P} * {pow(A, q + k, P)}::bigint % {P})"

    def n(q, k, low, high):
        return unif(d(q, k), low, high)

    def w(q, k, names):
        return word(d(q, k), names)

    def month(k):
        return f"strftime(date '1993-01-01' + to_months(cast({k} as int)), '%Y-%m-%d')"

    def year(k):
        return f"'19' || {k} || '-01-01'"

    def brand(q, k):
        return f"'Brand#' || {n(q, k, 1, 5)} || {n(q, k + 1, 1, 5)}"

    def weighted_word(q, k, pairs):
        return weighted(d(q, k), pairs)

    def shuffled(q, k, size, taken, first):
        values = f"range({first}, {first + size})"
        for i in range(taken):
            j = f"{unif(d(q, k + i), i, size - 1)} + 1"
            values = (f"(select list_transform(range(1, {size + 1}), lambda x: case when x = {i + 1} then l[j]"
                      f" when x = j then l[{i + 1}] else l[x] end) from (select {values} as l, {j} as j))")
        return f"array_to_string(({values})[1:{taken}], '|')"

    regions, key = [], 0
    for _, step in words.NATION_STEPS:
        key += step
        regions.append(words.REGIONS[key])
    nation_list = ", ".join(f"'{x}'" for x in regions)
    type_list = words.PART_TYPES
    other = {q: f"(select v from accepted a where a.seed = s.seed and a.q = {q})" for q in (7, 12)}
    by_query = {
        1: [n(1, 1, 60, 120)],
        2: [n(2, 1, 1, 50), f"string_split({w(2, 2, type_list)}, ' ')[-1]", w(2, 3, words.REGIONS)],
        3: [w(3, 1, words.SEGMENTS), f"cast(date '1995-03-01' + cast({n(3, 2, 0, 30)} as int) as varchar)"],
        4: [month(n(4, 1, 1, 58))],
        5: [w(5, 1, words.REGIONS), year(n(5, 2, 93, 97))],
        6: [year(n(6, 1, 93, 97)), f"'0.0' || {n(6, 2, 2, 9)}", n(6, 3, 24, 25)],
        7: [w(7, 1, words.NATIONS), word(other[7], words.NATIONS)],
        8: [w(8, 1, words.NATIONS), f"([{nation_list}])[{n(8, 1, 1, 25)}]", w(8, 2, type_list)],
        9: [w(9, 1, words.COLOURS)],
        10: [month(n(10, 1, 1, 24))],
        11: [w(11, 1, words.NATIONS), "'0.0001000000'"],
        12: [w(12, 1, words.SHIP_MODES), word(other[12], words.SHIP_MODES),
             year(unif(f"({other[12]} * {A} % {P})", 93, 97))],
        13: [weighted_word(13, 1, words.QUERY_ADJECTIVES), weighted_word(13, 2, words.QUERY_NOUNS)],
        14: [month(n(14, 1, 0, 59))],
        15: [month(n(15, 1, 0, 57))],
        16: [brand(16, 1), f"array_to_string(string_split({w(16, 3, type_list)}, ' ')[1:2], ' ')", shuffled(16, 4, 50, 8, 1)],
        17: [brand(17, 1), w(17, 3, words.CONTAINERS)],
        18: [n(18, 1, 312, 315)],
        19: [brand(19, 1), brand(19, 3), brand(19, 5), n(19, 7, 1, 10), n(19, 8, 10, 20), n(19, 9, 20, 30)],
        20: [w(20, 1, words.COLOURS), year(n(20, 2, 93, 97)), w(20, 3, words.NATIONS)],
        21: [w(21, 1, words.NATIONS)],
        22: [shuffled(22, 1, 25, 7, 20)],
    }
    starts = " union all ".join(
        f"select seed, {q} as q, {d(q, 2)} as v, {unif(d(q, 1), 1, size)} as first, {size} as size from s"
        for q, size in ((7, len(words.NATIONS)), (12, len(words.SHIP_MODES))))
    chosen = unif("v", 1, "size")
    rows_of = " union all ".join(
        f"select seed, {q} as query, {' || chr(124) || '.join(f'({x})' for x in parts)} as parameters from s"
        for q, parts in by_query.items())
    return f"""
        with recursive s as (select c_custkey + 1 as seed from customer),
        tries as (
            {starts}
            union all
            select seed, q, v * {A} % {P}, first, size from tries where {chosen} = first),
        accepted as (select seed, q, v from tries where {chosen} <> first)
        {rows_of}"""


ORACLES = {
    "gen_rng_stream": f"""
        select row, {_j('line_quantity', 'j7', 1)} as first,
               {_j('line_quantity', 'j7', 7)} as seventh,
               {unif(_j('line_quantity', 'j7', 1), 1, 50)} as quantity
        from {rows('orders', 'o_orderkey', 7)}""",
    "gen_weighted_choice": f"""
        select row, {word(_j('part_container', 'j1'), words.CONTAINERS)} as container,
               {weighted(_j('part_container', 'j1'), words.NOUNS)} as noun
        from {rows('part', 'p_partkey', 1)}""",
    "gen_permuted_string": _NAMES,
    "gen_alnum_string": f"""
        select row, {address('customer_address', 'j9')} as address
        from {rows('customer', 'c_custkey', 9)}""",
    "gen_phone": f"""
        select row, {phone_text('customer_phone', 'j3',
                                unif(_j('customer_nation', 'j1'), 0, 24))} as phone
        from {rows('customer', 'c_custkey', 1, 3)}""",
    "gen_comment_span": f"""
        select row, {unif(_j('order_comment', 'j2', 1), 0, words.POOL_CHARACTERS - 78)} as at,
               {unif(_j('order_comment', 'j2', 2), 19, 78)} as size
        from {rows('orders', 'o_orderkey', 2)}""",
    "gen_dates": f"""
        select row, date '1992-01-01' + cast({unif(_j('order_date', 'j1'), 0, LAST_DAY)} as int)
                   as order_date
        from {rows('orders', 'o_orderkey', 1)}""",
    "gen_time_dim": """
        select n + 8035 as t_timekey, d as t_date, cast(year(d) as int) as t_year,
               cast(month(d) + 12 * (year(d) - 1970) as int) as t_month,
               cast((dayofyear(d) + 2) // 7 + 1 as int) as t_week, cast(day(d) as int) as t_day
        from (select distinct cast(cast(o_orderdate as date) - date '1995-01-01' + 1 as bigint) as n,
                     date '1992-01-01'
                     + cast(cast(o_orderdate as date) - date '1995-01-01' as int) as d
              from orders)""",
    "gen_region": f"""
        select r_regionkey, ({_listed(words.REGIONS)})[r_regionkey + 1] as r_name,
               r_name as given_name from region""",
    "gen_nation": f"""
        select n_nationkey, ({_listed(words.NATIONS)})[n_nationkey + 1] as n_name,
               ([{_region_of_nation()}])[n_nationkey + 1] as n_regionkey, n_name as given_name
        from nation""",
    "gen_supplier": f"""
        select row as s_suppkey, {padded('Supplier#', 'row')} as s_name,
               {address('supplier_address', 'j9')} as s_address,
               cast({unif(_j('supplier_nation', 'j1'), 0, 24)} as int) as s_nationkey,
               {phone_text('supplier_phone', 'j3', unif(_j('supplier_nation', 'j1'), 0, 24))}
                   as s_phone,
               {money(unif(_j('supplier_balance', 'j1'), -99999, 999999))} as s_acctbal
        from {rows('supplier', 's_suppkey', 1, 3, 9)}""",
    "gen_customer": f"""
        select row as c_custkey, {padded('Customer#', 'row')} as c_name,
               {address('customer_address', 'j9')} as c_address,
               cast({unif(_j('customer_nation', 'j1'), 0, 24)} as int) as c_nationkey,
               {phone_text('customer_phone', 'j3', unif(_j('customer_nation', 'j1'), 0, 24))}
                   as c_phone,
               {money(unif(_j('customer_balance', 'j1'), -99999, 999999))} as c_acctbal,
               {word(_j('customer_segment', 'j1'), words.SEGMENTS)} as c_mktsegment
        from {rows('customer', 'c_custkey', 1, 3, 9)}""",
    "gen_part": f"""
        select row as p_partkey, 'Manufacturer#' || {unif(_j('part_mfgr', 'j1'), 1, 5)} as p_mfgr,
               'Brand#' || {unif(_j('part_mfgr', 'j1'), 1, 5)}
                   || {unif(_j('part_brand', 'j1'), 1, 5)} as p_brand,
               {word(_j('part_type', 'j1'), words.PART_TYPES)} as p_type,
               cast({unif(_j('part_size', 'j1'), 1, 50)} as int) as p_size,
               {word(_j('part_container', 'j1'), words.CONTAINERS)} as p_container,
               {money(price('row'))} as p_retailprice
        from {rows('part', 'p_partkey', 1)}""",
    "gen_retail_price": f"""
        select row, {price('row')} as cents from (select p_partkey + 1 as row from part)""",
    "gen_partsupp": f"""
        select row as ps_partkey, {bridge('row', '(slot - 1)')} as ps_suppkey,
               cast({unif(value_at('partsupp_quantity', 'j4', 'slot', 4), 1, 9999)} as int)
                   as ps_availqty,
               {money(unif(value_at('partsupp_cost', 'j4', 'slot', 4), 100, 100000))}
                   as ps_supplycost
        from {rows('part', 'p_partkey', 4)} cross join (select unnest([1, 2, 3, 4]) as slot)
             cross join {_COUNTS}""",
    "gen_orders": orders_sql(_ORDER_ROWS, sparse("row")),
    "gen_lineitem": lines_sql(_ORDER_ROWS, sparse("row")),
    "gen_sparse_key": f"""
        select row, (row // 8) * 32 + row % 8 as base_key, (row // 8) * 32 + 8 + row % 8 as new_key
        from {_ORDER_ROWS}""",
    "gen_chunk": f"""
        select cast(least((row - 1) // ({N_ORD} // 7) + 1, 7) as int) as chunk,
               min(row) as first, max(row) as last, count(*) as n
        from {_ORDER_ROWS} group by 1""",
    "gen_refresh_inserts": orders_sql(_SET_ROWS, sparse("new_row", "(set_number // 1000 + 1)")),
    "gen_refresh_lines": lines_sql(_SET_ROWS, sparse("new_row", "(set_number // 1000 + 1)")),
    "gen_refresh_deletes": f"""
        select cast(set_number as bigint) as set_number, cast(position as int) as position,
               {sparse('new_row', '(set_number // 1000) % 4')} as o_orderkey
        from {_SET_ROWS}""",
    "gen_refresh_segments": f"""
        select cast(set_number as bigint) as set_number, cast(position as int) as position,
               case when position < (n % 4) * (n // 4 + 1) then position // (n // 4 + 1)
                    else n % 4 + (position - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) end
                   as inserts,
               position // (n // 4 + 1) as deletes
        from {_SET_ROWS} cross join (select {PER_SET} as n)""",
    "gen_series": f"""
        select range as a, range * 2 as b, range % 100 as c, {N_ORD} - range as d
        from range(1, {N_ORD} + 1)""",
    "gen_random_tables": """
        select cast(k as int) as tbl, n, n as largest, cast(n * (n + 1) // 2 as bigint) as total
        from (select k, c + cast('0x' || substr(md5('7:' || k), 1, 8) as bigint) % (c + 1) as n
              from (select unnest(range((select count(*) from region))) as k,
                           (select count(*) from customer) as c))""",
    "gen_query_params": _params_sql(),
    "gen_query_order": f"""
        select cast(c_custkey % {len(words.QUERY_ORDERS)} as bigint) as stream, cast(position as int) as position,
               ([{', '.join(str(list(o)) for o in words.QUERY_ORDERS)}])
                   [c_custkey % {len(words.QUERY_ORDERS)} + 1][position] as query
        from customer cross join (select unnest(range(1, 23)) as position)""",
}
