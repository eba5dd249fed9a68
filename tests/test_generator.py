"""Generator against known rows, a brute-force rendering of the rules, and itself in chunks."""

import pytest
from pyspark.sql import functions as F

from starmill.generator import names, parameters, refresh, tables, text, words
from starmill.generator.scale import Scale, chunk_bounds, row_numbers
from starmill.plans import generator_runs
from tests.conftest import DATA

P, A = 2**31 - 1, 16807


class Stream:
    """A stream stepped one draw at a time."""

    def __init__(self, state):
        self.state = state

    def step(self):
        self.state = self.state * A % P
        return self.state

    def uniform(self, low, high):
        return low + int(self.step() / float(P) * float(high - low + 1))

    def pick(self, weighted):
        weighted = [w if isinstance(w, tuple) else (w, 1) for w in weighted]
        value, total = self.uniform(1, sum(w for _, w in weighted)), 0
        for word, weight in weighted:
            total += weight
            if total >= value:
                return word


def rows_of(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "row bigint")


def test_known_customers(spark):
    got = {r.c_custkey: r for r in tables.customer(rows_of(spark, 57040, 143347)).collect()}
    one = got[57040]
    assert (one.c_address, one.c_nationkey, one.c_phone, float(one.c_acctbal)) == (
        "Eioyzjf4pp", 12, "22-895-641-3466", 632.87)
    assert got[143347].c_address == "1aReFYv,Kw4"


def test_known_orders(spark):
    scale = Scale.of(1)
    rows = rows_of(spark, 1180509, 760822)
    orders = {r.o_orderkey: r for r in tables.orders(rows, scale).collect()}
    assert orders[4722021].o_custkey == 128120
    assert str(orders[4722021].o_orderdate) == "1994-04-07"
    assert float(orders[4722021].o_totalprice) == 544089.09
    assert orders[3043270].o_custkey == 144617
    assert float(orders[3043270].o_totalprice) == 530604.44
    sums = {r.l_orderkey: (r.q, r.n) for r in tables.lineitem(rows, scale).groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("int").alias("q"), F.count("*").alias("n")).collect()}
    assert sums == {4722021: (323, 7), 3043270: (317, 7)}


def test_order_total_and_status_follow_the_lines(spark):
    scale = Scale.of(0.001)
    rows = row_numbers(spark, 1, scale.orders)
    lines = tables.lineitem(rows, scale)
    cents = F.floor(F.floor((F.col("l_extendedprice") * 100) * (100 - F.col("l_discount") * 100) / 100)
                    * (100 + F.col("l_tax") * 100) / 100)
    rollup = lines.groupBy("l_orderkey").agg(
        F.sum(cents).cast("bigint").alias("cents"),
        F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("done"), F.count("*").alias("n"))
    joined = tables.orders(rows, scale).join(rollup, F.col("o_orderkey") == F.col("l_orderkey"))
    status = F.when(F.col("done") == F.col("n"), "F").when(F.col("done") > 0, "P").otherwise("O")
    assert joined.count() == scale.orders
    assert joined.filter((F.col("o_totalprice") * 100 != F.col("cents"))
                         | (F.col("o_orderstatus") != status)).count() == 0


def test_return_flags_draw_in_turn(spark):
    scale = Scale.of(0.001)
    by_order = {}
    for r in tables.lineitem(row_numbers(spark, 1, 300), scale).collect():
        by_order.setdefault(r.l_orderkey, []).append(r)
    seed, reserved = words.STREAMS["line_return"]
    for row in range(1, 301):
        key = (row >> 3 << 5) | (row & 7)
        stream = Stream(seed * pow(A, (row - 1) * reserved, P) % P)
        for line in sorted(by_order[key], key=lambda r: r.l_linenumber):
            received = str(line.l_receiptdate) <= words.CUTOFF_DATE
            assert line.l_returnflag == (stream.pick(words.RETURN_FLAGS) if received else "N")


def test_names_carry_over_and_do_not_depend_on_chunks(spark):
    n = 500
    order, stream = list(range(92)), Stream(words.STREAMS["part_name"][0])
    expected = []
    for _ in range(n):
        for place in range(92):
            source = stream.uniform(place, 91)
            order[place], order[source] = order[source], order[place]
        expected.append(" ".join(words.COLOURS[i] for i in order[:5]))
    assert expected[:2] == ["goldenrod lavender spring chocolate lace", "maroon sky cream royal snow"]
    for size in (7, 125, 1000):
        got = names.part_names(row_numbers(spark, 1, n), size).orderBy("p_partkey").collect()
        assert [r.p_name for r in got] == expected


def test_names_need_dense_rows(spark):
    with pytest.raises(Exception, match="not dense"):
        names.part_names(rows_of(spark, 1, 3), 10).collect()


def serial_pool(characters):
    stream, out, size = Stream(words.STREAMS["text_pool"][0]), [], 0
    kinds = {"N": words.NOUNS, "V": words.VERBS, "J": words.ADJECTIVES, "D": words.ADVERBS,
             "X": words.AUXILIARIES}

    def phrase(forms):
        return " ".join(stream.pick(kinds[t[0]]) + t[1:] for t in stream.pick(forms).split())

    while size < characters:
        said = []
        for token in stream.pick(words.SENTENCES).split():
            if token == "T":
                said[-1] += stream.pick(words.TERMINATORS)
            elif token == "P":
                preposition = stream.pick(words.PREPOSITIONS)
                said.append(f"{preposition} the {phrase(words.NOUN_PHRASES)}")
            else:
                said.append(phrase(words.NOUN_PHRASES if token == "N" else words.VERB_PHRASES))
        out.append(" ".join(said))
        size += len(out[-1]) + 1
    return (" ".join(out) + " ")[:characters]


def test_pool_made_in_blocks_equals_the_serial_one(spark, tmp_path, monkeypatch):
    characters = 1_500_000  # more than one block
    expected = serial_pool(characters)
    assert expected.startswith(
        "furiously special foxes haggle furiously blithely ironic deposits. slyly final theodolites")
    pool = text.build_pool(spark, str(tmp_path / "pool"), characters)
    pieces = pool.pieces.orderBy("piece").collect()
    assert [r.piece for r in pieces] == list(range(len(pieces)))
    for r in pieces:
        at = r.piece * text.PIECE
        assert r.text == expected[at:at + text.PIECE + text.OVERLAP]
    rows = tables.orders(row_numbers(spark, 1, 200), Scale.of(0.01), pool).collect()
    seed = words.STREAMS["order_comment"][0]
    for r in rows:
        row = (r.o_orderkey >> 5 << 3) | (r.o_orderkey & 7)
        stream = Stream(seed * pow(A, (row - 1) * 2, P) % P)
        at, size = stream.uniform(0, characters - 78), stream.uniform(19, 78)
        assert r.o_comment == expected[at:at + size]


def test_registered_comments_come_from_the_exact_pool(spark, star, monkeypatch):
    made, build = [], text.build_pool
    monkeypatch.setattr(text, "build_pool", lambda *a: made.append(build(*a)) or made[-1])
    got = {r.row: r.comment for r in generator_runs.gen_text_comment(star).collect()}
    assert len(got) == star.raw("orders").count()
    pool, = made
    known = tables.customer(rows_of(spark, 57040, 143347), pool).collect()  # answers/q10.out
    assert {r.c_custkey: r.c_comment.strip() for r in known} == {
        57040: "sits. slyly regular requests sleep alongside of the regular inst",
        143347: "ggle carefully enticing requests. final deposits use bold, bold pinto beans. ironic, idle re"}
    pieces = pool.pieces.agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum(F.least(
        F.length("text"), F.lit(text.PIECE))).alias("size")).first()
    assert (pieces.n, pieces.last, pieces.size) == (307_200, 307_199, 314_572_800)
    for row in (1, 2, 777):
        stream = Stream(words.STREAMS["order_comment"][0] * pow(A, (row - 1) * 2, P) % P)
        at, size = stream.uniform(0, 314_572_800 - 78), stream.uniform(19, 78)
        piece = pool.pieces.filter(F.col("piece") == at // text.PIECE).first().text
        assert got[row] == piece[at % text.PIECE:at % text.PIECE + size]


def test_full_tables_have_their_comments(spark, star, tmp_path, monkeypatch):
    queries, short = generator_runs.generator_queries(), text.build_pool(spark, str(tmp_path / "pool"), 300_000)
    monkeypatch.setattr(generator_runs, "_pool", lambda star: short)
    extra = {"region": {"r_comment"}, "nation": {"n_comment"}, "supplier": {"s_comment"}, "customer": {"c_comment"},
             "part": {"p_comment", "p_name"}, "partsupp": {"ps_comment"}, "orders": {"o_comment"},
             "lineitem": {"l_comment"}, "refresh_inserts": {"o_comment"}, "refresh_lines": {"l_comment"}}
    for name, columns in extra.items():
        plain, full = (queries[f"gen_{name}{end}"](spark, DATA) for end in ("", "_full"))
        assert set(full.columns) == set(plain.columns) | columns
        assert full.drop(*columns).exceptAll(plain.select(full.drop(*columns).columns)).count() == 0
        assert full.where(" or ".join(f"{c} is null" for c in columns)).count() == 0
        assert full.count() == plain.count()


def test_supplier_notices(spark, tmp_path):
    pool = text.build_pool(spark, str(tmp_path / "pool"), 300_000)
    rows = tables.supplier(row_numbers(spark, 1, 10_000), pool)
    marked = rows.filter(F.col("s_comment").rlike("Customer .*(Complaints|Recommends)"))
    # ten draws of 10,000 mark a supplier
    assert 1 <= marked.count() <= 25


def test_chunks_make_up_the_table(spark):
    scale = Scale.of(0.001)
    whole = tables.lineitem(row_numbers(spark, 1, scale.orders), scale)
    for chunks in (1, 2, 3, 7, 16):
        bounds = [chunk_bounds(scale.orders, chunks, c) for c in range(1, chunks + 1)]
        assert bounds[0][0] == 1 and bounds[-1][1] == scale.orders
        assert all(a[1] + 1 == b[0] for a, b in zip(bounds, bounds[1:]))
    made = None
    for c in range(1, 8):
        part = tables.lineitem(row_numbers(spark, *chunk_bounds(scale.orders, 7, c)), scale)
        made = part if made is None else made.unionByName(part)
    assert made.exceptAll(whole).count() == 0 and whole.exceptAll(made).count() == 0


def test_scale_counts():
    assert Scale.of(1) == Scale(200_000, 10_000, 150_000, 1_500_000, 1000)
    assert Scale.of(30).clerks == 30_000
    assert Scale.of(0.01) == Scale(2000, 100, 1500, 15_000, 1000)


def test_refresh_keys_are_new(spark):
    scale = Scale.of(0.01)
    sets = spark.range(1, 6).withColumnRenamed("id", "set_number")
    rows = refresh.set_rows(sets, scale)
    new = refresh.new_orders(rows, scale)
    base = tables.orders(row_numbers(spark, 1, scale.orders), scale)
    assert new.count() == 5 * refresh.orders_per_set(scale) == 50
    assert new.select("o_orderkey").distinct().count() == 50
    assert new.join(base, "o_orderkey", "left_semi").count() == 0
    deleted = refresh.deleted_keys(rows)
    assert deleted.join(base, "o_orderkey", "left_semi").count() == 50


def test_segments(spark):
    rows = spark.range(11).withColumnRenamed("id", "position")
    got = rows.select(refresh.insert_segment(F.col("position"), 11, 4).cast("int").alias("i"),
                      refresh.delete_segment(F.col("position"), 11, 4).cast("int").alias("d")).collect()
    assert [r.i for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    assert [r.d for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]


def brute_parameters(seed):
    state, streams = seed, {}
    for query in range(1, 23):
        state = state * A % P
        streams[query] = Stream(state)
    regions, key = {}, 0
    for name, step in words.NATION_STEPS:
        key += step
        regions[name] = words.REGIONS[key]

    def other(stream, names, first):
        while (second := stream.pick(names)) == first:
            pass
        return second

    def month(months):
        return f"{1993 + months // 12}-{months % 12 + 1:02d}-01"

    def shuffled(stream, values):
        for i in range(len(values)):
            j = stream.uniform(i, len(values) - 1)
            values[i], values[j] = values[j], values[i]
        return values

    out = {}
    s = streams
    out[1] = [s[1].uniform(60, 120)]
    out[2] = [s[2].uniform(1, 50), s[2].pick(words.PART_TYPES).split()[-1], s[2].pick(words.REGIONS)]
    out[3] = [s[3].pick(words.SEGMENTS), f"1995-03-{s[3].uniform(0, 30) + 1:02d}"]
    out[4] = [month(s[4].uniform(1, 58))]
    out[5] = [s[5].pick(words.REGIONS), f"19{s[5].uniform(93, 97)}-01-01"]
    out[6] = [f"19{s[6].uniform(93, 97)}-01-01", f"0.0{s[6].uniform(2, 9)}", s[6].uniform(24, 25)]
    first = s[7].pick(words.NATIONS)
    out[7] = [first, other(s[7], words.NATIONS, first)]
    nation = s[8].pick(words.NATIONS)
    out[8] = [nation, regions[nation], s[8].pick(words.PART_TYPES)]
    out[9] = [s[9].pick(words.COLOURS)]
    out[10] = [month(s[10].uniform(1, 24))]
    out[11] = [s[11].pick(words.NATIONS), "0.0001000000"]
    first = s[12].pick(words.SHIP_MODES)
    out[12] = [first, other(s[12], words.SHIP_MODES, first), f"19{s[12].uniform(93, 97)}-01-01"]
    out[13] = [s[13].pick(words.QUERY_ADJECTIVES), s[13].pick(words.QUERY_NOUNS)]
    out[14] = [month(s[14].uniform(0, 59))]
    out[15] = [month(s[15].uniform(0, 57))]
    brand = f"Brand#{s[16].uniform(1, 5)}{s[16].uniform(1, 5)}"
    kind = s[16].pick(words.PART_TYPES).rsplit(" ", 1)[0]
    out[16] = [brand, kind] + shuffled(s[16], list(range(1, 51)))[:8]
    out[17] = [f"Brand#{s[17].uniform(1, 5)}{s[17].uniform(1, 5)}", s[17].pick(words.CONTAINERS)]
    out[18] = [s[18].uniform(312, 315)]
    out[19] = [f"Brand#{s[19].uniform(1, 5)}{s[19].uniform(1, 5)}" for _ in range(3)] + [
        s[19].uniform(1, 10), s[19].uniform(10, 20), s[19].uniform(20, 30)]
    out[20] = [s[20].pick(words.COLOURS), f"19{s[20].uniform(93, 97)}-01-01", s[20].pick(words.NATIONS)]
    out[21] = [s[21].pick(words.NATIONS)]
    out[22] = [10 + c for c in shuffled(s[22], list(range(10, 35)))[:7]]
    return {q: [str(v) for v in values] for q, values in out.items()}


def test_parameters(spark):
    seeds = [1, 2, 99, 20_000, 19980401, 2147483000]
    rows = parameters.query_parameters(
        spark.createDataFrame([(s,) for s in seeds], "seed bigint")).collect()
    got = {(r.seed, r.query): list(r.parameters) for r in rows}
    assert len(got) == 22 * len(seeds)
    for seed in seeds:
        for query, expected in brute_parameters(seed).items():
            assert got[seed, query] == expected, (seed, query)


def test_registered_order_has_all_streams(star):
    got = {}
    for r in generator_runs.gen_query_order(star).distinct().collect():
        got.setdefault(r.stream, []).append((r.position, r.query))
    assert sorted(got) == list(range(41))
    orders = {k: tuple(q for _, q in sorted(v)) for k, v in got.items()}
    assert all(sorted(o) == list(range(1, 23)) for o in orders.values()) and len(set(orders.values())) == 41
    assert orders[5][:4] == (21, 15, 4, 6) and orders[40][-4:] == (10, 12, 5, 19)


def test_query_orders_are_permutations(spark):
    rows = parameters.query_order(spark.range(5).withColumnRenamed("id", "stream")).collect()
    by_stream = {}
    for r in rows:
        by_stream.setdefault(r.stream, []).append((r.position, r.query))
    assert all(sorted(q for _, q in v) == list(range(1, 23)) for v in by_stream.values())
    assert [q for _, q in sorted(by_stream[0])][:3] == [14, 2, 9]
    assert len(by_stream) == 5
