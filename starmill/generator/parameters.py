"""Substitution parameters and query orders of benchmark streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.generator import words
from starmill.generator.streams import (
    MODULUS, MULTIPLIER, expanded, long_array, word_array, pick_index, uniform)

def _draw(query: int, k: int) -> Column:
    """Draw ``k`` of a query's stream; stream q starts q steps after the seed."""
    return F.col("seed") % MODULUS * pow(MULTIPLIER, query + k, MODULUS) % MODULUS


def _draws(query: int, k: int, count: int) -> Column:
    """Draws ``k`` .. ``k + count - 1`` as an array."""
    constants = long_array([pow(MULTIPLIER, query + k + i, MODULUS) for i in range(count)])
    return F.transform(constants, lambda c: F.col("seed") % MODULUS * c % MODULUS)


def _number(query: int, k: int, low: int, high: int) -> Column:
    return uniform(_draw(query, k), low, high)


def _chosen(value: Column, weighted: list) -> Column:
    values = expanded(weighted)
    return F.get(word_array(values), (uniform(value, 1, len(values)) - 1).cast("int"))


def _word(query: int, k: int, weighted: list) -> Column:
    return _chosen(_draw(query, k), weighted)


# Second choices that must differ from the first, by query: the words and the draw of the second one.
_OTHERS = {7: (words.NATIONS, 2), 12: (words.SHIP_MODES, 2)}


def _redrawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per seed and query of ``_OTHERS``: the first draw from the second one on that chooses
    another word than the draw before it, however many that takes, and the draw that follows."""
    def choice(draws: np.ndarray, size: int) -> np.ndarray:
        return (draws / float(MODULUS) * size).astype(np.int64)

    for batch in batches:
        seed = np.fmod(batch.column("seed").to_numpy(), MODULUS)
        made, names = [batch.column("seed")], ["seed"]
        for query, (listed, k) in _OTHERS.items():
            first = choice(seed * pow(MULTIPLIER, query + k - 1, MODULUS) % MODULUS, len(listed))
            draws = seed * pow(MULTIPLIER, query + k, MODULUS) % MODULUS
            # a zero seed draws nothing but zeros, so its choices can't differ
            pending = np.flatnonzero((choice(draws, len(listed)) == first) & (seed != 0))
            while len(pending):
                draws[pending] = draws[pending] * MULTIPLIER % MODULUS
                pending = pending[choice(draws[pending], len(listed)) == first[pending]]
            made += [pa.array(draws), pa.array(draws * MULTIPLIER % MODULUS)]
            names += [f"other{query}", f"next{query}"]
        yield pa.RecordBatch.from_arrays(made, names=names)


def _other_word(query: int) -> Column:
    return _chosen(F.col(f"other{query}"), _OTHERS[query][0])


def _month(months: Column) -> Column:
    """First day of the month ``months`` after January 1993."""
    return F.date_format(F.add_months(F.lit("1993-01-01").cast("date"), months.cast("int")),
                         "yyyy-MM-dd")


def _year(number: Column) -> Column:
    return F.concat(F.lit("19"), number.cast("string"), F.lit("-01-01"))


def _january(query: int, k: int) -> Column:
    return _year(_number(query, k, 93, 97))


def _brand(query: int, k: int) -> Column:
    return F.concat(F.lit("Brand#"), _number(query, k, 1, 5).cast("string"),
                    _number(query, k + 1, 1, 5).cast("string"))


def _shuffled(query: int, k: int, size: int, taken: int, first_value: int) -> Column:
    """First ``taken`` of the values first_value.. after a shuffle of ``size`` of them.

    Step i of the shuffle settles place i, so the steps beyond ``taken`` do not matter.
    """
    swaps = F.transform(
        _draws(query, k, taken),
        lambda value, place: F.struct(
            place.alias("place"),
            uniform(value, place, F.lit(size - 1)).cast("int").alias("source")))
    values = F.sequence(F.lit(first_value), F.lit(first_value + size - 1))

    def swap(held: Column, step: Column) -> Column:
        return F.transform(held, lambda value, at: F.when(
            at == step["place"], F.get(held, step["source"])
        ).when(at == step["source"], F.get(held, step["place"])).otherwise(value))

    return F.transform(F.slice(F.aggregate(swaps, values, swap), 1, taken),
                       lambda v: v.cast("string"))


def _texts(*columns: Column) -> Column:
    return F.array(*[c.cast("string") for c in columns])


def _by_query(factor: float) -> dict[int, Column]:
    regions_of_nations, key = [], 0
    for _, step in words.NATION_STEPS:
        key += step
        regions_of_nations.append(words.REGIONS[key])
    nation8 = pick_index(_draw(8, 1), len(words.NATIONS)).cast("int")
    modes = words.SHIP_MODES
    return {
        1: _texts(_number(1, 1, 60, 120)),
        2: _texts(_number(2, 1, 1, 50),
                  F.substring_index(_word(2, 2, words.PART_TYPES), " ", -1),
                  _word(2, 3, words.REGIONS)),
        3: _texts(_word(3, 1, words.SEGMENTS),
                  F.date_add(F.lit("1995-03-01").cast("date"), _number(3, 2, 0, 30).cast("int"))),
        4: _texts(_month(_number(4, 1, 1, 58))),
        5: _texts(_word(5, 1, words.REGIONS), _january(5, 2)),
        6: _texts(_january(6, 1), F.concat(F.lit("0.0"), _number(6, 2, 2, 9).cast("string")),
                  _number(6, 3, 24, 25)),
        7: _texts(_word(7, 1, words.NATIONS), _other_word(7)),
        8: _texts(F.get(word_array(words.NATIONS), nation8),
                  F.get(word_array(regions_of_nations), nation8),
                  _word(8, 2, words.PART_TYPES)),
        9: _texts(_word(9, 1, words.COLOURS)),
        10: _texts(_month(_number(10, 1, 1, 24))),
        11: _texts(_word(11, 1, words.NATIONS), F.lit(f"{0.0001 / factor:11.10f}")),
        12: _texts(_word(12, 1, modes), _other_word(12),
                   _year(uniform(F.col("next12"), 93, 97))),  # however many draws the second mode took
        13: _texts(_word(13, 1, words.QUERY_ADJECTIVES), _word(13, 2, words.QUERY_NOUNS)),
        14: _texts(_month(_number(14, 1, 0, 59))),
        15: _texts(_month(_number(15, 1, 0, 57))),
        16: F.concat(
            _texts(_brand(16, 1), F.substring_index(_word(16, 3, words.PART_TYPES), " ", 2)),
            _shuffled(16, 4, 50, 8, 1)),
        17: _texts(_brand(17, 1), _word(17, 3, words.CONTAINERS)),
        18: _texts(_number(18, 1, 312, 315)),
        19: _texts(_brand(19, 1), _brand(19, 3), _brand(19, 5), _number(19, 7, 1, 10),
                   _number(19, 8, 10, 20), _number(19, 9, 20, 30)),
        20: _texts(_word(20, 1, words.COLOURS), _january(20, 2), _word(20, 3, words.NATIONS)),
        21: _texts(_word(21, 1, words.NATIONS)),
        # The listed codes already start at ten, and ten is added once more.
        22: _shuffled(22, 1, 25, 7, 20),
    }


def query_parameters(seeds: DataFrame, factor: float = 1.0) -> DataFrame:
    """Parameters of the 22 queries for every ``seed``."""
    rows = F.array(*[
        F.struct(F.lit(query).alias("query"), parameters.alias("parameters"))
        for query, parameters in _by_query(factor).items()])
    drawn = seeds.select(F.col("seed").cast("bigint").alias("seed")).mapInArrow(
        _redrawn, "seed bigint, other7 bigint, next7 bigint, other12 bigint, next12 bigint")
    return drawn.select("seed", F.explode(rows).alias("row")).select("seed", "row.*")


def query_order(streams: DataFrame,
                orders: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Queries of every ``stream`` in order; a stream beyond the table is an error.

    The orders are those of ``query_orders.csv``; pass a longer table to run more streams.
    """
    table = F.array(*[F.array(*[F.lit(q) for q in row]) for row in orders or words.QUERY_ORDERS])
    length = len(orders or words.QUERY_ORDERS)
    return streams.select(
        "stream",
        F.posexplode(F.when(F.col("stream") < length, F.get(table, F.col("stream").cast("int"))).otherwise(
            F.raise_error(F.lit(f"there are orders for {length} streams only")).cast("array<int>"))).alias("at", "query"),
    ).select("stream", (F.col("at") + 1).alias("position"), "query")
