"""Registered runs of the star query suite.

The parameters are chosen so that the given tables, whose names and date range
differ from generated data, give rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starmill.plans import star_suite as suite
from starmill.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]

PARAMETERS: dict[str, dict] = {
    "q01": {},
    "q02": {"type_suffix": "ECONOMY"},
    "q03": {"day": "1998-03-15"},
    "q04": {"day": "1996-07-01"},
    "q05": {"day": "1997-01-01"},
    "q06": {"day": "1997-01-01"},
    "q07": {"nation1": "NATION_6", "nation2": "NATION_9"},
    "q08": {"nation": "NATION_1", "part_type": "ECONOMY"},
    "q09": {"colour": "red"},
    "q10": {"day": "1996-10-01"},
    "q11": {"nation": "NATION_9", "fraction": 0.001},
    "q12": {"day": "1997-01-01"},
    "q13": {},
    "q14": {"day": "1997-09-01"},
    "q15": {"day": "1996-01-01"},
    "q16": {"brand": "Brand#15", "type_prefix": "MEDIUM"},
    "q17": {},
    "q18": {"quantity": 200},
    "q19": {"brand3": "Brand#14"},
    "q20": {"colour": "red", "day": "1997-01-01", "nation": "NATION_9"},
    "q21": {"nation": "NATION_9"},
    "q22": {},
}

# How the drawn parameters of a query, all texts, become arguments of its plan.
_ARGUMENTS: dict[int, list[tuple[str, Callable]]] = {
    1: [("days", int)],
    2: [("size", int), ("type_suffix", str), ("region", str)],
    3: [("segment", str), ("day", str)],
    4: [("day", str)],
    5: [("region", str), ("day", str)],
    6: [("day", str), ("discount", str), ("quantity", int)],
    7: [("nation1", str), ("nation2", str)],
    8: [("nation", str), ("region", str), ("part_type", str)],
    9: [("colour", str)],
    10: [("day", str)],
    11: [("nation", str), ("fraction", float)],
    12: [("mode1", str), ("mode2", str), ("day", str)],
    13: [("word1", str), ("word2", str)],
    14: [("day", str)],
    15: [("day", str)],
    17: [("brand", str), ("container", str)],
    18: [("quantity", int)],
    19: [("brand1", str), ("brand2", str), ("brand3", str), ("quantity1", int),
         ("quantity2", int), ("quantity3", int)],
    20: [("colour", str), ("day", str), ("nation", str)],
    21: [("nation", str)],
}


def drawn_arguments(query: int, parameters: list[str]) -> dict:
    """Arguments of a query's plan from its drawn parameters."""
    if query == 16:
        return {"brand": parameters[0], "type_prefix": parameters[1],
                "sizes": tuple(int(p) for p in parameters[2:])}
    if query == 22:
        return {"codes": tuple(parameters)}
    return {name: kind(p) for (name, kind), p in zip(_ARGUMENTS[query], parameters, strict=True)}


VARIANTS = {"q08a": "q08", "q12a": "q12", "q13a": "q13", "q14a": "q14", "q15a": "q15"}

# Row limits of the variant set run against a sharded layout.
DISTRIBUTED_LIMITS: dict[str, dict] = {
    "q01": {}, "q03": {"limit": 20}, "q05": {}, "q06": {}, "q07": {}, "q08": {},
    "q09": {"limit": 20}, "q10": {"limit": 4}, "q12": {"limit": 4}, "q14": {"limit": 4},
    "q19": {"limit": 4},
}


def _run(name: str, parameters: dict) -> Query:
    plan = getattr(suite, name)
    return lambda spark, path: plan(Star(spark, path, idle_customers=True), **parameters)


def star_queries() -> dict[str, Query]:
    out = {f"tpch_{name}": _run(name, args) for name, args in PARAMETERS.items()}
    out.update({f"tpch_{v}": _run(v, PARAMETERS[base]) for v, base in VARIANTS.items()})
    out.update({
        f"dist_{name}": _run(name, PARAMETERS[name] | limits)
        for name, limits in DISTRIBUTED_LIMITS.items()
    })
    return out
