"""Constraint checks that return the violating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.operators.joins import without_match
from starmill.sources.star import Star

# Child table and column, parent table and column.
FOREIGN_KEYS = [
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("partsupp", ["ps_suppkey"], "supplier", ["s_suppkey"]),
    ("partsupp", ["ps_partkey"], "part", ["p_partkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("lineitem", ["l_partkey", "l_suppkey"], "partsupp", ["ps_partkey", "ps_suppkey"]),
]

PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "part": ["p_partkey"],
    "supplier": ["s_suppkey"], "partsupp": ["ps_partkey", "ps_suppkey"],
    "customer": ["c_custkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
}


def primary_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their number of rows."""
    has_null = F.lit(False)
    for name in key:
        has_null = has_null | F.col(name).isNull()
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | has_null)


def foreign_key(child: DataFrame, columns: list[str], parent: DataFrame,
                parent_columns: list[str]) -> DataFrame:
    """Distinct child keys without a parent, with their rows. A null key passes.

    The child is counted per key first, so a key with very many rows joins once.
    """
    present = F.lit(True)
    for name in columns:
        present = present & F.col(name).isNotNull()
    counted = child.filter(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return without_match(counted, parent, dict(zip(columns, parent_columns)))


def check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return df.filter(~condition)


def fill_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of nulls per column that must not have any."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "nulls")


def referencing_insert(rows: DataFrame, key: str, parent: DataFrame, parent_key: str, condition: Column) -> DataFrame:
    """``rows`` with ``outcome``: inserted, or the constraint that refuses the row, the check before the key.

    An unknown condition and a null key pass. Parents are made distinct before the join, so
    a parent that repeats adds no rows.
    """
    parents = parent.select(F.col(parent_key).alias("_parent")).distinct().withColumn("_known", F.lit(True))
    refused = F.when(~condition, "check").when(F.col(key).isNotNull() & F.col("_known").isNull(), "foreign key")
    return rows.join(parents, F.col(key) == F.col("_parent"), "left").withColumn(
        "outcome", refused.otherwise("inserted")).drop("_parent", "_known")


def _tags(df: DataFrame, tags: list[tuple[int, bool, list[str]]]) -> DataFrame:
    """(number, one, two, n, parent): per row and tag, a constraint's key as child or as parent.

    Rows are summed per key within a task before they are sent; a child with a null key is
    not sent.
    """
    made = [F.struct(
        F.lit(number).alias("number"), F.col(columns[0]).cast("bigint").alias("one"),
        (F.col(columns[1]) if len(columns) > 1 else F.lit(0)).cast("bigint").alias("two"),
        F.lit(0 if parent else 1).cast("bigint").alias("n"), F.lit(parent).alias("parent"))
        for number, parent, columns in tags]
    return df.select(F.explode(F.array(*made)).alias("t")).select("t.*").filter("one is not null and two is not null")


def _merged(tags: DataFrame) -> DataFrame:
    return tags.groupBy("number", "one", "two").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"))


def star_foreign_keys(star: Star) -> DataFrame:
    """Orphans of every foreign key of the star schema, each stored table read once.

    Every table sends its keys, tagged by constraint and side, to one grouped sum, which
    sees for each key whether it has children and a parent. Where ``partsupp`` is not stored
    but follows from the lines, its rows are the distinct keys that the lines sent.
    """
    tags: dict[str, list[tuple[int, bool, list[str]]]] = {}
    own = {number: FOREIGN_KEYS[number] for number in range(len(FOREIGN_KEYS))}
    for number, (child, columns, parent, parent_columns) in own.items():
        tags.setdefault(child, []).append((number, False, columns))
        tags.setdefault(parent, []).append((number, True, parent_columns))
    derived = tags.pop("partsupp") if not star.has_partsupp else []
    sent = None
    for table, wanted in tags.items():
        rows = _tags(getattr(star, table), wanted)
        sent = rows if sent is None else sent.unionByName(rows)
    keys = _merged(sent)
    if derived:
        line, = (number for number, (child, _, parent, _) in own.items() if (child, parent) == ("lineitem", "partsupp"))
        place = {"ps_partkey": "one", "ps_suppkey": "two"}
        of_line = F.col("number") == line
        row = [F.struct(
            F.lit(number).alias("number"), F.col(place[columns[0]]).alias("one"),
            (F.col(place[columns[1]]) if len(columns) > 1 else F.lit(0).cast("bigint")).alias("two"),
            F.lit(0 if parent else 1).cast("bigint").alias("n"), F.lit(parent).alias("parent"))
            for number, parent, columns in derived]
        itself = F.struct("number", "one", "two", "n", "parent")
        keys = _merged(keys.select(F.explode(F.when(of_line, F.array(itself, *row)).otherwise(F.array(itself))).alias("t")).select("t.*"))
    orphan = F.col("n") * (~F.col("parent")).cast("bigint")
    names = F.element_at(F.array(*[F.lit(f"{c}.{'+'.join(k)}") for c, k, _, _ in FOREIGN_KEYS]), F.col("number") + 1)
    # a marker per constraint, so that one without any rows is reported as well
    markers = star.spark.range(len(FOREIGN_KEYS)).select(
        F.col("id").cast("int").alias("number"), F.lit(0).cast("bigint").alias("orphans"))
    return keys.select("number", orphan.alias("orphans")).unionByName(markers).groupBy("number").agg(
        F.count(F.when(F.col("orphans") > 0, 1)).alias("keys"), F.sum("orphans").alias("n")).select(
        names.alias("foreign_key"), "keys", "n")
