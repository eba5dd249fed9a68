"""Connected components by hooking and pointer jumping, all in joins and grouped minima.

Every round joins the edges with their ends' grandparents, takes minima per node (with
map-side sums, so a node with very many edges is one row per task) and hooks parents to
smaller ones. Rounds follow the logarithm of the longest path. Each round is written to
the shared folder; earlier rounds are deleted.

A round is one query, which also counts what it changed: the driver holds threads and memory for
each query and each exchange of the last minute. Minima are grouped, not joined back to their nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from starmill.llm.stored import drop, stored_at


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (columns a, b).

    Nodes are those with an edge. Loops, repeated edges and either direction are fine;
    rows with a null end are ignored. No edge: no row. Raises if ``rounds`` do not
    suffice, instead of returning wrong components.
    """
    spark = edges.sparkSession
    known = edges.where("a is not null and b is not null")
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both, both_at = stored_at(known.select(ends.alias("end")).select("end.a", "end.b").distinct(), "edges")
    parent, parent_at = stored_at(
        both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("f")), "parents")
    for _ in range(rounds):
        up = parent.select(F.col("u").alias("f"), F.col("f").alias("g"))
        grand = parent.join(up, "f").select("u", "f", F.col("g").alias("m"))
        near = both.join(grand.select(F.col("u").alias("b"), "m"), "b").select(
            F.col("a").alias("u"), F.lit(None).cast(dict(parent.dtypes)["f"]).alias("f"), "m")
        offered = grand.unionByName(near).groupBy("u").agg(F.min("f").alias("f"), F.min("m").alias("m"))
        # a grandparent is never larger than a parent, so what is offered replaces the node's parent and the parent's own
        hooked = F.explode(F.array(F.struct("u", F.col("f").alias("was"), "m"), F.struct(
            F.col("f").alias("u"), F.lit(None).cast(dict(parent.dtypes)["f"]).alias("was"), "m")))
        after = offered.select(hooked.alias("hook")).groupBy(F.col("hook.u").alias("u")).agg(
            F.min("hook.was").alias("was"), F.min("hook.m").alias("f"))
        seen = Observation()
        after, after_at = stored_at(after.observe(seen, F.count(F.when(F.col("f") != F.col("was"), 1)).alias("changed")), "parents")
        changed = seen.get["changed"]
        drop(spark, parent_at)
        parent, parent_at = after.select("u", "f"), after_at
        if not changed:
            drop(spark, both_at)
            return parent.select(F.col("u").alias("node"), F.col("f").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
