"""Exact top-k by inner product with a dual cover tree.

A cover tree is fitted on a bounded sample (``FIT`` rows, drawn by a hash of the id): nets of
halving radius, every centre within a net's radius of its parent, up to ``LEAVES`` leaf
centres. Every row, queries and candidates alike, goes to its nearest leaf, so leaves cover
all rows; covering radii are maxima over all rows.

For a query leaf and a candidate leaf, no inner product exceeds

    <q, c> + rq |c| + rc |q| + rq rc

(centres q, c, covering radii rq, rc). Each query's k-th score among the sample is a floor,
and a query node's floor is its worst. Both trees are descended together from their roots;
node pairs whose bound lies below the floor are pruned with all that is beneath. What is
left is compared in blocks: leaves are cut or packed into blocks of bounded size (a leaf
that holds much of the data is cut by a hash), pairs of blocks are tasks, and within a task
leaf pairs are pruned again as k-th scores rise, best bounds first.

Scores are exact integers: components become floor(256 x). Vectors that are null or hold null
or non-finite components, and rows without an id, take no part. Shorter vectors are filled
with zeros. Rows that repeat an id are candidates of their own, but no row is a candidate of
a query with its id; a repeated query is one query. Scores must stay below 2^63.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmill.llm.stored import stored

FIT, LEAVES, BLOCK, QUERIES = 2048, 192, 2048, 1024
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


@dataclass
class Tree:
    centres: np.ndarray  # all nodes; nets are prefixes, since each net holds the one above
    nets: list[int]  # sizes of the nets, the last one being the leaves
    parents: list[np.ndarray]  # per net but the first: the parent of each of its nodes


def build(sample: np.ndarray, leaves: int = LEAVES) -> Tree:
    """Nets of halving radius over the rows of ``sample``, which must not be empty."""
    distance = np.linalg.norm(sample - sample[0], axis=1)
    chosen, nets, parents, radius = [0], [1], [], distance.max()
    while len(chosen) < leaves and radius > 0.5:
        radius /= 2
        above = len(chosen)
        while len(chosen) < leaves and distance.max() > radius:  # the farthest row is not covered yet
            k = int(distance.argmax())
            chosen.append(k)
            distance = np.minimum(distance, np.linalg.norm(sample - sample[k], axis=1))
        if len(chosen) > above:
            gaps = np.linalg.norm(sample[chosen][:, None] - sample[chosen[:above]][None], axis=2)
            parents.append(gaps.argmin(1))
            nets.append(len(chosen))
    return Tree(sample[chosen].astype(float), nets, parents)


def _bounds(q: np.ndarray, rq: np.ndarray, c: np.ndarray, rc: np.ndarray) -> np.ndarray:
    """Largest inner product that rows of each pair of nodes can have, rounding included."""
    made = q @ c.T + np.outer(rq, np.linalg.norm(c, axis=1)) + np.outer(np.linalg.norm(q, axis=1), rc) + np.outer(rq, rc)
    return made + 1e-9 * np.abs(made) + 1e-6


def surviving(tree: Tree, rq: np.ndarray, rc: np.ndarray, floor: np.ndarray) -> list[tuple[int, int]]:
    """Leaf pairs left by descending both trees; radii are -inf for empty leaves, floors the worst k-th scores."""
    levels = [(rq, rc, floor)]
    for net in range(len(tree.nets) - 1, 0, -1):
        below, parent, n = levels[0], tree.parents[net - 1], tree.nets[net - 1]
        gap = np.linalg.norm(tree.centres[: tree.nets[net]] - tree.centres[parent], axis=1)
        up = [np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, np.inf)]
        np.maximum.at(up[0], parent, below[0] + gap)
        np.maximum.at(up[1], parent, below[1] + gap)
        np.minimum.at(up[2], parent, below[2])
        levels.insert(0, tuple(up))
    pairs = np.zeros((1, 2), int)
    for net, (q, c, least) in enumerate(levels):
        if net:
            parent = tree.parents[net - 1]
            kids = [np.flatnonzero(parent == k) for k in range(tree.nets[net - 1])]
            pairs = np.array([(x, y) for a, b in pairs.tolist() for x in kids[a] for y in kids[b]], int).reshape(-1, 2)
        a, b = pairs[:, 0], pairs[:, 1]
        there = np.isfinite(q[a]) & np.isfinite(c[b])
        a, b = a[there], b[there]
        centres = tree.centres[: tree.nets[net]]
        bound = _bounds(centres, np.where(np.isfinite(q), q, 0), centres, np.where(np.isfinite(c), c, 0))[a, b]
        keep = bound >= least[a]
        pairs = np.column_stack((a[keep], b[keep]))
    return [tuple(p) for p in pairs.tolist()]


def _stack(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles (64-bit integers where doubles would round)."""
    flat, at = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum([len(x) for x in column]))).astype(int)
    made = np.zeros((len(column), width), np.int64)
    size = np.diff(at)
    made[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return made if len(flat) and width * float(np.abs(flat).max()) ** 2 >= 2 ** 52 else made.astype(float)


def _assign(tree: Tree, sample: np.ndarray, ids: np.ndarray, width: int, k: int):
    def assign(batches):
        leaves = tree.centres
        norms = (leaves ** 2).sum(1)
        for batch in batches:
            x = _stack(batch.column("vector"), width).astype(float)
            leaf = (norms - 2 * x @ leaves.T).argmin(1)
            away = np.linalg.norm(x - leaves[leaf], axis=1)
            own = batch.column("vec_id").to_numpy()
            floor = np.full(len(x), -np.inf)
            asked = np.flatnonzero(batch.column("query").to_numpy(zero_copy_only=False))
            if len(asked) and len(ids) > k:
                score = x[asked] @ sample.T.astype(float)
                score[own[asked][:, None] == ids[None]] = -np.inf
                floor[asked] = np.partition(score, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), batch.column("query"), pa.array(leaf.astype(np.int32)),
                 pa.array(away), pa.array(floor)], names=["vec_id", "vector", "query", "leaf", "away", "floor"])

    return assign


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - first < k]


def _compare(tree: Tree, radii: np.ndarray, width: int, k: int):
    def compare(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        x, y = (_stack(t.column(c).combine_chunks(), width) for t, c in ((candidates, "vector"), (queries, "q_vector")))
        if x.dtype != y.dtype:
            x, y = x.astype(np.int64), y.astype(np.int64)
        ids, own = candidates.column("vec_id").to_numpy(), queries.column("q_vec_id").to_numpy()
        leaf, group = candidates.column("leaf").to_numpy(), queries.column("q_leaf").to_numpy()
        floors = queries.column("q_floor").to_numpy()
        found = [np.zeros(0, np.int64)] * 3  # query row, score, id
        for g in np.unique(group).tolist():
            mine = np.flatnonzero(group == g)
            centre = tree.centres[g]
            spread = np.linalg.norm(y[mine].astype(float) - centre, axis=1).max(keepdims=True)
            here = np.unique(leaf)
            bounds = _bounds(centre[None], spread, tree.centres[here], radii[here])[0]
            worst, rows, scores, names = floors[mine], *([np.zeros(0, np.int64)] * 3)
            for at in np.argsort(-bounds).tolist():
                if len(mine) and bounds[at] < worst.min():
                    break  # bounds only fall from here on
                other = np.flatnonzero(leaf == here[at])
                score = y[mine] @ x[other].T
                most = np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf
                score[own[mine][:, None] == ids[other][None]] = most
                least = np.partition(score, -k, axis=1)[:, -k] if len(other) > k else np.full(len(mine), most)
                row, col = np.nonzero((score >= np.maximum(least, worst)[:, None]) & (score > most))
                rows, scores, names = (np.concatenate(z) for z in (
                    (rows, row), (scores, score[row, col].astype(np.int64)), (names, ids[other][col])))
                keep = _best(rows, scores, names, k)
                rows, scores, names = rows[keep], scores[keep], names[keep]
                full = np.bincount(rows, minlength=len(mine)) >= k
                low = np.full(len(mine), np.inf)
                np.minimum.at(low, rows, scores.astype(float))
                worst = np.where(full, np.maximum(worst, low), worst)
            found = [np.concatenate(z) for z in zip(found, (mine[rows], scores, names), strict=True)]
        return pa.table({"query_id": own[found[0]], "digest": queries.column("q_digest").to_numpy()[found[0]],
                         "vec_id": found[2], "score": found[1]})

    return compare


def _laid_out(counts: dict[int, int], block: int) -> list[tuple[int, int, int]]:
    """(leaf, first block, number of blocks): large leaves are cut, small ones packed in order."""
    made, next_block, room = [], 0, 0
    for leaf, n in sorted(counts.items()):
        if n >= block:
            next_block += room > 0
            made.append((leaf, next_block, -(-n // block)))
            next_block, room = next_block + -(-n // block), 0
        else:
            if room + n > block:
                next_block, room = next_block + 1, 0
            made.append((leaf, next_block, 1))
            room += n
    return made


def _in_blocks(rows: DataFrame, counts: dict[int, int], block: int, name: str) -> DataFrame:
    # one row per leaf: at most LEAVES
    layout = rows.sparkSession.createDataFrame(_laid_out(counts, block), "leaf int, first int, cuts int")
    return rows.join(F.broadcast(layout), "leaf").withColumn(
        name, F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("cuts"))).drop("first", "cuts")


def search(table: DataFrame, query: Column, k: int = 5, vector_column: str = "embedding") -> DataFrame:
    """The k best candidates of each row for which ``query`` holds: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    number = F.transform(vector_column, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    sound = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = stored(table.where(F.col("vec_id").isNotNull() & F.col(vector_column).isNotNull() & sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), number.alias("vector"), F.coalesce(query, F.lit(False)).alias("query")), "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        width = 1
    drawn = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(FIT).select("vec_id", "vector").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], RESULT)
    sample, ids = _stack(drawn.column("vector").combine_chunks(), width), drawn.column("vec_id").to_numpy()
    tree = build(sample.astype(float))
    placed = stored(rows.mapInArrow(
        _assign(tree, sample, ids, width, k),
        "vec_id bigint, vector array<bigint>, query boolean, leaf int, away double, floor double"), "placed")
    leaves = placed.groupBy("leaf").agg(
        F.count("*").alias("n"), F.max("away").alias("radius"), F.sum(F.col("query").cast("int")).alias("asked"),
        F.max(F.when(F.col("query"), F.col("away"))).alias("spread"),
        F.min(F.when(F.col("query"), F.col("floor"))).alias("floor")).collect()  # at most LEAVES rows
    n = len(tree.centres)
    radius, spread, floor = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, np.inf)
    for r in leaves:
        radius[r["leaf"]] = r["radius"]
        if r["asked"]:
            spread[r["leaf"]], floor[r["leaf"]] = r["spread"], r["floor"]
    pairs = surviving(tree, spread, radius, floor)
    if not pairs:
        return spark.createDataFrame([], RESULT)
    near = spark.createDataFrame(pairs, "query_leaf int, leaf int")
    candidates = _in_blocks(placed.select("vec_id", "vector", "leaf"), {r["leaf"]: r["n"] for r in leaves}, BLOCK, "block")
    queries = _in_blocks(
        placed.where("query").select("vec_id", "vector", "leaf", "floor", F.xxhash64("vector").alias("digest")).dropDuplicates(
            ["vec_id", "digest"]), {r["leaf"]: r["asked"] for r in leaves if r["asked"]}, QUERIES, "query_block")
    asked = queries.select(F.col("leaf").alias("query_leaf"), "query_block").distinct()
    there = candidates.select("leaf", "block").distinct()
    tasks = asked.join(near, "query_leaf").join(there, "leaf").select("query_block", "block").distinct()
    left = candidates.join(tasks, "block").groupBy("block", "query_block")
    asking = queries.join(tasks, "query_block")
    right = asking.select(*(F.col(c).alias(f"q_{c}") for c in asking.columns)).groupBy("q_block", "q_query_block")
    found = left.cogroup(right).applyInArrow(
        _compare(tree, np.where(np.isfinite(radius), radius, 0), width, k), "query_id bigint, digest bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "digest").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
