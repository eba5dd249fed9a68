"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters, digits and characters beyond ASCII, lower-cased; a shingle is
``k`` of them in a row (an item with fewer words is one shingle as a whole). A shingle
weighs the log of how rare it is among the items, in quarters; one that no item has weighs
most. Weights are integers, so similarities are exact.

1. A window that is similar to an item shares a shingle with it. Each shared shingle proposes
   a start: its place in the document less its place in the item. A window has as many
   shingles as the item; starts between proposed ones that lie close (words were put in or
   left out) are windows too.
2. Windows and items get 64-bit SimHash fingerprints of their weighted shingles.
3. Multi-index search: with ``BLOCKS`` blocks, two fingerprints within ``RADIUS`` bits have a
   block in which they differ by ``RADIUS // BLOCKS`` bits at most, so joining the blocks with
   all such neighbours of the items' blocks finds every pair within the radius. With 4 blocks
   of 16 bits and a radius of 11 an item has 137 neighbours a block, and 0.8 % of unrelated
   pairs meet. A pair at the threshold is about 10 bits apart, deviation 3; most lie within the
   radius, and those that don't are found by
   weight: a similar window shares the threshold's part of the item's weight, so it has one of
   the item's rarest shingles whose weights just exceed the rest. Pairs that share one, with
   totals that allow the threshold, are passed on whatever their distance.
4. The weighted similarity of the pair's shingle counts, sum of minima by sum of maxima,
   decides.

All steps are DataFrame functions. Item tables are broadcast if a count shows them below
``SMALL`` rows, else joined by shuffles. Null and empty texts have no windows. A document is
an id with a text: repeated rows are one, rows without an id count as one id.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmill.llm.stored import stored

SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RADIUS, BLOCKS, SMALL = 11, 4, 1_000_000
NO_ID = -(1 << 63)
KEY = ["id", "digest"]
SPAN = [*KEY, "start", "size"]


def _words(text_column: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text_column), F.lit(""))), SIGNS), "")


def _shingles(words: str, k: int) -> Column:
    """Hash of the k words from each place on; no array element for texts that are shorter."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _bounded(table: DataFrame, rows: int) -> DataFrame:
    """The table, broadcast if its counted rows are few."""
    return F.broadcast(table) if rows <= SMALL else table


def _keyed(docs: DataFrame, text_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(text_column).alias("digest"), F.col(text_column).alias("text"))


def fingerprint(shingles: DataFrame, by: list[str]) -> DataFrame:
    """SimHash of groups of rows ``h``, ``times``, ``weight``: (by, print, whole)."""
    value = "times * weight"
    sums = [F.expr(f"sum(if(shiftright(h, {b}) & 1 = 1, {value}, 0)) as bit{b}") for b in range(64)]
    made = " | ".join(f"if(bit{b} * 2 >= whole, shiftleft(1L, {b}), 0L)" for b in range(64))
    return shingles.groupBy(*by).agg(F.expr(f"sum({value}) as whole"), *sums).select(*by, F.expr(f"{made} as print"), "whole")


def _widths() -> list[int]:
    return [64 // BLOCKS + (b >= BLOCKS - 64 % BLOCKS) for b in range(BLOCKS)]


def _masks(near: bool) -> Column:
    """Block, shift, bits of the block, and what to flip: nothing, or up to the bits of a near one.

    A constant array, so the plan holds one value and not an expression per mask.
    """
    made, at = [], 0
    for b, width in enumerate(_widths()):
        for n in range(RADIUS // BLOCKS + 1 if near else 1):
            made += [f"named_struct('block', {b}, 'at', {at}, 'bits', {(1 << width) - 1}L, 'flip', {sum(1 << x for x in bits)}L)"
                     for bits in combinations(range(width), n)]
        at += width
    return F.expr(f"explode(array({', '.join(made)}))")


_VALUE = "((shiftrightunsigned(print, mask.at) & mask.bits) ^ mask.flip) as value"


def within_radius(windows: DataFrame, items: DataFrame, items_rows: int) -> DataFrame:
    """Pairs of rows of ``windows`` and ``items`` (print each) within the radius, with ``distance``."""
    one = windows.withColumn("mask", _masks(False)).select("*", "mask.block", F.expr(_VALUE)).drop("mask")
    two = items.withColumn("mask", _masks(True)).select("item", F.col("print").alias("other"), "mask.block", F.expr(_VALUE))
    variants = sum(len(list(combinations(range(w), n))) for w in _widths() for n in range(RADIUS // BLOCKS + 1))
    pairs = one.join(_bounded(two, items_rows * variants), ["block", "value"])
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= RADIUS).drop(
        "block", "value", "print", "other").distinct()


def _by_weight(weighed: DataFrame, of_items: DataFrame, percent: int, items_rows: int) -> DataFrame:
    """(SPAN, item) that share one of the item's rarest shingles; all similar pairs do."""
    rarest = Window.partitionBy("item").orderBy(F.desc("weight"), "h")
    heavy = F.col("times") * F.col("weight")
    before = F.sum(heavy).over(rarest) - heavy
    needed = of_items.withColumns({"before": before, "total": F.sum(heavy).over(Window.partitionBy("item"))}).where(
        F.col("before") * 100 <= F.col("total") * (100 - percent)).select("item", "h")
    return weighed.select(*SPAN, "h").join(_bounded(needed, items_rows), "h").select(*SPAN, "item").distinct()


def _found(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """Leaks of items by shingles of k words; rows SPAN, item, item_id, distance, similarity."""
    shingled = stored(items.select("item", "item_id", F.posexplode(_shingles("words", k)).alias("place", "h")), "item-shingles")
    rows, many = shingled.count(), shingled.select("item").distinct().count()
    rarity = stored(shingled.groupBy("h").agg(F.countDistinct("item").alias("n")).select(
        "h", F.round(4 * F.log(1 + F.lit(float(many)) / F.col("n"))).cast("bigint").alias("weight")), "item-weights")
    rarest = F.round(4 * F.log(F.lit(1.0 + many))).cast("bigint")
    sizes = shingled.groupBy("item").agg(F.count("*").cast("int").alias("size"))
    keyed = _keyed(docs, "text")
    places = keyed.select(*KEY, F.col("text")).select(*KEY, _words("text").alias("words")).select(
        *KEY, F.posexplode(_shingles("words", k)).alias("place", "h"))
    hits = stored(places.join(_bounded(rarity.select("h"), rows), "h", "left_semi"), "item-hits")
    offsets = shingled.join(_bounded(sizes, many), "item").select("h", F.col("place").alias("inside"), "size").distinct()
    # small tables are written, as each stage and broadcast that a query starts at once takes megabytes of the driver
    starts = stored(hits.join(_bounded(offsets, rows), "h").select(
        *KEY, "size", (F.col("place") - F.col("inside")).alias("start")).distinct(), "item-starts")
    after = F.lead("start").over(Window.partitionBy(*KEY, "size").orderBy("start"))
    last = F.when(after - F.col("start") <= F.greatest(F.col("size") / 4, F.lit(1)), after - 1).otherwise(F.col("start"))
    spread = starts.withColumn("last", last).select(*KEY, "size", F.explode(F.sequence("start", F.greatest("last", "start"))).alias("start"))
    # texts of the few documents with a hit; a text that several rows have is one
    texts = stored(keyed.join(hits.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, _words("text").alias("words")).select(*KEY, _shingles("words", k).alias("all")).dropDuplicates(KEY), "hit-texts")
    have = F.size("all")
    windows = spread.join(texts, KEY).select(
        *KEY, "all", F.least(F.greatest("start", F.lit(0)), F.greatest(have - F.col("size"), F.lit(0))).alias("start"),
        F.least("size", have).alias("size")).distinct()
    counted = windows.select(*SPAN, F.explode(F.expr("slice(all, start + 1, size)")).alias("h")).groupBy(*SPAN, "h").agg(
        F.count("*").alias("times"))
    weighed = stored(counted.join(_bounded(rarity, rows), "h", "left").withColumn("weight", F.coalesce("weight", rarest)), "windows")
    of_items = stored(shingled.groupBy("item", "item_id", "h").agg(F.count("*").alias("times")).join(rarity, "h"), "item-counts")
    item_prints = stored(fingerprint(of_items, ["item", "item_id"]).withColumnRenamed("whole", "item_whole"), "item-prints")
    prints = stored(fingerprint(weighed, SPAN), "window-prints")
    near = within_radius(prints, item_prints.select("item", "print"), many).select(*SPAN, "item")
    pairs = stored(near.union(_by_weight(weighed, of_items, percent, rows)).distinct().join(prints, SPAN).join(
        _bounded(item_prints.withColumnRenamed("print", "other"), many), "item").where(
        (F.col("whole") * 100 >= F.col("item_whole") * percent) & (F.col("item_whole") * 100 >= F.col("whole") * percent)).withColumn(
        "distance", F.bit_count(F.col("print").bitwiseXOR(F.col("other")))).drop("print", "other"), "item-pairs")
    other = of_items.select("item", "h", F.col("times").alias("item_times"))
    shared = pairs.join(weighed, SPAN).join(_bounded(other, rows), ["item", "h"]).groupBy(
        *SPAN, "item", "item_id", "distance", "whole", "item_whole").agg(
        F.sum(F.least("times", "item_times") * F.col("weight")).alias("both"))
    union = F.col("whole") + F.col("item_whole") - F.col("both")
    return shared.where(F.col("both") * 100 >= union * percent).select(
        *SPAN, "item", "item_id", "distance", (F.col("both") / union).alias("similarity"))


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, text_column: str = "text") -> DataFrame:
    """One row per document and item that it leaks, by the item's most similar window.

    doc_id, digest (of the text), item_id, similarity, distance (bits), start and size (of the
    window, in shingles). Documents without a leak have no row.
    """
    rows = docs.select("doc_id", F.col(text_column).alias("text"))
    words = items.select(F.xxhash64("item_id", text_column).alias("item"), "item_id", _words(text_column).alias("words")).where(
        "size(words) > 0").dropDuplicates(["item"])
    read = stored(words.withColumn("k", F.least(F.size("words"), F.lit(k))), "items")
    made = None
    for r in sorted(x["k"] for x in read.select("k").distinct().collect()):  # at most k rows
        part = _found(rows, read.where(F.col("k") == r), r, percent)
        made = part if made is None else made.unionByName(part)
    if made is None:
        made = _found(rows, read, k, percent)
    best = made.groupBy(*KEY, "item", "item_id").agg(F.min(F.struct(
        (-F.col("similarity")).alias("s"), "distance", "start", "size")).alias("x"))
    return best.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "digest", "item_id", (-F.col("x.s")).alias("similarity"),
        F.col("x.distance").alias("distance"), F.col("x.start").alias("start"), F.col("x.size").alias("size"))


def drop_leaks(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    found = leaks(docs, items, text_column=text_column).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("leak_id"), F.col("digest").alias("leak_digest")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == found["leak_id"]) & (
        F.xxhash64(docs[text_column]) == found["leak_digest"])
    return docs.join(found, same, "left_anti")
