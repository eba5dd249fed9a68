"""Mix sources to target weights along a curriculum that changes over time.

A source's target is its share of all words, at most ``most`` times its own size; what a
source cannot give is reshared by weight. The documents of a source stand in the order of a
hash of their id (then by id and size); a target of 2.3 times the size takes all of them twice and the
first 30 % a third time, the last one in part, so a source's taken words equal its rounded target.

Each source has a schedule: its weight over training time 0 to 1, piecewise linear. The
schedule's integral, scaled to the target, is the source's cumulative demand. Inverting it
at the words before a document gives that document's training time; a range sort by it is
the training order, in which ``mix`` and ``training_set`` return their rows.

Running sums are split: every source is cut into ranges of the hash that hold about
``per_range`` documents, ranges are summed (with map-side sums), and only the small table of
ranges is added up in order. No task holds a source. Rows of one source, id and size are alike
to the plan and go through it as one counted class, so of many rows that share an id, or lack
one, a range holds one class for each size. ``training_set`` orders a class by a hash of
id and text and cuts it into cells of about ``per_range`` rows, so only equal texts of one id meet.

Nulls: a null text has size 0, a null source is a source of its own that comes last, a null
id sorts first. Repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmill.llm.stored import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of one row that a task writes at a time.
COPIES = 100_000
#: Columns that rows of one class share: source (by its rank), id and size.
CLASS = ("rank", "no_id", "id", "size")
#: Weight by training time, one list of (time, weight) for each source in turn.
SCHEDULES = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)))


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a piecewise linear schedule has given ``share`` (0 to 1) of its integral."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0 or any(w < 0 for _, w in knots) or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("times must rise, weights must not be negative, and their integral must be positive")
    made, before = F.lit(float(knots[-1][0])), whole
    wanted = share * F.lit(whole)
    for (t0, w0), (t1, w1), area in reversed([*zip(knots, knots[1:], areas, strict=False)]):
        before -= area
        slope, more = (w1 - w0) / (t1 - t0), wanted - F.lit(before)
        if slope:
            step = (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * more, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        else:
            step = more / F.lit(w0) if w0 else F.lit(0.0)
        made = F.when(wanted < F.lit(before + area), F.lit(t0) + step).otherwise(made)
    return made


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, rank (from 0), weight, target.

    ``sizes`` has source and source_size, one row for each source, so its windows run over
    a table of sources, not of documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", rank.alias("rank"), weight.cast("bigint").alias("weight"))
    filling = Window.orderBy((most * F.col("source_size") / F.col("weight")), "rank")
    before, after = (filling.rowsBetween(Window.unboundedPreceding, -1),
                     filling.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumns({
        "left": F.sum("source_size").over(filling.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
        - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)),
        "share": F.sum("weight").over(after)})
    level = F.col("left").cast("double") / F.col("share").cast("double")
    free = F.col("level") * F.col("weight").cast("double") <= (most * F.col("source_size")).cast("double")
    # in this order the level rises while sources are full and falls after the first that is not
    return filled.withColumn("level", level).withColumn(
        "even", F.max(F.when(free, F.col("level"))).over(everything)).select(
        "source", "source_size", "rank", "weight",
        F.when(free, F.col("even") * F.col("weight").cast("double"))
        .otherwise((most * F.col("source_size")).cast("double")).alias("target"))


def _sized(docs: DataFrame, text_column: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(text_column).cast("string"))).alias("draw"), *more)


def _cut(digest: str, ranges: int) -> Column:
    """Number of the range that a digest falls into; even ranges of its first 32 bits keep its order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * F.lit(ranges) / F.lit(1 << 32))


def _ranges(rows: DataFrame, per_range: int) -> int:
    return max(16, min(1 << 24, rows.count() // per_range))


def _classes(sized: DataFrame) -> DataFrame:
    """Rows of one source, id and size as one row with their number."""
    return stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "classes")


def _keyed(table: DataFrame, plan: DataFrame) -> DataFrame:
    """With what the plan says of the source; the columns of CLASS are never null."""
    return table.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumns({
        "no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})


def _plan(classes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``targets`` of the sources, with the source as ``of``, the goal and the uses of whole sources."""
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("bigint")
    full = F.coalesce(F.expr("goal div nullif(source_size, 0)"), F.lit(0))
    return targets(sizes, weights, most).withColumnRenamed("source", "of").withColumn("goal", goal).withColumn("full", full)


def _placed(classes: DataFrame, plan: DataFrame, per_range: int) -> DataFrame:
    """The classes with what the plan says and ``ahead``, the words of the source before the class."""
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = _keyed(classes.withColumn("place", place), plan).withColumns({
        "words": F.col("size") * F.col("copies"), "part": _cut("place", _ranges(classes, per_range))})
    sums = keyed.groupBy("rank", "part").agg(F.sum("words").alias("words"))
    up_to = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("rank", "part", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "part").orderBy(
        "place", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(
        bases, ["rank", "part"]).withColumn("ahead", F.col("ahead") + F.col("base")).drop("words", "part", "base")


def _taken(ahead: DataFrame) -> DataFrame:
    """With ``last``, the words of a last use, and ``taken``, those of all uses."""
    last = F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("goal") - F.col("full") * F.col("source_size") - F.col("ahead")))
    return ahead.withColumn("last", last).withColumn("taken", F.col("full") * F.col("size") + F.col("last"))


def _time(ahead: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Training time in millionths at which a source's demand reaches ``ahead`` words."""
    share = ahead.cast("double") / F.nullif(F.col("goal"), F.lit(0)).cast("double")
    time = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        time = F.when(F.col("rank") % len(schedules) == k, inverse_demand(share, knots)).otherwise(time)
    return F.floor(time * F.lit(1e6)).cast("bigint")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3,
        schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, per_range: int = 500,
        text_column: str = "text") -> DataFrame:
    """One row per document in training order: doc_id, source, size, source_size, target, taken, position.

    ``taken``: words the mix takes of it, repeats counted. ``position``: training time of
    its first use in millionths, null if it is not used; such rows come last.
    """
    counted = _classes(_sized(docs, text_column))
    classes = _placed(counted, _plan(counted, weights, most), per_range)
    # copies are spread over tasks, a chunk each, before they become rows again
    chunks = classes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))))
    spread = chunks.repartition(*CLASS, "chunk").withColumn("copy", F.explode(F.sequence(
        F.col("chunk") * COPIES, F.least((F.col("chunk") + 1) * COPIES, F.col("copies")) - 1)))
    placed = _taken(spread.withColumn("ahead", F.col("ahead") + F.col("copy") * F.col("size")))
    position = F.when(F.col("taken") > 0, _time(F.col("ahead"), schedules))
    ordered = placed.withColumn("position", position).orderBy(
        F.col("position").asc_nulls_last(), "doc_id", "rank", "size", "copy")
    return ordered.select("doc_id", "source", "size", "source_size", "target", "taken", "position")


def training_order(mixed: DataFrame) -> DataFrame:
    """The documents that the mix uses, range-sorted by training time."""
    return mixed.where("taken > 0").orderBy("position", "doc_id")


def training_set(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3,
                 schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, per_range: int = 500,
                 text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, once for each use, range-sorted by training time.

    A last use counts if it takes at least half of the document.
    """
    sized = stored(_sized(docs, text_column), "sized")
    counted = _classes(sized)
    plan = stored(_plan(counted, weights, most), "plan")  # one row for each source, joined three times
    cell = _cut("draw", _ranges(sized, per_range))
    before = Window.partitionBy(*CLASS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = _keyed(sized.withColumn("cell", cell), plan).groupBy(*CLASS, "cell").agg(F.count("*").alias("n")).select(
        *CLASS, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    starts = stored(cells.join(_placed(counted, plan, per_range).select(*CLASS, F.col("ahead").alias("start")), [*CLASS]), "starts")
    rows = _keyed(_sized(docs, text_column, F.struct("*").alias("row")).withColumn("cell", cell), plan)
    number = F.row_number().over(Window.partitionBy(*CLASS, "cell").orderBy("draw")) - 1
    placed = _taken(rows.withColumn("number", number).join(starts, [*CLASS, "cell"]).withColumn(
        "ahead", F.col("start") + (F.col("earlier") + F.col("number")) * F.col("size")))
    uses = F.col("full") + F.when((F.col("last") * 2 >= F.col("size")) & (F.col("size") > 0), F.lit(1)).otherwise(F.lit(0))
    used = placed.withColumn("uses", uses).where("uses > 0 and size > 0").withColumn(
        "use", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("uses") - 1)))
    timed = used.select("row", "doc_id", _time(F.col("use") * F.col("source_size") + F.col("ahead"), schedules).alias("position"))
    return timed.orderBy("position", "doc_id").select("row.*")
