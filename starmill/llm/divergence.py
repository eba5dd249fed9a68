"""How far the sources of a language differ from each other and from the language.

Every group (lang, source) gives each kept term of its language a share
``p = 1 + floor(10^9 (count + 1) / (N + V))``; two shares differ by
``floor((p - q)^2 / q)``. Two reports come of it: the divergence of every ordered pair of
groups of one language, and each group's terms that stand out most against the language.

The pairs are partitioned as a three-dimensional cube. Groups are dealt into blocks of about
``GROUPS`` and terms into blocks of about ``TERMS``, both by a hash; a cell (group block,
group block, term block) is a task of its own. Each slice of counts (one group block, one
term block) is copied to the cells that need it, a cell computes the partial divergences of
its groups in both directions over its terms, and the partial sums are reduced along the
term axis. A cell's size is bounded whatever the size of the data, one source may hold any
share of the documents, and no cell holds a whole group or a whole vocabulary.

Counting: whole texts are cut into terms in Arrow, summed per task before the shuffle.

Defined results. Null text, lang and source count as ''. A text without terms adds none, but
its group occurs. Rows that repeat an id, or are equal, are documents of their own. A language
without kept terms has pairs of value 0 and no terms. Ties of value go to the smaller item in
UTF-8 order. No rows: no result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmill.llm.kernel import text_slices
from starmill.llm.stored import stored

GROUPS, TERMS, LEAST_DOCS, BEST = 64, 2048, 3, 200
#: Bytes of text cut at once, and rows a task gathers before it passes them on.
SLICE, HELD = 4 << 20, 400_000


def _folded() -> np.ndarray:
    """Of each byte: a blank if it separates terms, the small letter of a capital, else itself."""
    made = np.arange(256, dtype=np.uint8)
    made[0x41:0x5B] += 32
    made[:0x41] = made[0x5B:0x61] = made[0x7B:0x80] = 32
    return made


def _terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(number of the text, term) of every term of some texts."""
    texts = pa.StringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_folded()[data]))
    parts = pc.split_pattern(texts, " ")
    numbers, terms = pc.list_parent_indices(parts), pc.list_flatten(parts)
    some = pc.not_equal(terms, "")
    return numbers.filter(some), terms.filter(some)


def _summed(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return sums.rename_columns(["lang", "source", "term", "count", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column("text"), SLICE):
            numbers, terms = _terms_of(data, offsets)
            each = pa.table({"row": numbers, "term": terms}).group_by(["row", "term"]).aggregate([([], "count_all")])
            where = pc.add(each.column("row").cast(pa.int64()), a)
            made = pa.table({
                "lang": batch.column("lang").take(where.combine_chunks()),
                "source": batch.column("source").take(where.combine_chunks()), "term": each.column("term"),
                "count": each.column("count_all").cast(pa.int64()),
                "docs": pa.array(np.ones(len(where), np.int64))})
            held.append(_summed([made]))
            rows += held[-1].num_rows
            if rows > HELD:
                held = [_summed(held)]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _summed(held).to_batches()


def _share(count: str, size: str, terms: str) -> str:
    return f"1 + (cast({count} + 1 as decimal(19, 0)) * 1000000000) div nullif({size} + {terms}, 0)"


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (that hold the term), over all rows."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    made = texts.mapInArrow(_count, "lang string, source string, term string, count bigint, docs bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _cell(rows: pa.Table) -> pa.Table:
    """Partial divergences of the groups of two blocks, both ways, over the terms of a block.

    A row without a term stands for its group: ``p`` is then its share of a term it lacks.
    """
    sources = rows.column("source").combine_chunks().dictionary_encode()
    terms = rows.column("term").combine_chunks().dictionary_encode()
    names, group = sources.dictionary.to_pylist(), np.asarray(sources.indices)
    shares, seen = rows.column("p").to_numpy(), np.flatnonzero(np.asarray(terms.is_valid()))
    marks = np.flatnonzero(np.asarray(terms.is_null()))
    known, total = len(terms.dictionary), int(rows.column("n_terms").to_numpy().max())
    # the last column stands for all terms of the block that no group here has
    table, block = np.zeros((len(names), known + 1), np.int64), np.zeros(len(names), np.int64)
    table[group[marks]] = shares[marks, None]
    block[group] = rows.column("own").to_numpy()
    table[group[seen], np.asarray(terms.indices.take(pa.array(seen)))] = shares[seen]
    one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    times = np.ones(known + 1, np.int64)
    times[-1] = total - known
    found: list[tuple[int, int, int]] = []
    for a, others in [(x, right) for x in left] + ([(x, left) for x in right] if one != two else []):
        gaps = table[a] - table[others]
        sums = ((gaps * gaps // np.maximum(table[others], 1)) * times).sum(1)
        found += [(a, b, v) for b, v in zip(others.tolist(), sums.tolist(), strict=True) if a != b]
    return pa.table({
        "lang": pa.array([rows.column("lang")[0].as_py()] * len(found), pa.string()),
        "source": pa.array([names[a] for a, _, _ in found], pa.string()),
        "item": pa.array([names[b] for _, b, _ in found], pa.string()),
        "value": pa.array([v for _, _, v in found], pa.int64())})


def _pairs(kept: DataFrame, groups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of groups of a language."""
    dealt = groups.withColumn("own", F.expr(f"pmod(xxhash64(source), ceil(n_groups / {GROUPS}))"))
    term_block = f"pmod(xxhash64(term), ceil(n_terms / {TERMS}))"
    sizes = vocabulary.groupBy("lang", F.expr(term_block).alias("part")).agg(F.count("*").alias("in_part"))
    # a language without terms still has one cell per pair of blocks
    marks = dealt.join(sizes, "lang", "left").select(
        "lang", "source", "own", "n_groups", F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("in_part", F.lit(0)).alias("n_terms"), F.lit(None).cast("string").alias("term"),
        F.expr("coalesce(" + _share("0", "size", "n_terms") + ", 0)").alias("p"))
    slices = kept.join(dealt.select("lang", "source", "own", "n_groups"), ["lang", "source"]).select(
        "lang", "source", "own", "n_groups", F.expr(term_block).alias("part"), F.lit(0).cast("bigint").alias("n_terms"), "term", "p")
    copied = marks.unionByName(slices).withColumn(
        "other", F.explode(F.expr(f"sequence(0, cast(ceil(n_groups / {GROUPS}) as int) - 1)")))
    cells = copied.select(
        "lang", "source", "own", "part", "term", "p", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        "n_terms")
    parts = cells.groupBy("lang", "one", "two", "part").applyInArrow(
        _cell, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module's text."""
    found = stored(counts(docs), "divergence-counts")
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    vocabulary = found.groupBy("lang", "term").agg(
        F.sum("count").alias("all_count"), F.sum("docs").alias("all_docs")).where(F.col("all_docs") >= LEAST_DOCS)
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("all_count").alias("all_size"))
    words = stored(vocabulary.join(langs, "lang").select(
        "lang", "term", "n_terms", F.expr(_share("all_count", "all_size", "n_terms")).alias("q")), "divergence-terms")
    counted = stored(found.join(words, ["lang", "term"]).select("lang", "source", "term", "count", "n_terms", "q"), "divergence-kept")
    sizes = counted.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    number = occurring.groupBy("lang").agg(F.count("*").alias("n_groups"))
    groups = stored(occurring.join(sizes, ["lang", "source"], "left").join(number, "lang").join(
        langs.select("lang", "n_terms"), "lang", "left").select(
        "lang", "source", "n_groups", F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("n_terms", F.lit(0)).alias("n_terms")), "divergence-groups")
    kept = counted.join(groups.select("lang", "source", "size"), ["lang", "source"]).select(
        "lang", "source", "term", "n_terms", "q", F.expr(_share("count", "size", "n_terms")).alias("p"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups, words).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    terms = kept.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        F.expr("(p - q) * (p - q) div q").alias("value")).withColumn(
        "rank", F.row_number().over(by_value)).where(F.col("rank") <= BEST)
    return pairs.unionByName(terms)
