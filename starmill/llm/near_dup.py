"""Near duplicates by b-bit MinHash.

A document's set holds its distinct k-word shingles as 64-bit hashes. Equal sets are one
class, named by the smallest id, before anything is compared. Per class:

* minima of the set under ``hashes`` permutations; bands of ``rows`` minima name buckets;
* the low ``BITS`` bits of each minimum, packed as bit planes. The share of equal entries,
  less the 1/4 that agree by chance, estimates the similarity by counting bits.

Bands are as many as leave a pair at the threshold unfound with probability below
``MISSED``. Candidates come in two rounds. In the first, ``EARLY`` bands link the members of
a bucket to its smallest one only (a star), so a bucket of n costs n rows; in the second, the
other bands link what the first left apart, one row per bucket and group. All candidates
together make families. Star pairs of the first round that pass the estimate are confirmed on
full sets and give first components.

What the stars can't settle, members of a family that are still in different components, is
found by an exact prefix filter. Shingles are put in one order, rarest first (by a sketch of
``SKETCH`` counters). Of a linked pair, the larger set's first ``n - ceil(t n) + 1`` shingles and
the smaller one's first ``n - ceil(2 t n / (1 + t)) + 1`` share one, at places that leave enough
of both sets behind them. So postings of those few shingles are joined within a family, only
between components; estimates and full sets confirm what is left, the likeliest pair of each two
components first, since one link joins them. Documents that share a
template but are not linked have their own rare shingles first, and meet nobody. Postings of
more than ``BLOCK`` entries are cut, and their partners copied to each part. Nothing is capped.

Words are lower-cased (A-Z) and separated by blank, tab to carriage return. A text with
fewer than k words is one shingle; a text without words (null, empty, blank) is linked with
nothing. Rows that repeat an id are one document. A null id is linked with nothing and kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmill.llm.components import components
from starmill.llm.kernel import long_lists, mix, shingle_sets, text_slices, words
from starmill.llm.stored import stored

BITS, MISSED, BLOCK, EARLY, SKETCH, TRIES = 2, 1e-6, 128, 4, 1 << 18, 8


@dataclass(frozen=True)
class Rule:
    """Link two documents if ``100 * shared >= percent * all`` of their k-word shingles."""

    k: int = 5
    percent: int = 80
    rows: int = 6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISSED) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        """64-bit words of one bit plane."""
        return -(-self.hashes // 64)

    @property
    def least_equal(self) -> int:
        """Equal entries below which a pair at the threshold lies six deviations off."""
        chance = 2.0 ** -BITS
        share = chance + (1 - chance) * self.percent / 100
        return math.floor(self.hashes * share - 6 * math.sqrt(self.hashes * share * (1 - share)))


def estimate(equal: Column, hashes: int) -> Column:
    """Similarity from equal b-bit entries, corrected for those that agree by chance."""
    chance = 2.0 ** -BITS
    return (equal / F.lit(float(hashes)) - F.lit(chance)) / F.lit(1 - chance)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def _signatures(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(bit planes, band keys) of sets, one row each; those of empty sets mean nothing."""
    full = [k for k, x in enumerate(sets) if len(x)]
    planes = np.zeros((len(sets), BITS * rule.words), np.uint64)
    keys = np.zeros((len(sets), rule.bands), np.uint64)
    if not full:
        return planes, keys
    sizes = np.array([len(sets[k]) for k in full])
    at = np.cumsum(sizes) - sizes
    flat = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((rule.hashes, len(full)), np.uint32)
    room = np.empty_like(flat)
    for j, (a, b) in enumerate(zip(*_permutations(rule.hashes), strict=True)):
        np.multiply(flat, a, out=room)
        room += b
        np.minimum.reduceat(room, at, out=minima[j])
    low = mix(minima.T.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    padded = np.zeros((len(full), rule.words * 64), np.uint8)
    for bit in range(BITS):
        padded[:, : rule.hashes] = (low >> np.uint64(bit)) & np.uint64(1)
        planes[full, bit * rule.words: (bit + 1) * rule.words] = np.packbits(padded, 1, "little").view(np.uint64)
    banded = minima.reshape(rule.bands, rule.rows, len(full)).astype(np.uint64)
    key = np.arange(1, rule.bands + 1, dtype=np.uint64)[:, None] * np.uint64(0xA0761D6478BD642F)
    for r in range(rule.rows):
        key = mix(key ^ banded[:, r]) + np.uint64(r)
    keys[full] = key.T
    return planes, keys


def _rows(table: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel().view(np.int64)))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for a, b, data, offsets in text_slices(batch.column("text")):
        hashes, _, bounds = words(data, offsets)
        yield batch.column("doc_id").slice(a, b - a), shingle_sets(hashes, bounds, k)


def _signer(rule: Rule):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _sets(batch, rule.k):
                planes, keys = _signatures(sets, rule)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(x) for x in sets], pa.int64()),
                     pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                              pa.binary()), _rows(planes), _rows(keys)],
                    names=["doc_id", "n_shingles", "name", "planes", "bands"])

    return sign


def _setter(rule: Rule):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _sets(batch, rule.k):
                planes, _ = _signatures(sets, rule)
                yield pa.RecordBatch.from_arrays(
                    [ids, _rows(planes), long_lists(sets)], names=["node", "planes", "shingles"])

    return collect


def signatures(docs: DataFrame, rule: Rule, text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, name (of the set), planes, bands; one row per document."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return named.mapInArrow(
        _signer(rule), "doc_id bigint, n_shingles bigint, name binary, planes array<bigint>, bands array<bigint>")


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that share one of ``bands``, each bucket as a star around its smallest."""
    postings = classes.select("node", F.explode("bands").alias("bucket"))
    centers = postings.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    return postings.join(centers.drop("last"), "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _families(classes: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, family): classes connected by buckets of any band, of which ``stars`` has the early ones."""
    early = stored(components(stars), "early-families")
    named = classes.join(early, "node", "left").select(
        F.coalesce("component", "node").alias("node"), F.slice("bands", EARLY + 1, 1 << 20).alias("bands"))
    late = candidates(named).select("a", "b")
    return components(late.unionByName(early.select(F.col("component").alias("a"), F.col("node").alias("b")))).withColumnRenamed(
        "component", "family")


def _alike(pairs: DataFrame, light: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose sizes and bit planes allow a link, with ``differ``, from rows without shingles."""
    one = light.select(F.col("node").alias("a"), F.col("planes").alias("p"), F.col("size").alias("m"))
    two = light.select(F.col("node").alias("b"), F.col("planes").alias("q"), F.col("size").alias("n"))
    differ = F.lit(0)
    for w in range(rule.words):
        odd = F.lit(0).cast("bigint")
        for bit in range(BITS):
            i = bit * rule.words + w
            odd = odd.bitwiseOR(F.col("p")[i].bitwiseXOR(F.col("q")[i]))
        differ = differ + F.bit_count(odd)
    sizes = F.least("m", "n") * 100 >= F.greatest("m", "n") * rule.percent
    return pairs.join(two, "b").join(one, "a").withColumn("differ", differ).where(
        sizes & (F.lit(rule.hashes) - F.col("differ") >= rule.least_equal)).select(*pairs.columns, "differ")


def _exact(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b), those linked by their full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    shared = pairs.join(two, "b").join(one, "a").withColumn("shared", F.size(F.array_intersect("s", "t")))
    return shared.where(F.expr(f"100 * shared >= {rule.percent} * (size(s) + size(t) - shared)")).select(*pairs.columns)


def _light(sets: DataFrame) -> DataFrame:
    return sets.select("node", "planes", F.size("shingles").alias("size"))


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b), those linked; sets are joined only for pairs that the estimate leaves."""
    return _exact(stored(_alike(pairs, _light(sets), rule), "likely"), sets, rule).select("a", "b")


def _joined(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between components, from candidates a, b in components ``one`` and ``two``.

    One link joins two components, so the likeliest pair of each two is tried first. What
    that joins needs no further pair; of the rest each round tries ``TRIES`` times as many.
    """
    left = stored(_alike(pairs, _light(sets), rule).select(
        "a", "b", "differ", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")), "likely")
    place = F.row_number().over(Window.partitionBy("one", "two").orderBy("differ", "a", "b"))
    found, tries = None, 1
    while True:
        linked = stored(_exact(left.withColumn("place", place).where(F.col("place") <= tries), sets, rule).select(
            F.col("one").alias("a"), F.col("two").alias("b")).distinct(), "crossing")
        found = linked if found is None else found.unionByName(linked)
        rest = left.withColumn("place", place).where(F.col("place") > tries)
        if not rest.limit(1).count():
            return found
        top = stored(components(linked).select("node", F.col("component").alias("top")), "tops")
        rest = rest.join(top.withColumnRenamed("node", "one").withColumnRenamed("top", "p"), "one", "left").join(
            top.withColumnRenamed("node", "two").withColumnRenamed("top", "q"), "two", "left").withColumns(
            {"x": F.coalesce("p", "one"), "y": F.coalesce("q", "two")}).where("x <> y")
        left = stored(rest.select("a", "b", "differ", F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")), "left")
        tries *= TRIES


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        flat = batch.column("shingles").flatten().to_numpy().view(np.uint64)
        total += np.bincount((flat % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])


def _prefixes(rule: Rule, frequency: np.ndarray):
    """Rarest shingles of each set: ``place`` in the order, ``short`` if the set may be the smaller one there."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            size = np.asarray(pc.list_value_length(batch.column("shingles"))).astype(np.int64)
            flat, at = batch.column("shingles").flatten().to_numpy(), np.cumsum(size) - size
            for k, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
                own = flat[a: a + n]
                order = np.lexsort((own, frequency[(own.view(np.uint64) % np.uint64(SKETCH)).astype(np.int64)]))
                most = n + (-rule.percent * n) // 100 + 1
                few = n + (-2 * rule.percent * n) // (100 + rule.percent) + 1
                place = np.arange(most)
                made.append((np.full(most, k), own[order[:most]], place, place < few, np.full(most, n)))
            if made:
                row, shingle, place, short, n = (np.concatenate(x) for x in zip(*made, strict=True))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in ("family", "component", "node")), pa.array(shingle),
                     pa.array(place.astype(np.int32)), pa.array(short), pa.array(n)],
                    names=["family", "component", "node", "shingle", "place", "short", "size"])

    return cut


def _crossing(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of components of one family that a link joins; ``members`` has node, family, component."""
    families = members.groupBy("family").agg(
        F.count("*").alias("all"), F.min("component").alias("one"), F.max("component").alias("last"))
    # two members in two components: their one pair was a star's, unless a late band found it
    unsettled = families.where("one <> last").select("family")
    open_ = stored(members.join(unsettled, "family", "left_semi").join(sets.select("node", "shingles"), "node"), "unsettled")
    counted = open_.select("shingles").mapInArrow(_sketched, "at bigint, n bigint").groupBy("at").agg(
        F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    frequency = np.zeros(SKETCH, np.int64)
    frequency[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    postings = stored(open_.mapInArrow(
        _prefixes(rule, frequency), "family bigint, component bigint, node bigint, shingle bigint, place int, short boolean, size bigint"),
        "postings")
    key = ["family", "shingle"]
    lists = postings.groupBy(*key).agg(
        F.min("component").alias("one"), F.max("component").alias("last"), F.sum(F.col("short").cast("int")).alias("n")).where(
        "one <> last and n > 0").select(*key, F.ceil(F.col("n") / BLOCK).alias("cuts"))
    met = postings.join(lists, key)
    small = met.where("short").select(
        *key, F.pmod(F.xxhash64("node"), F.col("cuts")).alias("part"), F.col("node").alias("a"), F.col("component").alias("one"),
        F.col("size").alias("m"), F.col("place").alias("i"))
    large = met.select(
        *key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("part"), F.col("node").alias("b"),
        F.col("component").alias("two"), F.col("size").alias("n"), F.col("place").alias("j"))
    share, whole = rule.percent, 100 + rule.percent
    pairs = small.join(large, [*key, "part"]).where(
        "one <> two and (m < n or m = n and a < b)"
        f" and 100 * m >= {share} * n and {whole} * least(m - i, n - j) >= {share} * (m + n)").select(
        "a", "b", "one", "two").distinct()
    return _joined(stored(pairs, "crossing-pairs"), sets, rule)


def near_duplicates(docs: DataFrame, rule: Rule | None = None, text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the
    row's own. Intermediate tables stay in the shared folder, since the result reads them.
    """
    rule = rule or Rule()
    signed = stored(signatures(docs, rule, text_column), "signatures")
    known = signed.where("doc_id is not null and name is not null")
    classes = stored(known.groupBy("name").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    stars = stored(candidates(classes.select("node", F.slice("bands", 1, EARLY).alias("bands"))), "stars")
    families = stored(_families(classes, stars), "families")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    sets = stored(texts.join(families.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(
        _setter(rule), "node bigint, planes array<bigint>, shingles array<bigint>"), "sets")
    first = stored(components(stored(_confirmed(stars, sets, rule), "links")), "components")
    members = stored(families.join(first, "node", "left").select(
        "node", "family", F.coalesce("component", "node").alias("component")), "members")
    joined = components(stored(_crossing(members, sets, rule), "crossing"))
    final = members.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")),
                         "component", "left").select("node", F.coalesce("top", "component").alias("component_id"))
    named = signed.select("doc_id", "n_shingles", "name").join(classes.select("name", "node"), "name", "left")
    reached = named.join(final, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "node", "doc_id"))
        .alias("component_id"))
    return reached.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, rule: Rule | None = None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group."""
    kept = stored(near_duplicates(docs, rule, text_column).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    same = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", text_column])
    return same.select(docs.columns).unionByName(docs.where("doc_id is null"))
