import itertools
import random

import pytest
from pyspark.sql import functions as F

from starmill.llm import decontaminate

DOCS = "doc_id bigint, text string, id string, digest int, item int, words string"
ITEMS = "item_id bigint, text string, size string, h int"


def data(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 9 == 0 else f"v{k}" for k in range(300)]
    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(rng.randint(12, 50)))) for k in range(25)] + [(90, "Only three words"), (91, None), (92, ""), (90, "Only three words")]
    docs, planted = [], set()
    for key in range(120):
        body = words(rng.randint(0, 150))
        if key % 3 == 0:
            item, text = rng.choice(items[:25])
            part = text.upper().split()
            if key % 6 == 0:
                spot = rng.randrange(len(part))
                part[spot: spot + rng.choice((0, 1))] = words(1) if len(part) > 40 else [part[spot]] * rng.choice((0, 1)) or [part[spot]]
            at = rng.randint(0, len(body))
            body[at:at] = part
            if key % 6:
                planted.add((key, item))
        docs.append((key, (", " if key % 2 else " \n").join(body)))
    docs += [(500, "x Only  THREE words, y"), (501, None), (502, ""), (503, "a b"), (None, items[3][1]), (504, "Only three w words")]
    planted |= {(500, 90), (None, 3)}
    return docs, items, planted


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1, 2, "y") for d in docs], DOCS),
            spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS))


def brute(docs, items, percent=80):
    """Every item-sized window against every item, by plain counts of shingles (all of equal weight)."""
    import re
    def words(t):
        return [w for w in re.split(decontaminate.SIGNS, (t or "").lower()) if w]
    def counts(w, k):
        out = {}
        for i in range(len(w) - k + 1):
            out[tuple(w[i: i + k])] = out.get(tuple(w[i: i + k]), 0) + 1
        return out
    found = {}
    for (key, text), (item, sample) in itertools.product(docs, items):
        d, t = words(text), words(sample)
        if not t:
            continue
        k = min(5, len(t))
        want = counts(t, k)
        for s in range(max(len(d) - len(t), 0) + 1):
            have = counts(d[s: s + len(t)], k)
            both = sum(min(n, have.get(x, 0)) for x, n in want.items())
            every = sum(want.values()) + sum(have.values()) - both
            if both and both * 100 >= percent * every:
                found[key, item] = max(found.get((key, item), 0), both / every)
    return found


def test_equals_brute_force(spark):
    docs, items, planted = data()
    got = decontaminate.leaks(*frames(spark, docs, items)).collect()
    pairs = {(r.doc_id, r.item_id): r.similarity for r in got}
    want = brute(docs, items)
    assert planted <= set(pairs)
    # weights of these items differ too little to move a pair over the threshold
    assert set(pairs) == set(want)
    assert all(pairs[p] == pytest.approx(want[p], abs=0.1) for p in want)
    assert len(got) == len(pairs)


def test_pairs_beyond_the_radius(spark, monkeypatch):
    """However few bits the search allows, every similar window is verified."""
    monkeypatch.setattr(decontaminate, "RADIUS", 2)
    docs, items, _ = data(3)
    got = decontaminate.leaks(*frames(spark, docs, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(brute(docs, items))
    assert max(r.distance for r in got) > 2


def test_drop_leaks(spark):
    docs, items, planted = data(2)
    d, i = frames(spark, docs + [(0, "the same id, another text")], items)
    left = decontaminate.drop_leaks(d, i)
    assert left.columns == d.columns
    ids = [r.doc_id for r in left.collect()]
    assert 0 in ids and None not in ids and not {k for k, _ in planted if k} & set(ids)
    assert {1, 2, 501, 502, 503} <= set(ids)


def test_radius_is_complete(spark):
    rng = random.Random(4)
    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x
    prints = [rng.getrandbits(64) for _ in range(30)]
    near = []
    for p in prints:
        for n in (0, 5, 19, 20, 21, 30):
            near.append(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    items = spark.createDataFrame([(k, signed(p)) for k, p in enumerate(prints)], "item bigint, print bigint")
    windows = spark.createDataFrame([(k, signed(p)) for k, p in enumerate(near)], "id bigint, print bigint")
    got = {(r.id, r.item, r.distance) for r in decontaminate.within_radius(windows, items, 30).collect()}
    want = {(a, b, (x ^ y).bit_count()) for a, x in enumerate(near) for b, y in enumerate(prints) if (x ^ y).bit_count() <= decontaminate.RADIUS}
    assert got == want


def test_empty_tables(spark):
    docs, items, _ = data()
    d, i = frames(spark, docs[:5], items)
    assert decontaminate.leaks(d.limit(0), i).count() == 0
    assert decontaminate.leaks(d, i.limit(0)).count() == 0
    assert decontaminate.drop_leaks(d, i.where(F.lit(False))).count() == 5
