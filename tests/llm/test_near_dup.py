import random

import pytest

from starmill.llm import near_dup
from starmill.llm.near_dup import Rule

COLUMNS = "doc_id bigint, text string, node int, name string, bands string"


def brute(rows, k, percent):
    sets = {}
    for key, text in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (text or "").split()]
        sets[key] = {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {key: key for key in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and shared:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {key: (len(sets[key]), find(key)) for key in keys}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.choice((1, 1, 2, 5, 60))):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["one", "One", "two words", "TWO\twords", "", None, " \n ", "one two three", "é É x", "é é x"]
    rng.shuffle(rows)
    return [(3 * k + 1, text) for k, text in enumerate(rows)]


@pytest.mark.parametrize("rule", [Rule(3, 85, 7), Rule()])
def test_equals_brute_force(spark, monkeypatch, rule):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rows = corpus(rule.k)
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLUMNS)
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame, rule).collect()}
    want = brute(rows, rule.k, rule.percent)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_star_centre_that_links_nobody(spark):
    """Buckets may have an unrelated smallest member; links between the others stay."""
    rule = Rule(3, 85, 7)
    base = [f"a{k}" for k in range(120)]
    chain = []
    for step in range(30):
        text = list(base)
        text[: 4 * step] = [f"b{k}" for k in range(4 * step)]
        chain.append((step + 1, " ".join(text)))
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in chain], COLUMNS)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, rule).collect()}
    assert got == {k: c for k, (_, c) in brute(chain, 3, 85).items()}


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (9, text), (None, text), (None, None), (11, "other words entirely")]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLUMNS)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(frame).collect())
    assert got == sorted([("5", "5", True), ("5", "5", True), ("9", "5", False), ("None", "None", True),
                          ("None", "None", True), ("11", "11", True)])
    left = near_dup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["11", "5", "None", "None"]


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0


def test_estimate_follows_similarity():
    import numpy as np

    rule = Rule(3, 85, 7)
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 63, 1000).astype(np.uint64)
    for shared in (500, 850, 920):
        b = np.concatenate((a[:shared], rng.integers(1, 1 << 63, 1000 - shared).astype(np.uint64)))
        planes, _ = near_dup._signatures([np.sort(a), np.sort(b)], rule)
        x = planes[0] ^ planes[1]
        differ = int(np.bitwise_count(x[: rule.words] | x[rule.words:]).sum())
        similarity = ((1 - differ / rule.hashes) - 0.25) / 0.75
        assert similarity == pytest.approx(shared / (2000 - shared), abs=0.13)
    assert rule.least_equal < rule.hashes * (0.25 + 0.75 * 0.85)
