import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from starmill.llm import divergence

COLUMNS = "doc_id bigint, text string, lang string, source string, term string, p double"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, best=200):
    clean = [tuple(x or "" for x in r[1:4]) for r in rows]
    out = []
    for lang in {x[1] for x in clean}:
        docs, counts = Counter(), {x[2]: Counter() for x in clean if x[1] == lang}
        for text, _, source in (x for x in clean if x[1] == lang):
            words = TERM.findall(text.translate(LOWER))
            counts[source].update(words)
            docs.update(set(words))
        kept = {w for w, n in docs.items() if n >= least}

        def shares(count):
            size = sum(count[w] for w in kept)
            return {w: 1 + 1000000000 * (count[w] + 1) // (size + len(kept)) for w in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in counts if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (v, i) in enumerate(items) if part == "pair" or r < best]
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], COLUMNS)
    got = divergence.audit(frame)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"),
                          ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, got.collect()))


def documents(rng, n, sources, hot=0.0):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Été", "été", "ÜBER", "A-b", "x_y", "\U0001f600z"]
    made = []
    for k in range(n):
        source = "hot" if rng.random() < hot else f"s{rng.randrange(sources)}"
        text = " ".join(rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randrange(40)))
        made.append((k, text, rng.choice(["en", "de"]), source))
    return made


def test_equals_brute_force_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 3)
    monkeypatch.setattr(divergence, "TERMS", 16)
    rows = documents(random.Random(1), 400, 9, hot=0.4)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = documents(rng, 60, 3)
    rows += [rows[5]] * 7 + [(5, "other text", "en", "s0"), (None, "wa wb", None, None), (None, None, "en", None), (1, "", "", "")]
    rows += [(900 + k, "only here", "xx", f"z{k}") for k in range(2)]  # two documents: no term is kept
    rows += [(910, None, "yy", "alone"), (911, "Q" * 300_000 + " wa" * 100_000, "en", "long"), (912, "tab\x00nul 12 .,", "en", "s1")]
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_item_in_utf8_order(spark):
    rows = [(k, "same", "en", s) for k, s in enumerate(["b", "B", "é", "￿", "\U00010000", "a"] * 3)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert [x[3] for x in sorted((x for x in got if x[1] == "a"), key=lambda x: x[5])] == ["B", "b", "é", "￿", "\U00010000"]


def test_no_rows_and_one_group(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a b", "en", "s")] * 3) == []


def test_only_the_best_terms_are_listed(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BEST", 4)
    rows = documents(random.Random(3), 200, 4)
    assert found(spark, rows) == brute(rows, best=4)


def test_counting_is_the_same_however_often_it_is_passed_on(monkeypatch):
    texts = documents(random.Random(4), 300, 3)
    batches = [pa.RecordBatch.from_pydict({"lang": [r[2] for r in part], "source": [r[3] for r in part], "text": [r[1] for r in part]})
               for part in (texts[:100], texts[100:])]

    def totals():
        made = Counter()
        for b in divergence._count(iter(batches)):
            for x in b.to_pylist():
                key = x["lang"], x["source"], x["term"]
                made[key] = made.get(key, 0) + np.array([x["count"], x["docs"]])
        return {k: tuple(v) for k, v in made.items()}

    whole = totals()
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "SLICE", 400)
    assert totals() == whole
