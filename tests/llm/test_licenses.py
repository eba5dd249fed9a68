import re

import pytest

from starmill.llm import licenses

COLUMNS = "doc_id bigint, text string, words string, hits int, base int, label string, id int"
LINES = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
         "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.",
         "Released under the\nMIT  license", "the apache foundation has a license", "general public", "cc by cc by CC-BY",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more",
         "all RIGHTS reserved, all rights, reserved", "publİc", "", None, "übercc by", "by", "reserved all rights"]


def scanned(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], COLUMNS)
    return licenses.scan(frame).collect()


def by_hand(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i: i + len(parts)] == parts]
        places += found
        labels |= {label} if found else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_base_columns(spark):
    rows = [(k, text) for k, text in enumerate(LINES)] + [(100 + k, f"w{k} " * 50 + (LINES[k % 5])) for k in range(40)]
    rows += [(None, LINES[0]), (3, LINES[3]), (3, LINES[4]), (500, "word " * 40000 + LINES[1] + " all rights reserved")]
    got = scanned(spark, rows)
    assert len(got) == len(rows)
    def key(t):
        return tuple(map(str, t))
    want = sorted(key((i, *by_hand(t))) for i, t in rows)
    assert sorted(key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_labels_of_the_method(spark):
    got = {r.doc_id: r.labels for r in scanned(spark, [(k, t) for k, t in enumerate(LINES)] + [(50 + k, "plain text here") for k in range(30)])}
    assert got[0] == "cc-by,cc-by-nc-4.0"
    assert got[1] == "gpl,gpl-3.0"
    assert got[2] == "apache-2.0"
    assert got[3] == got[5] == "mit"
    assert got[4] == "copyright-reserved,reserved"
    assert got[6] == got[7] == got[12] == got[13] == got[50] == ""
    assert got[9] == "mit"


def test_every_complete_alignment_counts(spark):
    """Several licences in a file, and ordinary words of other templates around one."""
    ordinary = "The software is free for any person and any purpose, permission to copy and distribute a version into the domain. "
    several = " ".join(sentence + "." for _, sentence, _ in licenses.TEMPLATES)
    rows = [(0, several), (1, ordinary + LINES[2]), (2, LINES[2] + " " + ordinary), (3, ordinary + LINES[3] + " " + LINES[0])]
    rows += [(10 + k, "the apache license of a public mit domain") for k in range(30)]
    got = {r.doc_id: r for r in scanned(spark, rows)}
    assert set(got[0].labels.split(",")) >= {label for label, _, _ in licenses.TEMPLATES}
    assert [got[k].labels for k in (1, 2, 3)] == ["apache-2.0", "apache-2.0", "cc-by,cc-by-nc-4.0,mit"]
    assert got[1].score == got[2].score == 1


def test_empty_table(spark):
    assert scanned(spark, []) == []


def test_mandatory_phrase_must_stand_in_its_sentence():
    with pytest.raises(ValueError):
        licenses.postings((("x", "one two three", "two one"),))


def test_sql_and_query_agree_on_files_with_several_licences(spark):
    import random

    import duckdb
    import pyarrow as pa

    from starmill.llm.oracles import ORACLES

    rng = random.Random(6)
    sentences = [sentence for _, sentence, _ in licenses.TEMPLATES]
    several = [" and ".join(rng.sample(sentences, k)) for k in (2, 5, 9, 17) for _ in range(6)]
    rows = list(enumerate(LINES[:11] + several + [f"plain words of file {k} " + " ".join(rng.sample(sentences[0].split(), 3)) for k in range(40)]))
    documents = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    with duckdb.connect() as c:
        c.register("documents", documents)
        made = c.execute(ORACLES["op10_license_scan"])
        names = [d[0] for d in made.description]
        want = sorted(made.fetchall(), key=lambda r: r[names.index("doc_id")])
    got = sorted((tuple(r[n] for n in names) for r in scanned(spark, rows)), key=lambda r: r[names.index("doc_id")])
    assert got == want
    assert max(len(r[names.index("labels")].split(",")) for r in got) >= len({label for label, _, _ in licenses.TEMPLATES})
