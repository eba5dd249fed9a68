"""Licence scan by a positional index of rare words.

Templates are licence sentences. The index holds, for each of their words but the commonest
English ones, its positions in the templates. Per template the word of its mandatory phrase
with the highest inverse document frequency (counted over all files) is looked up; a file
without it cannot hold the phrase. For the templates found so, each posting gives an alignment,
position in the file less position in the template; all licence words of the file that agree
with the same alignment are intersected. An alignment counts if it holds all words of the
template's mandatory phrase and at least ``SHARE`` of the template's weight.

Base phrases are found word by word besides; their labels always stay.

Words are runs of letters, digits and characters beyond ASCII, lower-cased. (Lower-casing is
that of Spark: beyond A-Z it changes no word boundary and makes no ASCII letter but ``k``
from the Kelvin sign, which no base phrase has.) Null texts are empty: no words, no labels,
score 0. Repeated rows get equal results; a null id is kept as it is.

All steps are DataFrame functions. The index is at most a few hundred rows, fixed by the
templates, so it is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.stored import stored

SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.6
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, sentence, mandatory phrase (words that stand in the sentence).
TEMPLATES = (
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", "affero general public license"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "binary forms"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0 1 0"),
    ("copyright-reserved", "All rights reserved", "rights reserved"),
    ("epl-2.0", "under the terms of the Eclipse Public License v 2.0", "eclipse public license"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", "copy modify and or distribute"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "lesser general public license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"),
)
#: Words too common to be indexed, unless a mandatory phrase needs them.
COMMON = frozenset("a an and any are at be by for from in into is of on or the this to use with without".split())


def split_words(text: str) -> list[str]:
    return [w for w in re.split(SIGNS, text.lower()) if w]


def postings(templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[tuple[int, str, str, int, int]]:
    """(template, label, word, position, 1 if mandatory) of all indexed words."""
    made = []
    for k, (label, sentence, phrase) in enumerate(templates):
        words, needed = split_words(sentence), split_words(phrase)
        at = next((i for i in range(len(words)) if words[i: i + len(needed)] == needed), None)
        if at is None:
            raise ValueError(f"{label}: the mandatory phrase does not stand in the sentence")
        for i, w in enumerate(words):
            mandatory = at <= i < at + len(needed)
            if mandatory or w not in COMMON:
                made.append((k, label, w, i, int(mandatory)))
    return made


def _places(words: Column, hits: Column, phrase: str) -> Column:
    """Starts of a phrase, from the places of its rarest-looking (longest) word."""
    parts = split_words(phrase)
    lead = max(range(len(parts)), key=lambda i: len(parts[i]))

    def stands(hit: Column) -> Column:
        here = hit["w"] == parts[lead]
        for j, part in enumerate(parts):
            if j != lead:
                here = here & F.coalesce(F.when(hit["p"] + (j - lead) >= 0, F.get(words, hit["p"] + (j - lead))) == part, F.lit(False))
        return here

    return F.transform(F.filter(hits, stands), lambda hit: hit["p"] - lead)


def _scanned(docs: DataFrame, vocabulary: list[str], base: Sequence[tuple[str, str]], text_column: str) -> DataFrame:
    """Per row: number of words, base places by phrase, and the places of indexed words."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"),
        F.array_remove(F.split(F.lower(text), SIGNS), "").alias("words"))
    known = split.withColumn("places", F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: F.get("words", i).isin(vocabulary)))
    hits = known.withColumn("hits", F.transform("places", lambda i: F.struct(F.get("words", i).alias("w"), i.alias("p"))))
    return hits.select(
        "doc_id", "digest", F.size("words").cast("bigint").alias("n_words"), "hits",
        F.array(*(_places(F.col("words"), F.col("hits"), phrase) for phrase, _ in base)).alias("base"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES,
         base: Sequence[tuple[str, str]] = BASE, text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (share of the best template's weight, 1 for a base phrase)."""
    spark = docs.sparkSession
    index = postings(templates)
    leads = {max(split_words(phrase), key=len) for phrase, _ in base}
    vocabulary = sorted({w for _, _, w, _, _ in index} | leads)
    rows = stored(_scanned(docs, vocabulary, base, text_column), "license-words")
    files, seen = rows.count(), {w: 0 for w in vocabulary}
    # one count per indexed word: the templates fix how many rows come back
    for r in rows.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count().collect():
        seen[r["w"]] = r["count"]
    idf = {w: round(_idf(files, seen[w]), 6) for w in vocabulary}
    rarest = {k: max((idf[w], w) for t, _, w, _, needed in index if t == k and needed)[1] for k in range(len(templates))}
    weight = F.create_map(*(F.lit(x) for w in vocabulary for x in (w, idf[w])))
    listed = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(w).alias("w"), F.lit(at).alias("at"),
                 F.lit(needed).alias("needed"), F.lit(rarest[k]).alias("rarest")) for k, label, w, at, needed in index))).alias("x")).select("x.*")
    weighed = listed.withColumn("weight", F.element_at(weight, F.col("w")))
    totals = weighed.groupBy("template").agg(F.sum("weight").alias("whole"), F.sum("needed").alias("all_needed"))
    looked_up = F.array(*(F.lit(w) for w in sorted(set(rarest.values()))))
    marked = rows.where(F.size("hits") > 0).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "digest", "hits",
        F.array_intersect("hits.w", looked_up).alias("rare")).where(F.size("rare") > 0).dropDuplicates(["id", "digest"])
    found = marked.select("id", "digest", "rare", F.explode("hits").alias("hit")).select(
        "id", "digest", "rare", F.col("hit.w").alias("w"), F.col("hit.p").alias("p"))
    aligned = found.join(F.broadcast(weighed), "w").where(F.array_contains("rare", F.col("rarest"))).groupBy(
        "id", "digest", "template", "label", (F.col("p") - F.col("at")).alias("shift")).agg(
        F.sum("weight").alias("weight"), F.sum("needed").alias("needed"))
    share = F.col("weight") / F.col("whole")
    agreed = aligned.join(F.broadcast(totals), "template").where(
        (F.col("needed") == F.col("all_needed")) & (share >= SHARE)).groupBy("id", "digest").agg(
        F.collect_set("label").alias("found"), F.max(share).alias("best"))
    named = F.array_sort(F.filter(F.array(*(
        F.when(F.size(F.get("base", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(base))),
        lambda x: x.isNotNull()))
    every = F.flatten("base")
    result = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(agreed, ["id", "digest"], "left")
    return result.select(
        "doc_id", "n_words", F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(F.array_distinct(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.round(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0)), 6)).alias("score"))


def _idf(files: int, having: int) -> float:
    import math

    return math.log((files + 1) / (having + 1)) + 1.0
