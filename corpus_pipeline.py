"""From raw documents to token files: five stages, each over all that the one before kept.

Columns of ``documents`` beside doc_id, text and source pass through untouched, whatever their
names; ``n_chars`` is a feature of the classifier only if it holds numbers. Every stage takes
an empty table and returns one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starmill.functions.shared import shared_dir
from starmill.llm import decontaminate, mixing, near_dup, quality, token_orc
from starmill.llm.stored import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the factorisation machine rejects; it learns from the labelled rows of ``docs``.

    Null and empty texts are scored like any other; rows without an id are never learned from.
    Each of several equal rows is judged alike. Without usable labels nothing is dropped. A score
    of exactly 0.5 stays.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8.

    The smallest id stays; of rows equal in id and text, one. Texts without words and rows
    without an id are linked with nothing and stay.
    """
    return near_dup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go, all rows of such an id and text.

    Null and empty texts and items leak nothing. A similarity of exactly 0.8 is a leak.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it, in training order.

    Texts without words are not used. A null source is a source of its own; rows that repeat an
    id are documents of their own. Ties of position go by id, nulls first.
    """
    return mixing.training_set(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; their digest, read back from them.

    A null or empty text is the end id alone. Rows without an id come first; rows that repeat
    one are ordered by their text, and each counts.
    """
    path = shared_dir(spark, "corpus-tokens")
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.digest(token_orc.read_tokens(spark, path))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can't express a trained classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
