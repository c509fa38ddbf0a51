"""Training-data pipeline over ``documents``: identify languages, drop near-duplicates, cut repeated passages, mix the
sources, and pack what is left into sequences.

Every stage takes the rows its predecessor kept, written as Parquet and read again. Texts decide, not tables outside:
``sf_dir`` is part of the interface only. Rows with nulls are handled as the operators say; an empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framegate.llm import alike, language, mixing, packing, substring
from framegate.llm.common import read, stage
from framegate.llm.queries import tokenizer_json


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or closer to noise than to every learned language, go."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the smallest doc_id stays."""
    return alike.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out; documents left empty by it go."""
    return substring.keep_rest(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to two epochs, as the tempered weights want it."""
    return mixing.mix(docs, columns=tuple(docs.columns)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in a sequence of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_json()).drop("ids")


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: Models, fingerprints by XXH64 and the vocabulary have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
