"""A training corpus from ``documents``: five stages, each written and read again before the next.

Defined results, beside what each operator states: a null text is an empty one, has no
language and goes in the first stage, like one without a letter; rows without an id pass
near-dedup and are decontaminated by their texts; rows that share id and text are one for
near-dedup, where the one with the smallest hash of all columns stays; ties go to the
smallest id; texts of any length are read whole; further columns, whatever their names, pass
through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallylog.llm import decontam, langid, mixing, near_copies, token_blocks
from tallylog.llm.common import materialise, read

TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more), the one with the smallest id.

    SimHash fingerprints go through op9's binary trie first; MinHash bands find what differs
    in more bits than a trie can follow at scale; both are confirmed by the exact similarity.
    """
    return near_copies.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; copies of one keep its id."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id files of all documents, listed as read back: (doc_id, start, n_tokens, ids_crc32)."""
    return token_blocks.store_ids(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing_to_target_weights", mix_sources),
    ("token_id_output", token_ids),
]

#: the language model, singular vectors and Newton steps have no SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
