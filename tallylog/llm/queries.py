"""The queries of this subpackage, by name, and the SQL that gives their rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.audio import media_report
from tallylog.llm.bloom_variants import spelling_forms
from tallylog.llm.common import read
from tallylog.llm.decontam import leaks
from tallylog.llm.fast_sketches import similar_groups
from tallylog.llm.langid import languages
from tallylog.llm.licenses import license_scan
from tallylog.llm.mixing import mix_report, sizes_of, source_targets
from tallylog.llm.pair_counts import alignments
from tallylog.llm.quotes import conversations
from tallylog.llm.simhash import simhash_groups
from tallylog.llm.token_blocks import store_ids
from tallylog.llm.token_counts import token_counts
from tallylog.llm.warc import archive_report

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations(read(spark, sf_dir, "conversations"))
    return found.withColumn("body_chars", F.length("body")).withColumn("body", F.sha2("body", 256))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(read(spark, sf_dir, "documents"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_ids(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"))


def op5_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(read(spark, sf_dir, "pages"))


def op7_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op10_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op11_pair_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op12_fast_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"))


def op13_bloom_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(read(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that ``op4_entropy_balancing`` mixes by, one row a source."""
    targets = source_targets(sizes_of(read(spark, sf_dir, "documents"))[0])
    return targets.select("source", "source_size", F.round("target", 3).alias("target"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op2_audio_features`` that SQL can tell."""
    return op2_audio_features(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotation_links": op1_quotation_links,
    "op2_audio_features": op2_audio_features,
    "op3_context_mixing": op3_context_mixing,
    "op4_entropy_balancing": op4_entropy_balancing,
    "op5_latent_leaks": op5_latent_leaks,
    "op6_warc_salvage": op6_warc_salvage,
    "op7_string_kernels": op7_string_kernels,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_license_paragraphs": op10_license_paragraphs,
    "op11_pair_hashing": op11_pair_hashing,
    "op12_fast_sketches": op12_fast_sketches,
    "op13_bloom_variants": op13_bloom_variants,
    "mix_targets": mix_targets,
    "media_payloads": media_payloads,
}
ORACLE_SQL: dict[str, str] = {
    "op6_warc_salvage": """
        WITH p AS (
            SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "media_payloads": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, greatest(1, (n + 191) // 192) * 192 AS padded FROM d)
        SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(padded AS BIGINT) AS payload_bytes, sha256(text || repeat(' ', padded - n)) AS payload_sha256, CAST(padded + 44 AS BIGINT) AS media_bytes
        FROM p""",
    # with the sources of least room for their weight first, a running sum tells the level of the others
    "mix_targets": """
        WITH s AS (
            SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS source_size FROM documents GROUP BY source
        ), r AS (
            SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
        ), w AS (
            SELECT *, CAST((sum(source_size) OVER () * 1.5 - coalesce(sum(2 * source_size) OVER b, 0)) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
            FROM r WINDOW b AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), f AS (
            SELECT *, (SELECT arg_min(level, 2 * source_size / weight) FROM w WHERE 2 * source_size > level * weight) AS shared FROM w
        )
        SELECT source, CAST(source_size AS BIGINT) AS source_size, round(coalesce(least(2.0 * source_size, shared * weight), 2.0 * source_size), 3) AS target FROM f""",
}
