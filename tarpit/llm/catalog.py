"""The registered queries of the operators and the pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, licenses, mixing, nn_descent, pii, quality, sharding, simhash, spelling, substrings, token_files, toxicity, word_runs
from .rows import table


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and zstandard-band verdict of every document."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and the licences of every document."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, by extendible hashing to at most 1 MiB of text."""
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op4_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of every document's source and the words the mix takes of it."""
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_nn_descent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 and their components over all vectors, found by NN-descent."""
    return nn_descent.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document after noisy-channel restoring of its words."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of their decoding."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_simhash_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document."""
    found = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in Simple-8b blocks, and a report read from them."""
    return token_files.write_and_report(table(spark, sf_dir, "documents"))


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict spans of personal data in every document, and those the span classifier adds."""
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, by block convolution, and what is left without the repeats."""
    return word_runs.run_report(table(spark, sf_dir, "documents"))


def op12_block_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without the 20-word windows that start earlier in the table."""
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


def op13_letter_count_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of the documents, by k-d trees."""
    return spelling.spelling_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_compression_bands, op2_license_sentences, op3_extendible_shards, op4_hash_threshold_mix, op5_nn_descent_links, op6_noisy_channel_toxicity, op7_segment_tree_bpe,
    op8_simhash_ball_hashing, op9_simple8b_files, op10_weak_supervision_pii, op11_word_runs, op12_block_anchor_repeats, op13_letter_count_variants, pipeline)}
ORACLES = {"op2_license_sentences": licenses.LICENSE_SQL, "op3_extendible_shards": sharding.SHARD_SQL, "op4_hash_threshold_mix": mixing.MIX_SQL,
           "op5_nn_descent_links": nn_descent.LINKS_SQL, "op11_word_runs": word_runs.RUNS_SQL, "op12_block_anchor_repeats": substrings.REPEATS_SQL,
           "op13_letter_count_variants": spelling.SPELLING_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
