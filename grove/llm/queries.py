"""The registered queries of this subpackage: one thin opN query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from grove.llm import bpe, ctw, omh, packing, quality, simhash, suffix_dedup, superkmers, toxicity, warc
from grove.llm.common import table


#: Where the vocabularies are: a parameter of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.edited(table(spark, sf_dir, "documents"))


def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("digest_holds")


def op7_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.digests(table(spark, sf_dir, "documents"))


def op9_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.ledger(table(spark, sf_dir, "documents"))
    base_failed = ~F.coalesce(quality.verdict("base-1"), F.lit(False))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rated.select(*columns, base_failed.alias("base_failed"), quality.verdict("full-1").alias("kept"), "fail_bits")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_order_minhash, op3_context_tree_weighting, op4_suffix_array_dedup, op5_toxicity_weak_supervision, op6_warc_revisits, op7_simhash_bit_sliced, op8_super_kmers, op9_bpe_prefix_dp, op10_quality_rules)}
