"""A pipeline for training documents: each stage is one operator of grove.llm applied to what the stage before kept.

Every stage takes (spark, docs, sf_dir), docs being the Parquet table that the stage before wrote, and all but the last
return documents with the columns of the table they got. Texts that suffix-array dedup shortens have n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grove.llm import packing, quality, simhash, suffix_dedup, toxicity
from grove.llm.common import table
from grove.llm.queries import WORD_BPE
from grove.storage import cut


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rates toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the newest policy go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts at five-word Jaccard similarity of 0.8 or more the document with the smallest id stays."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that occur more than once go."""
    return suffix_dedup.dedup(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of training sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: A classifier is trained and tokens are counted on the way: SQL can't express these. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
