"""A training corpus in five stages: toxicity, language, near-duplicates, benchmark contamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it to the shared folder and reads it back as the next
stage's documents. The first four keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrow.llm import decontaminate, language_id, minhash_dedup, sentencepiece_fst, toxicity
from harrow.llm.common import drop_table, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts hold no insult and stay."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go, and so do null texts and texts without a letter."""
    return language_id.reject_unknown(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays. Texts without words are in no group and stay."""
    return minhash_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words are benchmark passages go; the others, and texts without words, stay as they
    are."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text (null: none, as for an empty one), and whether they decode to it."""
    return sentencepiece_fst.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The stages learn models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, table(stage(spark, docs, sf_dir), name)
        if hasattr(before, "table_path"):  # the next stage's output is written, so nothing reads it any more
            drop_table(before)
    return docs
