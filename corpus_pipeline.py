"""Corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

STAGES are applied in order: quality classifier, near-duplicates (5-word
shingles, similarity 0.8), benchmark decontamination, mixing of sources, token
ids in binary files. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontaminate, mixing, near_dedup, quality_model, token_files
from skarn.llm.common import free_name, read_table, scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, scores 0.5 or more."""
    with scratch(spark):
        model = quality_model.train(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    score = free_name(docs, "__score")
    return quality_model.score(docs, model, into=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates."""
    return near_dedup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the shard files."""
    return token_files.read_tokens(token_files.write_tokens(docs, TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mixed),
    ("token ids", tokenized),
]
#: SQL can't express a trained classifier or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
