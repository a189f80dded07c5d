"""A training corpus out of `documents`, in five stages. Each takes what its predecessor kept, as a table.

Every stage handles null and empty texts, null ids, repeated rows and extra columns as its operator's
docstring says; an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import decontaminate, neardup, packing, queries, secrets, toxicity
from tallyfield.llm.common import drop_stage, id_crc, staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), id_crc() % 4 != 2, queries.TOXIC_TRAIN_ROWS)
    return toxicity.reject(docs, lexicon, 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return neardup.deduplicate(docs, 5, 80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; those that hold nothing else go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), 10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in sequences of at most 1024 tokens."""
    return packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), 2, 1024)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_copies), ("decontamination", cut_benchmark), ("secrets", redact_secrets), ("packing", pack)]

# Scores and token ids have no SQL form; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
            drop_stage(before)  # nothing reads it any more
    return docs
