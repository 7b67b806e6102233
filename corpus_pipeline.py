"""A training-data pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes the documents its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import bpe, mixing, rules, secrets, simhash
from loomtext.llm.common import shared_folder


# All stages: an empty table gives an empty one; very long texts are taken whole; columns beside doc_id, text, source and
# n_chars may have any names and are kept as they are.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go; rows that repeat stay or go together, ids may be null."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id, rows without an id last; of equal rows one.

    Null and empty texts are like each other. Texts that are no near-duplicates stay apart, also under one id.
    """
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked. A null text stays null; rows that repeat or have no id are kept."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one like any other, its weight the last. Null and empty texts have no words and are taken as often as
    the whole part of their source's rate says. Rows that repeat an id or have none are rounded like any other.
    """
    return mixing.apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix. Null text counts as empty; one row per row."""
    return bpe.digests(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing sources", source_mix), ("byte-level BPE", byte_bpe)]

#: The language of the SQL check has neither XXH64 nor byte-level BPE; tests hold run() against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Between stages the documents are written to the folder that all executors share. What a stage wrote is deleted once the
    next one has written its own; the documents that the last stage reads stay for as long as its result is used.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            _remove(spark, f"{base}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
