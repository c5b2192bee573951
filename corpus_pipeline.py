"""Corpus pipeline: toxicity, n-gram Jaccard join, decontamination, secret scans, byte-level BPE."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard, secrets, toxicity
from tidemark.llm.common import shared_folder

STAGES = [
    ("toxicity", toxicity.stage),
    ("jaccard", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL cannot express these stages; tests/llm hold run() against its stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and read by the next."""
    base = f"{shared_folder(spark)}-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
