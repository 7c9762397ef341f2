"""A training-corpus pipeline: language ID, near-dedup, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tonearm.llm import common, langid, minhash, mixing, secrets, sentencepieces

STAGES = [
    ("language_id", langid.stage),
    ("minhash_near_dedup", minhash.stage),
    ("secret_scan", secrets.stage),
    ("source_mixing", mixing.stage),
    ("sentencepiece", sentencepieces.stage),
]

#: Trained models and hashed signatures can't be written in SQL: the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # the table before is read no more
                common.delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
