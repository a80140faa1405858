"""A corpus pipeline over `documents`: quality rules, near-dedup, personal data, mixing, encoding.

Each stage is one of the training-data operators and takes what its predecessor kept; stages are
written as Parquet in the shared folder and read again, so the loss of executors never reaches back
beyond a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactgrid.llm import bpe, mixing, pii, quality, simhash
from contactgrid.llm.common import materialize

#: (name, (spark, docs, sf_dir) -> DataFrame).  All but the last return the columns of documents.
STAGES = [
    ("quality", quality.quality_stage),
    ("near_dedup", simhash.dedup_stage),
    ("personal_data", pii.redact_stage),
    ("mixing", mixing.mix_stage),
    ("byte_bpe", bpe.encode_stage),
]

#: The classifier of the first stage and the fingerprints of the second can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
