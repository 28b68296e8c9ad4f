"""From raw documents to packed training sequences, one stage after another.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns
the documents it keeps, the last one the packed pieces. Results are written as Parquet in
the shared folder and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from siftwall.llm import stages  # noqa: E402
from siftwall.session import stage  # noqa: E402

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("quality_rules", stages.quality_rules),
    ("exact_dedup", stages.exact_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("packing", stages.packing),
]

#: Scores of a fitted model, connected components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
