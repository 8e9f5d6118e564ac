"""The corpus pipeline: filter, deduplicate, redact and pack documents.

Each stage reads the Parquet that the one before it wrote, so a stage can be run again on its own and a
lost executor costs no more than the stage at work.  What a stage wrote for itself goes when it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pangraph_spark.llm import common, corpus_stages

STAGES = [
    ("toxicity", corpus_stages.drop_toxic),
    ("ngram_jaccard_join", corpus_stages.drop_near_duplicates),
    ("substring_dedup", corpus_stages.drop_repeated_passages),
    ("secret_scan", corpus_stages.redact_secrets),
    ("best_fit_packing", corpus_stages.pack_sequences),
]

# a trained model and a tokenizer take part, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per packed piece."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with common.dropped() as keep:
            docs = keep(common.cut(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
