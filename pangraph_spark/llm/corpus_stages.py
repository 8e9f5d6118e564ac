"""The stages of the corpus pipeline; each takes ``(spark, docs, sf_dir)`` and returns a table.

All but the last return the columns of documents.  A stage works on every row of what it is given, reads
texts whole however long they are, and gives an empty table for an empty one.  Further columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, packing, secrets, similarity, substrings, toxicity


def _recounted(docs: DataFrame) -> DataFrame:
    """The table with ``n_chars`` as long as its texts, where it has that column; null texts keep theirs."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the documents that the toxicity model rejects.

    Null and empty texts score as texts without evidence do and stay; repeated rows are judged alike, and
    rows without id as any other.
    """
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, the one of the smallest id.

    Null and empty texts and rows without id are like nothing and stay; rows of one id and text stay once.
    """
    return similarity.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out of texts that begin earlier in the corpus.

    Null and empty texts stay as they are.  Rows of one id follow one another by text, those without id come
    first; of repeated rows the first keeps its passages.
    """
    return _recounted(substrings.dedup(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts.  Null texts stay null; repeated rows are treated alike."""
    return _recounted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens.

    Null and empty texts are one token, the end mark; repeated rows and rows without id are packed each.
    """
    return packing.pack(docs, common.tokenizer_path())
