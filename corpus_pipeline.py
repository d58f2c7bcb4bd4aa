"""The corpus pipeline: quality classifier, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import common, linededup, nearcopies, quality
from helixlake.llm.queries import pack_documents


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The classifier learns from the labelled documents of its own input.

    Null and empty texts have the score of no features and go or stay together; null ids are scored but not learnt from.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, all rows stay; ``n_chars`` follows the text. Null texts stay null, equal rows are one document."""
    out = linededup.dedup(docs)
    return out.select([F.length("text").cast("long").alias(name) if name.lower() == "n_chars" else column for name, column in zip(docs.columns, common.quoted(docs.columns))])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest id stays, null ids last.

    Null and wordless texts are copies of each other; different texts of one id are different documents.
    """
    return nearcopies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, cut into pieces of sequences of 1024; null texts are empty, repeated rows documents of their own."""
    return pack_documents(docs)


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_lines), ("simhash_near_dedup", keep_one), ("packing", pack)]

#: None: SQL can express neither the classifier's training nor the tokenizer. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{at}/{number}-{name}")
        docs = spark.read.parquet(f"{at}/{number}-{name}")
    return docs
