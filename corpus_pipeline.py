"""From raw documents to packed sequences: toxicity, quality rules, near duplicates, personal data, packing.

Every stage takes null ids and texts, empty and long texts, repeated rows, empty tables and columns of any name; all but the
last return the rows that they keep with all columns. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from parley.llm import jaccard, packing, pii, quality, toxicity
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to labelled rows of this stage's input, does not reject. Null and wordless
    texts are scored as texts without toxic words; without labels of both classes all documents stay."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules; null texts and those of fewer than ten words don't."""
    return quality.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with the smallest id (null last), of each group of near duplicates, also where rows or ids are repeated;
    documents without words all stay."""
    return jaccard.distinct_rows(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind and n_chars, if there is one, counted again; null
    texts stay null."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most 2048 tokens. A null or empty text is a
    piece of its end token; rows of one id are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 0)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("packing", pack_sequences)]
#: The stages score, tokenise and pack with models that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    from parley.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
