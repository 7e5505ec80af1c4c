"""Corpus pipeline: language, quality, near-duplicates, secrets, packing.

Every stage takes the documents that the one before it kept, as a table. The first four return the columns of `documents`
(the third and fourth with the rows or texts that their decision leaves), the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import lang_id, packing, quality, secrets, simhash
from posegrid.llm.common import split_of, table, written

#: A document goes when it has no language, or its language's probability is lower.
LEAST_LANGUAGE = 0.4
#: A document goes when its quality score is lower.
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.fit(docs, split_of("id", 4) != 2)
    if model is None:
        return docs
    judged = lang_id.judged(docs, model, "__lang")
    return judged.where((F.col("__lang.lang_pred") != lang_id.UNKNOWN) & (F.col("__lang.score") >= LEAST_LANGUAGE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, model, "__quality").where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the least id stays, with all its rows, repeated ones too; rows without an id stay and are not compared."""
    return simhash.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, secrets.frequent_words(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good_quality), ("near_dedup", near_dedup), ("secrets", without_secrets), ("packing", packed)]

#: SQL can't express the classifiers, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
