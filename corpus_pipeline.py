"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import bpe, jaccard, language, packing, quality, secrets
from cairnspark.llm.common import shared_folder, table

#: Near copies in the pipeline: shingles of so many words, similar from so many per cent on.
SHINGLE, PERCENT = 5, 80
#: A language must be this likely.
CERTAIN = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose posterior probability of being clean is high enough."""
    return quality.accepted(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and, if there is a language to learn, those whose language is uncertain."""
    model = language.train(docs.where(~language.held_out()))
    if not model.languages:
        return language.lettered(docs)
    return language.certain(docs, model, CERTAIN)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id."""
    return jaccard.representatives(docs, percent=PERCENT, size=SHINGLE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; the character count follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(out.schema["n_chars"].dataType))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token windows of what is left."""
    return packing.pack(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_copies", near_copies), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL cannot express weak supervision, naive Bayes or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
