"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, jaccard, language, packing, quality, secrets, sharding, token_counts
from .common import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.VOCABULARY))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking, order and validation, on calls and results made from all conversations."""
    return chat.formatted(chat.with_calls(table(spark, sf_dir, "conversations"))).drop("json")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_ALL = (
    op1_bpe_round_trip,
    op2_chat_formatting,
    op3_quality_rules,
    op4_language_id,
    op5_ngram_jaccard,
    op6_token_counts,
    op7_packing,
    op8_secret_scan,
    op9_sharding,
    op10_inner_product_search,
    tool_call_links,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": chat.SQL, "tool_call_links": chat.LINKS_SQL}
