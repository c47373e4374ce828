"""One query for each operator, over the whole table it is meant for, and SQL where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, hilbert, lm, mixing, packing, quality, simhash, sketch, toxicity, warc
from .common import load, shared_path


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(load(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, load(spark, sf_dir, "pages"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(load(spark, sf_dir, "documents"), shared_path(spark, "shards"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(load(spark, sf_dir, "documents"))


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_corpus(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_chat_format, op3_lm_score, op4_warc, op5_hilbert_shards, op6_toxicity, op7_quality, op8_sketch, op9_packing, op10_simhash)
}

SQL: dict[str, str] = {
    "op1_mixing": mixing.MIX_SQL,
    "op2_chat_format": chat.FORMAT_SQL,
    "op4_warc": "SELECT page_id, url, html FROM pages",
    "op7_quality": quality.metrics_sql(),
}
