"""The corpus pipeline: quality rules, toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import mixing, packing, quality, simhash, toxicity
from lumenfold.llm.common import load, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go.

    Null, empty and wordless texts break one. A null lang is judged like a known one. Length alone breaks none. Repeated
    rows stay or go together; null ids, ties and other columns (clashing names too) change nothing; an empty table stays empty.
    """
    return quality.quality_filter(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the labels table teaches the lexicon.

    Null and empty texts stay. Very long texts are read whole, and judged by how thick their hits stand. Repeated rows
    stay or go together; null ids, ties and other columns change nothing; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least doc_id.

    Rows of a null doc_id and texts without a word (null and empty ones) stay as they are. Of repeated rows the first in
    its file stays; different texts of one doc_id all stay. Ties of the least doc_id go by fingerprint. Other columns change
    nothing; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them: sources above their weight lose some, others repeat.

    Null sources are one source; a null doc_id is an id of its own. Null and empty texts have no tokens and go. Rows that
    share doc_id, source and number of tokens are drawn alike. Other columns change nothing; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows over what is left.

    Documents stand in order of doc_id, null ones first, repeated ones side by side. Null and empty texts have no tokens and
    are in no window; sentences longer than a window are cut. Other columns don't matter; an empty table gives no windows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Near copies, learned lexicons and packing can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the last one's rows. Each stage is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
