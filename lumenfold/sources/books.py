"""Readers and writers of books, records and resources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RECORD, as_records, record_json


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    as_records(records).write.mode(mode).parquet(path)


def write_json(records: DataFrame, path: str) -> None:
    as_records(records).select(record_json(as_records(records))).write.text(path)


def get_by_id(records: DataFrame, record_id: str) -> DataFrame:
    return records.filter(F.col("_id") == record_id)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """chapter, note, english, arabic, section of a spreadsheet's CSV: no header, cells may hold line breaks."""
    names = ["chapter", "note", "unused", "english", "arabic", "section"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=False, multiLine=True, quote='"', escape='"').drop("unused")


def read_xml_rows(spark: SparkSession, path: str, row: str = "Row", cell: str = "Cell", data: str = "Data") -> DataFrame:
    """cells: the texts of each row's cells, in order."""
    schema = T.StructType([T.StructField(cell, T.ArrayType(T.StructType([T.StructField(data, T.StringType())])))])
    rows = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return rows.select(F.transform(cell, lambda c: F.coalesce(c[data], F.lit(""))).alias("cells"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc, page, text of text files whose pages end in form feeds."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    return docs.select("doc", F.posexplode(F.split("value", "\f")).alias("page", "text"))


def render_pages(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """doc, page, text of binary documents (PDF, say): pages_of makes the texts of a file's pages of its bytes.

    The reader that pages_of stands for isn't part of this package. A file is one task's row; pages leave it one by one.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for doc, content in zip(pdf["path"], pdf["content"]):
                text = pages_of(bytes(content))
                yield pd.DataFrame({"doc": doc, "page": range(len(text)), "text": text})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc string, page int, text string")


def ocr_text(response: str = "response"):
    """The text of an OCR service's JSON answer."""
    return F.get_json_object(response, "$.ParsedResults[0].ParsedText")


def latest_file(spark: SparkSession, folder: str) -> str | None:
    """The file changed last; None where there is none. Contents aren't read."""
    row = spark.read.format("binaryFile").load(folder).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return row[0]


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a short resource, such as a list of administrators."""
    return [r[0].strip() for r in spark.read.text(path).filter(F.trim("value") != "").collect()]


def read_blurbs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("book string, blurb string").json(path, multiLine=True)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """group_id, term: comma lists, a group a line; lines with # are comments."""
    t = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    t = t.select(F.xxhash64("value").alias("group_id"), F.explode(F.split("value", ",")).alias("term"))
    return t.select("group_id", F.trim("term").alias("term")).filter("term <> ''")


def expand_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """terms (term) and all terms that share a group with one of them."""
    s = synonyms.select("group_id", F.col("term").alias("other"))
    groups = terms.join(synonyms, "term").select("group_id").distinct()
    return terms.select("term").unionByName(groups.join(s, "group_id").select(F.col("other").alias("term"))).distinct()


def operation_log(df: DataFrame, error: str, path: str) -> None:
    """Rows' errors as text lines beside the output."""
    df.filter(F.col(error).isNotNull()).select(F.col(error).cast("string")).write.mode("append").text(path)
