"""The record schema, and adapters from plain tables to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = ("source", "book", "number", "part", "edition", "chapter", "publisher", "section", "volume", "notes", "arabic", "english")
GRADING = T.StructType([T.StructField(c, T.StringType()) for c in ("grader", "rationale", "grading")])
RELATED = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "description")])
LISTS = {"tags": T.ArrayType(T.StringType()), "gradings": T.ArrayType(GRADING), "related": T.ArrayType(RELATED), "history": T.ArrayType(T.StringType())}
#: Order of keys in a record's JSON.
KEYS = ("source", "book", "number", "part", "edition", "chapter", "publisher", "section", "volume", "tags", "notes", "arabic", "english", "gradings", "related", "history")
RECORD = T.StructType(
    [T.StructField("_id", T.StringType(), False)]
    + [T.StructField(k, LISTS.get(k, T.StringType())) for k in KEYS]
    + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
#: Two records are the same where these agree, nulls included.
IDENTITY = ("number", "book", "chapter", "section", "source", "english", "volume", "part", "arabic")
TEXT_FIELDS = tuple(k for k in KEYS if k in SCALARS and k != "number")


def as_records(df: DataFrame) -> DataFrame:
    """df with every record column: what lacks is null, lists are never null."""
    have = set(df.columns)
    out = []
    for f in RECORD.fields:
        c: Column = F.col(f.name) if f.name in have else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in LISTS:
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def documents_as_records(docs: DataFrame) -> DataFrame:
    """The documents table as records: text is english, lang the book, source the chapter too."""
    return docs.select(
        F.col("doc_id").cast("string").alias("_id"),
        "source",
        F.col("lang").alias("book"),
        F.col("doc_id").cast("string").alias("number"),
        F.col("source").alias("chapter"),
        F.col("text").alias("english"),
    )


def record_json(df: DataFrame) -> Column:
    """A record's JSON: keys in fixed order, nulls left out, unknown keys flattened in at the end."""
    known = F.to_json(F.struct(*[F.col(k) for k in KEYS]))
    extra = F.to_json("extra") if "extra" in df.columns else F.lit(None)
    body = lambda c: F.regexp_replace(c, r"^\{|\}$", "")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(F.length(body(c)) > 0, body(c)) for c in (known, extra)]), F.lit("}"))


def from_record_json(c: Column, strict: bool = True) -> Column:
    """A record struct from JSON; strict fails the query on a record that can't be read."""
    return F.from_json(c, RECORD, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
