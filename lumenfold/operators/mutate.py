"""Edits: shallow merges by id with history, as new versions over immutable files."""

from __future__ import annotations

from collections.abc import Collection
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import same_elements
from ..schema import RECORD, as_records, from_record_json, record_json

EDITABLE = ("book", "number", "source", "part", "edition", "chapter", "publisher", "section", "volume", "tags", "notes", "english", "arabic")


def apply_patches(records: DataFrame, patches: DataFrame, user: str | None = None, allowed: Collection[str] | None = None) -> DataFrame:
    """records with each patch's non-null fields in place of their own (lists whole), and a note in history.

    patches has _id, at (a timestamp) and some of records' fields. Of several patches of an id the latest wins field by
    field. Where allowed is given, user must be in it.
    """
    if allowed is not None and user not in allowed:
        raise PermissionError(f"{user} may not edit")
    fields = [c for c in patches.columns if c not in ("_id", "at") and c in records.columns]
    # field by field the latest value that isn't null
    p = patches.groupBy("_id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"new_{c}") for c in fields], F.max("at").alias("at"))
    j = records.join(p.withColumnRenamed("_id", "patch_id"), F.col("_id") == F.col("patch_id"), "left")
    before = F.to_json(F.struct(*[F.col(c) for c in records.columns if c != "history"]))
    note = F.concat(F.lit(f"{user or 'someone'} at "), F.col("at").cast("string"), F.lit(": "), before, F.lit(" -> "), F.to_json(F.struct(*[F.col(f"new_{c}").alias(c) for c in fields])))
    out = []
    for c in records.columns:
        if c == "history":
            own = F.coalesce(F.col(c), F.array().cast("array<string>"))
            out.append(F.when(F.col("patch_id").isNotNull(), F.array_append(own, note)).otherwise(own).alias(c))
        else:
            out.append(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c))
    return j.select(*out)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The row of the highest version of each _id."""
    w = Window.partitionBy("_id").orderBy(F.desc("version"))
    return versions.withColumn("nth_version", F.row_number().over(w)).filter("nth_version = 1").drop("nth_version")


class Cache(Protocol):
    def clear(self) -> None: ...


VERSIONED = T.StructType([*RECORD.fields, T.StructField("version", T.LongType())])


class Versions:
    """Records as versions under a folder: an edit appends, a reader takes the highest version of each id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, records: DataFrame, version: Column | None = None) -> None:
        v = F.lit(0) if version is None else version
        out = as_records(records).select(*RECORD.fieldNames())
        out = out.withColumn("version", v.cast("long")) if version is None else records.select(*RECORD.fieldNames(), v.cast("long").alias("version"))
        out.write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(VERSIONED).parquet(self.path)

    def latest(self) -> DataFrame:
        return latest_versions(self.all())

    def edit(self, patches: DataFrame, user: str | None = None, allowed: Collection[str] | None = None, caches: Collection[Cache] = ()) -> None:
        """Check the user, merge patches into the latest versions of their records, check the results, append them, drop caches.

        Only patched records are read whole and written. A record that can't be read back from its own JSON fails
        the edit before anything is written. Patches of unknown ids change nothing.
        """
        own = self.all().join(patches.select(F.col("_id").alias("patched")).distinct(), F.col("_id") == F.col("patched"), "left_semi")
        merged = apply_patches(latest_versions(own), patches, user, allowed)
        back = from_record_json(record_json(merged), strict=True)
        checked = merged.withColumn("readable", back).filter(F.col("readable").isNotNull()).drop("readable")
        self.append(checked, F.col("version") + 1)
        for c in caches:
            c.clear()


def changed_fields(before: Column, after: Column, fields: Collection[str], lists: Collection[str] = ("tags",)) -> Column:
    """Names of fields of struct after that have a value unlike before's; lists are equal in any order. Fields without a value before don't count."""
    out = []
    for f in fields:
        a, b = before[f], after[f]
        same = same_elements(a, b) if f in lists else a.eqNullSafe(b)
        out.append(F.when(a.isNotNull() & b.isNotNull() & ~same, F.lit(f)))
    return F.array_compact(F.array(*out))
