"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ascending list of the k least distinct hashes (as signed 64-bit integers,
ordered as such) of a text's word shingles. Sketches of parts merge into the sketch of the whole;
two sketches estimate resemblance, containment and, alone, the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, id_type, mix, text_chunks, word_hashes, words, written

K, SHINGLE = 128, 5
_A = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of each run of width words; of all words where there are fewer."""
    n = min(width, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _A + h[i : i + len(out)]
    return mix(out + np.uint64(n))


def text_sketches(column: pa.Array, k: int = K, width: int = SHINGLE) -> Iterator[tuple[np.ndarray, int]]:
    """For each text its sketch and its number of shingles, repeats counted."""
    for _, data, off in text_chunks(column):
        data = fold(data)
        starts, ends, at = words(data, off)
        h = word_hashes(data, starts, ends)
        for i in range(len(off) - 1):
            s = shingle_hashes(h[at[i] : at[i + 1]], width).view(np.int64)
            yield np.unique(s)[:k], len(s)


def sketch_documents(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles (repeats counted), sketch, distinct_shingles (estimated; exact below k).

    docs has doc_id (of any type) and text; other columns are ignored, whatever their names. A text of fewer than
    width words is one shingle. Null, empty and wordless texts have an empty sketch and 0 shingles.
    Texts of any length are read whole. Repeated rows give equal sketches; a null doc_id is carried; equal
    hashes are one; an empty table gives no rows. One scan, no shuffle.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not len(b):
                continue
            parts, size = zip(*text_sketches(b.column(1), k, width))
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), lists], names=["doc_id", "n_shingles", "sketch"])

    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    out = d.mapInArrow(run, f"doc_id {id_type(docs)}, n_shingles long, sketch array<long>")
    return out.withColumn("distinct_shingles", distinct_count(F.col("sketch"), k))


# Estimators over sketches, as Spark expressions. A null sketch counts as empty, on either side.


def _own(s: Column) -> Column:
    return F.coalesce(s, F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.array_sort(F.array_union(_own(a), _own(b))), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """(k - 1) over the share of the hash space below the k-th hash; the sketch's size where it isn't full."""
    share = (F.element_at(s, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(_own(s)) < k, F.size(_own(s)).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both have; 0 where both are empty."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(u, F.array_intersect(_own(a), _own(b))))
    return F.when(F.size(u) > 0, both / F.size(u)).otherwise(F.lit(0.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a that is in b: resemblance times the union's count over a's, 1 at most; 0 where a is empty."""
    n = distinct_count(_own(a), k)
    return F.when(n > 0, F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / n)).otherwise(F.lit(0.0))


def merge_groups(sketches: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, n_documents, n_shingles, sketch: one merged sketch for each key (null is a key), of sketches with key, n_shingles, sketch.

    A key's sketch reaches no further than the least k-th hash of its rows' full ones, so most hashes go before any
    shuffle. The others are shuffled once a task and spread by their own value; then the k least of a key are ranked, of
    which every task sends k at most, however many rows a key has.
    """
    s = sketches.select(sketches[key].alias("key"), sketches["n_shingles"].alias("n"), sketches["sketch"].alias("s"))
    size = s.groupBy("key").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_shingles"), F.min(F.when(F.size("s") >= k, F.element_at("s", k))).alias("bound"))
    size = written(size, "sketch-bounds")
    bound = size.select(F.col("key").alias("key3"), "bound")
    near = s.join(bound, F.col("key").eqNullSafe(F.col("key3")))
    h = near.select("key", F.explode(F.filter("s", lambda x: F.col("bound").isNull() | (x <= F.col("bound")))).alias("h")).distinct()
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("h"))).filter(F.col("rank") <= k)
    h = h.groupBy("key").agg(F.array_sort(F.collect_list("h")).alias("sketch")).withColumnRenamed("key", "key2")
    out = size.join(h, F.col("key").eqNullSafe(F.col("key2")), "left")
    return out.select(F.col("key").alias(key), "n_documents", "n_shingles", _own(F.col("sketch")).alias("sketch"))


def fingerprint_corpus(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """The sketches of documents, of sources and of the corpus in one table, and what a source gives to the corpus.

    level ("document", "source" or "corpus"), doc_id, source, n_documents, n_shingles, sketch, distinct_shingles
    (estimated), resemblance and containment. For a source these two compare it with the whole corpus: containment is
    the share of the corpus' distinct shingles that the source holds. Elsewhere both are null.

    docs has doc_id (of any type), source and text; other columns are ignored, whatever their names. A null source is a
    source of its own. Texts as in sketch_documents. An empty table gives the corpus' row alone, empty.
    """
    spark = docs.sparkSession
    own = docs.select(F.struct(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source")).alias("doc_id"), docs["text"].alias("text"))
    d = written(sketch_documents(own, k, width).select("doc_id.doc_id", "doc_id.source", "n_shingles", "sketch", "distinct_shingles"), "sketches")
    s = written(merge_groups(d, "source", k), "sketch-sources")
    # a row a source: their union is the corpus
    c = merge_groups(s.withColumn("all", F.lit(0)), "all", k).select("sketch")
    sizes = s.agg(F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n_shingles"))
    none = spark.createDataFrame([([],)], "sketch array<bigint>")
    c = c.unionByName(none).orderBy(F.desc(F.size("sketch"))).limit(1)
    whole = written(sizes.crossJoin(F.broadcast(c)), "sketch-corpus")  # one row each
    t = s.crossJoin(F.broadcast(whole.select(F.col("sketch").alias("w"))))  # one row
    a, w = F.col("sketch"), F.col("w")
    n = F.lit(None).cast("double")
    no_id = F.lit(None).cast(id_type(docs))
    document = d.select(F.lit("document").alias("level"), "doc_id", "source", F.lit(1).cast("long").alias("n_documents"), "n_shingles", "sketch", "distinct_shingles", n.alias("resemblance"), n.alias("containment"))
    source = t.select(F.lit("source").alias("level"), no_id.alias("doc_id"), "source", "n_documents", "n_shingles", "sketch", distinct_count(a, k).alias("distinct_shingles"), resemblance(a, w, k).alias("resemblance"), containment(w, a, k).alias("containment"))
    corpus = whole.select(F.lit("corpus").alias("level"), no_id.alias("doc_id"), F.lit(None).cast("string").alias("source"), "n_documents", "n_shingles", "sketch", distinct_count(a, k).alias("distinct_shingles"), n.alias("resemblance"), n.alias("containment"))
    return document.unionByName(source).unionByName(corpus)
