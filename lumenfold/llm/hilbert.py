"""Sharding by a Hilbert curve over several metadata columns.

Each dimension is quantised to 2^BITS equal-count cells; a document's cell gets its index on the
Hilbert curve through the grid; the curve is cut into runs of about SHARD_SIZE. Documents
near on the curve are near in every dimension, so a file of one run has narrow ranges in all of them
and a filter on any prunes files.

No global sort: quantiles and run boundaries come from histograms, so a document's shard follows from its own row.
Ten bits a dimension tell apart all that the dimensions can tell: a number's histogram has some 2000 buckets, and
three dimensions have 2^30 cells, more than shards of 64 MB in an exabyte. Writing shuffles once, on the shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

BITS, SHARD_SIZE = 10, 64_000_000
#: The leading bits of the curve by which running sums are cut.
COARSE = 12


@dataclass(frozen=True)
class Dimension:
    """A column, and whether its values are numbers (quantised by size) or names (laid out in order of name)."""

    column: str
    numeric: bool = True


DIMENSIONS = (Dimension("n_chars"), Dimension("lang", False), Dimension("source", False))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of cells (n, dims), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the high bit
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    h = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            h = (h << 1) | ((x[i] >> b) & 1)
    return h


def _fine(d: Dimension, c: Column) -> Column:
    """The fine bucket of a value: its exact place for names; for numbers about 1.5 % of the value. Null is a bucket of its own."""
    if not d.numeric:
        return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit(""))
    v = c.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(-(1 << 40))).otherwise(F.signum(v).cast("long") * F.floor(F.log2(F.abs(v) + 1) * 46)).cast("long")


def cell_table(docs: DataFrame, d: Dimension, bits: int) -> DataFrame:
    """fine, cell: equal-count cells from a histogram over all documents, written once.

    Of a numeric dimension the histogram has some thousand buckets, of a name dimension as many as names. Running counts are
    made within ranges of buckets and over the ranges' sums, so no task sees all names, whatever they begin with.
    """
    h = docs.select(_fine(d, docs[d.column]).alias("fine")).groupBy("fine").agg(F.count(F.lit(1)).alias("n"))
    h = written(h.repartitionByRange("fine").withColumn("part", F.spark_partition_id()), "hilbert-histogram")
    # a row a range
    p = h.groupBy("part").agg(F.sum("n").alias("m"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    p = p.select(F.col("part").alias("part2"), F.coalesce(F.sum("m").over(over), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(p, F.col("part") == F.col("part2")).withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # a bucket lies in the cell of its middle document
    return written(h.select("fine", F.least(F.floor((F.col("before") + F.col("n") / 2) * (1 << bits) / F.col("total")), F.lit((1 << bits) - 1)).cast("int").alias("cell")), "hilbert-cells")


def assign_shards(docs: DataFrame, dimensions: Sequence[Dimension] = DIMENSIONS, bits: int = BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """docs' columns, and hilbert_index and shard (renamed with underscores where docs has such names).

    docs has doc_id (of any type), n_chars and the dimensions' columns. A shard holds about shard_size of n_chars (null and
    negative ones weigh 0, every document 1 more). Documents of one cell are alike in every dimension, as far as cells
    tell, and nothing prunes between them: a cell larger than a shard is spread over several by the hash of doc_id,
    or of the row where that is null. Nulls of a dimension have a cell of their own at the low end. Ties and repeated rows
    share a cell, and a shard unless the cell is spread. Texts aren't read. An empty table gives no rows.
    """
    h_col, s_col = fresh(docs, "hilbert_index", "shard")
    cells = fresh(docs, *[f"cell_{i}" for i in range(len(dimensions))])
    d = docs
    for dim, c in zip(dimensions, cells):
        fine, cell = fresh(d, "fine_key", c)
        t = cell_table(docs, dim, bits).select(F.col("fine").alias(fine), F.col("cell").alias(cell))
        d = d.join(t, _fine(dim, d[dim.column]) == F.col(fine)).drop(fine)

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], 1), bits))

    weight = F.greatest(F.coalesce(docs["n_chars"], F.lit(0)), F.lit(0)) + 1
    # a row for each cell of the curve that documents lie in
    grid = d.groupBy(*cells).agg(F.sum(weight).alias("w"))
    grid = grid.select(*cells, index(*[F.col(c) for c in cells]).alias(h_col), "w")
    top = F.shiftright(F.col(h_col), max(0, bits * len(dimensions) - COARSE))
    grid = written(grid.withColumn("top", top), "hilbert-grid")
    over = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)  # 2^COARSE rows at most
    base = grid.groupBy("top").agg(F.sum("w").alias("m")).select(F.col("top").alias("top2"), F.coalesce(F.sum("m").over(over), F.lit(0)).alias("front"))
    inside = Window.partitionBy("top").orderBy(h_col).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.join(base, F.col("top") == F.col("top2")).withColumn("before", F.col("front") + F.coalesce(F.sum("w").over(inside), F.lit(0)))
    grid = written(grid.select(*cells, h_col, F.expr(f"before div {shard_size}").alias("base"), F.ceil(F.col("w") / shard_size).cast("int").alias("split")), "hilbert-runs")
    first, split = fresh(d, "run_base", "run_split")
    g = grid.select(*[F.col(c).alias(c + "_g") for c in cells], h_col, F.col("base").alias(first), F.col("split").alias(split))
    d = d.join(g, [F.col(c) == F.col(c + "_g") for c in cells])
    row = [docs[c] for c, t in docs.dtypes if not t.startswith("map")]
    own = F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"])).otherwise(F.xxhash64(*row))
    spread = F.when(F.col(split) > 1, F.pmod(own, F.col(split))).otherwise(F.lit(0))
    return d.select(*[docs[c] for c in docs.columns], h_col, (F.col(first) + spread).alias(s_col))


def write_shards(docs: DataFrame, path: str, dimensions: Sequence[Dimension] = DIMENSIONS, bits: int = BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Write docs to path, a folder per shard, rows in curve order: Parquet's footers then prune by every dimension.

    Returns what was written: docs' columns, hilbert_index and shard. Cases as in assign_shards.
    """
    out = assign_shards(docs, dimensions, bits, shard_size)
    h_col, s_col = out.columns[-2:]
    out.repartition(F.col(s_col)).sortWithinPartitions(s_col, h_col).write.partitionBy(s_col).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def shard_report(shards: DataFrame, dimensions: Sequence[Dimension] = DIMENSIONS) -> DataFrame:
    """shard, documents, size, and least and greatest value of each dimension, of what write_shards returned."""
    s = shards.columns[-1]
    ranges = [f(d.column).alias(f"{n}_{d.column}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return shards.groupBy(s).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("size"), *ranges)


def shard_documents(docs: DataFrame, path: str, dimensions: Sequence[Dimension] = DIMENSIONS, bits: int = BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """doc_id, hilbert_index, shard, shard_documents and the shard's range in each dimension, of every row as it was written to path.

    docs is written whole, with all its columns. Cases as in assign_shards.
    """
    w = write_shards(docs, path, dimensions, bits, shard_size)
    h_col, s_col = w.columns[-2:]
    own = w.select(F.col("doc_id"), F.col(h_col).alias("hilbert_index"), F.col(s_col).alias("shard"))
    r = shard_report(w, dimensions).drop("size").withColumnRenamed(s_col, "shard").withColumnRenamed("documents", "shard_documents")
    return own.join(r, "shard").select("doc_id", "hilbert_index", "shard", "shard_documents", *[c for c in r.columns if c not in ("shard", "shard_documents")])
