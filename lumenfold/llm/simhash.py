"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: 128 bits over the set of a text's words (two 64-bit words). Two documents are
near copies where their fingerprints differ in at most RADIUS bits and the smaller
has at least RATIO as many distinct words as the larger. A group is a connected component
of that relation; the one of least doc_id stays. Copies count as one text in the comparison.

Plan
1. One scan makes (doc_id, fingerprint, size); equal fingerprints collapse to one entry.
2. Entries fall into size classes (powers of 1/RATIO: only a class and the next can match) and,
   within a class, stand in order of population count, cut into tiles of about TILE entries.
   Tile boundaries come from counts by (class, population count), a table of bounded size.
3. A pair of tiles is compared only if classes are neighbours and the ranges of population counts
   come within RADIUS: a larger difference in counts is a larger distance. The comparison is numpy's
   exclusive-or and bit count, block by block, with the same skip between blocks. A tile pair
   returns a spanning forest, so thousands of copies give thousands of edges, not millions.
4. The forest's components are found by hooking to the least neighbour and pointer
   jumping, each round written to the shared folder.

Nothing is approximate and no candidate is dropped. Comparison is quadratic in the distinct
fingerprints of neighbouring size classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_uri, fold, fresh, id_type, kept, mix, open_uri, shared_path, text_chunks, tidy, tidy_cogroup, word_hashes, words, written

RADIUS, RATIO, TILE, BLOCK = 20, 0.8, 32768, 512

#: A byte's bits as eight lanes of a 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_SECOND = np.uint64(0xA0761D6478BD642F)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 2) 64-bit words: bit i is set where more than half of a set's hashes have bit i set."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), 2), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    h = np.concatenate([sets[i] for i in some])
    n = size[some]
    starts = np.cumsum(n) - n
    # lanes hold 255 at most: sums run over pieces of 255 hashes, then over each set's pieces
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    piece = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for w in range(2):
        bits = np.ascontiguousarray(h if w == 0 else mix(h ^ _SECOND)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(_LANES[bits[:, byte]], piece)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            packed = np.packbits(2 * ones > n[:, None], axis=1).ravel()
            out[some, w] |= packed.astype(np.uint64) << np.uint64(8 * byte)
    return out


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for first, data, off in text_chunks(b.column(1)):
            data = fold(data)
            starts, ends, at = words(data, off)
            h = word_hashes(data, starts, ends)
            sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(len(off) - 1)]
            f = fingerprints(sets).view(np.int64)
            ids = b.column(0).slice(first, len(sets))
            yield pa.record_batch([ids, pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array([len(s) for s in sets], pa.int32())], names=["doc_id", "f0", "f1", "size"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f0, f1, size (distinct words) for every row; all 0 where there is no word."""
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return d.mapInArrow(tidy(_scan), f"doc_id {id_type(docs)}, f0 long, f1 long, size int")


def close_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, radius: int, ratio: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius. a and b are (n, 2), in order of population count."""
    ca, cb = (np.bitwise_count(x).sum(1).astype(np.int64) for x in (a, b))
    # one pair of buffers, small enough for a core's cache, serves all blocks
    diff, count, low = np.empty((BLOCK, BLOCK), np.uint64), np.empty((BLOCK, BLOCK), np.uint8), np.empty((BLOCK, BLOCK), np.bool_)
    y_first = np.ascontiguousarray(b[:, 0])
    for i in range(0, len(a), BLOCK):
        x0, x1 = a[i : i + BLOCK, 0].copy()[:, None], a[i : i + BLOCK, 1]
        for j in range(i if same else 0, len(b), BLOCK):
            y0, y1 = y_first[j : j + BLOCK], b[j : j + BLOCK, 1]
            if cb[j] - ca[i : i + BLOCK][-1] > radius or ca[i] - cb[j : j + BLOCK][-1] > radius:
                continue
            if len(x0) == BLOCK == len(y0):
                d0, c0, l0 = diff, count, low
            else:
                d0, c0, l0 = (np.empty((len(x0), len(y0)), t.dtype) for t in (diff, count, low))
            np.bitwise_xor(x0, y0[None, :], out=d0)
            np.bitwise_count(d0, out=c0)
            np.less_equal(c0, radius, out=l0)
            at = np.flatnonzero(l0.ravel())
            p, q = at // len(y0), at % len(y0)
            d = c0.ravel()[at].astype(np.int16) + np.bitwise_count(x1[p] ^ y1[q])
            near = d <= radius
            if same and i == j:
                near &= p < q
            p, q = p[near] + i, q[near] + j
            fit = np.minimum(na[p], nb[q]) >= ratio * np.maximum(na[p], nb[q])
            if fit.any():
                yield p[fit], q[fit]


class Forest:
    """Union-find over array positions, whole arrays of edges at a time; the root is the least position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            p, q = self.up[p], self.up[q]
            p, q = np.minimum(p, q), np.maximum(p, q)
            live = p != q
            p, q = p[live], q[live]
            if not len(p):
                return
            np.minimum.at(self.up, q, p)
            while True:
                two = self.up[self.up]
                if (two == self.up).all():
                    break
                self.up = two


def _tile_edges(radius: int, ratio: float):
    """Rows (a, b, n) of two tiles: a forest's edges with n null, and for each entry with links (a = b) the rows behind its links."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(t: pa.Table):
            t = t.sort_by([("pc", "ascending"), ("id", "ascending")])
            f = np.stack([t["f0"].to_numpy(), t["f1"].to_numpy()], 1).view(np.uint64)
            return t["id"].to_numpy(), f, t["size"].to_numpy().astype(np.int64), t["n"].to_numpy()

        empty = pa.table({k: pa.array([], pa.int64()) for k in "abn"})
        if not len(left):
            return empty
        ia, fa, na, ca = arrays(left)
        same = not len(right)  # a tile against itself has no right side
        ib, fb, nb, cb = (ia, fa, na, ca) if same else arrays(right)
        ids, copies = (ia, ca) if same else (np.concatenate([ia, ib]), np.concatenate([ca, cb]))
        forest, shift, links = Forest(len(ids)), 0 if same else len(ia), np.zeros(len(ids), np.int64)
        for p, q in close_pairs(fa, fb, na, nb, radius, ratio, same):
            q = q + shift
            forest.add(p, q)
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
        child, linked = np.flatnonzero(forest.up != np.arange(len(ids))), np.flatnonzero(links)
        if not len(linked):
            return empty
        return pa.table({"a": pa.array(np.concatenate([ids[forest.up[child]], ids[linked]])), "b": pa.array(np.concatenate([ids[child], ids[linked]])), "n": pa.concat_arrays([pa.nulls(len(child), pa.int64()), pa.array(links[linked])])})

    return run


def edges(entries: DataFrame, radius: int, ratio: float, tile: int) -> DataFrame:
    """a, b, n: a spanning forest of the near-copy relation over entries (id, f0, f1, size, n), and rows of links; see _tile_edges."""
    step = math.log(1 / ratio)
    # a margin keeps a size that lies on a class boundary in one class on every machine
    cls = F.floor(F.log(F.col("size").cast("double")) / step + 1e-9)
    e = entries.withColumns({"cls": cls, "pc": (F.bit_count("f0") + F.bit_count("f1")).cast("int")})
    cells = e.groupBy("cls", "pc").agg(F.count(F.lit(1)).alias("m"))
    over = Window.partitionBy("cls").orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("m").over(over), F.lit(0)))
    # A cell larger than a tile is spread over several by hash. At most 129 cells a class.
    cells = written(cells.select("cls", "pc", F.expr(f"before div {tile}").alias("base"), F.greatest(F.ceil(F.col("m") / tile), F.lit(1)).cast("int").alias("split")), "simhash-cells")
    tiled = e.join(cells.withColumnRenamed("cls", "c2").withColumnRenamed("pc", "p2"), (F.col("cls") == F.col("c2")) & (F.col("pc") == F.col("p2")))
    own = F.struct(F.col("base").alias("base"), F.when(F.col("split") == 1, F.lit(-1)).otherwise(F.col("pc")).alias("own"), F.pmod(F.xxhash64("id"), F.col("split")).alias("salt"))
    tiled = written(tiled.select("id", "f0", "f1", "size", "n", "cls", "pc", own.alias("t")), "simhash-tiles")
    tiles = tiled.groupBy("cls", "t").agg(F.min("pc").alias("lo"), F.max("pc").alias("hi"))
    tiles = written(tiles, "simhash-tile-list")
    x, y = tiles.select(F.col("cls").alias("xc"), F.col("t").alias("xt"), F.col("lo").alias("xl"), F.col("hi").alias("xh")), tiles.select(F.col("cls").alias("yc"), F.col("t").alias("yt"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    near = (F.col("yl") - F.col("xh") <= radius) & (F.col("xl") - F.col("yh") <= radius)
    pairs = x.join(y, F.col("xc") == F.col("yc")).filter(near & (F.col("xt") <= F.col("yt"))).unionByName(x.join(y, F.col("xc") + 1 == F.col("yc")).filter(near))
    pairs = written(pairs.select("xc", "xt", "yc", "yt", F.xxhash64("xc", "xt", "yc", "yt").alias("pair")), "simhash-pairs")
    left = tiled.join(pairs, (F.col("cls") == F.col("xc")) & (F.col("t") == F.col("xt"))).select("pair", "id", "f0", "f1", "size", "n", "pc")
    other = pairs.filter((F.col("xc") != F.col("yc")) | (F.col("xt") != F.col("yt")))
    right = tiled.join(other, (F.col("cls") == F.col("yc")) & (F.col("t") == F.col("yt")))
    right = right.select(*[F.col(c).alias(c) for c in ("pair", "id", "f0", "f1", "size", "n", "pc")])
    return left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(tidy_cogroup(_tile_edges(radius, ratio)), "a long, b long, n long")


def components(links: DataFrame) -> DataFrame:
    """id, root: the least id of each connected component, for every id that links name.

    Rounds of hooking to the least neighbour and contracting: every round at least halves the
    components that still have links, so the rounds grow with the logarithm of the input.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "cc-hook")
        while True:  # pointer jumping: hooks only lead to lesser ids
            up = hook.select(F.col("id").alias("k"), F.col("root").alias("next"))
            two = written(hook.join(up, F.col("root") == F.col("k")).select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "cc-jump")
            hook = two.select("id", "root")
            if two.filter("moved").isEmpty():
                break
        maps.append(hook)
        ra, rb = hook.select(F.col("id").alias("ka"), F.col("root").alias("ra")), hook.select(F.col("id").alias("kb"), F.col("root").alias("rb"))
        links = links.join(ra, F.col("a") == F.col("ka")).join(rb, F.col("b") == F.col("kb")).filter("ra != rb")
        links = written(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-links")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[0]
    for m in maps[1:]:
        later = m.select(F.col("id").alias("k"), F.col("root").alias("r"))
        out = out.join(later, F.col("root") == F.col("k"), "left").select("id", F.coalesce("r", "root").alias("root"))
    return out


def _classes(f: DataFrame, radius: int, ratio: float, tile: int) -> DataFrame:
    """f0, f1, size, n_links, best (doc_id, f0, f1, size of the text that is kept) of the fingerprints in groups of several documents.

    f has a row for each (doc_id, f0, f1, size).
    """
    # an entry's number is fixed by being written
    entries = f.groupBy("f0", "f1", "size").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    entries = written(entries.withColumn("id", F.monotonically_increasing_id()), "simhash-entries")
    found = written(edges(entries.select("id", "f0", "f1", "size", "n"), radius, ratio, tile), "simhash-links")
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("far"))
    root = components(found.filter("n IS NULL").select("a", "b"))
    e = entries.join(root.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left").withColumn("root", F.coalesce("root", "id")).drop("k")
    e = e.join(links, F.col("id") == F.col("linked"), "left")
    e = written(e.select("f0", "f1", "size", "root", "least", "n", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links")), "simhash-classes")
    # of several texts of the least doc_id one is kept: the one of the least fingerprint
    groups = e.groupBy("root").agg(F.sum("n").alias("members"), F.min(F.struct("least", "f0", "f1", "size")).alias("best")).filter("members > 1")
    return e.join(groups.withColumnRenamed("root", "r2"), F.col("root") == F.col("r2")).select("f0", "f1", "size", "n_links", "best")


def _kept() -> Column:
    return (F.col("doc_id") == F.col("best.least")) & (F.struct("f0", "f1", "size") == F.struct("best.f0", "best.f1", "best.size"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, ratio: float = RATIO, tile: int = TILE) -> DataFrame:
    """doc_id, group_id, n_links, kept: the members of every group of two documents or more.

    group_id is the least doc_id of the group, n_links the number of documents that this one is near to, copies among them.
    docs needs doc_id (of any type that sorts) and text; other columns are ignored, whatever their names. Rows of a null
    doc_id, and texts without a word (null and empty ones), belong to no group. Texts of any length are read whole.
    A repeated row (doc_id and fingerprint) is one document; different texts of one doc_id are documents of their own, each
    with its row. Of several texts of the least doc_id the one of the least fingerprint is kept. An empty table gives
    no rows.
    """
    f = written(document_fingerprints(docs).filter("doc_id IS NOT NULL AND size > 0").distinct(), "simhash-prints")
    m = f.join(_classes(f, radius, ratio, tile), ["f0", "f1", "size"])
    return m.select("doc_id", F.col("best.least").alias("group_id"), "n_links", _kept().alias("kept"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, ratio: float = RATIO, tile: int = TILE) -> DataFrame:
    """docs, with all their columns, with one document of each group.

    Which rows are documents and which is kept: see near_duplicates. Of rows that repeat a doc_id and fingerprint the
    first in its file stays. Different texts that share a doc_id are no copies of one another and both stay. Rows of a null
    doc_id and texts without a word stay as they are. An empty table gives no rows.

    Rows are known by their place, a file and a number in it, so docs is read from files: as it is where it comes from
    Parquet, else written first. Texts are read twice and never shuffled: the places to drop are laid out by file, and
    a task reads those of the files it scans.
    """
    spark = docs.sparkSession
    file, row = fresh(docs, "own_file", "own_row")
    placed = _placed(docs, file, row)
    d = placed.select(F.struct(placed["doc_id"].alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row")).alias("doc_id"), placed["text"].alias("text"))
    f = document_fingerprints(d).filter("doc_id.doc_id IS NOT NULL AND size > 0").select("doc_id.doc_id", "doc_id.file", "doc_id.row", "f0", "f1", "size")
    f = written(f, "simhash-prints")
    # the first place of each document stands for it
    one = written(f.groupBy("doc_id", "f0", "f1", "size").agg(F.min(F.struct("file", "row")).alias("first")), "simhash-documents")
    lost = one.join(_classes(one.select("doc_id", "f0", "f1", "size"), radius, ratio, tile), ["f0", "f1", "size"]).filter(~_kept())
    gone = lost.select("first.file", "first.row")
    again = one.join(f.groupBy("doc_id", "f0", "f1", "size").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), ["doc_id", "f0", "f1", "size"]).drop("rows")
    more = f.join(again, ["doc_id", "f0", "f1", "size"]).filter(F.struct("file", "row") != F.col("first")).select("file", "row")
    path = shared_path(spark, "simhash-gone")
    gone.unionByName(more).repartition("file").sortWithinPartitions("file", "row").write.partitionBy("file").parquet(path)
    default, names = default_uri(spark), docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in it:
            where, at = b.column(len(names)), b.column(len(names) + 1).to_numpy()
            keep = np.ones(len(b), bool)
            for name in where.unique().to_pylist():
                if name not in known:
                    known.clear()
                    known[name] = _gone_rows(path, name, default)
                own = where.to_numpy(False) == name
                keep[own] = ~np.isin(at[own], known[name])
            yield from kept(pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names), keep)

    return placed.mapInArrow(tidy(run), docs.schema)


def _placed(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with each row's file (a digest of its path) and its number in it."""
    for d in (docs, None):
        d = written(docs, "simhash-input") if d is None else d
        try:
            at = d.metadataColumn("_metadata")
            return d.select("*", F.concat_ws("-", F.xxhash64(at["file_path"]).cast("string"), F.hash(at["file_path"]).cast("string")).alias(file), at["row_index"].alias(row))
        except AnalysisException:  # no plain scan of Parquet files
            if d is not docs:
                raise
    raise AssertionError


def _gone_rows(path: str, name: str, default: str) -> np.ndarray:
    """The numbers of the rows to drop of one file."""
    system, root = open_uri(f"{path}/file={name}", default)
    files = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [pq.read_table(f, filesystem=system, partitioning=None, columns=["row"])["row"].to_numpy() for f in files]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64)
