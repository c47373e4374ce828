"""Packing: order-preserving dynamic programming over sentence boundaries.

Documents stand in order of doc_id. Between two sentences, or two documents, a window of
CAPACITY tokens may be cut. A window costs its padding, and a cut inside a document costs
CUT_PENALTY tokens on top (a truncation). A sentence longer than a window has extra cut points
every CAPACITY tokens, which cost HARD_PENALTY. With S the tokens before a cut point,

    f(j) = CAPACITY - S(j) + penalty(j) + min { f(i) + S(i) : i < j, S(j) - S(i) <= CAPACITY },

the least over a sliding range of i, kept in a monotone queue: linear time.

Documents are packed within shards: a shard is the documents that begin within SHARD_TOKENS tokens of the sequence,
which bounds a task and keeps the order whatever the ids are. The tokens before a document are those before it in its
range of ids and those of the ranges before. Only sentence lengths are shuffled, never text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, text_chunks, tidy, tidy_group, written

CAPACITY, CUT_PENALTY, HARD_PENALTY, SHARD_TOKENS = 2048, 64, 256, 1 << 19

_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, np.bool_)
_STOP[[ord(c) for c in ".!?"]] = True


def sentence_lengths(data: np.ndarray, off: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, tokens and end (in characters) of each unit, and whether a hard cut ends it.

    Tokens are runs of anything but ASCII white space. A sentence ends after a token that ends
    in . ! or ?, and where a line ends. A unit is a sentence, or capacity tokens of a longer one.
    """
    solid = ~_SPACE[data]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    cut = off[1:-1]
    cut = cut[cut > 0]
    tail[cut - 1] |= solid[cut - 1]
    ends = np.flatnonzero(tail)  # last byte of each token
    chars = np.cumsum((data & 0xC0) != 0x80)
    lines = np.cumsum(data == 10)
    stop = _STOP[data[ends]]
    if len(ends):
        stop[:-1] |= lines[ends[1:]] > lines[ends[:-1]]
    at = np.searchsorted(ends, off)
    for i in range(len(off) - 1):
        a, b = at[i], at[i + 1]
        last = np.flatnonzero(stop[a:b])
        if b > a and (not len(last) or last[-1] != b - a - 1):
            last = np.append(last, b - a - 1)
        stops, n = last, np.diff(last, prepend=-1)
        if len(n) and n.max() > capacity:
            more = [np.arange(e - k + capacity, e, capacity) for e, k in zip(last[n > capacity].tolist(), n[n > capacity].tolist())]
            last = np.sort(np.concatenate([last, *more]))
        before = chars[off[i] - 1] if off[i] else 0
        yield np.diff(last, prepend=-1), chars[ends[a + last]] - before, ~np.isin(last, stops)


def cut_windows(sizes: list[int], penalties: list[int], capacity: int = CAPACITY) -> tuple[int, list[int]]:
    """The least cost, and the units after which windows end (the last one included).

    sizes[i] <= capacity; penalties[i] is the price of a cut after unit i; the last is free.
    Of equal costs the longest window wins, so the result is one.
    """
    n = len(sizes)
    total, best, back = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    queue: deque[int] = deque()
    value = 0
    for j in range(1, n + 1):
        total[j] = total[j - 1] + sizes[j - 1]
        # i = j - 1 enters; larger values behind it can't win again
        value = best[j - 1] + total[j - 1]
        while queue and best[queue[-1]] + total[queue[-1]] > value:
            queue.pop()
        queue.append(j - 1)
        least = total[j] - capacity
        while total[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        best[j] = best[i] + total[i] + capacity - total[j] + (penalties[j - 1] if j < n else 0)
        back[j] = i
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = back[j]
    return best[n], cuts[::-1]


def _units(capacity: int):
    """doc_id, unit sizes, character ends and hard cuts of each text with a token."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, sizes, ends, hard = [], [], [], []
            for first, data, off in text_chunks(b.column(1)):
                for i, (n, e, h) in enumerate(sentence_lengths(data, off, capacity)):
                    if len(n):
                        ids.append(first + i)
                        sizes.append(n)
                        ends.append(e)
                        hard.append(h)
            if ids:
                to = pa.array(np.cumsum([0, *map(len, sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(to, pa.array(np.concatenate(x).astype(t))) for x, t in ((sizes, np.int32), (ends, np.int32), (hard, np.bool_))]
                yield pa.record_batch([b.column(0).take(pa.array(ids)), *lists], names=["doc_id", "sizes", "ends", "hard"])

    return run


def _pack(capacity: int, cut_penalty: int, hard_penalty: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("before", "ascending"), ("nth", "ascending")])
        shard = table["shard"][0]
        ids, all_sizes, all_ends, all_hard = table["doc_id"].to_pylist(), table["sizes"], table["ends"], table["hard"]
        sizes, price, kind, doc, end = [], [], [], [], []
        for d in range(len(ids)):
            for n, e, h in zip(all_sizes[d].as_py(), all_ends[d].as_py(), all_hard[d].as_py()):
                sizes.append(n)
                price.append(hard_penalty if h else cut_penalty)
                kind.append("hard" if h else "sentence")
                doc.append(d)
                end.append(e)
            price[-1], kind[-1] = 0, "document"
        _, cuts = cut_windows(sizes, price, capacity)
        out = {k: [] for k in ("shard", "window", "n_tokens", "padding", "cut", "doc_ids", "starts", "ends")}
        i = 0
        for w, c in enumerate(cuts):
            n = sum(sizes[i : c + 1])
            rows: list[list[int]] = []
            for u in range(i, c + 1):
                if rows and rows[-1][0] == doc[u]:
                    rows[-1][2] = end[u]
                else:
                    start = end[u - 1] if u and doc[u - 1] == doc[u] else 0
                    rows.append([doc[u], start, end[u]])
            for k, v in zip(out, (shard.as_py(), w, n, capacity - n, kind[c], [ids[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows])):
                out[k].append(v)
            i = c + 1
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(table["doc_id"].type), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cut_penalty: int = CUT_PENALTY, hard_penalty: int = HARD_PENALTY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per window: shard, window, n_tokens, padding, cut (what ends it), and its pieces.

    A piece is doc_ids[i] from character starts[i] to ends[i]; white space between pieces stays at a
    piece's front. The pieces of a document follow each other without gaps, and every window's pieces hold n_tokens
    tokens. "hard" cuts stand after a token inside a sentence longer than a window.

    docs has doc_id (of any type that sorts) and text; other columns are ignored, whatever their names. Texts without a
    token (null and empty ones too) are left out; texts of any length are packed whole. Documents of a null doc_id come
    first. Of equal doc_ids the one of the shorter first unit comes first, then by a digest of their lengths, so repeated
    rows stand side by side and are packed as often as they stand. Of equally good cuts the one with longer windows
    first is taken. An empty table gives no rows.
    """
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    kind = id_type(docs)
    units = d.mapInArrow(tidy(_units(capacity)), f"doc_id {kind}, sizes array<int>, ends array<int>, hard array<boolean>")
    units = units.withColumns({"first": F.get("sizes", F.lit(0)), "digest": F.xxhash64("sizes", "ends")})
    windows = f"shard long, window int, n_tokens int, padding int, cut string, doc_ids array<{kind}>, starts array<int>, ends array<int>"
    return _placed(units, shard_tokens).groupBy("shard").applyInArrow(tidy_group(_pack(capacity, cut_penalty, hard_penalty)), windows)


def _running(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With each row's partition, its number in it, and the tokens above it there."""
    from pyspark import TaskContext

    part, rows, tokens = TaskContext.get().partitionId(), 0, 0
    for b in it:
        if not len(b):
            continue
        sizes = b.column(1)
        to = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
        total = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy().astype(np.int64))])[to]
        own = {"part": pa.array(np.full(len(b), part)), "nth": pa.array(rows + np.arange(len(b))), "above": pa.array(tokens + total[:-1]), "tokens": pa.array(np.diff(total))}
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *own.values()], names=["doc_id", "sizes", "ends", "hard", *own])
        rows += len(b)
        tokens += int(total[-1])


def _placed(units: DataFrame, shard_tokens: int) -> DataFrame:
    """units with before (the tokens of the documents in front of it), nth (which orders equal ones) and shard.

    Rows are cut into ranges; neither before nor the shards depend on where. A row per range reaches the driver.
    """
    spark = units.sparkSession
    order = ("doc_id", "first", "digest")
    # finding the ranges reads the rows once more: from the file, not from the texts
    ranged = written(units, "pack-lengths").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "sizes", "ends", "hard")
    own = [T.StructField(c, T.LongType()) for c in ("part", "nth", "above", "tokens")]
    ranged = ranged.mapInArrow(tidy(_running), T.StructType([*ranged.schema.fields, *own]))
    ranged = written(ranged, "pack-units")
    before, rows = 0, []
    for p, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("tokens")).collect()):
        rows.append((p, before))
        before += n
    shift = spark.createDataFrame(rows, "part2 long, shift long")
    placed = ranged.join(F.broadcast(shift), F.col("part") == F.col("part2"))  # a row per range
    placed = placed.withColumn("before", F.col("above") + F.col("shift"))
    return placed.select("doc_id", "sizes", "ends", "hard", "before", "nth", F.expr(f"before div {shard_tokens}").alias("shard"))
