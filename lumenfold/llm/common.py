"""Shared helpers: column naming, the shared folder, and numpy views of Arrow text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_path, written  # noqa: F401  operators take them from here


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    """The SQL name of a column's type, for schemas of functions that carry it as it is."""
    return df.select(df[column]).schema[0].dataType.simpleString()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def default_uri(spark: SparkSession) -> str:
    """The file system that paths without a scheme belong to."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).toString()


def open_uri(uri: str, default: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of what Spark calls uri; default is default_uri of the session."""
    if not urlparse(uri).scheme:
        uri = default.rstrip("/") + "/" + uri.lstrip("/")
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(uri)


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a written folder, in order of their part."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-"))


def _lean() -> None:
    """Let this worker's C library take each array of MAPPED bytes or more from the system and return it as soon as it is freed."""
    try:
        ctypes.CDLL(None).mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # no such call in this C library
        return


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it, beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that keeps no freed memory."""

    def all_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        try:
            yield from run(it)
        finally:
            give_back()

    return all_of


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """tidy for applyInArrow over groups."""

    def one(table: pa.Table) -> pa.Table:
        _lean()
        try:
            return run(table)
        finally:
            give_back()

    return one


def tidy_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """tidy for applyInArrow over pairs of groups."""

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        _lean()
        try:
            return run(left, right)
        finally:
            give_back()

    return two


def kept(b: pa.RecordBatch, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of b that keep marks, of PIECE rows at a time: a whole batch is as large as its texts, and is copied on its way."""
    for i in range(0, len(b), PIECE):
        yield b.slice(i, PIECE).filter(pa.array(keep[i : i + PIECE]))


#: Bytes from which an array is mapped on its own; rows of a batch that are sent back together.
MAPPED, PIECE = 1 << 20, 1024

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: 1: ASCII letter or digit, or any byte of a multi-byte character.
_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        _powers.clear()
        for base in (_P, _PINV):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers.append(np.multiply.accumulate(a))
    return _powers[0], _powers[1]


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column: (first row, bytes, offsets) over runs of rows of about limit bytes.

    A null counts as empty. A text longer than limit is one run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of UTF-8."""
    out = _FOLD[data]
    if len(data) > 1:
        cap = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][cap] += 32
    return out


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one more at the end).

    A word is a run of ASCII letters, digits and non-ASCII characters in one text.
    """
    w = is_word[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] |= w[cut]
    starts = np.flatnonzero(begin)
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cut - 1] |= w[cut - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands."""
    up, down = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_PINV))
