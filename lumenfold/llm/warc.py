"""WARC archives: split reading by boundary-chain verification.

A WARC file has no index, and a record's payload may hold what looks like a record. Each task scans
one split of a file for the magic, and for each place whose header can be read emits an edge from the
candidate to its successor (the header's Content-Length tells where). Inside a split, chains are
followed at once, so a candidate's edge leads out of its split. Pointer jumping from offset 0 over
these edges then finds the candidates at which the true chain enters a split: each round doubles the
number of splits covered. Only records on chains from those entries are read; magic inside a
payload is on no such chain.

In a file of gzip members the candidates are the places where a member begins whose text begins with the
magic, and a member's successor is where its stream ends.

Files are read by ranges through pyarrow's file systems, so any folder that all executors reach will do; a path
without a scheme belongs to the file system that Spark would look in.

How public records are read: names of header fields in any case; a record id of any kind (page_id is the number of
an id <urn:page:N>, else null); WARC-Truncated changes nothing. Of a block of type application/http the header goes.
A body is decoded by the charset that its HTTP header names, if Python knows it and it fits, else as UTF-8, else as
Latin-1, which fits any bytes.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_uri, id_type, open_uri, shared_path, written

MAGIC, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
SPLIT, HEADER, READ = 16 << 20, 64 << 10, 1 << 20
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)")
#: The header field of our own by which a page without a body is told from an empty one.
_NULL = "X-Null-Body"
#: Marks records whose url and id have line breaks and blanks at the ends percent-encoded.
_ESCAPED = "X-Escaped"


def record(page_id: object, url: str | None, body: str | None) -> bytes:
    """One response record. A null url has no header line, a null body a flag of its own, to tell them from empty ones."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.0", "WARC-Type: response", "Content-Type: text/html; charset=utf-8", f"{_ESCAPED}: 1"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{_escape(str(page_id))}>")
    if url is not None:
        head.append("WARC-Target-URI: " + _escape(url))
    if body is None:
        head.append(f"{_NULL}: 1")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _escape(x: str) -> str:
    """x without what would end or change a header line: line breaks, and blanks at the ends."""
    x = x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    body = x.strip(" \t")
    if len(body) == len(x):
        return x
    code = lambda blanks: blanks.replace(" ", "%20").replace("\t", "%09")
    if not body:
        return code(x)
    at = x.index(body)
    return code(x[:at]) + body + code(x[at + len(body) :])


def _unescape(x: str) -> str:
    for code, ch in (("%0A", "\n"), ("%0D", "\r"), ("%20", " "), ("%09", "\t"), ("%25", "%")):
        x = x.replace(code, ch)
    return x


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """path, bytes, records: a WARC file for each partition of pages, under folder.

    A file is written under the attempt's own name and renamed when whole, so a task that is lost or runs
    twice leaves one whole file.
    """
    default = default_uri(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        system, root = open_uri(folder, default)
        system.create_dir(root, recursive=True)
        name = f"part-{ctx.partitionId():06d}.warc"
        last, own = f"{root}/{name}", f"{root}/_attempt-{ctx.taskAttemptId()}"
        n = size = 0
        with system.open_output_stream(own) as out:
            for b in it:
                for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                    r = record(i, u, h)
                    out.write(r)
                    n += 1
                    size += len(r)
        if n:
            if system.get_file_info(last).type != fs.FileType.NotFound:  # an earlier attempt's, the same bytes
                system.delete_file(last)
            system.move(own, last)
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])
        else:
            system.delete_file(own)

    p = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return written(p.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes of the files under folder whose names end in .warc or .warc.gz; no content is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select("path", F.col("length").alias("bytes")).filter(F.lower("path").rlike(r"\.warc(\.gz)?$"))


def parse_header(head: bytes) -> tuple[int, int] | None:
    """Length of the header with its blank line, and of the payload; None if it can't be read."""
    end = head.find(b"\r\n\r\n")
    if end < 0 or not head.startswith(MAGIC):
        return None
    m = _LENGTH.search(head, 0, end + 2)
    return (end + 4, int(m[1])) if m else None


def read_head(f, off: int, size: int) -> bytes:
    """The file from off on, as far as the first blank line or the file's end, HEADER bytes at least (if there)."""
    f.seek(off)
    head = f.read(min(HEADER, size - off))
    seen = 0
    while head.find(b"\r\n\r\n", seen) < 0 and off + len(head) < size:
        seen = max(0, len(head) - 3)
        more = f.read(min(len(head), size - off - len(head)))
        if not more:
            break
        head += more
    return head


class LongHeaders:
    """Headers beyond HEADER bytes: what stands before one blank line is read once for all candidates in it."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.start = self.stop = 0
        self.end, self.at, self.n = -1, [], []

    def parse(self, off: int) -> tuple[int, int] | None:
        """As parse_header for the header at off, where the magic stands."""
        if not self.start <= off < self.stop:
            head = read_head(self.f, off, self.size)
            end = head.find(b"\r\n\r\n")
            self.start, self.stop = off, off + end if end >= 0 else self.size
            self.end = off + end + 4 if end >= 0 else -1
            found = list(_LENGTH.finditer(head, 0, end + 2)) if end >= 0 else []
            self.at, self.n = [off + m.start() for m in found], [int(m[1]) for m in found]
        k = bisect_right(self.at, off)
        return (self.end - off, self.n[k]) if self.end >= 0 and k < len(self.at) else None


def candidates(f, start: int, stop: int, size: int) -> dict[int, int]:
    """Offset to successor for each place in [start, stop) where a record or member can be read and ends in the file."""
    f.seek(0)
    zipped = f.read(len(GZIP)) == GZIP
    out: dict[int, int] = {}
    far = LongHeaders(f, size)
    magic, more = (GZIP, len(GZIP)) if zipped else (MAGIC, HEADER)
    at = start
    while at < stop:
        want = min(READ, stop - at)
        f.seek(at)
        block = f.read(min(want + more, size - at))
        i = block.find(magic)
        while 0 <= i < want:
            if zipped:
                end = member_end(f, at + i, size)
            else:
                got = parse_header(block[i : i + HEADER]) if block.find(b"\r\n\r\n", i, i + HEADER) >= 0 else far.parse(at + i)
                end = at + i + sum(got) + 4 if got else None
            if end and end <= size:
                out[at + i] = end
            i = block.find(magic, i + 1)
        at += want
    return out


def _inflate(f, off: int, size: int) -> Iterator[tuple[bytes, int | None]]:
    """The pieces of the gzip member at off, each with where the member ends once that is known; an error ends it."""
    d = zlib.decompressobj(31)
    at = off
    while at < size and not d.eof:
        f.seek(at)
        block = f.read(min(READ >> 4 if at == off else READ, size - at))
        at += len(block)
        while not d.eof:
            try:
                piece = d.decompress(block, READ)
            except zlib.error:
                return
            block = d.unconsumed_tail
            yield piece, at - len(d.unused_data) if d.eof else None
            if not block and len(piece) < READ:
                break


def member_end(f, off: int, size: int) -> int | None:
    """Where the gzip member at off ends; None where there is none, or its text doesn't begin with the magic."""
    front, known = b"", False
    for piece, end in _inflate(f, off, size):
        if not known:
            front += piece[: len(MAGIC)]
            if front[: len(MAGIC)] != MAGIC[: len(front)]:
                return None
            known = len(front) >= len(MAGIC)
        if end is not None:
            return end if known else None
    return None


def exits(edges: dict[int, int], stop: int) -> dict[int, int]:
    """For each candidate, where its chain leaves the split; chains that hit no candidate end at -1."""
    out: dict[int, int] = {}
    for off in sorted(edges, reverse=True):  # successors lie ahead
        to = edges[off]
        out[off] = to if to >= stop else out.get(to, -1)
    return out


def _tasks(files: DataFrame, split: int) -> int:
    """As many tasks as splits: their rows are tiny, so Spark must be told that the work isn't."""
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    return int(max(1, min(n, 100_000)))


def _splits(files: DataFrame, split: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))
    return files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))


def chain_edges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, bytes, start (of the split), off, exit: an edge for each candidate."""
    default = default_uri(files.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                system, at = open_uri(path, default)
                stop = min(size, start + split)
                with system.open_input_file(at) as f:
                    found = exits(candidates(f, start, stop, size), stop)
                n = len(found)
                yield pa.record_batch([pa.array([path] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array([start] * n, pa.int64()), pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["path", "bytes", "start", "off", "exit"])

    s = _splits(files, split).repartition(_tasks(files, split), "path", "start")
    return s.mapInArrow(run, "path string, bytes long, start long, off long, exit long")


def entries(edges: DataFrame) -> DataFrame:
    """path, bytes, start, off: the candidates at which the chain from offset 0 enters each split.

    Pointer jumping: after round r the reached set holds the first 2^r entries of each file, and every
    jump spans 2^r splits; it ends when a round reaches nothing new.
    """
    edges = written(edges, "warc-edges")
    # Columns of paths are small on disk and large in memory: Spark mustn't judge by file size that
    # a side can be sent whole, so every join is a merge join.
    meet = lambda a, b, how="inner": a.join(b.hint("merge"), ["path", "off"], how)
    jump = edges.filter("exit >= 0 AND exit < bytes").select("path", "off", "exit")
    reached = written(edges.filter("off = 0").select("path", "off"), "warc-reached")
    while True:
        step = meet(reached, jump).select("path", F.col("exit").alias("off"))
        # an exit that is no candidate ends its chain: the file is broken there
        step = meet(step, edges.select("path", "off"), "left_semi")
        new = written(meet(step, reached, "left_anti").distinct(), "warc-new")
        if new.isEmpty():
            break
        reached = written(reached.unionByName(new), "warc-reached")
        onward = jump.select("path", F.col("off").alias("exit"), F.col("exit").alias("next"))
        jump = written(jump.join(onward.hint("merge"), ["path", "exit"]).select("path", "off", F.col("next").alias("exit")), "warc-jump")
    return meet(edges, reached, "left_semi").select("path", "bytes", "start", "off")


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, off, type, record_id, url, html of every record on the chain from each file's start.

    files has path and bytes. A file that doesn't begin with a record has none; after a broken record the
    rest of its file is left out. Of a gzip member with several records each has the member's off. Empty files give
    no rows.
    """
    default = default_uri(files.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, size, start, off in zip(*(b.column(k).to_pylist() for k in range(4))):
                system, at = open_uri(path, default)
                stop, rows, held = min(size, start + split), [], 0
                with system.open_input_file(at) as f:
                    f.seek(0)
                    read = _member if f.read(len(GZIP)) == GZIP else _plain
                    while off < stop:
                        got, end = read(f, off, size)
                        for head, body in got:
                            rows.append((path, off, *_fields(head, body)))
                            held += len(head) + len(body)
                        if end is None:
                            break
                        off = end
                        if held > READ * 8:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    starts = entries(chain_edges(files, split)).repartition(_tasks(files, split), "path", "start")
    return starts.mapInArrow(run, "path string, off long, type string, record_id string, url string, html string")


def _plain(f, off: int, size: int) -> tuple[list[tuple[bytes, bytes]], int | None]:
    """The record at off as (header, body), and where the next begins; none where it is broken."""
    block = read_head(f, off, size)
    got = parse_header(block)
    if not got or off + sum(got) + 4 > size:
        return [], None
    head, n = got
    body = block[head : head + n]
    if len(body) < n:
        f.seek(off + len(block))
        body += f.read(n - len(body))
    return [(block[:head], body)], off + head + n + 4


def _member(f, off: int, size: int) -> tuple[list[tuple[bytes, bytes]], int | None]:
    """The records of the gzip member at off, as _plain."""
    pieces, end = [], None
    for piece, end in _inflate(f, off, size):
        pieces.append(piece)
    text = b"".join(pieces)
    if end is None or not text.startswith(MAGIC):
        return [], None
    out, at = [], 0
    while got := parse_header(text[at:] if at else text):
        head, n = got
        if at + head + n > len(text):
            break
        out.append((text[at : at + head], text[at + head : at + head + n]))
        at += head + n + 4
    return out, end


def _lines(head: bytes) -> dict[str, str]:
    """The fields of a header, names in small letters; a line that begins with a blank goes on from the one above."""
    out: dict[str, str] = {}
    last = None
    for line in _decoded(head, None).replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        if colon:
            last = key.strip().lower()
            out[last] = value.strip(" \t")
    return out


def _decoded(body: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8"):
        try:
            if name:
                text = body.decode(name)
                text.encode()  # a charset that makes half characters doesn't fit
                return text
        except (LookupError, UnicodeError):
            continue
    return body.decode("latin-1")


def _fields(head: bytes, body: bytes) -> tuple[str | None, str | None, str | None, str | None]:
    h = _lines(head)
    url = h.get("warc-target-uri")
    kind, text_type = h.get("content-type", ""), h.get("content-type", "")
    if kind.lower().replace(" ", "").startswith("application/http"):
        top, blank, rest = body.partition(b"\r\n\r\n")
        if blank:
            text_type, body = _lines(top + b"\r\n").get("content-type", ""), rest
    m = _CHARSET.search(text_type)
    if url is not None and _ESCAPED.lower() in h:
        url = _unescape(url)
    return h.get("warc-type"), h.get("warc-record-id"), url, None if _NULL.lower() in h else _decoded(body, m[1] if m else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "off", "type", "record_id", "url", "html"])


def page_id(record_id: str = "record_id", kind: str = "long"):
    """The id within <urn:page:...>; null for ids of any other kind."""
    own = F.regexp_extract(record_id, r"^<urn:page:([\s\S]*)>$", 1)
    for code, ch in (("%0A", "\n"), ("%0D", "\r"), ("%20", " "), ("%09", "\t"), ("%25", "%")):
        own = F.replace(own, F.lit(code), F.lit(ch))
    return F.when(F.col(record_id).rlike(r"^<urn:page:[\s\S]*>$"), own).try_cast(kind)


def archive_round_trip(spark: SparkSession, pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """page_id, url, html as read back from WARC files of pages, written to the shared folder.

    pages has page_id (of any type that a string can be cast back to), url and html; other columns are ignored,
    whatever their names. Nulls, empty and very long values of any column, magic inside them, and repeated rows come
    back as they were. There are no ties. An empty table gives no rows.
    """
    files = write_archives(pages, shared_path(spark, "warc"))
    return read_archives(files, split).select(page_id(kind=id_type(pages, "page_id")).alias("page_id"), "url", "html")
