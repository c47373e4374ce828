"""Line-oriented parsing as windows: pages to lines, headers carried forward, boundaries, islands, repairs.

Everything is partitioned by doc and ordered by (page, line); a document is the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, is_probably_arabic

ORDER = ("page", "line_no")


def by_doc() -> Window:
    return Window.partitionBy("doc").orderBy(*ORDER)


def so_far() -> Window:
    return by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lines(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """doc, page, line_no, line from pages (doc, page, text). Empty lines at the end of a page are dropped."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"(?:{separator})+$", "")
    return pages.select("doc", "page", F.posexplode(F.split(text, separator)).alias("line_no", "line"))


def carry_forward(df: DataFrame, header: Column, name: str) -> DataFrame:
    """The latest header at or above each line."""
    return df.withColumn(name, F.last(header, ignorenulls=True).over(so_far()))


def back_fill(df: DataFrame, header: Column, name: str) -> DataFrame:
    """The next header at or below each line."""
    w = by_doc().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(name, F.first(header, ignorenulls=True).over(w))


def records_from_starts(df: DataFrame, start: Column, name: str = "record") -> DataFrame:
    """A number for the record a line belongs to; 0 before the first start."""
    return df.withColumn(name, F.coalesce(F.sum(start.cast("int")).over(so_far()), F.lit(0)))


def records_from_ends(df: DataFrame, end: Column, name: str = "record") -> DataFrame:
    """The same where marks stand on a record's last line."""
    above = by_doc().rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(end.cast("int")).over(above), F.lit(0)))


def islands(df: DataFrame, member: Column, name: str = "island") -> DataFrame:
    """A number for each run of member lines, null elsewhere; a page ends a run."""
    before = F.lag(member).over(Window.partitionBy("doc", "page").orderBy("line_no"))
    start = member & ~F.coalesce(before, F.lit(False))
    d = df.withColumn(name, F.sum(start.cast("int")).over(so_far()))
    return d.withColumn(name, F.when(member, F.col(name)))


def multi_line_headers(df: DataFrame, start: Column, stop: Column, name: str = "header") -> DataFrame:
    """On a header's first line, it and the lines after it down to the first stop, joined by spaces; null elsewhere.

    in_header is true on all lines of a header.
    """
    d = records_from_starts(df, start, "h_id")
    w = Window.partitionBy("doc", "h_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stopped = F.max((stop & ~start).cast("int")).over(w)
    d = d.withColumn("in_header", (F.col("h_id") > 0) & (stopped == 0))
    own = F.when(F.col("in_header"), F.trim("line"))
    whole = Window.partitionBy("doc", "h_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.withColumn(name, F.when(start, F.array_join(F.collect_list(own).over(whole), " "))).drop("h_id")


def look_back(df: DataFrame, name: str = "above") -> DataFrame:
    """The nearest run of Arabic lines among the four above, nearest line first; "" where there is none.

    The first line of a page is never taken.
    """
    w = Window.partitionBy("doc", "page").orderBy("line_no")
    got, found, done = F.lit(""), F.lit(False), F.lit(False)
    for k in range(1, 5):
        text, no = F.lag("line", k).over(w), F.lag("line_no", k).over(w)
        arabic = F.coalesce(is_probably_arabic(text), F.lit(False))
        ok = F.coalesce(no > 0, F.lit(False)) & ~done
        got = F.when(ok & arabic, F.concat(got, F.trim(text), F.lit(" "))).otherwise(got)
        done = done | (ok & found & ~arabic)
        found = found | (ok & arabic)
    return df.withColumn(name, got)


def drop_noise(df: DataFrame, *patterns: str) -> DataFrame:
    """Without lines that match a pattern, and without contents pages."""
    for p in patterns:
        df = df.filter(~F.col("line").rlike(p))
    return df


def drop_contents(pages: DataFrame) -> DataFrame:
    t = F.col("text")
    return pages.filter(~(F.lower(t).contains("table of contents") | (t.contains("Chapter") & t.contains("..."))))


def stop_rest_of_page(df: DataFrame, note: Column) -> DataFrame:
    """Without the lines of a page from its first note on."""
    w = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("noted", F.max(F.coalesce(note, F.lit(False)).cast("int")).over(w)).filter("noted = 0").drop("noted")


def repair_sequence(df: DataFrame, marker: Column, chapter: str, name: str = "number") -> DataFrame:
    """The running count of markers in a chapter, whatever number they claim; null before the first."""
    w = Window.partitionBy("doc", chapter).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(marker.cast("int")).over(w)
    return df.withColumn(name, F.when(n > 0, n))


def fifo_complete(english: DataFrame, arabic: DataFrame) -> DataFrame:
    """doc, number, arabic: Arabic lines given to the oldest record not yet completed.

    english has doc, number (int) of the pending records; arabic has doc, page, line_no, line, mark (an
    int where a line begins record mark, else null). A mark n completes all records below n; lines go to the
    least record at or above the largest mark so far.
    """
    a = arabic.withColumn("due", F.coalesce(F.max("mark").over(so_far()), F.lit(0)))
    need = a.select("doc", "due").distinct()
    e = english.select(F.col("doc").alias("d2"), F.col("number").alias("num"))
    to = need.join(e, (F.col("doc") == F.col("d2")) & (F.col("num") >= F.col("due"))).groupBy("doc", "due").agg(F.min("num").alias("number"))
    got = a.join(to, ["doc", "due"]).groupBy("doc", "number")
    return got.agg(join_lines(F.struct(*ORDER, F.trim("line").alias("line")), "line").alias("arabic"))


def join_lines(item: Column, field: str, separator: str = " ") -> Column:
    """An aggregate: items in order, their field joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x[field]), separator)


BLANK = rf"^{SPACE}*$"
