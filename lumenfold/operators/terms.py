"""Term statistics: top terms by prefix, significant terms by the JLH score."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_accents, strip_accents_py
from ..plans.index import Index, tokens
from ..plans.rewrite import check_prefix, check_size, searchable_terms

MINIMUM_SCORE, MINIMUM_DOCS = 0.5, 3
_META = re.compile(r"[.?+*|{}\[\]()\"\\#@&<>~]")


def _arabic(text: str) -> bool:
    return any(0x600 <= ord(ch) <= 0x6E0 for ch in text)


def _distinct_terms(records: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """doc_id, term: each term of a document once; deduplicated in the row, before any shuffle."""
    return records.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(field), field == "arabic"))).alias("term"))


def top_terms(records: DataFrame, prefix: str, size: int = 10) -> DataFrame:
    """term, docs: the terms with prefix (a live regular expression) in most documents; ties by term."""
    check_prefix(prefix)
    check_size(size)
    t = _distinct_terms(records, "arabic" if _arabic(prefix) else "english")
    match = F.col("term").rlike(f"^(?:{prefix}.*)$") if _META.search(prefix) else F.col("term").startswith(prefix)
    return t.filter(match).groupBy("term").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "term").limit(size)


def significant_field(records: DataFrame, hit: Column, field: str) -> DataFrame:
    """term, fg, bg, score over one field: JLH of the records for which hit is true against all.

    Only documents that have the field count. One scan and one aggregation: hit is carried along in the row, and the
    numbers of documents are the counts of a term of their own.
    """
    terms = F.array_append(F.array_distinct(tokens(F.col(field), field == "arabic")), F.lit(None).cast("string"))
    own = records.filter(F.col(field).isNotNull()).select(F.coalesce(hit, F.lit(False)).cast("int").alias("hit"), terms.alias("terms"))
    t = own.select("hit", F.explode_outer("terms").alias("term"))  # hit stands below the explosion: it is found once a record
    # all is told from a term after the aggregation, so that both uses of counts are one
    counts = t.groupBy("term").agg(F.sum("hit").alias("fg"), F.count(F.lit(1)).alias("bg"), F.max(F.col("term").isNull()).alias("all"))
    sizes = counts.filter("all").select(F.col("fg").alias("fg_n"), F.col("bg").alias("bg_n"))
    s = counts.filter((F.col("fg") >= MINIMUM_DOCS) & ~F.col("all")).crossJoin(F.broadcast(sizes))  # one row
    f, b = F.col("fg") / F.col("fg_n"), F.col("bg") / F.col("bg_n")
    return s.select("term", "fg", "bg", F.when(f > b, (f - b) * (f / b)).otherwise(F.lit(0.0)).alias("score")).filter("score > 0")


def matches(records: DataFrame, terms: list[str]) -> Column:
    """Whether a record holds a term in either language; in both where eight or more terms were given."""
    usable = searchable_terms(terms)
    arabic = [strip_accents_py(t.strip()) for t in usable if _arabic(t)]
    english = [strip_accents_py(t.strip().lower()) for t in usable if not _arabic(t)]
    hit = lambda field, ts: F.arrays_overlap(tokens(F.col(field), field == "arabic"), F.array(*[F.lit(t) for t in ts])) if ts else F.lit(False)
    n = sum(hit(f, ts).cast("int") for f, ts in (("english", english), ("arabic", arabic)) if f in records.columns)
    return n >= max(1, int(len(terms) * 0.25))


def matching_docs(records: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of the records that match."""
    return records.filter(matches(records, terms)).select(F.col("_id").alias("doc_id"))


def significant_terms(records: DataFrame, terms: list[str], size: int = 5) -> DataFrame:
    """term, score: what documents with the given terms have more often than others; the inputs themselves left out."""
    check_size(size)
    m = matches(records, terms)
    both = None
    for rank, field in enumerate(("english", "arabic")):
        if field in records.columns:
            part = significant_field(records, m, field).orderBy(F.desc("score"), "term").limit(size).select("term", "score", F.lit(rank).alias("lang"))
            both = part if both is None else both.unionByName(part)
    # compared with the inputs as they were typed: a capital in the input excludes nothing
    key = F.lower(F.trim(F.col("term")))
    kept = both.withColumn("key", strip_accents(key)).filter(~F.col("key").isin(*terms) if terms else F.lit(True))
    return kept.orderBy(F.desc("score"), "lang", "term").limit(size).filter(F.col("score") >= MINIMUM_SCORE).select("term", "score")


def index_top_terms(index: Index, prefix: str, size: int = 10) -> DataFrame:
    """top_terms from a written index: the lexicon has the counts, sorted by term."""
    check_prefix(prefix)
    field = "arabic" if _arabic(prefix) else "english"
    match = F.col("term").rlike(f"^(?:{prefix}.*)$") if _META.search(prefix) else F.col("term").startswith(prefix)
    return index.lexicon.filter((F.col("field") == field) & match).select("term", F.col("df").alias("docs")).orderBy(F.desc("docs"), "term").limit(size)


class TermCache:
    """Results kept by key: at most size of them, for ttl seconds each; the least used goes first.

    For top and significant terms, which clients ask for again and again; an edit clears it.
    """

    def __init__(self, size: int = 1000, ttl: float = 86_400, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.held: dict[Hashable, list] = {}

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> list:
        """The rows of make(), which is run only where key isn't held."""
        now = self.clock()
        own = self.held.get(key)
        if own and now - own[0] < self.ttl:
            own[1] += 1
            return own[2]
        rows = make().collect()  # ten terms at most
        self.held.pop(key, None)
        if len(self.held) >= self.size:
            self.held.pop(min(self.held, key=lambda k: (self.held[k][1], self.held[k][0])))
        self.held[key] = [now, 1, rows]
        return rows

    def clear(self) -> None:
        self.held.clear()
