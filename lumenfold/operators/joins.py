"""Joins and dedup over records: bilingual merge, cross references, containment, best match, last wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arabic_normalize, chapter_key, contains_arabic, match_score, strip_tags
from ..schema import IDENTITY
from ..storage import written


def merge_bilingual(english: DataFrame, arabic: DataFrame) -> DataFrame:
    """English records (chapter, number, english) with Arabic lines (chapter, number, pos, line, chapter_arabic) merged in.

    Lines meet the record whose chapter, up to its first dash and in capitals, and number agree; they are joined in
    order of pos. A chapter without Arabic gets the Arabic chapter's name. Lines without a record make one of
    their own, if their chapter is known.
    """
    lines = arabic.groupBy(F.upper(F.trim("chapter")).alias("k"), F.col("number").alias("n")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("line")))), lambda x: x["line"]), " ").alias("arabic"),
        F.min_by(F.trim("chapter_arabic"), "pos").alias("chapter_arabic"),
    )
    e = english.select("chapter", "number", "english", chapter_key(F.col("chapter")).alias("ek"))
    known = e.groupBy("ek").agg(F.min("chapter").alias("known_chapter")).withColumnRenamed("ek", "kk")
    both = e.join(lines, (F.col("ek") == F.col("k")) & (F.col("number") == F.col("n")), "full_outer")
    both = both.join(known, F.col("k") == F.col("kk"), "left").filter("ek IS NOT NULL OR kk IS NOT NULL")
    base = F.coalesce("chapter", "known_chapter")
    named = F.when(F.col("arabic").isNotNull() & ~contains_arabic(base), F.concat(base, F.lit(" / "), F.col("chapter_arabic"))).otherwise(base)
    return both.select(named.alias("chapter"), F.coalesce("number", "n").alias("number"), "english", F.concat(F.lit(" "), F.col("arabic")).alias("arabic"))


SAME_AS = r"^Same as no\.? *[0-9]+ *\.?$"
SIMILAR_TO = r"^Similar to no\.? *[0-9]+ *\.?$"


def resolve_same_as(records: DataFrame) -> DataFrame:
    """records (chapter, number, pos, english) with "Same as no. N" replaced by the text it names.

    pos orders all records and is unique. The name means the first record so far of that chapter and number: the first one
    of all, if it stands above. References may lead to references: chains are halved each round until none is left
    to shorten. Text without a referent stays.
    """
    ref = F.trim("english").rlike(SAME_AS)
    r = records.withColumn("target", F.when(ref, F.regexp_replace("english", "[^0-9]", "")))
    first = records.groupBy(F.col("chapter").alias("c2"), F.col("number").alias("n2")).agg(F.min("pos").alias("to"))
    named = r.filter("target IS NOT NULL").select("chapter", "target", "pos")
    links = named.join(first, F.col("chapter").eqNullSafe(F.col("c2")) & (F.col("target") == F.col("n2"))).filter(F.col("to") < F.col("pos"))
    links = written(links.select("pos", "to"), "same-as")
    while True:
        onward = links.select(F.col("pos").alias("at"), F.col("to").alias("next"))
        links = written(links.join(onward, F.col("to") == F.col("at"), "left").select("pos", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "same-as")
        moved, links = links.filter("moved"), links.select("pos", "to")
        if moved.isEmpty():
            break
    text = records.select(F.col("pos").alias("to"), F.col("english").alias("found"))
    out = r.join(links, "pos", "left").join(text, "to", "left")
    use = F.col("found").isNotNull() & (F.trim("found") != "")
    return out.select(*[F.when(use, F.trim("found")).otherwise(F.col("english")).alias("english") if c == "english" else F.col(c) for c in records.columns])


def mark_similar(english: Column) -> Column:
    return F.when(F.trim(english).rlike(SIMILAR_TO), F.concat(english, F.lit(" from this chapter."))).otherwise(english)


def with_blurbs(records: DataFrame, blurbs: DataFrame) -> DataFrame:
    """record and blurb for each blurb whose book the record's book contains, letter case and tags aside."""
    b = blurbs.select(F.col("book").alias("blurb_book"), "blurb")
    return records.join(b, F.upper(strip_tags(F.col("book"))).contains(F.upper("blurb_book")))


def best_match(texts: DataFrame, chunks: DataFrame, normalise: str = "chunk") -> DataFrame:
    """page, text_id and the chunk of the page that fits best; the first of equals; "" where a page has none.

    texts has page, text_id, text; chunks has page, idx, chunk. Either side's vowel signs are left out of the comparison:
    the chunk's or the text's. Blank chunks never match. Only pairs within a page meet.
    """
    c = chunks.filter(~F.col("chunk").rlike(r"^[\s\xA0]*$")).select(F.col("page").alias("p2"), "idx", "chunk")
    t, k = F.col("text"), F.col("chunk")
    score = match_score(t, arabic_normalize(k)) if normalise == "chunk" else match_score(arabic_normalize(t), k)
    pairs = texts.join(c, F.col("page") == F.col("p2"), "left").withColumn("score", score)
    best = pairs.groupBy("page", "text_id").agg(F.min_by("chunk", F.struct("score", "idx")).alias("chunk"))
    return best.select("page", "text_id", F.coalesce("chunk", F.lit("")).alias("chunk"))


def with_titles(records: DataFrame, titles: DataFrame) -> DataFrame:
    """records (n) with the title of their chapter number; titles has n and title. A number without a title stays without."""
    return records.join(titles, "n", "left")


def last_wins(records: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The latest record of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(pos))
    return records.withColumn("nth_last", F.row_number().over(w)).filter("nth_last = 1").drop("nth_last")


def ordered_distinct(records: DataFrame, order: str) -> DataFrame:
    """The first record, in order, of each identity."""
    by = [F.col(c) for c in IDENTITY if c in records.columns]
    w = Window.partitionBy(*by).orderBy(order)
    return records.withColumn("nth_same", F.row_number().over(w)).filter("nth_same = 1").drop("nth_same")
