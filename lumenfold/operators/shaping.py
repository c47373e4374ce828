"""What a client shows of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def volume_label(volume: Column) -> Column:
    return F.when(F.length(volume) > 0, F.concat(F.lit("Volume "), volume)).otherwise(volume)


def has_highlight(c: Column) -> Column:
    return F.coalesce(c.contains("<span"), F.lit(False))


def starts_with_ignore_case(text: Column, term: Column) -> Column:
    """A null or empty term begins everything."""
    return F.coalesce(term == "", F.lit(True)) | F.startswith(F.upper(text), F.upper(term))


def encode_component(c: Column) -> Column:
    """Percent encoding as browsers do it: a space is %20, and ! ' ( ) * stay."""
    out = F.url_encode(c)
    for code, ch in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def share_text(records: DataFrame, site: str, limit: int = 260) -> Column:
    """The encoded description of a record that goes with its link: cut so that both fit limit, tags and edge commas gone."""
    url = encode_component(F.concat(F.lit(site.rstrip("/") + "/?q=_id:"), F.col("_id")))
    some = lambda name, c: F.when(F.length(name) > 0, c).otherwise(F.lit(""))
    col = lambda n: F.col(n) if n in records.columns else F.lit(None).cast("string")
    desc = F.concat(
        some(col("book"), F.concat(col("book"), F.lit(" "))),
        F.when(F.length(col("edition")) > 0, F.concat(F.lit(" ("), col("edition"), F.lit("), "))).otherwise(F.lit(", ")),
        some(col("number"), F.concat(F.lit("#"), col("number"), F.lit(", "))),
        some(col("chapter"), F.concat(col("chapter"), F.lit(", "))),
        some(col("volume"), F.concat(F.lit("VOL. "), col("volume"))),
    )
    desc = F.substring(desc, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.length(url)))
    desc = F.replace(F.replace(desc, F.lit('<span class="highlight">'), F.lit("")), F.lit("</span>"), F.lit(""))
    return encode_component(F.trim(F.regexp_replace(desc, "(^,)|(,$)", "")))


def gradings_of(records: DataFrame) -> DataFrame:
    """_id, nth (from 0), grader, rationale, grading: a row a grading."""
    g = records.select("_id", F.posexplode("gradings").alias("nth", "g"))
    return g.select("_id", "nth", "g.grader", "g.rationale", "g.grading")


def related_of(records: DataFrame) -> DataFrame:
    """_id, nth (from 0), url, title, description: a row a related page."""
    r = records.select("_id", F.posexplode("related").alias("nth", "r"))
    return r.select("_id", "nth", "r.url", "r.title", "r.description")


def history_of(records: DataFrame) -> DataFrame:
    """_id, nth (from 0), note: a row an edit, the oldest first."""
    return records.select("_id", F.posexplode("history").alias("nth", "note"))
