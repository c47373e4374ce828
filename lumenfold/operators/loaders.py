"""Books to records: one function per input style.

Pages come as (doc, page, text); how text got out of a file or an image is another's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import joins, lines as L

_HEADER_WORDS = "CHAPTER|CHAPATER|CHHAPTER|CHAPER|CHATER|CHAPAATER|CHAPPTER|CAHPTER"
#: Headers, page numbers and watermarks of the end-marked style.
END_STYLE_NOISE = (
    r"^Alkafi Volume ",
    r"Al[ -]Kafi( –| -)? V",
    r"The Book Of",
    r"CH[\s\xA0][0-9]+[\s\xA0]H[\s\xA0][0-9]+",
    r"^[\s\xA0]*[0-9]+[\s\xA0]out[\s\xA0]of[\s\xA0][0-9]+[\s\xA0]*$",
    r"^[0-9]+[()]*[\s\xA0]*$",
    L.BLANK,
)


def chapter_number(header: Column) -> Column:
    """The number of a header "Chapter Twenty One: ..."; null where no colon is."""
    word = F.trim(F.replace(F.lower(F.substring_index(header, ":", 1)), F.lit("chapter"), F.lit("")))
    return F.when(header.contains(":"), X.convert_word_to_integer(word).cast("int"))


def numbered_book(pages: DataFrame, book: str, titles: DataFrame | None = None) -> DataFrame:
    """Records that begin with "12. ": book, chapter, number, english.

    Chapter headers run over lines to a blank or Arabic one. Where titles (n, title) are given, a header with
    a number in words gets its title from there. A translator's or editor's note ends its page.
    """
    d = L.lines(pages)
    t = F.trim("line")
    note = t.rlike("Translator’s Note|Editor’s Note")
    d = L.stop_rest_of_page(d, note).filter(~t.rlike("^[0-9]+$"))
    header = F.upper(t).startswith("CHAPTER ") & ~X.contains_arabic(F.col("line"))
    d = L.multi_line_headers(d, header, (t == "") | X.contains_arabic(F.col("line")), "header")
    d = L.carry_forward(d, F.col("header"), "chapter")
    body = d.filter((t != "") & ~X.contains_arabic(F.col("line")) & ~F.col("in_header"))
    start = t.rlike(r"^[0-9]+\..*$")
    body = L.records_from_starts(body, start).filter("record > 0")
    text = F.when(start, F.trim(F.regexp_replace(t, r"^[0-9]+\.", ""))).otherwise(t)
    out = body.groupBy("doc", "record").agg(
        F.min_by("chapter", F.struct(*L.ORDER)).alias("chapter"),
        F.min_by(F.regexp_extract(t, r"^([0-9]+)\.", 1), F.struct(*L.ORDER)).alias("number"),
        L.join_lines(F.struct(*L.ORDER, F.concat(text, F.lit(" ")).alias("x")), "x", "").alias("english"),
    )
    if titles is not None:
        out = joins.with_titles(out.withColumn("n", chapter_number(F.col("chapter"))), titles)
        out = out.withColumn("chapter", F.when(F.col("title").isNotNull(), F.concat(F.lit("Chapter "), F.col("n").cast("string"), F.lit(" - "), F.trim("title"))).otherwise(F.col("chapter")))
    return out.select("doc", F.lit(book).alias("book"), F.trim(X.cleanup_text(F.col("chapter"))).alias("chapter"), "number", X.cleanup_text(F.col("english")).alias("english"))


def dashed_book(pages: DataFrame, book: str) -> DataFrame:
    """Records that begin with "12- ", under SECTION <words> and CHAPTER <n> headers: book, section, chapter, number, english."""
    d = L.lines(pages)
    t = F.trim("line")
    d = L.stop_rest_of_page(d.filter(~F.coalesce(X.is_probably_arabic(F.col("line")), F.lit(False))), t.contains("Translators' note:"))
    d = L.drop_noise(d, r"PDF created with", r"^[\s]*Akhbar[\s]*$")
    up = F.upper(t)
    sec, chap, start = up.rlike(r"^SECTION[\s\xA0][A-Z]+$"), up.rlike(r"^CHAPTER[\s\xA0][0-9]+$"), t.rlike(r"^[0-9]+-.*$")
    d = L.multi_line_headers(d, sec, up.contains("CHAPTER") | (t == "") | start, "s_head").withColumnRenamed("in_header", "in_section")
    d = L.multi_line_headers(d, chap, start | (t == "") | t.startswith("God the Almighty") | sec, "c_head")
    word = F.element_at(F.split(t, " "), -1)
    rest = lambda c: F.trim(F.regexp_replace(c, r"(?i)^(section|chapter)[\s\xA0]\w+", ""))
    section = F.when(F.col("s_head").isNotNull(), F.trim(F.concat(F.lit("SECTION "), X.word_to_number(word), F.lit(" - "), rest(F.col("s_head")))))
    chapter = F.when(F.col("c_head").isNotNull(), F.trim(F.concat(up, F.lit(" - "), rest(F.col("c_head")))))
    d = L.carry_forward(L.carry_forward(d, section, "section"), chapter, "chapter")
    body = d.filter((t != "") & ~F.col("in_header") & ~F.col("in_section"))
    # a line that repeats the section's heading is a page header
    bare = lambda c: F.regexp_replace(F.upper(F.trim(c)), " ,-", "")
    body = body.filter(~F.coalesce(F.contains(bare(F.col("section")), bare(F.col("line"))), F.lit(False)))
    body = L.records_from_starts(body, start).filter("record > 0")
    text = F.when(start, F.trim(F.regexp_replace(t, r"^[0-9]+-", ""))).otherwise(F.trim(F.substring_index(t, "Translators", 1)))
    out = body.groupBy("doc", "record").agg(
        *[F.min_by(c, F.struct(*L.ORDER)).alias(c) for c in ("section", "chapter")],
        F.min_by(F.regexp_extract(t, r"^([0-9]+)-", 1), F.struct(*L.ORDER)).alias("number"),
        L.join_lines(F.struct(*L.ORDER, F.concat(text, F.lit(" ")).alias("x")), "x", "").alias("english"),
    )
    return out.select("doc", F.lit(book).alias("book"), "section", "chapter", "number", F.replace("english", F.lit("`’"), F.lit("")).alias("english"))


def tradition_book(pages: DataFrame, book: str, arabic_pages: DataFrame | None = None) -> DataFrame:
    """Records that begin with "Tradition 12:": book, chapter, number, english, arabic.

    "Same as no. 3" takes that record's text, "Similar to no. 3" names this chapter. Of records with one
    chapter and number the last counts. Arabic pages are merged in by chapter and running number.
    """
    d = L.lines(pages)
    t = F.trim("line")
    d = d.filter((t != "") & ~X.contains_arabic(F.col("line")) & ~t.rlike("^[0-9]+$"))
    start, header = t.rlike(r"^Tradition [0-9]+:.*$"), F.upper(t).startswith("CHAPTER ")
    d = L.multi_line_headers(d, header, t.contains("Tradition"), "header")
    d = L.carry_forward(d, F.replace("header", F.lit(":"), F.lit(" -")), "chapter")
    body = L.records_from_starts(d.filter(~F.col("in_header")), start).filter("record > 0")
    text = F.when(start, F.trim(F.regexp_replace(t, r"^Tradition [0-9]+:", ""))).otherwise(X.cleanup_text(F.replace(t, F.lit("Translation:"), F.lit(""))))
    out = body.groupBy("doc", "record").agg(
        F.min_by("chapter", F.struct(*L.ORDER)).alias("chapter"),
        F.min_by(F.regexp_extract(t, r"^Tradition ([0-9]+):", 1), F.struct(*L.ORDER)).alias("number"),
        L.join_lines(F.struct(*L.ORDER, text.alias("x")), "x").alias("english"),
    )
    out = out.withColumn("pos", F.concat("doc", F.format_string(":%012d", F.col("record"))))
    out = joins.resolve_same_as(out.select("chapter", "number", "pos", "english"))
    out = out.withColumn("english", joins.mark_similar(F.col("english"))).withColumn("chapter", F.trim(X.cleanup_text(F.col("chapter"))))
    out = joins.last_wins(out, ["chapter", "number"], "pos")
    if arabic_pages is not None:
        out = joins.merge_bilingual(out, arabic_lines(arabic_pages))
    else:
        out = out.withColumn("arabic", F.lit(None).cast("string"))
    return out.select(F.lit(book).alias("book"), "chapter", "number", X.cleanup_text(F.trim("english")).alias("english"), X.cleanup_text(F.col("arabic")).alias("arabic"))


def arabic_lines(pages: DataFrame) -> DataFrame:
    """chapter, number, pos, line, chapter_arabic from Arabic pages whose records begin "text-12".

    Numbers are counted afresh in each chapter: a number out of sequence becomes the next one.
    """
    t = F.trim("line")
    d = L.lines(pages).filter((t != "") & ~t.rlike(r"^[0-9]+.+:$"))
    mark = t.rlike(r"^.*-[0-9]+$") | t.rlike(r"^-.*[0-9]+$")
    header = F.upper(t).startswith("CHAPTER ")
    d = L.multi_line_headers(d, header, mark, "header")
    d = L.carry_forward(d, F.when(header, t), "chapter").filter("chapter IS NOT NULL")
    name = F.trim(F.substr(F.col("header"), F.length(F.when(header, t)) + 1))
    d = L.carry_forward(d, F.when(header, name), "chapter_arabic").filter(~F.col("in_header"))
    d = L.repair_sequence(d, mark, "chapter").filter("number IS NOT NULL")
    text = F.when(t.rlike(r"^.*-[0-9]+$"), F.trim(F.substring_index(t, "-", 1))).when(mark, F.trim(F.regexp_replace(F.regexp_replace(t, "^-", ""), "[0-9]+$", ""))).otherwise(t)
    pos = F.concat("doc", F.format_string(":%08d:%08d", F.col("page"), F.col("line_no")))
    return d.select("chapter", F.col("number").cast("string").alias("number"), pos.alias("pos"), text.alias("line"), "chapter_arabic")


def end_marked_book(pages: DataFrame, book: str, watermarks: Sequence[str] = ()) -> DataFrame:
    """Records that end with their number, under VOLUME, THE BOOK OF and CHAPTER headers.

    Returns book, part, volume, section, chapter, number, english, arabic. Text counts only once all headers are known;
    pages of volume 8 are left out; the number is the trailing digits. Lines that match a watermark (a site's name, say) are noise.
    """
    p = L.drop_contents(pages).withColumn("text", X.rewrite_suffixes(F.col("text")))
    d = L.lines(p)
    t, line = F.trim("line"), F.col("line")
    up = F.upper(t)
    arabic = F.coalesce(X.is_probably_arabic(line), F.lit(False))
    noise = F.lit(False)
    for n in (*END_STYLE_NOISE, *watermarks):
        noise = noise | line.rlike(n)
    vol, sec = up.rlike(r"^VOLUME[\s\xA0][0-9]+$"), t.startswith("THE BOOK OF")
    chap = up.rlike(rf"^({_HEADER_WORDS})[\s\xA0]*[0-9]+[\s\xA0]–.*") & ~line.contains(".")
    blank = line.rlike(L.BLANK)
    d = L.look_back(d, "above")
    d = L.multi_line_headers(d, sec, noise | chap, "s_head").withColumnRenamed("in_header", "in_section")
    d = L.multi_line_headers(d, chap, arabic | blank, "c_head")
    d = L.carry_forward(d, F.when(vol, F.regexp_extract(t, "([0-9]+)$", 1)), "volume")
    cut = F.when(F.col("s_head").contains("(") & F.col("s_head").contains(")"), F.trim(F.regexp_replace("s_head", r"\([^(]*$", ""))).otherwise(F.col("s_head"))
    section = F.trim(X.clean_line(cut))
    chapter = F.trim(X.clean_line(F.regexp_replace("c_head", r"^\S+", "Chapter")))

    def with_arabic(c: Column) -> Column:
        above = F.trim("above")
        return F.when((above != "") & (F.length(X.arabic_normalize(F.col("above"))) <= F.length(c) * 3), F.concat(c, F.lit(" / "), above)).otherwise(c)

    d = L.carry_forward(d, F.when(F.col("s_head").isNotNull(), with_arabic(section)), "section")
    d = L.carry_forward(d, F.when(F.col("c_head").isNotNull(), with_arabic(chapter)), "chapter")
    d = d.filter("volume IS NOT NULL AND section IS NOT NULL AND chapter IS NOT NULL AND volume <> '8'")
    body = d.filter(~vol & ~F.col("in_section") & ~F.col("in_header") & (arabic | ~noise))
    clean = F.trim(X.clean_line(line))
    end = ~arabic & clean.rlike(r".*(\.|\?|!|'|-|`|~|’)[\s\xA0]*[0-9]+[\s\xA0]*$")
    body = L.records_from_ends(body, end)
    text = F.when(end, F.trim(F.regexp_replace(clean, r"[0-9]+[\s\xA0]*$", ""))).otherwise(clean)
    out = body.groupBy("doc", "record").agg(
        *[F.min_by(c, F.struct(*L.ORDER)).alias(c) for c in ("volume", "section", "chapter")],
        F.max(F.when(end, F.regexp_extract(clean, r"([0-9]+)[\s\xA0]*$", 1))).alias("number"),
        L.join_lines(F.when(~arabic, F.struct(*L.ORDER, text.alias("x"))), "x").alias("english"),
        L.join_lines(F.when(arabic, F.struct(*L.ORDER, t.alias("x"))), "x").alias("arabic"),
    )
    out = out.filter("number IS NOT NULL")
    return out.select("doc", F.lit(book).alias("book"), X.volume_part(F.col("volume")).alias("part"), "volume", "section", "chapter", "number", "english", "arabic")


def ocr_chunks(pages: DataFrame) -> DataFrame:
    """doc, page, idx, chunk: runs of Arabic lines of recognised text, each line's words in reverse order."""
    d = L.lines(pages)
    d = L.islands(d, F.coalesce(X.is_probably_arabic(F.col("line")), F.lit(False))).filter("island IS NOT NULL")
    own = F.struct("line_no", F.trim(X.reverse_words(F.col("line"))).alias("x"))
    return d.groupBy("doc", "page", F.col("island").alias("idx")).agg(F.concat(F.lit(" "), L.join_lines(own, "x")).alias("chunk"))


def csv_book(rows: DataFrame, book: str) -> DataFrame:
    """Rows (chapter, note, english, arabic, section), english being "[12] source: text": book, chapter, section, number, source, english, arabic, notes."""
    tidy = lambda c: F.regexp_replace(F.replace(c, F.lit("al-"), F.lit("Al-")), "[`’]", "")
    raw = F.trim("english")
    number = F.substring(raw, F.locate("[", raw), F.locate("]", raw) - F.locate("[", raw) + 1)
    body = tidy(F.substr(raw, F.locate("]", raw) + 1))
    ar = F.replace(F.trim("arabic"), F.concat(F.lit("]"), number, F.lit("]")), F.lit(""))
    source = F.trim(F.substring_index(body, ":", 1))
    text = X.cite_verse(F.trim(F.replace(body, F.concat(F.lit(":"), source), F.lit(""))))
    text = F.when(text.contains(":"), F.trim(F.substr(text, F.locate(":", text) + 1))).otherwise(text)
    note = X.cite_verse(tidy(F.trim("note")))
    head = F.trim("chapter")
    chapter = F.replace(tidy(F.regexp_replace(head, r"^([^.]*)\.", "$1 -")), F.lit("\n"), F.lit(""))
    return rows.select(
        F.lit(book).alias("book"),
        chapter.alias("chapter"),
        "section",
        number.alias("number"),
        source.alias("source"),
        text.alias("english"),
        F.trim(F.substr(ar, F.locate("]", ar) + 1)).alias("arabic"),
        F.nullif(note, F.lit("")).alias("notes"),
    )


def xml_two_books(rows: DataFrame) -> DataFrame:
    """Rows (cells) of the sheet that holds two books, told apart by their ids' prefix.

    Cells are counted: id, topic, subtopic, arabic, english, source, publisher. A row of the first book that has fewer
    cells is left out, as is a row whose id has no number.
    """
    c = [F.get("cells", F.lit(i)) for i in range(7)]
    first = c[0].startswith("MH")
    r = rows.filter(~first | (F.size("cells") >= 7)).filter(X.id_number(c[0]).isNotNull())
    q = X.strip_quotes
    topic = q(F.trim(X.squeeze(c[1])))
    return r.select(
        F.when(first, F.lit("Mizan Al-Hikmah")).otherwise(F.lit("Ghurar Al-Hikam")).alias("book"),
        X.id_number(c[0]).alias("number"),
        F.when(first, topic).alias("part"),
        F.when(first, q(F.trim(X.squeeze(c[2])))).otherwise(F.concat(topic, F.lit(" "), F.coalesce(c[2], F.lit("")))).alias("section"),
        F.when(first, q(c[3])).otherwise(F.concat(F.lit("الإمامُ عليٌّ (عَلَيهِ الّسَلامُ) : "), q(c[3]))).alias("arabic"),
        F.when(first, q(c[4])).otherwise(F.concat(F.lit("Imam Ali (AS) said, "), q(c[4]))).alias("english"),
        F.when(first, q(X.expand_source(c[5]))).alias("source"),
        F.when(first, c[6]).otherwise(F.lit("Ansariyan Publications")).alias("publisher"),
    )


def xml_one_book(rows: DataFrame, book: str) -> DataFrame:
    """Rows (cells) of a single-book sheet: id, arabic, english, (one unused), publisher; notes split off."""
    c = [F.get("cells", F.lit(i)) for i in range(5)]
    flat = lambda x: F.regexp_replace(F.trim(X.strip_quotes(x)), "[\r\n]", "")
    english, notes = X.split_notes(flat(c[2]))
    r = rows.filter(X.id_number(F.trim(c[0])).isNotNull())
    return r.select(F.lit(book).alias("book"), X.id_number(F.trim(c[0])).alias("number"), flat(c[1]).alias("arabic"), english.alias("english"), F.trim(c[4]).alias("publisher"), notes.alias("notes"))
