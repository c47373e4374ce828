"""Text functions as Spark columns. Python runs only where Spark has no such expression."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\xA0]"
ARABIC = r"[؀-۠]"
_MARKS = r"[ؐ-ؚـً-ٰٟۖ-ۭ]"


def is_arabic(c: Column) -> Column:
    """Some letter lies in U+0600..U+06E0."""
    return c.rlike(ARABIC)


def contains_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


def is_probably_arabic(c: Column) -> Column:
    """Arabic letters number at least half the length, rounded down; blank text isn't Arabic.

    So any single character that isn't a blank is Arabic.
    """
    arabic = F.length(F.regexp_replace(c, r"[^؀-۠]+", ""))
    return ~c.rlike(rf"^{SPACE}*$") & (arabic >= F.floor(F.length(c) / 2))


def is_arabic_client(c: Column) -> Column:
    return c.rlike(r"[؀-ۿݐ-ݿ]")


def arabic_normalize(c: Column) -> Column:
    """Without honorifics, Koranic marks, tatweel and vowel signs; letters stay as they are."""
    return F.regexp_replace(c, _MARKS, "")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Combining marks U+0300..U+036F dropped after decomposition; l and L with a stroke become plain."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", x) if not 0x300 <= ord(ch) <= 0x36F).replace("ł", "l").replace("Ł", "L")

    return s.map(one)


def strip_accents_py(x: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", x) if not 0x300 <= ord(ch) <= 0x36F).replace("ł", "l").replace("Ł", "L")


def cleanup_text(c: Column) -> Column:
    """Back quotes and apostrophes go, a footnote digit after a stop or comma and white-space runs become a space."""
    c = F.regexp_replace(c, "[`’]", "")
    c = F.regexp_replace(c, "[.,][0-5] ", " ")
    return F.regexp_replace(c, r"\s+", " ")


_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]).cast("map<string,bigint>")


def convert_word_to_integer(c: Column) -> Column:
    """The number that words name; 0 if any word is none, or there is no text.

    Hundred multiplies what the words since the last larger scale add up to.
    """
    small = {w: i for i, w in enumerate(_UNITS)} | {w: 10 * i for i, w in enumerate(_TENS, 2)}
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "[–-]", " ")), " and", " "))
    words = F.split(t, r"\s+")
    values, scales = _lookup(small), _lookup(_SCALES)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("run"))

    def step(acc: Column, w: Column) -> Column:
        unit, scale = F.element_at(values, w), F.element_at(scales, w)
        big = scale.isNotNull()
        total = F.when(big, acc["total"] + acc["run"] * scale).otherwise(acc["total"])
        run = F.when(big, F.lit(0)).when(w == "hundred", acc["run"] * 100).otherwise(acc["run"] + F.coalesce(unit, F.lit(0)))
        return F.struct(total.alias("total"), run.cast("long").alias("run"))

    known = [*small, "hundred", *_SCALES]
    good = F.forall(words, lambda w: w.isin(*known))
    got = F.aggregate(words, start, step, lambda a: a["total"] + a["run"])
    return F.when(c.isNull() | (F.length(c) == 0) | ~good, F.lit(0).cast("long")).otherwise(got)


def word_to_number(c: Column) -> Column:
    """The other reading of number words, as text: unknown words are skipped, "fourty" is known and "forty" isn't.

    A scale multiplies the words since the last scale, tens replace them.
    """
    units = {w: i for i, w in enumerate(_UNITS)}
    tens = {("fourty" if w == "forty" else w): 10 * i for i, w in enumerate(_TENS, 2)}
    scales = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9}
    u, t, o = _lookup(units), _lookup(tens), _lookup(scales)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("prev"))

    def step(acc: Column, w: Column) -> Column:
        a, b, s = F.element_at(u, w), F.element_at(t, w), F.element_at(o, w)
        total = (
            F.when(a.isNotNull(), acc["sum"] + a)
            .when(s.isNotNull(), F.when(acc["sum"] != 0, acc["sum"] - acc["prev"]).otherwise(acc["sum"]) + acc["prev"] * s)
            .when(b.isNotNull(), acc["sum"] + b)
            .otherwise(acc["sum"])
        )
        prev = F.when(a.isNotNull(), acc["prev"] + a).when(s.isNotNull(), F.lit(0)).when(b.isNotNull(), b).otherwise(acc["prev"])
        return F.struct(total.alias("sum"), prev.cast("long").alias("prev"))

    return F.aggregate(F.split(F.lower(c), " "), start, step, lambda a: a["sum"].cast("string"))


def number_from_end(c: Column, strict: bool = True) -> Column:
    """Digits at the end, after something that is no digit; an error (or null) where there are none."""
    got = F.nullif(F.regexp_extract(c, r"[^0-9]+([0-9]+)$", 1), F.lit(""))
    return F.coalesce(got, F.raise_error(F.concat(F.lit("no number at the end of: "), c)).cast("string")) if strict else got


def combine_arabic(plain: Column, marked: Column) -> Column:
    """plain with each word of marked put back in where its bare form (of 3 letters or more) occurs.

    Words are taken in sorted order, so the result is one.
    """
    words = F.array_sort(F.array_distinct(F.split(marked, SPACE)))

    def put(text: Column, word: Column) -> Column:
        bare = arabic_normalize(word)
        return F.when(F.length(bare) >= 3, F.replace(text, bare, word)).otherwise(text)

    return F.aggregate(words, plain, put)


def _bare_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE, ""))


def match_score(text: Column, chunk: Column) -> Column:
    """How badly chunk fits text: difference in length, plus what is left of chunk without text's words."""
    left = F.aggregate(F.split(text, SPACE), chunk, lambda acc, w: F.when(w == "", acc).otherwise(F.replace(acc, w, F.lit(""))))
    rest = F.length(F.regexp_replace(F.regexp_replace(left, rf"{SPACE}.{SPACE}", ""), SPACE, ""))
    return F.abs(_bare_length(text) - _bare_length(chunk)) + rest


#: Words to which the honorific "as" is found glued.
HONOURED = tuple(
    sorted(
        set(
            "you your she he his him me i they their son brother musa isa nuh adam lut hud salih yahya yusuf yunus "
            "ayyub idris ishaq ismail ibrahim yaqoub shuaib qasim hamza farwa zakariya khadeeja maryam talib uttalib jibraeel mursils "
            "rasool rasools prophet prophets successors".split()
        )
    )
)


def clean_line(c: Column) -> Column:
    """Each word that is an honoured word with "as" glued on loses it and gets a capital; every word is followed by a space.

    The punctuation ignored in the comparison is a class in which ".-?" and ",-?" are ranges, digits included.
    """
    glued = F.array(*[F.lit(w + "as") for w in HONOURED])
    words = F.split(F.regexp_replace(c, rf"{SPACE}+$", ""), SPACE)

    def one(w: Column) -> Column:
        low = F.lower(w)
        known = F.array_contains(glued, F.regexp_replace(low, "[(),.-?’]", ""))
        form = F.regexp_replace(low, "[(),-?’]", "")
        cut = F.replace(low, form, F.substring(form, F.lit(1), F.length(form) - 2))
        cut = F.concat(F.upper(F.substring(cut, 1, 1)), F.substr(cut, F.lit(2)))
        return F.when(known & F.array_contains(glued, form), cut).otherwise(w)

    return F.concat(F.array_join(F.transform(words, one), " "), F.lit(" "))


def fix_ocr_digits(c: Column) -> Column:
    return F.translate(c, "lLIO", "1110")


def reverse_words(c: Column) -> Column:
    return F.array_join(F.reverse(F.split(c, " ")), " ")


#: Glued curses and their spelled-out form; one of them comes out with a T, as it always has.
_CURSES = {"satanla": "satan(la)", "yazidla": "yazid(la)", "Yazidla": "Tazid(la)", "Yazeedla": "Yazeed(la)", "Satanla": "Satan(la)", "Satanlsa": "Satans(la)"}


def rewrite_suffixes(c: Column) -> Column:
    c = F.regexp_replace(c, "azwj|asws|saww", "")
    for k, v in _CURSES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("p", "br", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "title", "ul", "ol", "table", "nav", "header", "footer"):
            self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "title"):
            self.out.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def html_text(x: str | None) -> str | None:
    if x is None:
        return None
    p = _Text()
    p.feed(x)
    p.close()
    return " ".join("".join(p.out).split())


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    """Text without markup, scripts and styles; blocks are set apart, white space collapsed."""
    return s.map(html_text)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<(?:.|\n)*?>", "")


def ascii_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


def split_query(c: Column) -> Column:
    """Words of a query; quoted runs stay whole."""
    return F.regexp_extract_all(c, F.lit(r'((?:".*?"|[^"\s]+)+)'), F.lit(1))


def is_numeric(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def query_param(url: Column, name: str) -> Column:
    """The decoded value of a URL's parameter; null where it has none."""
    return F.url_decode(F.replace(F.parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit("+"), F.lit("%20")))


def cite_verse(c: Column) -> Column:
    """(2:255) becomes [2:255], and the rest of its line goes."""
    return F.regexp_replace(c, r"\(([0-9]+):([0-9]+)\).*", "[$1:$2]")


def expand_source(c: Column) -> Column:
    for k, v in {"v. ": "volume:", "ch. ": "chapter:", "no. ": "number:"}.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def id_number(c: Column) -> Column:
    """The integer after an id's two-letter prefix, as text; null if it is none."""
    return F.substr(c, F.lit(3)).try_cast("int").cast("string")


def split_notes(english: Column) -> tuple[Column, Column]:
    """(english, notes): notes begin 10 characters before "ar-Radi says"."""
    at = F.locate("ar-Radi says", english)
    notes = F.when(at > 10, F.trim(F.substr(english, at - 10)))
    return F.when(notes.isNotNull(), F.substring(english, F.lit(1), F.length(english) - F.length(notes))).otherwise(english), notes


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, "[`~’]", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def chapter_key(c: Column) -> Column:
    return F.upper(F.trim(F.substring_index(c, "-", 1)))


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyy.MM.dd.HH.mm.ss")


def volume_part(volume: Column) -> Column:
    """Below 3 the principles, 8 none (its pages are left out), else jurisprudence."""
    v = volume.try_cast("int")
    return F.when(v < 3, F.lit("Al-Usul (Principles) / أصول الكافي")).when(v == 8, F.lit(None)).otherwise(F.lit("Al-Furu' (Jurisprudence) / فـروع الـكـافـي"))


def same_elements(a: Column, b: Column) -> Column:
    """Equal as bags: order doesn't matter."""
    return F.sort_array(a).eqNullSafe(F.sort_array(b))
