import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import shaping


def value(spark, f, *xs):
    df = spark.createDataFrame([xs], ", ".join(f"c{i} string" for i in range(len(xs))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(xs))]).alias("v")).first().v


@pytest.mark.parametrize(
    "f,given,want",
    [
        (X.word_to_number, "twenty one", "21"),
        (X.word_to_number, "forty two", "2"),
        (X.word_to_number, "fourty two", "42"),
        (X.word_to_number, "one hundred twenty", "120"),
        (X.word_to_number, "one hundred thousand", "100"),
        (X.word_to_number, "twenty one thousand", "21000"),
        (X.word_to_number, "SEVEN", "7"),
        (X.word_to_number, "xyz", "0"),
        (X.convert_word_to_integer, "twenty-one", 21),
        (X.convert_word_to_integer, "forty two", 42),
        (X.convert_word_to_integer, "one hundred and five", 105),
        (X.convert_word_to_integer, "one hundred thousand", 100000),
        (X.convert_word_to_integer, "two million three hundred thousand", 2300000),
        (X.convert_word_to_integer, "hundred", 0),
        (X.convert_word_to_integer, "fourty two", 0),
        (X.convert_word_to_integer, "", 0),
        (X.convert_word_to_integer, None, 0),
        (X.cleanup_text, "He said`,3 that  it’s.6 so.5 end", "He said that its.6 so end"),
        (X.cleanup_text, "a.5", "a.5"),
        (X.is_probably_arabic, "a", True),
        (X.is_probably_arabic, "ab", False),
        (X.is_probably_arabic, "", False),
        (X.is_probably_arabic, "علي", True),
        (X.is_probably_arabic, "ab قال", True),
        (X.contains_arabic, "ab ق", True),
        (X.is_arabic_client, "ݐ", True),
        (X.arabic_normalize, "مُحَمَّد", "محمد"),
        (X.number_from_end, "page 12", "12"),
        (X.fix_ocr_digits, "lO2I", "1021"),
        (X.reverse_words, "a b c", "c b a"),
        (X.rewrite_suffixes, "Musaasws satanla Yazidla", "Musa satan(la) Tazid(la)"),
        (X.clean_line, "the Prophetsas said", "the Prophets said "),
        (X.clean_line, "heas, went", "He, went "),
        (X.strip_tags, "a<b\nc>d", "ad"),
        (X.ascii_only, " é a ", "a"),
        (X.split_query, 'a "b c" d:"e f"', ["a", '"b c"', 'd:"e f"']),
        (X.is_numeric, "1.5", True),
        (X.is_numeric, "x", False),
        (X.cite_verse, "see (2:255) tail\nnext", "see [2:255]\nnext"),
        (X.expand_source, "v. 1 ch. 2 no. 3", "volume:1 chapter:2 number:3"),
        (X.id_number, "MH0042", "42"),
        (X.id_number, "MHx", None),
        (X.chapter_key, "Chapter 1 - x", "CHAPTER 1"),
        (X.volume_part, "8", None),
        (shaping.volume_label, "2", "Volume 2"),
        (shaping.encode_component, "a b!~", "a%20b!~"),
    ],
)
def test_scalar(spark, f, given, want):
    assert value(spark, f, given) == want


def test_number_from_end_fails(spark):
    with pytest.raises(Exception, match="no number"):
        value(spark, X.number_from_end, "12 none")


def test_query_param(spark):
    assert value(spark, lambda c: X.query_param(c, "q"), "http://a/?x=1&q=a%20b+c") == "a b c"
    assert value(spark, lambda c: X.query_param(c, "z"), "http://a/?x=1") is None


def test_combine(spark):
    assert value(spark, X.combine_arabic, "قال محمد", "مُحَمَّد مِن") == "قال مُحَمَّد"
    assert value(spark, X.match_score, "abc de", "abc de") == 0
    assert value(spark, X.match_score, "abc de", "xyz") == 2 + 3


def test_udfs(spark):
    assert value(spark, X.strip_accents, "Éà ł") == "Ea l"
    assert value(spark, X.html_to_text, "<p>a<b>b</b></p><script>x()</script><p>c&amp;d") == "ab c&d"
    assert value(spark, X.html_to_text, None) is None


def test_split_notes(spark):
    df = spark.createDataFrame([("Some long text here. as-Sayyid ar-Radi says: more",), ("none",)], "c string")
    e, n = X.split_notes(F.col("c"))
    got = [tuple(r) for r in df.select(e, n).collect()]
    assert got[0][1].endswith("ar-Radi says: more") and got[1] == ("none", None)


def test_share_text(spark):
    df = spark.createDataFrame([("7", '<span class="highlight">B</span>', None, "3", "C", "2"), ("8", "x" * 400, None, None, None, None)], "_id string, book string, edition string, number string, chapter string, volume string")
    a, b = [r.v for r in df.select(shaping.share_text(df, "https://h.example").alias("v")).collect()]
    assert a == "B%20%2C%20%233%2C%20C%2C%20VOL.%202"
    assert len(b) < 260


def test_normalisers_settle(spark):
    for f in (X.arabic_normalize, X.strip_tags, X.squeeze):
        once = value(spark, f, "مُحَمَّد  <b> a   b")
        assert value(spark, f, once) == once
