import datetime

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import joins, lines, loaders, mutate
from lumenfold.schema import RECORD, as_records, from_record_json
from lumenfold.sources import books


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc string, page int, text string")


def test_numbered_book(spark):
    p = pages(spark, "17\nCHAPTER TWO: long\ntitle\n\n1. First text\nmore.3 of it\n2. Second", "goes on\nTranslator’s Note\n3. lost", "3. Third `x’")
    titles = spark.createDataFrame([(2, "The Second")], "n int, title string")
    got = loaders.numbered_book(p, "B", titles).orderBy("number").collect()
    assert [(r.chapter, r.number, r.english) for r in got] == [
        ("Chapter 2 - The Second", "1", "First text more of it "),
        ("Chapter 2 - The Second", "2", "Second goes on "),
        ("Chapter 2 - The Second", "3", "Third x "),
    ]
    assert loaders.numbered_book(p, "B").first().chapter == "CHAPTER TWO: long title"


def test_dashed_book(spark):
    p = pages(spark, "SECTION TWO\nOn Faith\nCHAPTER 3\nSome title\n12- Text one\nmore\nON FAITH\n13- Two Translators say\nthree Translators say", "Translators' note: no\n14- never")
    got = loaders.dashed_book(p, "B").orderBy("number").collect()
    assert [(r.section, r.chapter, r.number, r.english) for r in got] == [
        ("SECTION 2 - On Faith", "CHAPTER 3 - Some title", "12", "Text one more "),
        ("SECTION 2 - On Faith", "CHAPTER 3 - Some title", "13", "Two Translators say three "),  # only later lines are cut
    ]


def test_tradition_book(spark):
    p = pages(spark, "Chapter 1: The\nstart\nTradition 1: One `text\nTranslation: rest\nTradition 2: Same as no. 1\nTradition 3: Similar to no 1.", "Tradition 4: Same as no. 2.\nTradition 5: Same as no. 9")
    ar = pages(spark, "CHAPTER 1\nباب\nنص-1\nتتمة\nنص ثان-7\nزائد-9\nx-4\ny-5\nz-6", doc="a")
    got = {r.number: r for r in loaders.tradition_book(p, "B", ar).collect()}
    assert got["1"].english == "One text rest" and got["2"].english == "One text rest" == got["4"].english
    assert got["3"].english == "Similar to no 1. from this chapter." and got["5"].english == "Same as no. 9"
    assert got["1"].chapter == "Chapter 1 - The start / باب" and got["1"].arabic == " نص تتمة"
    assert got["2"].arabic == " نص ثان"  # 7 follows 1, so it is 2
    assert got["6"].english is None and got["6"].arabic == " z"  # Arabic only, in a known chapter


def test_end_marked_book(spark):
    p = pages(
        spark,
        "Volume 1\nxx\nTHE BOOK OF Knowledge (x)\n\nChapter 2 – On it\n\nProphetsas said azwj this. 5\nnext\n3 out of 9\nline! 6\nقال مُحَمَّد\nlast. 7",
        "Table of Contents\nnot. 9",
        "Volume 8\nno. 1",
    )
    got = loaders.end_marked_book(p, "B").orderBy("number").collect()
    assert [(r.number, r.english, r.arabic) for r in got] == [("5", "Prophets said  this.", ""), ("6", "next line!", ""), ("7", "last.", "قال مُحَمَّد")]
    assert {(r.volume, r.section, r.chapter) for r in got} == {("1", "THE BOOK OF Knowledge", "Chapter 2 – On it")}
    assert got[0].part.startswith("Al-Usul")


def test_ocr_chunks(spark):
    got = loaders.ocr_chunks(pages(spark, "قال علي\nثم\nlatin text\nمحمد")).orderBy("idx").collect()
    assert [r.chunk for r in got] == [" علي قال ثم", " محمد"]


def test_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('"1. al-Faith\nx",see `al-x,u,"[12] Kafi: he said (2:255) tail",[12] نص,S\n"2. No","",u,"[13] Src: a: b",[13] ب,T\n', encoding="utf-8")
    got = loaders.csv_book(books.read_csv_rows(spark, str(tmp_path / "b.csv")), "B").orderBy("number").collect()
    a = got[0]
    assert (a.chapter, a.number, a.source, a.english, a.arabic, a.section, a.notes) == ("1 - Al-Faithx", "[12]", "Kafi", "he said [2:255]", "نص", "S", "see Al-x")
    assert got[1].notes is None and got[1].source == "Src"


def test_xml(spark, tmp_path):
    def row(*cells):
        return "<Row>" + "".join(f"<Cell><Data>{c}</Data></Cell>" for c in cells) + "</Row>"

    text = "<Sheet>" + row("MH012", "t  `a", "s", "ar", "en~", "v. 1 no. 2", "P") + row("MH13", "few") + row("GH7", "t", "s", "ar", "en") + row("XXno", *"abcdef") + "</Sheet>"
    (tmp_path / "x.xml").write_text(text)
    got = {r.number: r for r in loaders.xml_two_books(books.read_xml_rows(spark, str(tmp_path / "x.xml"))).collect()}
    assert set(got) == {"12", "7"}
    assert (got["12"].part, got["12"].source, got["12"].english, got["12"].book) == ("t a", "volume:1 number:2", "en", "Mizan Al-Hikmah")
    assert got["7"].section == "t s" and got["7"].english == "Imam Ali (AS) said, en" and got["7"].source is None
    one = loaders.xml_one_book(spark.createDataFrame([(["NB3", "ar\n", "Text that is long. Sh ar-Radi says: x", "", " P "],)], "cells array<string>"), "N").first()
    assert one.number == "3" and one.publisher == "P" and one.notes.endswith("says: x")


def test_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# c\nhand,يد\nfoot , leg\n\n", encoding="utf-8")
    syn = books.read_synonyms(spark, str(tmp_path / "s.txt"))
    assert syn.count() == 4
    t = spark.createDataFrame([("leg",), ("other",)], "term string")
    assert sorted(r.term for r in books.expand_synonyms(t, syn).collect()) == ["foot", "leg", "other"]
    assert books.read_lines(spark, str(tmp_path / "s.txt"))[1] == "hand,يد"
    (tmp_path / "bl.json").write_text('[{"book": "a", "blurb": "b"}]')
    assert books.read_blurbs(spark, str(tmp_path / "bl.json")).collect() == [("a", "b")]
    assert books.latest_file(spark, str(tmp_path)).endswith((".txt", ".json"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "p.txt").write_text("one\ftwo")
    assert [r.text for r in books.read_pages(spark, str(tmp_path / "p.txt")).orderBy("page").collect()] == ["one", "two"]
    r = spark.createDataFrame([('{"ParsedResults":[{"ParsedText":"hi"}]}',)], "response string")
    assert r.select(books.ocr_text()).first()[0] == "hi"


def test_record_files(spark, tmp_path):
    d = as_records(spark.createDataFrame([("1", "e")], "_id string, english string"))
    books.write_records(d, str(tmp_path / "r"))
    books.write_records(d, str(tmp_path / "r"))
    back = books.read_records(spark, str(tmp_path / "r"))
    assert back.count() == 2 and back.first().tags == [] and books.get_by_id(back, "1").count() == 2
    books.write_json(d, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"tags":[],"english":"e","gradings":[],"related":[],"history":[]}'
    with pytest.raises(Exception):
        spark.createDataFrame([("{broken",)], "j string").select(from_record_json(F.col("j"))).collect()
    assert RECORD["_id"].nullable is False


def test_line_tools(spark):
    d = lines.lines(pages(spark, "aa\n\nعلي\nمحمد\nxx\nHEAD\n\n"))
    assert [r.line for r in d.orderBy("line_no").collect()] == ["aa", "", "علي", "محمد", "xx", "HEAD"]
    above = {r.line_no: r.above for r in lines.look_back(d).collect()}
    # a line of one letter would count as Arabic
    assert above[5] == "محمد علي " and above[4] == "محمد علي " and above[1] == ""
    isl = {r.line_no: r.island for r in lines.islands(d, F.col("line").rlike("[؀-۠]")).collect()}
    assert isl == {0: None, 1: None, 2: 1, 3: 1, 4: None, 5: None}
    assert lines.drop_contents(pages(spark, "Table of Contents", "Chapter 1 ...", "ok")).count() == 1
    assert lines.drop_noise(d, lines.BLANK, "^HEAD").count() == 4


def test_fifo(spark):
    e = spark.createDataFrame([("d", n) for n in (1, 2, 3, 5)], "doc string, number int")
    a = spark.createDataFrame([("d", 0, i, x, m) for i, (x, m) in enumerate([("a", None), ("b", 2), ("c", None), ("d", 4), ("e", 9)])], "doc string, page int, line_no int, line string, mark int")
    got = {r.number: r.arabic for r in lines.fifo_complete(e, a).collect()}
    assert got == {1: "a", 2: "b c", 5: "d"}


def test_best_match(spark):
    t = spark.createDataFrame([(1, 1, "قال محمد"), (2, 1, "x")], "page int, text_id int, text string")
    c = spark.createDataFrame([(1, 0, " "), (1, 1, "علي"), (1, 2, "قال مُحَمَّد"), (1, 3, "قال مُحَمَّد")], "page int, idx int, chunk string")
    got = {r.page: r.chunk for r in joins.best_match(t, c).collect()}
    assert got == {1: "قال مُحَمَّد", 2: ""}


def test_patches(spark):
    r = spark.createDataFrame([("1", "a", "s", ["h"]), ("2", "b", None, None)], "_id string, english string, source string, history array<string>")
    t = datetime.datetime
    p = spark.createDataFrame([("1", "x", None, t(2020, 1, 1)), ("1", "y", None, t(2021, 1, 1)), ("1", None, "z", t(2019, 1, 1))], "_id string, english string, source string, at timestamp")
    got = {x._id: x for x in mutate.apply_patches(r, p, "me", {"me"}).collect()}
    assert (got["1"].english, got["1"].source, len(got["1"].history)) == ("y", "z", 2) and got["2"].history == []
    assert '"english":"a"' in got["1"].history[1]
    with pytest.raises(PermissionError):
        mutate.apply_patches(r, p, "you", {"me"})


def test_versions(spark, tmp_path):
    """An edit appends what it changed, checked, and drops caches; a refused one leaves no trace."""
    t = datetime.datetime
    v = mutate.Versions(spark, str(tmp_path / "v"))
    v.append(spark.createDataFrame([("1", "a", "s"), ("2", "b", "s")], "_id string, english string, source string"))

    class Counting:
        n = 0

        def clear(self):
            self.n += 1

    cache = Counting()
    p = spark.createDataFrame([("1", "x", t(2020, 1, 1)), ("9", "y", t(2020, 1, 1))], "_id string, english string, at timestamp")
    with pytest.raises(PermissionError):
        v.edit(p, "you", {"me"}, [cache])
    assert cache.n == 0 and v.all().count() == 2
    v.edit(p, "me", {"me"}, [cache])
    v.edit(p.withColumn("english", F.lit("z")), "me", caches=[cache])
    got = {r._id: r for r in v.latest().collect()}
    assert cache.n == 2 and v.all().count() == 4
    assert (got["1"].english, got["1"].source, got["1"].version, len(got["1"].history)) == ("z", "s", 2, 2)
    assert (got["2"].english, got["2"].version) == ("b", 0)


def test_render_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one|two")
    (tmp_path / "b.bin").write_bytes(b"three")
    got = books.render_pages(spark, str(tmp_path), lambda b: b.decode().split("|")).orderBy("doc", "page").collect()
    assert [(r.doc[-5:], r.page, r.text) for r in got] == [("a.bin", 0, "one"), ("a.bin", 1, "two"), ("b.bin", 0, "three")]


def test_same_as_chain(spark):
    """Chains of any length end at their text; a name that nothing above has stays."""
    rows = [("c", str(i), i, "text" if i == 0 else f"Same as no. {i - 1}") for i in range(40)] + [("c", "99", 99, "Same as no. 100."), ("c", "100", 100, "late"), (None, "1", 200, "own"), (None, "2", 201, "Same as no. 1")]
    d = spark.createDataFrame(rows, "chapter string, number string, pos int, english string")
    got = {r.pos: r.english for r in joins.resolve_same_as(d).collect()}
    assert all(got[i] == "text" for i in range(40)) and got[99] == "Same as no. 100." and got[201] == "own"


def test_changed_fields(spark):
    d = spark.createDataFrame([(("a", ["x", "y"], None), ("b", ["y", "x"], "n"))], "o struct<book:string,tags:array<string>,notes:string>, n struct<book:string,tags:array<string>,notes:string>")
    assert d.select(mutate.changed_fields(F.col("o"), F.col("n"), ["book", "tags", "notes"]).alias("c")).first().c == ["book"]


def test_blurbs(spark):
    r = spark.createDataFrame([("<b>Al-Kafi</b> / x",), ("other",)], "book string")
    b = spark.createDataFrame([("al-kafi", "B"), ("KAFI", "C")], "book string, blurb string")
    assert sorted(x.blurb for x in joins.with_blurbs(r, b).collect()) == ["B", "C"]
