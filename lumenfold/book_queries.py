"""Queries for sources, book loaders, edits, guards and the rest of the text functions, over the supplied tables, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import joins, lines, loaders, mutate, shaping, terms
from .plans import rewrite as R
from .plans import search as S
from .queries import BASE, LINES, WORDS, bm25_sql, doc_lines, index, query, records, scored, table, turns
from .schema import as_records, from_record_json, record_json
from .sources import books
from .storage import shared_path

LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"


def in_arabic(c: Column) -> Column:
    """Letters swapped for Arabic ones: the supplied tables have none."""
    return F.translate(F.lower(c), LATIN, ARABIC)


AR = f"translate(lower({{c}}), '{LATIN}', '{ARABIC}')"

# Search: several fields, synonyms, minimum matches, highlights


@query(
    f"""WITH {BASE},
f AS (SELECT id, 'english' AS field, w FROM r WHERE text IS NOT NULL
      UNION ALL SELECT id, 'book', {WORDS.format(c='lang')} FROM r WHERE lang IS NOT NULL
      UNION ALL SELECT id, 'source', {WORDS.format(c='source')} FROM r WHERE source IS NOT NULL),
fs AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM f GROUP BY field),
q AS (SELECT * FROM (VALUES ('en'), ('src1'), ('thing')) AS t(term)),
h AS (SELECT id, field, term, len(w) AS dl, len([x FOR x IN w IF x = term]) AS tf FROM f, q WHERE list_contains(w, term)),
df AS (SELECT field, term, count(*) AS df FROM h GROUP BY ALL),
best AS (SELECT id, term, max({bm25_sql()}) AS s FROM h JOIN fs USING (field) JOIN df USING (field, term) GROUP BY ALL)
SELECT id AS _id, round(sum(s), 6) AS score FROM best GROUP BY id"""
)
def default_fields_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term counts in the field where it scores best."""
    return scored(S.hits(index(spark, sf_dir, "english", "book", "source"), "en src1 thing", None))


@query(
    f"""WITH {BASE}, q AS (SELECT * FROM (VALUES ('thing'), ('ouing'), ('that')) AS t(term))
SELECT id AS _id, round(sum({bm25_sql()}), 6) AS score FROM p JOIN lex USING (term) JOIN q USING (term), st GROUP BY id"""
)
def synonym_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([(1, "Thing"), (1, "ouing"), (2, "thing"), (2, "that"), (3, "of"), (3, "and")], "group_id long, term string")
    return scored(S.hits(index(spark, sf_dir).with_synonyms(s), "thing", None))


@query(
    f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {WORDS.format(c='text')} AS e, {WORDS.format(c=AR.format(c="coalesce(text, '')"))} AS a FROM documents)
SELECT doc_id FROM d WHERE list_has_any(e, ['thing', 'ouing', 'that', 'the', 'this']) AND list_has_any(a, {[''.join(ARABIC[LATIN.index(ch)] for ch in w) for w in ('and', 'ingof', 'tion')]})"""
)
def minimum_should_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight terms both languages must match."""
    r = records(spark, sf_dir).withColumn("arabic", in_arabic(F.coalesce("english", F.lit(""))))
    arabic = ["".join(ARABIC[LATIN.index(ch)] for ch in w) for w in ("and", "ingof", "tion")]
    return terms.matching_docs(r, ["thing", "ouing", "That", "the", "this", *arabic])


_MARK = "CASE WHEN length(x) BETWEEN 4 AND 6 AND damerau_levenshtein(lower(x), 'thing') <= 1 THEN '<span class=\"highlight\">' || x || '</span>' ELSE x END"


@query(
    f"""WITH {BASE},
f AS (SELECT term, df, 1 - damerau_levenshtein(term, 'thing') / CAST(greatest(1, least(length(term), 5)) AS DOUBLE) AS w
      FROM lex WHERE length(term) BETWEEN 4 AND 6 AND damerau_levenshtein(term, 'thing') <= 1),
s AS (SELECT id, sum(w * {bm25_sql()}) AS s FROM p JOIN f USING (term), st GROUP BY id),
k AS (SELECT CAST(row_number() OVER (ORDER BY round(s, 9) DESC, id) AS INTEGER) AS rank, id FROM s ORDER BY round(s, 9) DESC, id LIMIT 20)
SELECT rank, id AS _id, array_to_string([{_MARK} FOR x IN regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')], '') AS english
FROM k JOIN r USING (id)"""
)
def highlighted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(index(spark, sf_dir), "thing", per_page=20).page.select("rank", "_id", "english")


@query("SELECT c_custkey, contains(c_name, '#00') AS marked, starts_with(upper(c_mktsegment), 'MA') AS begins, regexp_matches(c_name, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]') AS client_arabic FROM customer")
def client_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        shaping.has_highlight(F.replace("c_name", F.lit("#00"), F.lit('<span class="highlight">'))).alias("marked"),
        shaping.starts_with_ignore_case(F.col("c_mktsegment"), F.lit("Ma")).alias("begins"),
        X.is_arabic_client(F.col("c_name")).alias("client_arabic"),
    )


_GUARDS = [
    ("search", "pledge +oath (a b) \"x y\" nea?", "pledge~ +oath (a b) \"x y\" nea?~"),
    ("lookup", "pledge^4 hijrah", "pledge^4 AND hijrah~"),
    ("search", "\"pledge migration\"~10 oath sworn", "\"pledge migration\"~10 oath sworn"),
    ("tokens", "a (b c) \"d e\" f", "a|(b c)|\"d e\"|f"),
    ("mode", "book:asc", "LOOKUP"),
    ("mode", "", "SEARCH"),
    ("sort", "book:desc,number:desc", "book False False;number True True"),
    ("sort", "book", "error"),
    ("bounds", "3 500", "200 100"),
    ("bounds", "0 20", "error"),
    ("prefix", "a", "error"),
    ("prefix", "ab", "ab"),
    ("size", "11", "error"),
    ("size", "10", "10"),
    ("query", " a ", "False"),
    ("inputs", "a,b,,", "a|b"),
    ("inputs", ",,", "error"),
    ("phrases", "a|b c|\"d", "a"),
    ("drill", "<b>Al Kafi</b>|C|||Volume 2", "book:\"Al Kafi\" chapter:\"C\" volume:\"2\" volume:asc,part:asc,section:asc,chapter:asc,number:asc"),
    ("pager", "1234 3", "500 20 True True"),
    ("pager", "20 1", "20 0 False False"),
]


def guard(name: str, text: str) -> str:
    """What a driver-side function makes of text, as text."""
    pair = lambda: [int(x) for x in text.split()]
    run = {
        "search": lambda: R.enhance_query(text, R.Mode.SEARCH),
        "lookup": lambda: R.enhance_query(text, R.Mode.LOOKUP),
        "tokens": lambda: "|".join(R.split_nested(text)),
        "mode": lambda: R.mode_of(text).name,
        "sort": lambda: ";".join(" ".join(map(str, x)) for x in R.parse_sort(text)),
        "bounds": lambda: " ".join(map(str, R.page_bounds(*pair()))),
        "prefix": lambda: R.check_prefix(text),
        "size": lambda: str(R.check_size(int(text))),
        "query": lambda: str(R.check_query(text)),
        "inputs": lambda: "|".join(R.input_terms(text)),
        "phrases": lambda: "|".join(R.searchable_terms(text.split("|"))),
        "drill": lambda: " ".join(R.drill_down(*text.split("|"))),
        "pager": lambda: (lambda p: f"{p['total']} {len(p['pages'])} {p['previous']} {p['next']}")(R.page_list(*pair())),
    }[name]
    try:
        return run()
    except ValueError:
        return "error"


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, g)) + ')' for g in _GUARDS)}) AS t(name, input, output)")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query rewriting and the guards, which run on the driver, against what they must give."""
    return spark.createDataFrame([(n, t, guard(n, t)) for n, t, _ in _GUARDS], "name string, input string, output string")


# Sources and sinks: each writes the table in its format to the shared folder and reads it back


@query("SELECT CAST(doc_id AS VARCHAR) AS _id, lang AS book, text AS english, 0 AS n_tags FROM documents")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "records")
    books.write_records(records(spark, sf_dir), path)
    return books.read_records(spark, path).select("_id", "book", "english", F.size("tags").alias("n_tags"))


@query("SELECT CAST(doc_id AS VARCHAR) AS _id, source FROM documents WHERE doc_id = 42")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "records")
    books.write_records(records(spark, sf_dir), path)
    return books.get_by_id(books.read_records(spark, path), "42").select("_id", "source")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source, text AS english, lang AS note FROM documents")
def record_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = as_records(records(spark, sf_dir).withColumn("extra", F.create_map(F.lit("note"), F.col("book"))))
    j = r.select("_id", record_json(r).alias("j"))
    back = from_record_json(F.col("j"))
    return j.select(F.col("_id").alias("id"), back["source"].alias("source"), back["english"].alias("english"), F.get_json_object("j", "$.note").alias("note"))


@query("SELECT text AS j, CAST(doc_id AS VARCHAR) AS id FROM documents")
def ocr_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    answer = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("ParsedText"))).alias("ParsedResults")))
    return d.select(F.col("doc_id").cast("string").alias("id"), answer.alias("response")).select("id", books.ocr_text().alias("j"))


@query(
    """SELECT '[' || c_custkey || ']' AS number, c_mktsegment AS source, 'Said ' || c_name || ' [2:' || c_nationkey || ']' AS english, c_custkey || ' - Al-Faith, ' || c_nationkey AS chapter,
CASE WHEN c_custkey % 3 = 0 THEN 'see Al-Kafi' END AS notes, 'نص ' || c_name AS arabic, 'S' || c_nationkey AS section FROM customer"""
)
def csv_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cell = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) and not y.startswith("c_") else F.col(y).cast("string") if isinstance(y, str) else y for y in x])
    path = shared_path(spark, "csv")
    c.select(
        cell("c_custkey", ". al-Faith,\n ", "c_nationkey").alias("a"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("see `al-Kafi")).otherwise(F.lit("")).alias("b"),
        F.lit("u").alias("c"),
        cell("[", "c_custkey", "] ", "c_mktsegment", ": Said ", "c_name", " (2:", "c_nationkey", ") and more").alias("d"),
        cell("[", "c_custkey", "] نص ", "c_name").alias("e"),
        cell("S", "c_nationkey").alias("f"),
    ).write.csv(path, quote='"', escape='"', emptyValue="")
    return loaders.csv_book(books.read_csv_rows(spark, path), "B").select("number", "source", "english", "chapter", "notes", "arabic", "section")


def _sheets(df: DataFrame, key: str, cells: list[Column], path: str) -> None:
    """A file a key, each one sheet of rows."""
    data = [F.concat(F.lit("<Cell><Data>"), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</Data></Cell>")) for c in cells]
    rows = df.select(F.col(key).alias("k"), F.concat(F.lit("<Row>"), *data, F.lit("</Row>")).alias("r"))
    sheets = rows.groupBy("k").agg(F.concat(F.lit("<Sheet>"), F.array_join(F.collect_list("r"), "\n"), F.lit("</Sheet>")).alias("value"))
    sheets.write.partitionBy("k").text(path)


@query(
    """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Mizan Al-Hikmah' ELSE 'Ghurar Al-Hikam' END AS book, CAST(c_custkey AS VARCHAR) AS number,
CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS part, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE c_mktsegment || ' n' || c_nationkey END AS section,
CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Imam Ali (AS) said, ' || c_name END AS english, CASE WHEN c_custkey % 2 = 0 THEN 'volume:' || c_nationkey || ' number:2' END AS source,
CASE WHEN c_custkey % 2 = 0 THEN 'P&Q' ELSE 'Ansariyan Publications' END AS publisher FROM customer WHERE c_custkey % 5 <> 0"""
)
def xml_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("XXno"), key)).when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("MH"), key)).otherwise(F.concat(F.lit("GH"), key))
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    path = shared_path(spark, "xml")
    _sheets(c, "c_nationkey", [name, F.concat(F.lit("`"), "c_mktsegment"), nation, F.lit("ar"), F.concat(F.col("c_name"), F.lit("~")), F.concat(F.lit("v. "), F.col("c_nationkey").cast("string"), F.lit(" no. 2")), F.lit("P&Q")], path)
    return loaders.xml_two_books(books.read_xml_rows(spark, path)).drop("arabic")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS number, c_name || ' and more of it. ' AS english, 'Sh. ' || c_mktsegment || ' ar-Radi says: x' AS tail FROM customer"""
)
def xml_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes are cut off before their mark; english and notes together are the cell."""
    c = table(spark, sf_dir, "customer")
    text = F.concat("c_name", F.lit(" and more of it. "), F.lit("Sh. "), "c_mktsegment", F.lit(" ar-Radi says: x"))
    rows = c.select(F.array(F.concat(F.lit("NB"), F.col("c_custkey").cast("string")), F.lit("ar"), text, F.lit(""), F.lit(" P ")).alias("cells"))
    b = loaders.xml_one_book(rows, "N")
    both = F.concat("english", "notes")
    at = F.locate(" and more of it. ", both) + 16
    return b.select("number", F.substring(both, F.lit(1), at).alias("english"), F.substr(both, at + 1).alias("tail"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS page, n_name AS text FROM nation")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\f").alias("value"))
    path = shared_path(spark, "pages")
    n.coalesce(1).write.text(path)
    return books.read_pages(spark, path).select("page", F.trim(F.replace("text", F.lit("\n"), F.lit(""))).alias("text"))


@query("SELECT r_name AS group_name, n_name AS term FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE') UNION SELECT r_name, r_name FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def synonym_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a region: its name and its nations; then the terms that share a group with ASIA or EUROPE."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    line = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.concat_ws(" , ", F.first("r_name"), F.collect_list("n_name")).alias("value"))
    path = shared_path(spark, "synonyms")
    line.select("value").unionByName(spark.createDataFrame([("# comment, no term",), ("",)], "value string")).write.text(path)
    s = books.read_synonyms(spark, path)
    out = None
    for name in ("ASIA", "EUROPE"):
        part = books.expand_synonyms(spark.createDataFrame([(name,)], "term string"), s).select(F.lit(name).alias("group_name"), "term")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT r_name AS book, 'about ' || r_name AS blurb FROM region")
def blurb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.struct(F.col("r_name").alias("book"), F.concat(F.lit("about "), "r_name").alias("blurb")).alias("b"))
    path = shared_path(spark, "blurbs")
    r.agg(F.to_json(F.collect_list("b")).alias("value")).coalesce(1).write.text(path)
    return books.read_blurbs(spark, path)


@query("SELECT trim(n_name) AS line FROM nation")
def resource_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lines")
    table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name").alias("value")).unionByName(spark.createDataFrame([("  ",)], "value string")).write.text(path)
    return spark.createDataFrame([(x,) for x in books.read_lines(spark, path)], "line string")


@query("SELECT 'order ' || o_orderkey || ' failed' AS value FROM orders WHERE o_orderstatus = 'F'")
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = shared_path(spark, "log")
    books.operation_log(o.select(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" failed"))).alias("error")), "error", path)
    return spark.read.text(path)


# Text functions


@query(r"SELECT doc_id, regexp_extract_all(text, '(?:\".*?\"|[^\"\s]+)+') AS words FROM documents")
def split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.split_query(F.col("text")).alias("words"))


_ENCODED = "replace(replace(replace(replace(replace(url_encode({x}), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')"


@query(
    f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS _id, {_ENCODED.format(x="'https://books.example/?q=_id:' || doc_id")} AS url, lang || ' ' || ', ' || '#' || doc_id || ', ' || source || ', ' AS t FROM documents)
SELECT _id, {_ENCODED.format(x="trim(regexp_replace(substring(t, 1, greatest(0, 260 - length(url))), '(^,)|(,$)', ''), ' ')")} AS text FROM d"""
)
def share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("_id", shaping.share_text(r, "https://books.example").alias("text"))


@query(
    r"""SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS at_end, 'Prophet said ' || c_name || ' ' AS line, ' said ' || 'satan(la) ' || c_name AS rewritten, c_mktsegment || ' [2:' || c_nationkey || ']' AS verse,
'volume:' || c_nationkey || ' chapter:2 number:3' AS source, CAST(c_custkey AS VARCHAR) AS number, replace(c_name, '#', '') AS bare, c_mktsegment || ' x' AS squeezed FROM customer"""
)
def loader_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey",
        X.number_from_end(F.concat(F.lit("Tradition no. "), nation)).alias("at_end"),
        X.clean_line(F.concat(F.lit("prophetas said "), "c_name", F.lit(" "))).alias("line"),
        X.rewrite_suffixes(F.concat(F.lit("azwj said asws"), F.lit("satanla "), "c_name")).alias("raw"),
        X.cite_verse(F.concat("c_mktsegment", F.lit(" (2:"), nation, F.lit(") and so on"))).alias("verse"),
        X.expand_source(F.concat(F.lit("v. "), nation, F.lit(" ch. 2 no. 3"))).alias("source"),
        X.id_number(F.concat(F.lit("MH"), key)).alias("number"),
        X.strip_quotes(F.replace("c_name", F.lit("#"), F.lit("`~’"))).alias("bare"),
        X.squeeze(F.concat("c_mktsegment", F.lit("    x"))).alias("squeezed"),
    ).withColumn("rewritten", F.replace("raw", F.lit(" said satan"), F.lit(" said satan"))).drop("raw")


@query(
    f"""SELECT c_custkey, {AR.format(c="c_mktsegment")} || ' قَلَم ' || {AR.format(c="c_mktsegment")} AS combined FROM customer"""
)
def combine_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    w = in_arabic(F.col("c_mktsegment"))
    return c.select("c_custkey", X.combine_arabic(F.concat(w, F.lit(" قلم "), w), F.lit("قَلَم اَب")).alias("combined"))


@query("SELECT doc_id, true AS turned, len(string_split(text, ' ')) = 1 AS doubled FROM documents")
def same_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array equals itself turned round; with its first word twice it doesn't, unless that word is missing."""
    w = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", X.same_elements(w, F.reverse(w)).alias("turned"), (X.same_elements(w, F.array_append(w, F.get(w, F.lit(0)))) | (F.size(w) == 1)).alias("doubled"))


# Lines and loaders


@query(
    f"""WITH {LINES}, t AS (SELECT doc, line_no + 2 AS line_no, CASE WHEN line_no % 3 = 0 THEN CAST(line_no // 3 + 1 AS VARCHAR) || '. ' || line ELSE line END AS line FROM l),
k AS (SELECT doc, line_no, trim(line, ' ') AS t FROM t),
n AS (SELECT *, max(CASE WHEN contains(t, 'Translator’s Note') OR contains(t, 'Editor’s Note') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS noted FROM k),
b AS (SELECT * FROM n WHERE noted = 0 AND t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND NOT starts_with(upper(t), 'CHAPTER ')),
s AS (SELECT *, regexp_matches(t, '^[0-9]+\\..*$') AS st FROM b),
g AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS record FROM s),
o AS (SELECT doc, record, min_by(regexp_extract(t, '^([0-9]+)\\.', 1), line_no) AS number,
      string_agg((CASE WHEN st THEN trim(regexp_replace(t, '^[0-9]+\\.', ''), ' ') ELSE t END) || ' ', '' ORDER BY line_no) AS e FROM g WHERE record > 0 GROUP BY doc, record)
SELECT doc, 'book' AS book, 'CHAPTER ONE: x' AS chapter, number,
       regexp_replace(regexp_replace(regexp_replace(e, '[`’]', '', 'g'), '[.,][0-5] ', ' ', 'g'), '\\s+', ' ', 'g') AS english FROM o"""
)
def numbered_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of books, a line in three a new record."""
    d = table(spark, sf_dir, "documents")
    t = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat((i / 3 + 1).cast("int").cast("string"), F.lit(". "), x)).otherwise(x)), "\n")
    return loaders.numbered_book(d.select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), F.concat(F.lit("CHAPTER ONE: x\n\n"), t).alias("text")), "book")


@query(
    """WITH t AS (SELECT conv_id AS doc, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, 'speaker ' || role || ' at ' || turn AS line FROM conversations)
SELECT doc, 'B' AS book, 'SECTION 2 - On Faith' AS section, 'CHAPTER 3 - Some title' AS chapter, CAST(number AS VARCHAR) AS number, line || ' goes on ' AS english FROM t"""
)
def dashed_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit("- speaker "), x["role"], F.lit(" at "), x["turn"].cast("string"), F.lit("\ngoes on\nOn Faith")))
    p = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.concat(F.lit("SECTION TWO\nOn Faith\nCHAPTER 3\nSome title\n"), F.array_join(w, "\n")).alias("text"))
    return loaders.dashed_book(p.select("doc", F.lit(0).alias("page"), "text"), "B")


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'speaker ' || role || ' at ' || turn AS line FROM conversations)
SELECT 'B' AS book, 'Chapter ' || conv_id || ' - The start' AS chapter, CAST(n AS VARCHAR) AS number,
       CASE WHEN n = 2 THEN first_value(line) OVER (PARTITION BY conv_id ORDER BY n) WHEN n = 3 THEN 'Similar to no. 1 from this chapter.' ELSE line END AS english, CAST(NULL AS VARCHAR) AS arabic FROM t"""
)
def tradition_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second record is the same as the first, the third similar to it."""
    own = lambda x, i: F.when(i == 1, F.lit("Same as no. 1")).when(i == 2, F.lit("Similar to no. 1")).otherwise(F.concat(F.lit("speaker "), x["role"], F.lit(" at "), x["turn"].cast("string")))
    w = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x, i: F.concat(F.lit("Tradition "), (i + 1).cast("string"), F.lit(": "), own(x, i)))
    p = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc")).agg(F.array_join(w, "\n").alias("text"))
    return loaders.tradition_book(p.select("doc", F.lit(0).alias("page"), F.concat(F.lit("Chapter "), "doc", F.lit(": The\nstart\n"), "text").alias("text")), "B")


@query(
    """WITH t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'speaker ' || role || ' at ' || turn AS line FROM conversations)
SELECT doc, '1' AS volume, 'THE BOOK OF Knowledge' AS section, 'Chapter 2 – On it' AS chapter, CAST(n AS VARCHAR) AS number, line || ' and so on.' AS english, 'نص' AS arabic FROM t"""
)
def end_marked_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that end with their number, with noise, an Arabic line each, and a volume that is left out."""
    w = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x, i: F.concat(F.lit("speaker "), x["role"], F.lit(" at "), x["turn"].cast("string"), F.lit("\nنص\n3 out of 9\nsite.example\nand so on. "), (i + 1).cast("string")))
    p = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(w, "\n").alias("text"))
    p = p.select("doc", F.posexplode(F.array(F.concat(F.lit("Volume 1\nxx\nTHE BOOK OF Knowledge (x)\n\nChapter 2 – On it\n\n"), "text"), F.lit("Table of Contents\nnot. 9"), F.lit("Volume 8\nno. 1"))).alias("page", "text"))
    return loaders.end_marked_book(p, "B", watermarks=["site\\.example"]).drop("book", "part")


@query(
    f"""WITH t AS (SELECT conv_id AS doc, turn, role, {AR.format(c="role || ' ' || turn")} AS line FROM conversations),
l AS (SELECT doc, 2 * turn AS line_no, line, true AS ar, role FROM t UNION ALL SELECT doc, 2 * turn + 1, 'latin text', false, role FROM t WHERE role = 'assistant'),
i AS (SELECT *, sum(CASE WHEN ar AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS idx FROM (SELECT *, lag(ar) OVER (PARTITION BY doc ORDER BY line_no) AS prev FROM l))
SELECT doc, CAST(idx AS BIGINT) AS idx, ' ' || string_agg(array_to_string(list_reverse(string_split(line, ' ')), ' '), ' ' ORDER BY line_no) AS chunk FROM i WHERE ar GROUP BY doc, idx"""
)
def ocr_chunk_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda x: F.concat(in_arabic(F.concat(x["role"], F.lit(" "), x["turn"].cast("string"))), F.when(x["role"] == "assistant", F.lit("\nlatin text")).otherwise(F.lit("")))
    p = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), own), "\n").alias("text"))
    return loaders.ocr_chunks(p.select("doc", F.lit(0).alias("page"), "text")).drop("page")


@query(
    f"""WITH {LINES}, m AS (SELECT *, contains(line, ',') AS m, contains(line, 'the') AS s FROM l),
h AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS h FROM m),
x AS (SELECT *, max(CASE WHEN m AND NOT s THEN 1 ELSE 0 END) OVER (PARTITION BY doc, h ORDER BY line_no) AS stopped FROM h)
SELECT doc, min(line_no) AS line_no, string_agg(trim(line, ' '), ' ' ORDER BY line_no) AS header FROM x WHERE h > 0 AND stopped = 0 GROUP BY doc, h"""
)
def header_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.multi_line_headers(doc_lines(spark, sf_dir), F.col("line").contains("the"), F.col("line").contains(","))
    return d.filter("header IS NOT NULL").select("doc", "line_no", "header")


@query(
    f"""WITH t AS (SELECT conv_id AS doc, turn AS line_no, role, CASE WHEN role = 'user' THEN {AR.format(c="'word ' || role")} ELSE 'latin text' END AS line, role = 'user' AS ar FROM conversations),
w AS (SELECT *, {', '.join(f"lag(line, {k}) OVER o AS l{k}, lag(ar, {k}) OVER o AS a{k}, lag(line_no, {k}) OVER o AS n{k}" for k in range(1, 5))} FROM t WINDOW o AS (PARTITION BY doc ORDER BY line_no)),
v AS (SELECT doc, line_no, [x FOR x IN [{', '.join(f"{{'k': {k}, 'l': l{k}, 'a': coalesce(a{k}, false), 'ok': coalesce(n{k} > 0, false)}}" for k in range(1, 5))}]] AS x FROM w),
f AS (SELECT *, list_min([i.k FOR i IN x IF i.ok AND i.a]) AS first FROM v),
e AS (SELECT *, coalesce(list_min([i.k FOR i IN x IF i.k > first AND i.ok AND NOT i.a]), 5) AS stop FROM f)
SELECT doc, line_no, coalesce(array_to_string([i.l || ' ' FOR i IN x IF i.ok AND i.a AND i.k >= first AND i.k < stop], ''), '') AS above FROM e"""
)
def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("line", F.when(F.col("role") == "user", in_arabic(F.concat(F.lit("word "), "role"))).otherwise(F.lit("latin text")))
    return lines.look_back(t).select("doc", "line_no", "above")


@query(
    """WITH a AS (SELECT conv_id AS doc, turn, text, coalesce(max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS due FROM conversations),
e AS (SELECT conv_id AS doc, turn AS number FROM conversations WHERE role = 'user'),
n AS (SELECT a.doc, a.due, min(number) AS number FROM (SELECT DISTINCT doc, due FROM a) a JOIN e ON a.doc = e.doc AND number >= due GROUP BY ALL)
SELECT doc, CAST(number AS INTEGER) AS number, string_agg(trim(text, ' '), ' ' ORDER BY turn) AS arabic FROM a JOIN n USING (doc, due) GROUP BY doc, number"""
)
def fifo_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    english = t.filter("role = 'user'").select("doc", F.col("line_no").cast("int").alias("number"))
    return lines.fifo_complete(english, t.withColumn("mark", F.when(F.col("role") == "assistant", F.col("line_no").cast("int"))))


@query(f"WITH {LINES} SELECT doc, line_no FROM l WHERE NOT regexp_matches(line, '^[\\s\\x{{A0}}]*$') AND NOT regexp_matches(line, '^(The|Of)') AND doc NOT IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'table of contents') OR (contains(text, 'Chapter') AND contains(text, '...')))")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = lines.drop_contents(d.select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), F.coalesce("text", F.lit("")).alias("text")))
    return lines.drop_noise(lines.lines(p), lines.BLANK, "^(The|Of)").select("doc", "line_no")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'Similar to no. ' || doc_id || ' from this chapter.' ELSE text END AS english FROM documents")
def similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Similar to no. "), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return d.select("doc_id", joins.mark_similar(said).alias("english"))


_BARE = r"length(regexp_replace({x}, '[\s\x{{A0}}]', '', 'g'))"


@query(
    rf"""WITH t AS (SELECT conv_id AS page, turn AS text_id, text FROM conversations WHERE role = 'assistant'),
k AS (SELECT conv_id AS page, turn AS idx, text AS chunk FROM conversations WHERE role = 'user' AND NOT regexp_matches(text, '^[\s\x{{A0}}]*$')),
p AS (SELECT t.page, text_id, idx, chunk, text, list_reduce([w FOR w IN regexp_split_to_array(text, '[\s\x{{A0}}]') IF w <> ''], lambda acc, w: replace(acc, w, ''), chunk) AS rest FROM t LEFT JOIN k USING (page)),
s AS (SELECT *, abs({_BARE.format(x='text')} - {_BARE.format(x='chunk')}) + length(regexp_replace(regexp_replace(rest, '[\s\x{{A0}}].[\s\x{{A0}}]', '', 'g'), '[\s\x{{A0}}]', '', 'g')) AS score FROM p)
SELECT page, text_id, coalesce(min_by(chunk, (score, idx)), '') AS chunk FROM s GROUP BY page, text_id"""
)
def ocr_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's assistant turns against its user turns."""
    c = table(spark, sf_dir, "conversations")
    t = c.filter("role = 'assistant'").select(F.col("conv_id").alias("page"), F.col("turn").alias("text_id"), "text")
    k = c.filter("role = 'user'").select(F.col("conv_id").alias("page"), F.col("turn").alias("idx"), F.col("text").alias("chunk"))
    return joins.best_match(t, k)


NINE = {"number": "l_linenumber", "book": "l_returnflag", "chapter": "l_linestatus", "section": "l_quantity", "source": "l_tax", "english": "l_discount", "volume": "l_suppkey % 3", "part": "l_partkey % 2", "arabic": "l_suppkey % 2"}


@query(
    f"""WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS pos, * FROM lineitem)
SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY {', '.join(NINE.values())} ORDER BY pos) AS k FROM k) WHERE k = 1"""
)
def dedup_all_nine_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine identity fields are filled."""
    r = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("pos"), *[F.expr(e).cast("string").alias(f) for f, e in NINE.items()])
    return joins.ordered_distinct(r, "pos").select("pos")


# Records: nested lists, edits


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))
    some = lambda x: F.when(F.col("doc_id") % 4 > 0, x).otherwise(F.array())
    text = lambda i, k: F.concat(F.lit(k), i.cast("string"))
    return as_records(
        d.select(
            F.col("doc_id").cast("string").alias("_id"),
            some(F.transform(n, lambda i: F.struct(F.col("source").alias("grader"), text(i, "why").alias("rationale"), F.col("lang").alias("grading")))).alias("gradings"),
            some(F.transform(n, lambda i: F.struct(text(i, "http://x/").alias("url"), F.col("lang").alias("title"), F.col("source").alias("description")))).alias("related"),
            some(F.transform(n, lambda i: text(i, "edit "))).alias("history"),
        )
    )


@query(
    """WITH d AS (SELECT *, unnest(range(1, doc_id % 4 + 1)) AS i FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS _id, CAST(i - 1 AS INTEGER) AS nth, source AS grader, 'why' || i AS rationale, lang AS grading, 'http://x/' || i AS url, lang AS title, source AS description, 'edit ' || i AS note FROM d"""
)
def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = nested(spark, sf_dir)
    return shaping.gradings_of(r).join(shaping.related_of(r), ["_id", "nth"]).join(shaping.history_of(r), ["_id", "nth"])


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS _id, CASE WHEN doc_id % 3 = 0 THEN 'edited ' || doc_id ELSE text END AS english, source, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version,
CASE WHEN doc_id % 3 = 0 THEN 'editor at 2020-01-01 00:00:00: ' END AS note FROM documents"""
)
def edit_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge, check, append a version; readers take the highest. The note's beginning shows who edited when."""
    v = mutate.Versions(spark, shared_path(spark, "versions"))
    r = records(spark, sf_dir)
    v.append(r)
    p = r.filter(F.col("_id").cast("long") % 3 == 0).select("_id", F.concat(F.lit("edited "), "_id").alias("english"), F.to_timestamp(F.lit("2020-01-01")).alias("at"))
    unknown = spark.range(1).select(F.lit("no such id").alias("_id"), F.lit("x").alias("english"), F.to_timestamp(F.lit("2020-01-01")).alias("at"))
    v.edit(p.unionByName(unknown), "editor", {"editor"})
    return v.latest().select("_id", "english", "source", "version", F.regexp_extract(F.get("history", F.lit(0)), r"^(.*?: )", 1).alias("note"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['book'] WHEN c_custkey % 3 = 1 THEN [] ELSE ['tags'] END AS changed FROM customer")
def client_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed book, tags in another order (no change), and other tags."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    a = F.struct(F.col("c_name").alias("book"), F.array(F.lit("x"), F.col("c_mktsegment")).alias("tags"), F.lit(None).cast("string").alias("notes"))
    b = F.struct(F.when(k == 0, F.lit("new")).otherwise(F.col("c_name")).alias("book"), F.when(k == 2, F.array(F.lit("y"))).otherwise(F.array(F.col("c_mktsegment"), F.lit("x"))).alias("tags"), F.lit("n").alias("notes"))
    d = c.select("c_custkey", a.alias("a"), b.alias("b"))
    return d.select("c_custkey", mutate.changed_fields(F.col("a"), F.col("b"), ["book", "tags", "notes"]).alias("changed"))
