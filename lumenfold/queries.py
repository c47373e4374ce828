"""The engine's queries over the supplied tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import joins, lines, mutate, shaping, terms
from .plans import search as S
from .plans.index import Index
from .plans.rewrite import Mode
from .schema import documents_as_records
from .storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_records(table(spark, sf_dir, "documents"))


_indexes: dict[tuple, str] = {}


def index(spark: SparkSession, sf_dir: str, *fields: str) -> Index:
    """The stored index over the documents: written once a session to the shared folder, opened by every query."""
    fields = fields or ("english",)
    r = records(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, tuple(r.inputFiles()), fields)
    if key not in _indexes:
        path = shared_path(spark, "index")
        Index.of(r, fields).write(path)
        _indexes[key] = path
    return Index.open(spark, _indexes[key], r, fields)


def scored(found: DataFrame) -> DataFrame:
    return found.select(F.col("_id"), F.round("score", 6).alias("score"))


WORDS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"
BASE = f"""
r AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, lang, text, {WORDS.format(c='text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM r WHERE text IS NOT NULL),
p AS (SELECT id, term, count(*) AS tf, list(pos ORDER BY pos) AS pos, any_value(dl) AS dl
      FROM (SELECT id, len(w) AS dl, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM r) GROUP BY id, term),
lex AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def bm25_sql(tf: str = "tf", dl: str = "dl", idf: str = "ln(1 + (n - df + 0.5e0) / (df + 0.5e0))") -> str:
    return f"{idf} * 2.2e0 * {tf} / ({tf} + 1.2e0 * (1 - 0.75e0 + 0.75e0 * {dl} / avgdl))"


def term_cte(name: str, word: str, boost: float = 1.0) -> str:
    return f"{name} AS (SELECT id, {bm25_sql()} * {boost}e0 AS s FROM p JOIN lex USING (term), st WHERE term = '{word}')"


@query(
    f"""SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct({WORDS.format(c='text')})) AS term FROM documents)
WHERE term LIKE 'th%' GROUP BY term ORDER BY docs DESC, term LIMIT 10"""
)
def top_terms_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(records(spark, sf_dir), "th", 10)


@query(
    f"""SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct({WORDS.format(c='text')})) AS term FROM documents)
WHERE regexp_full_match(term, 't(h|i)e?.*') GROUP BY term ORDER BY docs DESC, term LIMIT 10"""
)
def top_terms_live_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(records(spark, sf_dir), "t(h|i)e?", 10)


JLH = f"""
WITH d AS (SELECT doc_id, list_distinct({WORDS.format(c='text')}) AS w FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, list_has_any(w, ['thing', 'ouing']) AS hit, w FROM d),
sz AS (SELECT CAST(sum(CAST(hit AS INTEGER)) AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS bn FROM m),
c AS (SELECT term, sum(CAST(hit AS INTEGER)) AS fg, count(*) AS bg FROM (SELECT hit, unnest(w) AS term FROM m) GROUP BY term),
s AS (SELECT term, CAST(fg AS BIGINT) AS fg, bg, (fg / fn - bg / bn) * ((fg / fn) / (bg / bn)) AS score FROM c, sz WHERE fg >= 3 AND fg / fn > bg / bn)
"""


@query(JLH + "SELECT term, fg, bg, round(score, 6) AS score FROM s")
def significance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    s = terms.significant_field(r, terms.matches(r, ["thing", "ouing"]), "english")
    return s.withColumn("score", F.round("score", 6))


@query(
    JLH
    + """SELECT term, round(score, 6) AS score FROM (
SELECT * FROM (SELECT * FROM s ORDER BY score DESC, term LIMIT 5) WHERE term NOT IN ('thing', 'ouing')) WHERE score >= 0.5e0"""
)
def significant_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.significant_terms(records(spark, sf_dir), ["thing", "ouing"], 5).withColumn("score", F.round("score", 6))


@query(f"WITH {BASE}, a AS (SELECT id, {bm25_sql()} AS s FROM p JOIN lex USING (term), st WHERE term = 'thing') SELECT id AS _id, round(s, 6) AS score FROM a")
def term_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "thing", None))


@query(
    f"""WITH {BASE} SELECT id AS doc_id, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl, df, n, round(avgdl, 6) AS avgdl,
round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf, round({bm25_sql()}, 6) AS score FROM p JOIN lex USING (term), st WHERE term = 'thing'"""
)
def explain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.explain_term(index(spark, sf_dir), "english", "thing")
    return e.select("doc_id", "tf", "dl", "df", "n", *[F.round(c, 6).alias(c) for c in ("avgdl", "idf", "score")])


@query(
    f"""WITH {BASE}, {term_cte('a', 'thing')}, {term_cte('b', 'ouing')}
SELECT id AS _id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def default_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "thing ouing", None))


@query(
    f"""WITH {BASE}, {term_cte('a', 'thing')}, {term_cte('b', 'the')}, {term_cte('c', 'ouing')}
SELECT a.id AS _id, round(a.s + coalesce(c.s, 0), 6) AS score FROM a LEFT JOIN c USING (id) WHERE a.id NOT IN (SELECT id FROM b)"""
)
def boolean_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "+thing -the ouing", None))


@query(f"WITH {BASE}, {term_cte('a', 'thing')}, {term_cte('b', 'that')} SELECT id AS _id, round(a.s + b.s, 6) AS score FROM a JOIN b USING (id)")
def lookup_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), 'thing^1 that^1', Mode.LOOKUP))


@query(
    f"""WITH {BASE}, {term_cte('a', 'thing', 3.0)}, {term_cte('b', 'ouing', 3.0)}, {term_cte('c', 'that')}
SELECT id AS _id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id"""
)
def grouped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "(thing ouing)^3 that", None))


@query(
    f"""WITH {BASE}, {term_cte('a', 'thing', 4.0)}, {term_cte('b', 'ouing', 0.5)}
SELECT id AS _id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "thing^4 ouing^0.5", None))


PHRASE = """
idf AS (SELECT sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0))) AS idf FROM lex, st WHERE term IN ('thing', 'the')),
x AS (SELECT a.id, a.dl, a.pos AS pa, [v - 1 FOR v IN b.pos] AS pb FROM p a JOIN p b USING (id) WHERE a.term = '{first}' AND b.term = '{second}')"""


@query(
    f"""WITH {BASE}, {PHRASE.format(first='the', second='thing')}, y AS (SELECT id, dl, len(list_intersect(pa, pb)) AS tf FROM x)
SELECT id AS _id, round({bm25_sql(idf='idf')}, 6) AS score FROM y, idf, st WHERE tf > 0"""
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), '"the thing"', None))


@query(
    f"""WITH {BASE}, {PHRASE.format(first='thing', second='the')},
y AS (SELECT id, dl, pa, pb, unnest(list_distinct(list_concat(pa, pb))) AS v FROM x),
z AS (SELECT id, any_value(dl) AS dl, count(*) AS tf FROM y
      WHERE len([q FOR q IN pa IF q BETWEEN v AND v + 3]) > 0 AND len([q FOR q IN pb IF q BETWEEN v AND v + 3]) > 0 GROUP BY id)
SELECT id AS _id, round({bm25_sql(idf='idf')}, 6) AS score FROM z, idf, st"""
)
def proximity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), '"thing the"~3', None))


@query(f"WITH {BASE} SELECT DISTINCT id AS _id, 1e0 AS score FROM p WHERE regexp_full_match(term, 'th.ng.*')")
def wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "th?ng*", None))


@query(f"WITH {BASE} SELECT DISTINCT id AS _id, 1e0 AS score FROM p WHERE term BETWEEN 'thing' AND 'things'")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "[thing TO things]~", None))


def fuzzy_sql(word: str, most: int) -> str:
    n = len(word)
    return f"""WITH {BASE},
f AS (SELECT term, df, 1 - damerau_levenshtein(term, '{word}') / CAST(greatest(1, least(length(term), {n})) AS DOUBLE) AS w
      FROM lex WHERE length(term) BETWEEN {n - most} AND {n + most} AND damerau_levenshtein(term, '{word}') <= {most})
SELECT id AS _id, round(sum(w * {bm25_sql()}), 6) AS score FROM p JOIN f USING (term), st GROUP BY id"""


@query(fuzzy_sql("thing", 1))
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "thing", Mode.SEARCH))


@query(fuzzy_sql("thing", 2))
def fuzzy_similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir), "thing~0.6", None))


FIELD = r"""
f AS (SELECT id, '{f}' AS field, regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+') AS w, {c} IS NOT NULL AS has FROM r)"""


@query(
    r"""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, source FROM documents),
f AS (SELECT id, 'book' AS field, regexp_extract_all(lower(coalesce(lang, '')), '[\p{L}\p{N}]+') AS w, 'fr' AS q FROM r WHERE lang IS NOT NULL
      UNION ALL SELECT id, 'source', regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}]+'), 'src1' FROM r WHERE source IS NOT NULL),
st AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM f GROUP BY field),
h AS (SELECT id, field, len(w) AS dl, len([x FOR x IN w IF x = q]) AS tf FROM f WHERE list_contains(w, q)),
df AS (SELECT field, count(*) AS df FROM h GROUP BY field)
SELECT id AS _id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * 2.2e0 * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
FROM h JOIN st USING (field) JOIN df USING (field) GROUP BY id HAVING count(*) = 2"""
)
def field_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hits(index(spark, sf_dir, "book", "source"), 'book:"fr" source:"src1"', Mode.LOOKUP))


@query("SELECT CAST(doc_id AS VARCHAR) AS _id, text AS english FROM documents WHERE doc_id = 17")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hits(index(spark, sf_dir), "_id:17", Mode.SEARCH).select("_id", "english")


@query(f"WITH {BASE} SELECT count(DISTINCT id) AS total FROM p WHERE term IN ('thing', 'ouing')")
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evaluate(index(spark, sf_dir), S.parse("thing ouing")).agg(F.count(F.lit(1)).alias("total"))


@query(
    f"""WITH {BASE}, a AS (SELECT id, {bm25_sql()} AS s FROM p JOIN lex USING (term), st WHERE term = 'the')
SELECT CAST(row_number() OVER (ORDER BY s DESC, id) AS INTEGER) AS rank, id AS _id, round(s, 6) AS score FROM a ORDER BY s DESC, id LIMIT 20 OFFSET 20"""
)
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.page_of(S.hits(index(spark, sf_dir), "the", None), None, page=2)
    return p.select("rank", "_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {BASE}, a AS (SELECT DISTINCT r.id, lang, source FROM p JOIN r USING (id) WHERE term = 'the')
SELECT CAST(row_number() OVER o AS INTEGER) AS rank, id AS _id FROM a WINDOW o AS (ORDER BY lang, source DESC, CAST(id AS INTEGER), id)
ORDER BY rank LIMIT 50"""
)
def hierarchical_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_of(S.hits(index(spark, sf_dir), "the", None), "book:asc,chapter:desc,number:asc", per_page=50).select("rank", "_id")


@query(
    f"""WITH {BASE}, a AS (SELECT DISTINCT id FROM p WHERE term = 'the')
SELECT CAST(row_number() OVER (ORDER BY CAST(id AS INTEGER)) AS INTEGER) AS rank, id AS _id FROM a ORDER BY rank LIMIT 100"""
)
def numeric_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_of(S.hits(index(spark, sf_dir), "the", None), "number:desc", per_page=500).select("rank", "_id")


@query(
    """SELECT _id FROM (SELECT CAST(doc_id AS VARCHAR) AS _id, row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS k FROM documents) WHERE k = 1"""
)
def dedup_nine_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("at", F.col("number").cast("long")).drop("number")
    return joins.ordered_distinct(r, "at").select("_id")


@query(
    """WITH b(book, blurb) AS (VALUES ('mobile', 'cars'), ('Build', 'houses'), ('HOLD', 'homes'), ('e', 'many'))
SELECT c_custkey, blurb FROM customer JOIN b ON contains(upper(c_mktsegment), upper(book))"""
)
def blurb_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.createDataFrame([("mobile", "cars"), ("Build", "houses"), ("HOLD", "homes"), ("e", "many")], "book string, blurb string")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("book"))
    return joins.with_blurbs(c, b).select("c_custkey", "blurb")


@query(
    """SELECT a.doc_id AS pos, trim(CASE WHEN a.doc_id % 7 IN (3, 5) THEN coalesce(b.text, 'Same as no. ' || CASE WHEN a.doc_id % 7 = 3 THEN 0 ELSE 3 END) ELSE a.text END) AS english
FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 7"""
)
def same_as_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 7
    said = F.when(k == 3, F.lit("Same as no. 0")).when(k == 5, F.lit("Same as no. 3")).otherwise(F.col("text"))
    r = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 7).cast("string").alias("chapter"), k.cast("string").alias("number"), F.col("doc_id").alias("pos"), said.alias("english"))
    return joins.resolve_same_as(r).select("pos", F.trim("english").alias("english"))


@query(
    """WITH e AS (SELECT 'Chapter ' || (doc_id // 4) || ' - x' AS chapter, 'CHAPTER ' || (doc_id // 4) AS k, CAST(doc_id % 4 AS VARCHAR) AS number, text AS english FROM documents),
a AS (SELECT 'CHAPTER ' || conv_id AS k, CAST(turn AS VARCHAR) AS number, string_agg(trim(text, ' '), ' ' ORDER BY turn) AS arabic FROM conversations GROUP BY ALL),
kn AS (SELECT k, min(chapter) AS chapter FROM e GROUP BY k)
SELECT coalesce(e.chapter, kn.chapter) || CASE WHEN a.arabic IS NOT NULL THEN ' / باب' ELSE '' END AS chapter,
       coalesce(e.number, a.number) AS number, e.english, ' ' || a.arabic AS arabic
FROM e FULL JOIN a ON e.k = a.k AND e.number = a.number LEFT JOIN kn ON kn.k = a.k WHERE e.k IS NOT NULL OR kn.k IS NOT NULL"""
)
def bilingual_full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    e = d.select(F.concat(F.lit("Chapter "), F.floor(F.col("doc_id") / 4), F.lit(" - x")).alias("chapter"), (F.col("doc_id") % 4).cast("string").alias("number"), F.col("text").alias("english"))
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.concat(F.lit("Chapter "), "conv_id").alias("chapter"), F.col("turn").cast("string").alias("number"), F.col("turn").alias("pos"), F.col("text").alias("line"), F.lit("باب").alias("chapter_arabic"))
    return joins.merge_bilingual(e, a)


@query("SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_wins(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn")


@query("SELECT o_orderkey AS id, n_name AS title FROM orders LEFT JOIN nation ON o_custkey % 40 = n_nationkey")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).cast("int").alias("n"))
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("title"))
    return joins.with_titles(r, t).select("id", "title")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc"), F.lit(0).alias("page"), F.col("turn").alias("line_no"), F.col("text").alias("line"), "role")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return lines.lines(d.select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), "text"))


LINES = r"""l AS (SELECT doc, CAST(line_no - 1 AS INTEGER) AS line_no, line FROM (
  SELECT doc_id AS doc, unnest(x) AS line, generate_subscripts(x, 1) AS line_no
  FROM (SELECT doc_id, string_split(rtrim(coalesce(text, ''), chr(10)), chr(10)) AS x FROM documents)))"""


@query(f"WITH {LINES} SELECT * FROM l")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc", "line_no", "line")


@query("SELECT conv_id AS doc, turn AS line_no, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.carry_forward(turns(spark, sf_dir), F.when(F.col("role") == "user", F.col("line")), "header").select("doc", "line_no", "header")


@query(
    "SELECT conv_id AS doc, turn AS line_no, first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS header FROM conversations"
)
def back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.back_fill(turns(spark, sf_dir), F.when(F.col("role") == "user", F.col("line")), "header").select("doc", "line_no", "header")


@query(
    f"""WITH {LINES}, s AS (SELECT *, sum(CASE WHEN starts_with(line, 'T') OR starts_with(line, 'L') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS record FROM l)
SELECT doc, CAST(record AS BIGINT) AS record, string_agg(line, ' ' ORDER BY line_no) AS text, count(*) AS n FROM s GROUP BY doc, record"""
)
def record_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.records_from_starts(doc_lines(spark, sf_dir), F.col("line").startswith("T") | F.col("line").startswith("L"))
    return d.groupBy("doc", "record").agg(lines.join_lines(F.struct("line_no", "line"), "line").alias("text"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {LINES}, s AS (SELECT *, coalesce(sum(CASE WHEN suffix(line, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record FROM l)
SELECT doc, CAST(record AS BIGINT) AS record, count(*) AS n FROM s GROUP BY doc, record"""
)
def record_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.records_from_ends(doc_lines(spark, sf_dir), F.col("line").endswith("."))
    return d.groupBy("doc", "record").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {LINES}, m AS (SELECT *, contains(line, ',') AS m FROM l),
s AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS island
      FROM (SELECT *, lag(m) OVER (PARTITION BY doc ORDER BY line_no) AS pm FROM m))
SELECT doc, CAST(island AS BIGINT) AS island, min(line_no) AS first_line, max(line_no) AS last_line FROM s WHERE m GROUP BY doc, island"""
)
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.islands(doc_lines(spark, sf_dir), F.col("line").contains(",")).filter("island IS NOT NULL")
    return d.groupBy("doc", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(
    """SELECT * FROM (SELECT conv_id AS doc, turn AS line_no, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS number FROM conversations)"""
)
def sequence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.repair_sequence(turns(spark, sf_dir), F.col("role") == "user", "page")
    return d.select("doc", "line_no", F.coalesce("number", F.lit(0)).alias("number"))


@query(f"WITH {LINES}, s AS (SELECT *, max(CASE WHEN contains(line, 'License') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS noted FROM l) SELECT doc, line_no FROM s WHERE noted = 0")
def stop_rest_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.stop_rest_of_page(doc_lines(spark, sf_dir), F.col("line").contains("License")).select("doc", "line_no")


def docs_with(spark: SparkSession, sf_dir: str, **cols: Callable) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[f(F.col("text")).alias(k) for k, f in cols.items()])


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[`’]', '', 'g'), '[.,][0-5] ', ' ', 'g'), '\s+', ' ', 'g') AS clean FROM documents")
def cleanup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, clean=X.cleanup_text)


@query(r"SELECT doc_id, trim(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), ' ') AS plain FROM documents")
def ascii_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, plain=X.ascii_only)


@query(
    """SELECT doc_id, CAST((doc_id % 9 + 1) * 100000 + (doc_id % 20) AS BIGINT) AS whole, CAST((doc_id % 9 + 1) * 100 + doc_id % 20 AS VARCHAR) AS loose FROM documents"""
)
def word_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.array(*[F.lit(w) for w in X._UNITS])
    a, b = F.get(unit, (F.col("doc_id") % 9 + 1).cast("int")), F.get(unit, (F.col("doc_id") % 20).cast("int"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.convert_word_to_integer(F.concat(a, F.lit("-hundred Thousand and "), b)).alias("whole"), X.word_to_number(F.concat(a, F.lit(" Hundred "), b)).alias("loose"))


@query(
    r"""SELECT doc_id, regexp_matches(text, '[\x{0600}-\x{06E0}]') AS some,
NOT regexp_full_match(text, '[\s\x{A0}]*') AND length(regexp_replace(text, '[^\x{0600}-\x{06E0}]', '', 'g')) >= length(text) // 2 AS mostly FROM documents"""
)
def arabic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, some=X.contains_arabic, mostly=X.is_probably_arabic)


@query(r"SELECT doc_id, regexp_replace(text, '[\x{0610}-\x{061A}\x{0640}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]', '', 'g') AS bare FROM documents")
def arabic_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, bare=X.arabic_normalize)


@query("SELECT doc_id, translate(text, 'lLIO', '1110') AS digits, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS reversed FROM documents")
def ocr_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, digits=X.fix_ocr_digits, reversed=X.reverse_words)


@query(r"SELECT page_id, regexp_replace(html, '<(?:.|\n)*?>', '', 'g') AS text FROM pages")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query(r"SELECT page_id, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def query_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.query_param(F.col("url"), "ref").alias("ref"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text("html").alias("text"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, plain=X.strip_accents)


@query(
    r"""SELECT c_custkey, 'Volume ' || c_nationkey AS volume, try_cast(c_name AS DOUBLE) IS NOT NULL AS numeric_name, upper(trim(split_part(c_name, '#', 1), ' ')) AS k,
CASE WHEN c_nationkey < 3 THEN 'Al-Usul (Principles) / أصول الكافي' WHEN c_nationkey = 8 THEN NULL ELSE 'Al-Furu'' (Jurisprudence) / فـروع الـكـافـي' END AS part FROM customer"""
)
def labels_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    v = F.col("c_nationkey").cast("string")
    return c.select("c_custkey", shaping.volume_label(v).alias("volume"), X.is_numeric(F.col("c_name")).alias("numeric_name"), X.chapter_key(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("k"), X.volume_part(v).alias("part"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d.%H.%M.%S') AS at FROM orders")
def timestamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.timestamp_text(F.col("o_orderdate")).alias("at"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS _id, CASE WHEN doc_id % 5 = 0 THEN 'edited' ELSE text END AS english, source, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS notes FROM documents"""
)
def shallow_merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("history", F.array().cast("array<string>"))
    p = r.filter(F.col("_id").cast("long") % 5 == 0).select("_id", F.lit("edited").alias("english"), F.lit(None).cast("string").alias("source"), F.lit("2020-01-01").cast("timestamp").alias("at"))
    return mutate.apply_patches(r, p, "editor").select("_id", "english", "source", F.size("history").alias("notes"))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS _id, max(l_linenumber) AS version FROM lineitem GROUP BY l_orderkey"""
)
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("_id"), F.col("l_linenumber").alias("version"))
    return mutate.latest_versions(v)
