"""Quality rules: a threshold table compiled into one Spark projection.

No user function is involved: every metric is a built-in expression, so the whole
operator is a scan, one projection and a filter, without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#$%&*|@^~<>{}[]\\=+_"
STOP_WORDS = tuple(
    "the of and to in a is that it was for on are as with he at be this from by an or have not you "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als er "
    "le la les de des et en un une du que est pour au qui dans sur par pas avec plus il "
    "el los las del y se por con no su para al lo es una como".split()
)
STOP_LANGS = ("en", "de", "fr", "es")
_SYMBOL = "[" + "".join("\\" + c for c in SYMBOLS) + "]"


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule where the metric lies outside [low, high] and it has min_words words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("too_few_words", "n_words", low=1),
    Rule("word_length", "mean_word_length", low=1.5, high=20.0, min_words=10),
    Rule("symbols", "symbol_ratio", high=0.06),
    Rule("capitals", "capital_ratio", high=0.6, min_words=10),
    Rule("exclamations", "exclamation_ratio", high=0.4, min_words=10),
    Rule("stop_words", "stop_word_ratio", low=0.02, min_words=60),
    Rule("stutter", "stutter_ratio", high=0.3, min_words=10),
    Rule("repeated_lines", "repeated_line_ratio", high=0.55),
)
METRICS = ("n_words", "mean_word_length", "symbol_ratio", "capital_ratio", "exclamation_ratio", "stop_word_ratio", "stutter_ratio", "repeated_line_ratio")


def _metrics(text: Column, lang: Column) -> Column:
    """A struct of the metrics. Null text counts as empty; every ratio over nothing is 0."""
    t = F.coalesce(text, F.lit(""))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    judged = lang.isNull() | lang.isin(*STOP_LANGS)

    def of_text(t: Column, chars: Column, w: Column, n: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x != "")
        again = F.filter(w, lambda x, i: F.when(i > 0, x == F.get(w, i - 1)).otherwise(F.lit(False)))
        repeated = F.transform(F.array(lines), lambda v: ratio(F.size(v) - F.size(F.array_distinct(v)), F.size(v)))[0]
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
        out = {
            "n_words": n,
            "mean_word_length": ratio(F.length(F.array_join(w, "")), n),
            "symbol_ratio": ratio(F.regexp_count(t, F.lit(_SYMBOL)), chars),
            "capital_ratio": F.transform(F.array(letters), lambda x: ratio(F.regexp_count(t, F.lit(r"\p{Lu}")), x))[0],
            "exclamation_ratio": ratio(chars - F.length(F.replace(t, F.lit("!"), F.lit(""))), n),
            "stop_word_ratio": F.when(judged, ratio(F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))), n)).otherwise(F.lit(1.0)),
            "stutter_ratio": ratio(F.size(again), n),
            "repeated_line_ratio": repeated,
        }
        return F.struct(*[out[k].alias(k) for k in METRICS])

    # What several metrics use is bound as the only element of a list, so that it is worked out once a row.
    bound = F.array(F.struct(t.alias("t"), F.length(t).alias("chars"), F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w")))
    return F.transform(bound, lambda x: of_text(x["t"], x["chars"], x["w"], F.size(x["w"])))[0]


def _broken(m: Column, rules: tuple[Rule, ...]) -> list[Column]:
    """The table compiled: for each rule its name where metrics m break it, else null."""
    out = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m[r.metric] < r.low)
        if r.high is not None:
            bad = bad | (m[r.metric] > r.high)
        out.append(F.when(bad & (m["n_words"] >= r.min_words), F.lit(r.name)))
    return out


def quality_metrics(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the metrics, the names of the broken rules, and keep.

    docs needs doc_id (of any type), text and lang; other columns are ignored, whatever their names.
    Null or empty text has no words and breaks too_few_words. A null lang is judged like
    a known one; of an unknown lang the stop words aren't judged (ratio 1). A very long
    text is read whole, and length alone breaks no rule. Repeated rows give repeated results; there are no ties;
    a null doc_id is carried; an empty table gives no rows.
    """
    one = docs.select(docs["doc_id"].alias("doc_id"), _metrics(docs["text"], docs["lang"]).alias("m"))
    flat = one.select("doc_id", *[F.col(f"m.{k}").alias(k) for k in METRICS], F.concat_ws(",", *_broken(F.col("m"), rules)).alias("broken"))
    return flat.withColumn("keep", F.col("broken") == "")


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that break no rule.

    Nulls, empty and long texts are judged as in quality_metrics: null and empty texts go. Repeated rows stay or go
    together. An empty table gives no rows.
    """
    broken = F.transform(F.array(_metrics(docs["text"], docs["lang"])), lambda m: F.coalesce(*_broken(m, rules), F.lit("")))[0]
    return docs.filter(broken == "")


def metrics_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The same projection in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    stops = ", ".join(q(s) for s in dict.fromkeys(STOP_WORDS))
    langs = ", ".join(q(s) for s in STOP_LANGS)
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0e0 END"
    broken = []
    for r in rules:
        bad = " OR ".join([f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None))
        broken.append(f"CASE WHEN ({bad}) AND n_words >= {r.min_words} THEN {q(r.name)} END")
    return f"""
WITH a AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF x <> ''] AS l
  FROM {table}),
b AS (
  SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words,
         {ratio("length(array_to_string(w, ''))", "len(w)")} AS mean_word_length,
         {ratio(f"length(t) - length(translate(t, {q(SYMBOLS)}, ''))", "length(t)")} AS symbol_ratio,
         {ratio("length(regexp_replace(t, '[^\\p{Lu}]+', '', 'g'))", "length(regexp_replace(t, '[^\\p{L}]+', '', 'g'))")} AS capital_ratio,
         {ratio("length(t) - length(replace(t, '!', ''))", "len(w)")} AS exclamation_ratio,
         CASE WHEN lang IS NULL OR lang IN ({langs}) THEN {ratio(f"len([x FOR x IN w IF x IN ({stops})])", "len(w)")} ELSE 1e0 END AS stop_word_ratio,
         {ratio("len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]])", "len(w)")} AS stutter_ratio,
         {ratio("len(l) - len(list_distinct(l))", "len(l)")} AS repeated_line_ratio
  FROM a),
c AS (SELECT *, concat_ws(',', {", ".join(broken)}) AS broken FROM b)
SELECT *, broken = '' AS keep FROM c"""
