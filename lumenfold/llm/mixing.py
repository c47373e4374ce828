"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, written

#: Share of the way from the natural entropy to the uniform one, and most passes over a source.
TARGET, MAX_EPOCHS, SEED, BLOCK_TOKENS = 0.5, 4.0, 17, 1_000_000
STEPS = 50


@dataclass(frozen=True)
class Plan:
    """exponent, and for each source (a null one included) its tokens, weight and quota of tokens."""

    exponent: float
    budget: int
    sources: tuple[tuple[str | None, int, float, int], ...]

    @property
    def n_blocks(self) -> int:
        return max(1, -(-self.budget // BLOCK_TOKENS))


def n_tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def weights(tokens: list[int], a: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** a for t in tokens]
    z = sum(raw)
    return [r / z for r in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def _quota(weight: float, tokens: int, budget: int, max_epochs: float) -> int:
    """The weight's tokens, one at least; where the weight keeps max_epochs, so does the quota."""
    q = max(math.floor(weight * budget + 1e-6), min(budget, 1))
    if weight * budget <= max_epochs * tokens * (1 + 1e-6):
        q = min(q, max(1, int(max_epochs * tokens)))
    return q


def solve(totals: list[tuple[str | None, int]], budget: int | None = None, target: float = TARGET, max_epochs: float = MAX_EPOCHS) -> Plan:
    """Bisect the exponent in [0, 1].

    At 1 the weights are the natural shares, at 0 they are equal. Entropy falls and the
    passes over the smallest source fall as the exponent rises: the least exponent is taken
    that keeps the passes within max_epochs, or the one whose entropy meets the target,
    whichever is larger. Sources without tokens have weight 0; any other is drawn from. The budget is all tokens unless given.
    """
    live = sorted(((s, t) for s, t in totals if t > 0), key=lambda x: (x[0] is not None, x[0] or ""))
    total = sum(t for _, t in live)
    budget = total if budget is None else budget
    if not live:
        return Plan(1.0, 0, ())
    toks = [t for _, t in live]
    goal = entropy(weights(toks, 1.0))
    goal += target * (math.log(len(toks)) - goal)
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        w = weights(toks, mid)
        flat = entropy(w) > goal + 1e-12 or max(x * budget / t for x, t in zip(w, toks)) > max_epochs
        lo, hi = (mid, hi) if flat else (lo, mid)
    w = weights(toks, round(hi, 9))
    return Plan(round(hi, 9), budget, tuple((s, t, x, _quota(x, t, budget, max_epochs)) for (s, t), x in zip(live, w)))


def totals(sized: DataFrame) -> list[tuple[str | None, int]]:
    """Tokens of each source, over all documents. One row a source comes to the driver."""
    return [(r[0], int(r[1] or 0)) for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()]


def _key(epoch: Column, doc_id: Column) -> Column:
    """32 hexadecimal digits that order a source's documents anew in each pass."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _drawn(sized: DataFrame, plan: Plan, least_epoch: str = "0") -> DataFrame:
    """doc_id, source, n_tokens, quota, last (pass), epoch, k, start of every document drawn in passes from least_epoch on.

    start is where the document begins in its source's sequence of passes. No source needs one task: prefix sums run
    inside buckets of the order's leading digits, as many as a source's size asks for, and over the buckets' sums.
    """
    spark = sized.sparkSession
    rows = [(s is None, s or "", t, q) for s, t, _, q in plan.sources if q > 0]
    # a row a source: Spark sends it to the tasks only if it is small
    quota = spark.createDataFrame(rows, "is_null boolean, name string, source_tokens long, quota long")
    d = sized.filter("n_tokens > 0").join(quota, (F.col("source").isNull() == F.col("is_null")) & (F.coalesce("source", F.lit("")) == F.col("name")))
    d = d.withColumn("last", ((F.col("quota") - 1) / F.col("source_tokens")).cast("int"))
    d = d.withColumn("epoch", F.explode(F.sequence(F.expr(least_epoch), F.col("last"))))
    # two digits make 256 buckets; beyond some 2^20 tokens a bucket another digit is taken
    digits = 2 + F.greatest(F.lit(0), F.ceil(F.log2(F.col("source_tokens") / F.lit(float(1 << 28))) / 4)).cast("int")
    d = d.withColumn("k", _key(F.col("epoch"), F.col("doc_id"))).withColumn("bucket", F.substring(F.col("k"), F.lit(1), digits))
    d = d.select("doc_id", "source", "n_tokens", "source_tokens", "quota", "last", "epoch", "k", "bucket")
    buckets = d.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    over = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "epoch", "bucket", F.coalesce(F.sum("bucket_tokens").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("k", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("d")
    b = buckets.alias("b")
    d = d.join(b, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.epoch") == F.col("b.epoch")) & (F.col("d.bucket") == F.col("b.bucket")))
    start = F.col("d.epoch").cast("long") * F.col("source_tokens") + F.col("before") + F.col("within")
    return d.select("d.source", "d.epoch", "d.doc_id", "n_tokens", "quota", "last", start.alias("start"), "k").filter(F.col("start") < F.col("quota"))


def schedule(sized: DataFrame, plan: Plan) -> DataFrame:
    """source, epoch, doc_id, n_tokens, block, position for every document drawn.

    sized has doc_id, source and n_tokens (and nothing else). In each pass (epoch) a source's
    documents stand in a pseudo-random order; the source's sequence is all its passes, cut at
    its quota: the document that begins before the quota ends is still drawn. A document that begins
    at share u of the quota goes to block floor(u * blocks), so each block holds the target mix,
    and inside a block the documents of all sources are permuted.
    """
    d = _drawn(sized, plan).withColumn("block", F.expr(f"start * {plan.n_blocks}L div quota"))
    spot = Window.partitionBy("block").orderBy("k", F.col("source").asc_nulls_first(), "doc_id", "epoch", "n_tokens")
    return d.select("source", "epoch", "doc_id", "n_tokens", "block", F.row_number().over(spot).alias("position"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, written once to the shared folder: the text is read one time."""
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), n_tokens(docs["text"]).alias("n_tokens"))
    return written(d, "mix-sizes")


def mix_sources(docs: DataFrame, budget: int | None = None, target: float = TARGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The schedule of draws that mixes the sources of docs.

    docs has doc_id (of any type that has a string), source and text; other columns are ignored, whatever their names. Null
    sources are one source; a null doc_id is an id of its own. Null and empty texts have no tokens and aren't drawn; texts
    of any length count whole. Documents whose hashes tie are ordered by doc_id, then tokens; repeated rows are drawn as
    often as they stand. An empty table gives no rows.
    """
    s = sized(docs)
    return schedule(s, solve(totals(s), budget, target, max_epochs))


def mixed_documents(docs: DataFrame, budget: int | None = None, target: float = TARGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """docs, with all their columns, as the mix has it: a document drawn in several passes stands several times, one never drawn is gone.

    The draws are those of mix_sources. Only a source's last pass is partial, and its draws are a prefix of that
    pass's order: so a row a source (the passes, and the last draw's place in the order) decides each document in its
    own row, and no text is shuffled. Rows that share doc_id, source and number of tokens are drawn alike: where the
    quota ends among them, all of them stand as often as the first. Rows without a token are gone. Nulls, ties and
    empty tables as in mix_sources.
    """
    s = sized(docs)
    plan = solve(totals(s), budget, target, max_epochs)
    if not plan.sources:
        return docs.limit(0)
    place = F.struct("k", "doc_id", "n_tokens")
    ends = _drawn(s, plan, "last").groupBy("source").agg(F.max(place).alias("end"), F.first("last").alias("last"))
    src, end, last = fresh(docs, "mix_source", "mix_end", "mix_last")
    ends = written(ends.select(F.col("source").alias(src), F.col("end").alias(end), F.col("last").alias(last)), "mix-ends")
    text = docs["text"]
    d = docs.filter(text.rlike(r"\S")).join(ends, docs["source"].cast("string").eqNullSafe(F.col(src)))
    own = F.struct(_key(F.col(last), docs["doc_id"]).alias("k"), docs["doc_id"].alias("doc_id"), n_tokens(text).alias("n_tokens"))
    times = F.col(last) + F.when(own <= F.col(end), F.lit(1)).otherwise(F.lit(0))
    (again,) = fresh(docs, "mix_again")
    return d.withColumn(again, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*[quoted(c) for c in docs.columns])


MIX_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS n_tokens FROM documents),
s AS MATERIALIZED (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t FROM d GROUP BY source HAVING sum(n_tokens) > 0),
b AS (SELECT CAST(sum(t) AS BIGINT) AS budget, count(*) AS n FROM s),
nat AS (SELECT -sum((t / budget) * ln(t / budget)) AS h FROM s, b),
goal AS (SELECT h + {TARGET}e0 * (ln(n) - h) AS g FROM nat, b),
bis AS (
  SELECT 0 AS i, 0e0 AS lo, 1e0 AS hi
  UNION ALL
  SELECT i + 1,
         CASE WHEN flat THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN flat THEN hi ELSE (lo + hi) / 2 END
  FROM (
    SELECT bis.*, (
      SELECT -sum((r / z) * ln(r / z)) > any_value(g) + 1e-12 OR max((r / z) * budget / t) > {MAX_EPOCHS}e0
      FROM (SELECT r, t, budget, g, sum(r) OVER () AS z
            FROM (SELECT pow(CAST(t AS DOUBLE) / budget, (lo + hi) / 2) AS r, t, budget, g FROM s, b, goal))) AS flat
    FROM bis WHERE i < {STEPS})),
a AS (SELECT round(hi, 9) AS e FROM bis WHERE i = {STEPS}),
w AS (SELECT source, t, least(greatest(CAST(floor(r / sum(r) OVER () * budget + 1e-6) AS BIGINT), 1), CAST({int(MAX_EPOCHS)} * t AS BIGINT)) AS quota
      FROM (SELECT source, t, budget, pow(CAST(t AS DOUBLE) / budget, e) AS r FROM s, b, a)),
x AS (
  SELECT doc_id, d.source, n_tokens, t, quota, CAST(unnest(range(0, (quota - 1) // t + 1)) AS INTEGER) AS epoch
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source WHERE n_tokens > 0),
k AS (SELECT *, md5('{SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM x),
p AS (
  SELECT *, epoch * t + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY k, doc_id, n_tokens
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
q AS (SELECT p.*, CAST((start * (SELECT greatest(1, (budget + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) FROM b)) // quota AS BIGINT) AS block
      FROM p WHERE start < quota)
SELECT source, epoch, doc_id, n_tokens, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY k, source NULLS FIRST, doc_id, epoch, n_tokens) AS INTEGER) AS position
FROM q"""
