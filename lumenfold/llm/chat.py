"""Chat formatting: turns to one training text per conversation, in Spark expressions only.

What a role or text holds of the format's own marks is escaped, so that no text can forge a turn: a mark's first
character is followed by one backslash more than it was. Taking one backslash away there gives the original.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")


def escaped(c: Column, *marks: str) -> Column:
    """c with a backslash more after the first character of what reads like the first two of a mark."""
    for m in dict.fromkeys(m.strip()[:2] for m in marks):
        if len(m) == 2:
            c = F.regexp_replace(c, f"{re.escape(m[0])}(\\\\*){re.escape(m[1])}", f"{_quoted(m[0])}\\\\$1{_quoted(m[1])}")
    return c


def _quoted(x: str) -> str:
    return "\\" + x if x in "\\$" else x


def format_chats(turns: DataFrame, begin: str = "<|", middle: str = "|>\n", end: str = "<|end|>\n", joiner: str = "\n") -> DataFrame:
    """conv_id, n_turns (rows used), n_messages (after merging), roles, text.

    turns has conv_id, turn, role and text; other columns are ignored, whatever their names.
    conv_id may be of any type that groups. Turns are sorted by (turn, role, text), so ties have one order; an exact
    repeat of a row counts once. A null turn sorts first. A null role reads as "unknown", a null
    text as empty. Adjacent turns of one role become one message, their texts joined by joiner; texts of any length
    are kept whole. begin and end in texts, and middle in roles too, are escaped (see the module's head).
    Rows of a null conv_id form one conversation with a null conv_id. An empty table gives no rows.

    One shuffle on conv_id. Every step over the sorted array is linear in its length.
    """
    t = turns.select(
        turns["conv_id"].alias("conv_id"),
        F.struct(
            turns["turn"].alias("turn"),
            escaped(F.coalesce(turns["role"], F.lit("unknown")), begin, middle, end).alias("role"),
            escaped(F.coalesce(turns["text"], F.lit("")), begin, end).alias("text"),
        ).alias("t"),
    )
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("s"))
    # exact repeats are neighbours once sorted
    rows = rows.select("conv_id", F.filter("s", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("s", i - 1))).alias("s"))
    # the indexes at which a role begins a run
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["role"] != F.get("s", i - 1)["role"]))
    rows = rows.select("conv_id", "s", starts.alias("b"))

    def message(b: Column, k: Column) -> Column:
        run = F.slice("s", b + 1, F.coalesce(F.get("b", k + 1), F.size("s")) - b)
        body = F.array_join(F.transform(run, lambda x: x["text"]), joiner)
        return F.struct(F.get("s", b)["role"].alias("role"), body.alias("text"))

    rows = rows.select("conv_id", F.size("s").alias("n_turns"), F.transform("b", message).alias("m"))
    return rows.select(
        "conv_id",
        "n_turns",
        F.size("m").alias("n_messages"),
        F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"),
        F.array_join(F.transform("m", lambda x: F.concat(F.lit(begin), x["role"], F.lit(middle), x["text"], F.lit(end))), "").alias("text"),
    )


FORMAT_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn,
         regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS role,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY i) THEN 0 ELSE 1 END AS b FROM o),
g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM c),
m AS (SELECT conv_id, k, any_value(role) AS role, string_agg(text, chr(10) ORDER BY i) AS text, count(*) AS n
      FROM g GROUP BY conv_id, k)
SELECT conv_id, CAST(sum(n) AS INTEGER) AS n_turns, CAST(count(*) AS INTEGER) AS n_messages,
       string_agg(role, ',' ORDER BY k) AS roles,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) AS text
FROM m GROUP BY conv_id"""
