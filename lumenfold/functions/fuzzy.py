"""Edit distance with adjacent swaps as one edit, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swaps(c: Column) -> Column:
    """Every string that one adjacent swap makes of c."""
    n = F.length(c)

    def at(i: Column) -> Column:
        return F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, n))

    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), at)).otherwise(F.array().cast("array<string>"))


def distance(a: Column, b: Column, most: int) -> Column:
    """Edits from a to b where there are at most most (0, 1 or 2), else null. Lengths are compared first."""
    # -1 beyond 4: a swap is two plain edits, so nothing further off can be within 2
    lev = F.levenshtein(a, b, 4)
    close = (F.abs(F.length(a) - F.length(b)) <= most) & (lev >= 0)
    out = F.when(a == b, F.lit(0))
    if most >= 1:
        out = out.when(close & ((lev <= 1) | ((lev == 2) & F.array_contains(swaps(a), b))), F.lit(1))
    if most >= 2:
        near = F.exists(swaps(a), lambda v: F.levenshtein(v, b) <= 1) | F.exists(swaps(b), lambda v: F.levenshtein(a, v) <= 1)
        twice = F.exists(swaps(a), lambda v: F.array_contains(swaps(v), b))
        out = out.when(close & ((lev <= 2) | near | twice), F.lit(2))
    return out


def _swapped(word: str) -> list[str]:
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def distance_to(word: str, c: Column, most: int) -> Column:
    """distance from a word known now: what can be is worked out before the plan is made."""
    w = F.lit(word)
    lev = F.levenshtein(w, c, 4)
    close = F.length(c).between(len(word) - most, len(word) + most)
    out = F.when(c == w, F.lit(0))
    once = _swapped(word)
    if most >= 1:
        out = out.when(close & (lev.between(0, 1) | c.isin(*once)), F.lit(1))
    if most >= 2:
        near = lev.between(0, 2) | c.isin(*{x for v in once for x in _swapped(v)})
        for v in once:
            near = near | F.levenshtein(F.lit(v), c, 1).between(0, 1)
        # a swap of c and one edit more make three plain edits; two swaps are in the list above
        far = (lev == 3) & F.exists(swaps(c), lambda v: F.levenshtein(w, v, 1).between(0, 1))
        out = out.when(close & (near | far), F.lit(2))
    return out


def allowed_edits(term: str, similarity: float | None = None) -> int:
    """By length (0 up to 2 letters, 1 up to 5, else 2); a similarity below 1 gives a share of the length; 1 or more are edits."""
    if similarity is None:
        return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    if similarity >= 1:
        return min(2, int(similarity))
    return min(2, int((1 - similarity) * len(term) + 1e-9))
