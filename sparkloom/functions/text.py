"""Column functions over text: words, shingles, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of letters, digits and combining marks.
WORDS = r"([\p{L}\p{N}\p{M}]+)"
SHINGLE = 5


def words(text: Column) -> Column:
    """Lower-cased words in order; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(1)), F.array().cast("array<string>"))


def shingles(tokens: Column, k: int = SHINGLE) -> Column:
    """All k-token windows in order, space-joined; fewer than k tokens have none.

    The tokens are bound to a lambda variable, so that they are computed once a row and not once a window.
    """

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))

    return F.transform(F.array(tokens), windows)[0]


def shingle_set(tokens: Column, k: int = SHINGLE) -> Column:
    return F.array_distinct(shingles(tokens, k))


def lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x))


def alnum_width(line: Column) -> Column:
    """Letters and digits in a line; a line with none carries no evidence."""
    return F.length(F.regexp_replace(line, r"[^\p{L}\p{N}]", "")).cast("bigint")


def let(value: Column, use) -> Column:
    """`use` of the value, which is computed once a row however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def gram_hashes(tokens: Column, k: int) -> Column:
    """64-bit hashes of all k-token windows in order; fewer than k tokens have none.

    Tokens are hashed once; hashes of windows of twice the width come from two of those before, so the work for a place grows with the
    logarithm of k, and no window is ever a string.
    """

    def grow(h: Column, width: int) -> Column:
        if width == k:
            return h
        step = min(width, k - width)

        def wider(a: Column) -> Column:
            firsts = F.slice(a, F.lit(1), F.greatest(F.size(a) - step, F.lit(0)))
            return grow(F.transform(firsts, lambda x, i: F.xxhash64(x, F.get(a, i + step))), width + step)

        return let(h, wider)

    return grow(F.transform(tokens, lambda w: F.xxhash64(w)), 1)
