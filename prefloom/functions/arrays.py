"""Python list-slicing semantics on Spark arrays.

Spark's `slice(a, -n, n)` returns [] when `a` is shorter than n, and
`element_at` / `a[i]` raise out of bounds under ANSI mode; these helpers
give Python's `v[:n]` and `v[-n:]` for a fixed int n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(a: Column, n: int) -> Column:
    """Python `a[:n]`."""
    if n >= 0:
        return F.slice(a, 1, F.lit(n))
    return F.slice(a, 1, F.greatest(F.size(a) + n, F.lit(0)))


def tail(a: Column, n: int) -> Column:
    """Python `a[-n:]`; note `a[-0:]` is the whole list."""
    if n == 0:
        return a
    if n > 0:
        return F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), F.lit(n))
    # a[k:] with k = -n > 0
    k = -n
    return F.when(F.size(a) <= k, F.array().cast("array<int>")).otherwise(F.slice(a, F.lit(k + 1), F.size(a) - k))


def repeat_int(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(int(value)), F.greatest(n, F.lit(0)).cast("int")).cast("array<int>")


def digest(a: Column) -> Column:
    """md5 of the comma-joined array of numbers (no nulls in it): a compact exact fingerprint for checks.

    JSON without its brackets is that text, written in one pass: no string per element.
    """
    return F.md5(F.btrim(F.to_json(a), F.lit("[]")))
