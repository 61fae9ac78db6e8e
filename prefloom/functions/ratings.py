"""Rating parsing and per-completion scores.

A rating is text.  It counts as a number exactly when Python's `float()`
accepts it; the mean over a completion's aspects is its score.  Spark's
`try_cast` alone is not enough: it accepts suffixes such as `4d` or `4.0f`,
rejects `1_0` and `+nan`, and Spark orders NaN above every number.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar of Python's float() (ASCII digits), after
# whitespace stripping and removal of single underscores between digits.
FLOAT_GRAMMAR = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"
# float() strips what str.strip() does except U+001C-U+001F: those make it fail.
FLOAT_STRIP_PATTERN = r"(?U)^\s+|\s+$"
DIGIT_UNDERSCORE = r"(?<=[0-9])_(?=[0-9])"
SIGNED_NAN = r"(?i)^[+-](nan)$"
# Text of these characters alone is its own normal form (\z: `$` would also match before a line end).
NORMAL = r"^[0-9A-Za-z./]+\z"


def nan() -> Column:
    return F.lit(float("nan"))


@lru_cache(maxsize=1)
def decimal_digit_map() -> tuple[str, str]:
    """Every Unicode decimal digit (category Nd) and its ASCII digit, by rule.

    Python's float() reads these as ASCII digits.
    """
    src = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd" and c > 0x7F)
    return src, "".join(str(unicodedata.decimal(ch)) for ch in src)


def normalize_rating(text: Column) -> Column:
    """Map Unicode digits to ASCII; strip Python whitespace and digit-group underscores."""
    src, dst = decimal_digit_map()
    # only non-ASCII text can hold such digits (char count = byte count otherwise)
    ascii_digits = F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(text, src, dst))
    t = F.regexp_replace(ascii_digits, FLOAT_STRIP_PATTERN, "")
    t = F.regexp_replace(t, DIGIT_UNDERSCORE, "")
    # the usual rating ('4', 'N/A') needs one match instead of three rewrites
    return F.when(text.rlike(NORMAL), text).otherwise(F.regexp_replace(t, SIGNED_NAN, "$1"))


def parse_normalized(t: Column) -> Column:
    return F.when(t.rlike(FLOAT_GRAMMAR), t.try_cast("double"))


def parse_rating(text: Column) -> Column:
    """DOUBLE if Python's float() would accept the text, else NULL."""
    return parse_normalized(normalize_rating(text))


def rating_class(text: Column) -> Column:
    """Why a rating parses or not: number, nan, inf, null, spark_only, rejected."""
    return class_of_normalized(text, normalize_rating(text))


def class_of_normalized(text: Column, t: Column) -> Column:
    """`rating_class` given the already normalised text `t` (a column)."""
    ok = t.rlike(FLOAT_GRAMMAR)
    v = t.try_cast("double")
    return (
        F.when(text.isNull(), F.lit("null"))
        .when(ok & F.isnan(v), F.lit("nan"))
        .when(ok & (F.abs(v) == F.lit(float("inf"))), F.lit("inf"))
        .when(ok, F.lit("number"))
        .when(v.isNotNull(), F.lit("spark_only"))
        .otherwise(F.lit("rejected"))
    )


ON_NULL = ("drop", "error")


def mean_rating(annotations: Column, on_null: str = "drop") -> Column:
    """Mean of the parsed ratings over whichever aspects the map holds.

    NULL when any rating is unparseable or the map is NULL; NaN for an empty
    map, as numpy's mean of nothing.  A present aspect whose value or rating
    is NULL counts as unparseable (`on_null="drop"`) or fails the job
    (`on_null="error"`).  Sums run left to right in map order and divide once.
    """
    # Normalise once per rating (a lambda result is a value, so the regex
    # chain is not evaluated a second time for the cast).
    normalized = F.transform(F.map_values(annotations), lambda v: normalize_rating(v["Rating"]))
    parsed = F.transform(normalized, parse_normalized)
    total = F.aggregate(parsed, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(annotations)
    score = F.when(annotations.isNull(), F.lit(None).cast("double")).when(n == 0, nan()).otherwise(total / n)
    if on_null == "drop":
        return score
    if on_null != "error":
        raise ValueError(f"on_null must be one of {ON_NULL}")
    has_null = F.exists(F.map_values(annotations), lambda v: v.isNull() | v["Rating"].isNull())
    return F.when(
        F.coalesce(has_null, F.lit(False)),
        F.raise_error(F.lit("annotation with a null aspect value or rating")).cast("double"),
    ).otherwise(score)


def usable(score: Column) -> Column:
    """A score that can be compared: parsed and not NaN."""
    return score.isNotNull() & ~F.isnan(score)
