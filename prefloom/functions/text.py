"""String helpers on Spark columns (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's `str.strip()` with no argument removes the 29 code
# points for which `str.isspace()` is true:
#   U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680,
#   U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Java's Unicode-aware `\s` covers all of them except U+001C-U+001F.
PY_SPACE_CLASS = r"[\s\x{1c}-\x{1f}]"
PY_STRIP_PATTERN = rf"(?U)^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$"


def py_strip(col: Column | str) -> Column:
    """Python `str.strip()` semantics (Spark `trim` only removes spaces)."""
    return F.regexp_replace(_c(col), PY_STRIP_PATTERN, "")


def image_prompt(prompt: Column | str, img_paths: Column | str) -> Column:
    """`Picture {i}: <img>{path}</img>\\n` per image (1-based), then the stripped prompt.

    A null path renders as the text `None`, as a Python f-string does; a
    null prompt gives a null result.
    """
    pics = F.transform(
        _c(img_paths),
        lambda p, i: F.concat(
            F.lit("Picture "),
            (i + 1).cast("string"),
            F.lit(": <img>"),
            F.coalesce(p, F.lit("None")),
            F.lit("</img>\n"),
        ),
    )
    return F.concat(F.array_join(pics, ""), py_strip(prompt))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
