"""JSON lines in and out.

Python's `json.loads` per line fails on a blank or broken line.  Spark's
JSON reader skips blank lines silently and DROPMALFORMED loses bad ones
silently, so lines are read as text (splittable, one task per file split)
and parsed with `from_json` against an explicit schema:

A line must hold one JSON object and nothing after it, in double quotes.

* `on_bad="error"`: a blank or malformed line fails the job, naming it.
* `on_bad="quarantine"`: good rows and a quarantine of bad lines with a
  reason, from one parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import computed_once

CORRUPT = "_corrupt_record"


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "none").json(path)


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # `from_json` reads the first value and ignores what follows.  The line is
    # therefore the value of a wrapper whose last field is a mark made from the
    # line: a line that ends the wrapper early cannot know the mark.
    wrapper = T.StructType([T.StructField("r", schema), T.StructField("end", T.StringType()), T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).select(F.col("value").alias("_line"), F.input_file_name().alias("_file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    mark = F.md5("_line")
    rec = F.from_json(F.concat(F.lit('{"r":'), F.col("_line"), F.lit(',"end":"'), mark, F.lit('"}')), wrapper, options)
    blank = F.regexp_replace(F.col("_line"), r"^\s+|\s+$", "") == ""
    reason = F.when(blank, F.lit("blank_line")).when(
        F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull() | F.col("_r.r").isNull() | ~F.col("_r.end").eqNullSafe(F.md5("_line")),
        F.lit("malformed"),
    )
    # parse once; the bad-line filters then read the parsed column
    parsed = lines.select(computed_once(F.col("_line").alias("_line"), F.col("_file").alias("_file"), rec.alias("_r")))
    return parsed.withColumn("_reason", reason)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, on_bad: str = "error") -> DataFrame:
    p = _parsed(spark, path, schema)
    if on_bad == "error":
        check = F.when(
            F.col("_reason").isNotNull(),
            F.raise_error(F.concat(F.lit("bad JSON line ("), F.col("_reason"), F.lit(") in "), F.col("_file"))),
        )
        p = p.where(check.isNull())
    elif on_bad == "quarantine":
        p = p.where(F.col("_reason").isNull())
    else:
        raise ValueError("on_bad must be 'error' or 'quarantine'")
    return p.select(*[F.col(f"_r.r.{f.name}").alias(f.name) for f in schema.fields])


def read_jsonl_quarantine(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The bad lines with their file and reason."""
    p = _parsed(spark, path, schema)
    return p.where(F.col("_reason").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_reason").alias("reason")
    )
