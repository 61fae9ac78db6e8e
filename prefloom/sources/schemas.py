"""Explicit schemas and the conversion from the parallel-list layout.

Hub-style datasets store a list of completion records column-wise: one
struct of parallel lists (`annotations`, `response`, ...) per row.  The
canonical form here is an array of completion structs.  The number of
annotations drives the pairing, as in the source semantics: extra
responses are ignored, and a missing response is NULL (its pairs are
dropped unless tied).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION = T.StructType([T.StructField("Rating", T.StringType()), T.StructField("Rationale", T.StringType())])
ANNOTATIONS = T.MapType(T.StringType(), ANNOTATION)
COMPLETION = T.StructType(
    [
        T.StructField("comp_idx", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("annotations", ANNOTATIONS),
    ]
)
PROMPT_ROW = T.StructType(
    [
        T.StructField("prompt_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("img_path", T.StringType()),
        T.StructField("completions", T.ArrayType(COMPLETION)),
    ]
)
PARALLEL_COMPLETIONS = T.StructType(
    [
        T.StructField("annotations", T.ArrayType(ANNOTATIONS)),
        T.StructField("response", T.ArrayType(T.StringType())),
        T.StructField("model", T.ArrayType(T.StringType())),
    ]
)
PARALLEL_ROW = T.StructType(
    [
        T.StructField("prompt_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("img_path", T.StringType()),
        T.StructField("completions", PARALLEL_COMPLETIONS),
    ]
)
PAIR = T.StructType(
    [
        T.StructField("prompt_id", T.LongType()),
        T.StructField("comp_i", T.LongType()),
        T.StructField("comp_j", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", T.StringType()),
        T.StructField("rejected", T.StringType()),
    ]
)


def from_parallel_lists(df: DataFrame, completions: str = "completions") -> DataFrame:
    """struct<annotations: array, response: array, ...> -> array<struct<...>>."""
    c = F.col(completions)
    arr = F.transform(
        c["annotations"],
        lambda a, k: F.struct(
            k.cast("bigint").alias("comp_idx"),
            F.get(c["model"], k).alias("model"),
            F.get(c["response"], k).alias("response"),
            a.alias("annotations"),
        ),
    )
    return df.withColumn(completions, arr)


def to_parallel_lists(df: DataFrame, completions: str = "completions") -> DataFrame:
    c = F.col(completions)
    return df.withColumn(
        completions,
        F.struct(
            F.transform(c, lambda x: x["annotations"]).alias("annotations"),
            F.transform(c, lambda x: x["response"]).alias("response"),
            F.transform(c, lambda x: x["model"]).alias("model"),
        ),
    )
