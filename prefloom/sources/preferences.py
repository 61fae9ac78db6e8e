"""Reading preference tables and writing results.

A preference table is read with an explicit schema (no inference), in
either layout: `nested` (array of completion structs) or `parallel` (a
struct of parallel lists, as hub datasets store it), which is converted to
the nested layout.  Results are written as parquet; `partition_by` and
`max_records_per_file` keep file counts and sizes under control at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas
from .jsonl import read_jsonl

LAYOUTS = {"nested": schemas.PROMPT_ROW, "parallel": schemas.PARALLEL_ROW}


IDS = ("long", "string", "derive")


def derive_ids(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Ids for a table that has none: a hash of the row's content and its number among equal rows.

    Equal rows are interchangeable, so the ids do not depend on the layout.
    """
    cols = [c for c in df.columns if c != key]
    # to_json leaves out null fields, so a field's name stands for its being there
    df = df.select(*cols, F.sha2(F.to_json(F.struct(*cols)), 256).alias("_h"))
    nth = F.row_number().over(Window.partitionBy("_h").orderBy("_h"))
    return df.select(F.concat_ws("-", F.substring("_h", 1, 32), nth.cast("string")).alias(key), *cols)


def table_schema(layout: str = "nested", ids: str = "long") -> T.StructType:
    """The schema that a table of this layout and kind of id is read with."""
    if ids not in IDS:
        raise ValueError(f"ids must be one of {IDS}")
    schema = LAYOUTS[layout]
    if ids == "derive":
        return T.StructType([f for f in schema.fields if f.name != "prompt_id"])
    if ids == "string":
        return T.StructType([T.StructField(f.name, T.StringType()) if f.name == "prompt_id" else f for f in schema.fields])
    return schema


def read_preference_table(
    spark: SparkSession, path: str, *, layout: str = "nested", fmt: str = "parquet", on_bad: str = "error", ids: str = "long"
) -> DataFrame:
    """A preference table in the nested layout.

    `ids`: the table's `prompt_id` is a "long" or a "string", or it has none
    and one is derived ("derive").  A parquet table that lacks the column
    fails unless it is derived, instead of reading as all null.
    """
    schema = table_schema(layout, ids)
    if fmt == "parquet":
        if ids != "derive" and "prompt_id" not in spark.read.parquet(path).columns:
            raise ValueError(f"{path} has no prompt_id column; pass ids='derive'")
        df = spark.read.schema(schema).parquet(path)
    elif fmt in ("json", "jsonl"):
        df = read_jsonl(spark, path, schema, on_bad=on_bad)
        if ids != "derive":
            missing = F.raise_error(F.lit(f"a line of {path} has no prompt_id; pass ids='derive'")).cast(df.schema["prompt_id"].dataType)
            df = df.withColumn("prompt_id", F.coalesce(F.col("prompt_id"), missing))
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    df = schemas.from_parallel_lists(df) if layout == "parallel" else df
    return derive_ids(df) if ids == "derive" else df


def write_table(
    df: DataFrame,
    path: str,
    *,
    mode: str = "errorifexists",
    partition_by: tuple[str, ...] = (),
    max_records_per_file: int | None = None,
) -> None:
    w = df.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
