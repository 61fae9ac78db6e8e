"""Preference data derived from the given tables (see FIXTURES.md).

Two fixtures, each in a nested form (one row per prompt, the reference's
data model) and a flat form (one row per completion):

* F-LINE, from `lineitem`: an order is a prompt, a line is a completion;
  ratings follow fixed rules on the part and supplier keys and include
  unparseable, NaN, suffixed and padded values.
* F-TEXT, from `documents` + `labels` + `benchmark`: real prose responses
  grouped four to a prompt, with a benchmark item as the prompt text.

Conversations (F-CONV) are the `conversations` table as is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

# Aspect names of the annotation template, in template order.
HELPFULNESS = "Helpfulness"
ETHICS = "Ethical Considerations"
FAITHFULNESS = "Visual Faithfulness"
ASPECTS = (HELPFULNESS, ETHICS, FAITHFULNESS)

ANNOTATION_TYPE = "map<string, struct<Rating: string, Rationale: string>>"


def annotations_map(entries: list[tuple[str, Column, Column, Column | bool]]) -> Column:
    """Build the aspect map from (aspect, rating, rationale, present) tuples.

    Absent aspects are left out of the map (not stored as NULL values).  Every
    combination of present aspects is one `create_map`, chosen by `when`: a map
    is built once, needs no lambda and stays cheap inside generated code.
    `present` is a condition, or True for an aspect that is always there.
    """

    def one(name: str, rating: Column, rationale: Column) -> list[Column]:
        return [F.lit(name), F.struct(rating.cast("string").alias("Rating"), rationale.cast("string").alias("Rationale"))]

    conditions = list({id(p): p for *_, p in entries if p is not True}.values())  # the same object counts once

    def build(rest: list[Column], absent: list[Column]) -> Column:
        if rest:
            return F.when(rest[0], build(rest[1:], absent)).otherwise(build(rest[1:], absent + rest[:1]))
        there = [one(*e) for *e, p in entries if not any(p is a for a in absent)]
        return F.create_map(*[c for pair in there for c in pair]) if there else F.create_map().cast(ANNOTATION_TYPE)

    return build(conditions, [])


# ---------------------------------------------------------------- F-LINE

_LINE_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _fline_prompt(orderkey: Column) -> dict[str, Column]:
    return {
        "prompt": F.concat(F.lit("Describe what order "), orderkey.cast("string"), F.lit(" contains.")),
        "img_path": F.concat(F.lit("img/"), orderkey.cast("string"), F.lit(".jpg")),
    }


def _fline_completion(partkey: Column, suppkey: Column, linenumber: Column, quantity: Column) -> dict[str, Column]:
    def s(c: Column) -> Column:
        return c.cast("string")

    helpful = s(F.lit(1) + quantity.cast("bigint") % 5)
    # F-LINE rating rules (FIXTURES.md), first match wins.
    faithful = (
        F.when(partkey % 17 == 0, F.lit("N/A"))
        .when(partkey % 19 == 0, F.lit("nan"))
        .when(partkey % 23 == 0, F.lit("4d"))
        .when(partkey % 29 == 0, F.lit(" 3 "))
        .otherwise(s(F.lit(1) + partkey % 5))
    )
    ethical = s(F.lit(1) + suppkey % 5)
    rationale = F.concat(F.lit("line "), s(linenumber), F.lit(" part "), s(partkey))
    return {
        "model": F.concat(F.lit("m"), s(suppkey % 12)),
        "response": F.concat_ws("-", F.lit("resp"), s(partkey), s(suppkey), s(linenumber)),
        "annotations": annotations_map(
            [
                (HELPFULNESS, helpful, rationale, True),
                (ETHICS, ethical, rationale, partkey % 31 != 0),
                (FAITHFULNESS, faithful, rationale, True),
            ]
        ),
    }


def fline_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat F-LINE: one row per completion, `comp_idx` by the four-column line order."""
    li = read_table(spark, sf_dir, "lineitem", *_LINE_COLS)
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    # Number the lines first, so the shuffle carries six numeric columns;
    # the text and map columns are built after it.
    li = li.withColumn("comp_idx", (F.row_number().over(w) - 1).cast("bigint"))
    p = _fline_prompt(F.col("l_orderkey"))
    c = _fline_completion(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity"))
    return li.select(
        F.col("l_orderkey").alias("prompt_id"),
        "comp_idx",
        p["prompt"].alias("prompt"),
        p["img_path"].alias("img_path"),
        c["model"].alias("model"),
        c["response"].alias("response"),
        c["annotations"].alias("annotations"),
    )


def fline_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested F-LINE: one row per order with its completions in line order."""
    li = read_table(spark, sf_dir, "lineitem", *_LINE_COLS)
    grouped = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(*_LINE_ORDER, "l_quantity"))).alias("lines")
    )
    p = _fline_prompt(F.col("l_orderkey"))

    def completion(x: Column, k: Column) -> Column:
        c = _fline_completion(x["l_partkey"], x["l_suppkey"], x["l_linenumber"], x["l_quantity"])
        return F.struct(
            k.cast("bigint").alias("comp_idx"),
            c["model"].alias("model"),
            c["response"].alias("response"),
            c["annotations"].alias("annotations"),
        )

    return grouped.select(
        F.col("l_orderkey").alias("prompt_id"),
        p["prompt"].alias("prompt"),
        p["img_path"].alias("img_path"),
        F.transform("lines", completion).alias("completions"),
    )


# ---------------------------------------------------------------- F-TEXT


def ftext_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat F-TEXT: one row per document, four documents to a prompt."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").withColumn("labelled", F.lit(True))
    bench = read_table(spark, sf_dir, "benchmark", "item_id", F.col("text").alias("bench_text"))
    # One scalar; the benchmark table is small and its size is not assumed.
    n_items = bench.count()
    d = docs.join(labels, "doc_id", "left").withColumn("prompt_id", F.expr("doc_id div 4").cast("bigint"))
    # an empty benchmark leaves the prompt NULL (no item matches) instead of dividing by zero
    d = d.join(bench, F.col("item_id") == F.pmod(F.col("prompt_id"), F.lit(max(n_items, 1))), "left")
    labelled = F.col("labelled").isNotNull()
    # Two lines, the second starting with "Rating:", to exercise answer parsing.
    rationale = F.concat(F.lit("from "), F.col("source"), F.lit("\nRating: see scale"))
    ann = annotations_map(
        [
            (HELPFULNESS, F.when(F.col("quality") == 1, "5").otherwise("2"), rationale, labelled),
            (ETHICS, F.when(F.col("toxic") == 1, "1").otherwise("5"), rationale, labelled),
            (FAITHFULNESS, (F.lit(1) + F.col("n_chars") % 5).cast("string"), rationale, True),
        ]
    )
    return d.select(
        "prompt_id",
        (F.col("doc_id") % 4).cast("bigint").alias("comp_idx"),
        F.col("bench_text").alias("prompt"),
        F.concat(F.lit("img/"), F.col("prompt_id").cast("string"), F.lit(".jpg")).alias("img_path"),
        F.col("source").alias("domain"),
        F.concat(F.lit("m"), ((F.col("doc_id") * 7) % 12).cast("string")).alias("model"),
        F.col("text").alias("response"),
        ann.alias("annotations"),
    )


def ftext_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested F-TEXT: one row per prompt, completions ordered by `comp_idx`."""
    flat = ftext_completions(spark, sf_dir)
    comp = F.struct("comp_idx", "model", "response", "annotations")
    nested = flat.groupBy("prompt_id").agg(
        F.first("prompt").alias("prompt"),
        F.first("img_path").alias("img_path"),
        F.array_sort(F.collect_list(comp), lambda a, b: F.signum(a["comp_idx"] - b["comp_idx"]).cast("int")).alias(
            "completions"
        ),
    )
    return nested


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
