"""Reports and readers that must not repeat work: same results, cheaper plans."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from prefloom.functions.arrays import digest
from prefloom.functions.ratings import normalize_rating, parse_rating
from prefloom.plans.catalog import QUERIES
from prefloom.sources import fixtures as fx


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_digest_is_md5_of_the_joined_ids_without_a_string_per_id(spark):
    arrays = [[1, 20, 300], [], [-100], [0, -1, 1114114], None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    got = {r.i: r.d for r in df.select("i", digest(F.col("a")).alias("d")).collect()}
    assert got == {i: None if a is None else hashlib.md5(",".join(map(str, a)).encode()).hexdigest() for i, a in enumerate(arrays)}
    assert "array<string>" not in plan_of(df.select(digest(F.col("a"))))


@pytest.mark.parametrize(
    "text, normal, value",
    [("4", "4", 4.0), ("4d", "4d", None), ("4\n", "4", 4.0), ("4\u0085", "4", 4.0), ("1_0", "10", 10.0), ("4\u001c", "4\u001c", None), ("４", "4", 4.0), ("N/A", "N/A", None), ("", "", None), (None, None, None)],
)
def test_normal_ratings_are_left_as_they_are(spark, text, normal, value):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(normalize_rating(F.col("t")).alias("n"), parse_rating(F.col("t")).alias("v")).first()
    assert (row.n, row.v) == (normal, value)


def test_rewrites_are_behind_the_check_for_normal_text(spark):
    plan = plan_of(spark.createDataFrame([("4",)], "t string").select(normalize_rating(F.col("t"))))
    assert "CASE WHEN RLIKE" in plan.upper() or "CASE WHEN T" in plan.upper() and "RLIKE" in plan.upper()


def test_an_aspect_map_is_built_once(spark):
    flat = fx.fline_completions(spark, SF001)
    assert "map_concat" not in plan_of(flat)
    absent = flat.where(F.size("annotations") == 2).select(F.map_keys("annotations").alias("k")).distinct().collect()
    assert [r.k for r in absent] == [["Helpfulness", "Visual Faithfulness"]]
    one = spark.range(3).select(fx.annotations_map([("a", F.lit("1"), F.lit("x"), F.when(F.col("id") > 0, F.col("id") == 1))]).alias("m"))
    assert [len(r.m) for r in one.collect()] == [0, 1, 0]


def test_ids_are_derived_once(spark):
    df = QUERIES["split_without_ids"](spark, SF001)
    assert "row_number" not in plan_of(df)
    assert df.count() == 2


def test_dealt_pairs_score_their_rows_once(spark):
    df = QUERIES["build_pairs_dealt"](spark, SF001)
    assert "map_values" not in plan_of(df)  # the join reads scored rows, not annotation maps
    assert df.count() == 7810
