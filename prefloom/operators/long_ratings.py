"""Ratings as rows: one row per (prompt, completion, aspect).

The nested layout keeps a completion's ratings in a map and folds it.  Here
they are rows of a table of their own, so the mean is an aggregation that
merges partial results in any order.  Double sums depend on the order, so
the sum is exact: ratings are added as decimals, beside counts of what
cannot be added (unparseable, NaN, infinite).

Semantics, as in the nested layout: a completion's score is the mean over its
rows; NULL if any rating does not parse, NaN if one is NaN, if both infinities
meet, or if the completion has no rating row.  A null rating or aspect counts as
unparseable (`on_null="drop"`) or fails the job (`on_null="error"`).  So does
an aspect that occurs twice for one completion, which a map cannot hold.
Ratings beyond 10^19 or finer than 18 decimals are no decimals of this type;
they are gathered, sorted and added to the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import ON_NULL, nan, parse_rating
from ..functions.rows import computed_once

KEYS = ("prompt_id", "comp_idx")
EXACT = "decimal(38,18)"


def to_long_ratings(completions: DataFrame) -> DataFrame:
    """Flat completions with an annotation map -> (prompt_id, comp_idx, aspect, rating, rationale) rows."""
    e = completions.select(*KEYS, F.explode("annotations").alias("aspect", "a"))
    return e.select(*KEYS, "aspect", F.col("a.Rating").alias("rating"), F.col("a.Rationale").alias("rationale"))


def _infinite(v: Column) -> Column:
    return F.abs(v) == F.lit(float("inf"))


def scores_from_rows(ratings: DataFrame, *, on_null: str = "drop") -> DataFrame:
    """(prompt_id, comp_idx, aspect, rating) rows -> prompt_id, comp_idx, n_aspects, score.

    One partially aggregated shuffle by completion; a completion's rows are
    never gathered, so neither a hot prompt nor a completion with very many
    aspects meets in one task before it is reduced.
    """
    if on_null not in ON_NULL:
        raise ValueError(f"on_null must be one of {ON_NULL}")
    r = ratings.select(*KEYS, "aspect", computed_once(parse_rating(F.col("rating")).alias("v"), F.col("rating").alias("t")))
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & ~_infinite(v)
    exact = F.when(finite, v.try_cast(EXACT))
    fits = exact.isNotNull() & (exact.cast("double") == v)
    g = r.groupBy(*KEYS).agg(
        F.count("*").alias("n_aspects"),
        F.size(F.collect_set("aspect")).alias("_names"),
        F.count(F.when(F.col("aspect").isNull() | F.col("t").isNull(), 1)).alias("_null"),
        F.count(v).alias("_parsed"),
        F.count(F.when(F.isnan(v), 1)).alias("_nan"),
        F.count(F.when(v == F.lit(float("inf")), 1)).alias("_up"),
        F.count(F.when(v == F.lit(float("-inf")), 1)).alias("_down"),
        F.sum(F.when(fits, exact)).alias("_sum"),
        F.array_sort(F.collect_list(F.when(finite & ~F.coalesce(fits, F.lit(False)), v))).alias("_wide"),
    )
    n = F.col("n_aspects")
    whole = F.aggregate("_wide", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)), lambda a, x: a + x)
    mean = (
        F.when((F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0)), nan())
        .when(F.col("_up") > 0, F.lit(float("inf")))
        .when(F.col("_down") > 0, F.lit(float("-inf")))
        .otherwise(whole / n)
    )
    bad = (F.col("_null") > 0) | (F.col("_names") < n)
    score = F.when((F.col("_parsed") == n) & ~bad, mean)
    if on_null == "error":
        fail = F.raise_error(F.lit("rating row without a rating or aspect, or an aspect twice for one completion")).cast("double")
        score = F.when(bad, fail).otherwise(score)
    return g.select(*KEYS, n.cast("bigint").alias("n_aspects"), score.alias("score"))


def completion_scores_long(completions: DataFrame, ratings: DataFrame, *, on_null: str = "drop") -> DataFrame:
    """Scores of all completions; one without rating rows scores NaN, as an empty map does."""
    s = scores_from_rows(ratings, on_null=on_null)
    j = completions.select(*KEYS).join(s, list(KEYS), "left")
    n = F.coalesce(F.col("n_aspects"), F.lit(0)).cast("bigint")
    return j.select(*KEYS, n.alias("n_aspects"), F.when(F.col("n_aspects").isNull(), nan()).otherwise(F.col("score")).alias("score"))


def scored_completions_long(completions: DataFrame, ratings: DataFrame, *, on_null: str = "drop") -> DataFrame:
    """Completions with `score` instead of the annotation map, for `build_pairs_join(score=...)`."""
    s = scores_from_rows(ratings, on_null=on_null).drop("n_aspects").withColumn("_rated", F.lit(True))
    j = completions.drop("annotations", "score").join(s, list(KEYS), "left")
    return j.withColumn("score", F.when(F.col("_rated").isNull(), nan()).otherwise(F.col("score"))).drop("_rated")
