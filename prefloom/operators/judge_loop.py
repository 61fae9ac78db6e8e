"""The way back from judge answers to rated completions.

`annotation_prompts` asks a judge about groups of four responses; the answers
come back as text.  Here the parsed ratings find their completions again:
text t of group g is completion 4 g + t - 1 of its prompt.  One aggregation by
prompt gathers a prompt's ratings (a nested row is one record, so they are
bounded by it), one join puts them into its completions, and the result is the
nested table that `build_pairs` reads.

Nothing is lost silently: `judge_loop_report` accounts for every expected
(completion, aspect) and for every block that belongs to none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import ASPECTS, N_SLOTS, parse_answers
from .pairs import fields_of
from ..sources.schemas import ANNOTATIONS


def _position() -> F.Column:
    return (F.coalesce(F.col("group_idx"), F.lit(0)) * N_SLOTS + F.col("text_idx") - 1).cast("bigint")


def rating_rows(answers: DataFrame, *, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """Parsed answers as rating rows (prompt_id, comp_idx, aspect, rating, rationale) of the long layout."""
    if "group_idx" not in answers.columns:
        answers = answers.withColumn("group_idx", F.lit(0).cast("bigint"))
    p = parse_answers(answers, aspects=aspects).where(F.col("status") == "ok")
    return p.select("prompt_id", _position().alias("comp_idx"), "aspect", "rating", "rationale")


def rejoin_answers(prompts: DataFrame, answers: DataFrame, *, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """Nested prompts whose completions carry the ratings of the judge's answers.

    Aspects stand in the order of `aspects`.  An aspect that did not come back
    is absent from its completion's map, a completion without any has an empty
    map (its pairs are dropped), and a prompt without an answer keeps its
    completions with empty maps.  An answer that came twice must be removed
    before; two ratings of one aspect of a completion fail the job.  Answers of
    unknown prompts match nothing (the report counts them).
    """
    order = F.create_map(*[x for i, a in enumerate(aspects) for x in (F.lit(a), F.lit(i))])
    value = F.struct(F.col("rating").alias("Rating"), F.col("rationale").alias("Rationale"))
    row = F.struct(F.col("comp_idx").alias("pos"), order[F.col("aspect")].alias("place"), F.struct("aspect", value.alias("value")).alias("entry"))
    rows = rating_rows(answers, aspects=aspects).groupBy("prompt_id").agg(F.sort_array(F.collect_list(row)).alias("_ratings"))
    # sorted by position, then by place: each completion's entries are one run
    # the ratings that a stored completion has already are not read
    kept = [f.name for f in prompts.schema["completions"].dataType.elementType.fields]
    read = [f for f in kept if f != "annotations"] or kept
    unrated = prompts.select(*[fields_of(F.col(c), *read).alias(c) if c == "completions" else F.col(c) for c in prompts.columns])
    joined = unrated.join(rows, "prompt_id", "left")

    def annotations(k: F.Column) -> F.Column:
        own = F.filter(F.coalesce(F.col("_ratings"), F.array()), lambda r: r["pos"] == k)
        return F.map_from_entries(F.transform(own, lambda r: r["entry"])).cast(ANNOTATIONS)

    def rated(c: F.Column, k: F.Column) -> F.Column:
        return F.struct(*[annotations(k).alias(f) if f == "annotations" else c[f].alias(f) for f in kept])

    return joined.select(*[F.transform("completions", rated).alias(c) if c == "completions" else F.col(c) for c in prompts.columns])


def judge_loop_report(prompts: DataFrame, answers: DataFrame, *, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """(outcome, n): where every expected rating went, and what came back besides.

    The statuses of `parse_answers` for what was asked and answered, no_answer for
    what was asked in a group without an answer row, unknown_group for blocks of
    groups that no prompt has.  All but unknown_* and duplicate add up to
    completions x aspects (an answer row that came twice counts twice).
    """
    if "group_idx" not in answers.columns:
        answers = answers.withColumn("group_idx", F.lit(0).cast("bigint"))
    n = F.size("completions")
    asked = prompts.where(n > 0).select("prompt_id", n.cast("bigint").alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / N_SLOTS) - 1)).alias("group_idx"))
    asked = asked.select("prompt_id", "group_idx", F.least(F.lit(N_SLOTS), F.col("_n") - N_SLOTS * F.col("group_idx")).alias("_texts"))
    known = answers.drop("n_texts").join(asked, ["prompt_id", "group_idx"], "left").withColumnRenamed("_texts", "n_texts")
    matched = parse_answers(known.where(F.col("n_texts").isNotNull()), aspects=aspects).select(F.col("status").alias("outcome"))
    strange = parse_answers(answers.join(asked, ["prompt_id", "group_idx"], "left_anti").withColumn("n_texts", F.lit(0)), aspects=aspects)
    strange = strange.where(F.col("text_idx").isNotNull()).select(F.lit("unknown_group").alias("outcome"))
    counts = matched.unionByName(strange).groupBy("outcome").agg(F.count("*").alias("n"))
    lost = asked.join(answers.select("prompt_id", "group_idx"), ["prompt_id", "group_idx"], "left_anti")
    lost = lost.agg((F.coalesce(F.sum("_texts"), F.lit(0)) * len(aspects)).cast("bigint").alias("n"))
    return counts.unionByName(lost.select(F.lit("no_answer").alias("outcome"), "n"))
