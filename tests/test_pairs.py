import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001, plan_text
from model import pairs as model_pairs
from prefloom.operators import pairs
from prefloom.sources import fixtures as fx
from prefloom.sources import schemas

RATINGS = ["1", "2", "3", "4", "5", "4.5", " 3 ", "N/A", "nan", "4d", "inf", "-inf", "1_0", ""]


def nested_df(spark, rows):
    data = []
    for pid, (responses, annotations) in enumerate(rows):
        comps = []
        for k, ann in enumerate(annotations):
            resp = responses[k] if k < len(responses) else None
            comps.append((k, "m", resp, None if ann is None else {a: (r, "why") for a, r in ann.items()}))
        data.append((pid, f"prompt {pid}", f"img/{pid}.jpg", comps))
    return spark.createDataFrame(data, schemas.PROMPT_ROW)


def spark_pairs(df, **kw):
    out = pairs.build_pairs(df, format_prompt=False, **kw).collect()
    return sorted((r.prompt_id, r.comp_i, r.comp_j, r.chosen, r.rejected) for r in out)


def model_rows(rows):
    out = []
    for pid, (responses, annotations) in enumerate(rows):
        anns = [None if a is None else {k: {"Rating": v, "Rationale": "why"} for k, v in a.items()} for a in annotations]
        for i, j, c, r in model_pairs(responses, anns):
            out.append((pid, i, j, c, r))
    return sorted(out)


def test_golden_counts_sf0001(spark):
    nested = fx.fline_prompts(spark, SF001)
    assert pairs.build_pairs(nested).count() == 7810
    outcomes = dict(pairs.pair_outcomes(nested).collect())
    assert outcomes == {"combinations": 12008, "unparseable": 2286, "nan": 935, "tie": 977, "missing_response": 0, "pair": 7810}
    assert pairs.build_pairs(fx.ftext_prompts(spark, SF001)).count() == 271


def test_forms_agree(spark):
    nested = fx.fline_prompts(spark, SF001)
    a = pairs.build_pairs(nested)
    b = pairs.build_pairs_join(fx.fline_completions(spark, SF001))
    c = pairs.build_pairs(nested)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0


def test_layout_invariance(spark):
    nested = fx.fline_prompts(spark, SF001)
    a = pairs.build_pairs(nested.repartition(1))
    b = pairs.build_pairs(nested.repartition(17))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_hand_made_rows(spark):
    H = "Helpfulness"
    rows = [
        ([], []),  # no completions
        (["a"], [{H: "5"}]),  # one completion
        (["a", "b"], [{H: "5"}, {H: "3"}]),  # one pair, first wins
        (["a", "b"], [{H: "3"}, {H: "5"}]),  # second wins
        (["a", "b"], [{H: "4"}, {H: "4"}]),  # tie
        (["a", "b", "c"], [{H: "N/A"}, {H: "3"}, {H: "5"}]),  # bad rating drops its pairs only
        (["a", "b"], [{H: "nan"}, {H: "5"}]),  # NaN never wins
        (["a", "b"], [{H: "inf"}, {H: "5"}]),  # inf is a number
        (["same", "same"], [{H: "1"}, {H: "2"}]),  # identical texts kept
        (["a"], [{H: "1"}, {H: "2"}]),  # missing response: dropped
        (["a", "b", "c"], [{H: "1"}, {H: "2"}]),  # extra response ignored
        (["a", "b"], [{}, {H: "2"}]),  # empty annotations -> NaN -> dropped
        (["a", "b"], [{H: "2", "X": "4"}, {H: "2"}]),  # own aspect count: 3 vs 2
    ]
    got = spark_pairs(nested_df(spark, rows))
    assert got == model_rows(rows)
    assert (2, 0, 1, "a", "b") in got and (3, 0, 1, "b", "a") in got
    assert (7, 0, 1, "a", "b") in got
    assert not any(p[0] in (4, 6, 9, 11) for p in got)


def test_parallel_list_layout(spark):
    df = spark.createDataFrame(
        [(1, "p", "i.jpg", ([{"H": ("5", "")}, {"H": ("3", "")}, {"H": ("4", "")}], ["a", "b"], ["m1", "m2"]))],
        schemas.PARALLEL_ROW,
    )
    got = spark_pairs(schemas.from_parallel_lists(df))
    assert got == [(1, 0, 1, "a", "b")]  # pairs with the missing third response are dropped


ann = st.dictionaries(st.sampled_from(["H", "E", "V"]), st.sampled_from(RATINGS), max_size=3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(ann, max_size=6), min_size=1, max_size=6))
def test_random_against_model(spark, groups):
    rows = [([f"r{g}-{k}" for k in range(len(a))], a) for g, a in enumerate(groups)]
    assert spark_pairs(nested_df(spark, rows)) == model_rows(rows)


def test_plan_nested_has_no_shuffle_or_python(spark, tmp_path):
    path = str(tmp_path / "nested")
    fx.fline_prompts(spark, SF001).write.parquet(path)
    plan = plan_text(pairs.build_pairs(spark.read.parquet(path)))
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_plan_join_shares_its_exchange(spark):
    df = pairs.build_pairs_join(fx.fline_completions(spark, SF001))
    df.collect()
    plan = plan_text(df)  # the final adaptive plan
    assert "isFinalPlan=true" in plan
    assert "BroadcastExchange" not in plan
    assert "ReusedExchange" in plan


def test_skewed_prompt_is_split(spark):
    """One prompt holding a third of the rows: AQE splits its join partition.

    The hot rows come from several map tasks (as rows of a large input do);
    AQE splits a skewed reduce partition along map outputs.
    """
    flat = fx.fline_completions(spark, SF001)
    hot = flat.withColumn("prompt_id", F.when(F.col("prompt_id") % 3 == 0, F.lit(0)).otherwise(F.col("prompt_id")))
    from pyspark.sql import Window

    w = Window.partitionBy("prompt_id").orderBy("comp_idx", "response")
    hot = hot.withColumn("comp_idx", F.row_number().over(w) - 1).repartition(8).checkpoint()
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = pairs.build_pairs_join(hot)
        n = out._jdf.queryExecution().toRdd().count()
        plan = plan_text(out)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    ref = pairs.build_pairs_join(hot).count()
    assert n == ref and n > 0
    assert "skew=true" in plan


def test_on_null_policy(spark):
    rows = [(["a", "b"], [{"H": "5"}, {"H": "3", "E": None}])]
    df = nested_df(spark, rows)
    assert spark_pairs(df) == []  # the null aspect makes completion 1 unparseable
    with pytest.raises(Exception):
        pairs.build_pairs(df, on_null="error").collect()
    ok = nested_df(spark, [(["a", "b"], [{"H": "5"}, {"H": "3"}])])
    assert pairs.build_pairs(ok, on_null="error").count() == 1


def test_null_and_repeated_ids_do_not_mix_prompts(spark):
    import pytest

    a = [("r1", "1"), ("r2", "2"), ("r3", "3")]
    comps = lambda tag: [(i, "m", f"{tag}-{r}", {"H": (v, "")}) for i, (r, v) in enumerate(a)]
    rows = [(5, "p", None, comps("x")), (5, "q", None, comps("y")), (None, "z", None, comps("w"))]
    from prefloom.sources import schemas

    df = spark.createDataFrame(rows, schemas.PROMPT_ROW)
    out = pairs.build_pairs(df, format_prompt=False).collect()
    assert len(out) == 9 and all(r.chosen[0] == r.rejected[0] for r in out)
    with pytest.raises(Exception, match="without a prompt id"):
        pairs.build_pairs_join(pairs.unnest_completions(df), format_prompt=False).collect()


def test_registered_flat_join_can_be_split(spark):
    """Nothing stands between the exchange and the join's sort, so AQE can split a hot prompt."""
    from prefloom.plans.catalog import QUERIES

    plan = plan_text(QUERIES["build_pairs_join"](spark, SF001))
    import re

    assert len(re.findall(r"Sort \[prompt_id[^\n]*\n[^\n]*Exchange hashpartitioning\(prompt_id", plan)) == 2
