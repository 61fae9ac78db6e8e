import math

from pyspark.sql import functions as F

from conftest import SF001, SF01
from prefloom.operators import pairs, split
from prefloom.sources import fixtures as fx

KEYS = ("prompt_id", "comp_i", "comp_j")


def brute_force(df, test_size=0.005, seed=42):
    rows = df.select(*KEYS, split.hash_key(seed, *KEYS).alias("h")).collect()
    rows.sort(key=lambda r: (r.h, r.prompt_id, r.comp_i, r.comp_j))
    n = math.ceil(test_size * len(rows))
    return {(r.prompt_id, r.comp_i, r.comp_j) for r in rows[:n]}


def test_exact_count_and_members(spark):
    p = pairs.build_pairs(fx.fline_prompts(spark, SF01)).select(*KEYS)
    s = split.split_exact(p, KEYS)
    test = {tuple(r[:3]) for r in s.where("split = 'test'").collect()}
    assert len(test) == 389
    assert test == brute_force(p)
    assert s.count() == 77606


def test_multi_level_refinement_and_layout(spark):
    p = pairs.build_pairs(fx.fline_prompts(spark, SF001)).select(*KEYS)
    want = brute_force(p, test_size=0.3)
    for parts in (1, 17):
        s = split.split_exact(p.repartition(parts), KEYS, test_size=0.3, )
        got = {tuple(r[:3]) for r in s.where("split = 'test'").collect()}
        assert got == want


def test_carries_other_columns(spark):
    p = pairs.build_pairs(fx.fline_prompts(spark, SF001))
    s = split.split_exact(p, KEYS, test_size=0.01)
    assert set(s.columns) == set(p.columns) | {"split"}
    assert s.where("split = 'test'").count() == math.ceil(0.01 * 7810)


def test_split_by_prompt_no_leakage(spark):
    p = pairs.build_pairs(fx.fline_prompts(spark, SF01)).select(*KEYS)
    s = split.split_by_prompt(p, test_size=0.05)
    both = s.groupBy("prompt_id").agg(F.countDistinct("split").alias("k")).where("k > 1").count()
    assert both == 0
    frac = s.where("split = 'test'").select("prompt_id").distinct().count() / p.select("prompt_id").distinct().count()
    assert 0.03 < frac < 0.07


def test_repeated_or_null_keys_fail(spark):
    import pytest

    for rows in ([(1, 0, 1), (1, 0, 1)], [(None, 0, 1), (2, 0, 1)]):
        df = spark.createDataFrame(rows, "prompt_id long, comp_i long, comp_j long")
        with pytest.raises(ValueError, match="unique"):
            split.split_exact(df, KEYS)
