"""Ratings as rows, the judge loop, dealt pairs, growing splits and content groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from model import score as mean_score
from prefloom.operators import annotate, content_groups, dealt_pairs, judge_loop, long_ratings, pairs, split
from prefloom.operators.growing_split import GrowingSplit
from prefloom.session import scratch_path
from prefloom.sources import fixtures as fx

LONG = "prompt_id long, comp_idx long, aspect string, rating string"
KEYS = ("prompt_id", "comp_i", "comp_j")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# ---- ratings as rows ----


def test_scores_from_rows_against_maps(spark):
    r = random.Random(1)
    pool = ["1", "2", "4.5", " 3 ", "1e1", "nan", "inf", "-inf", "N/A", "4d", None, "0.1", "0.2", "1e30", "1e-25", "1_0"]
    maps = []
    for i in range(400):
        picked = {f"a{k}": {"Rating": r.choice(pool), "Rationale": "x"} for k in range(r.randrange(0, 5))}
        maps.append((i // 5, i % 5, picked or {}))
    schema = "prompt_id long, comp_idx long, annotations map<string, struct<Rating: string, Rationale: string>>"
    flat = spark.createDataFrame(maps, schema)
    got = {}
    for parts in (1, 17):
        ratings = long_ratings.to_long_ratings(flat).repartition(parts)
        got[parts] = rows(long_ratings.completion_scores_long(flat, ratings), "prompt_id", "comp_idx", "n_aspects", "score")
    assert got[1] == got[17] or str(got[1]) == str(got[17])  # bit for bit, NaN included
    want = {(p, c): mean_score(m) for p, c, m in maps}
    for p, c, n, score in got[1]:
        w = want[p, c]
        assert n == len(next(m for a, b, m in maps if (a, b) == (p, c)))
        if w is None:
            assert score is None
        elif math.isnan(w):
            assert math.isnan(score)
        else:
            assert score == w or abs(score - w) <= 1e-12 * abs(w)


def test_exact_sum_does_not_depend_on_order(spark):
    values = ["0.1"] * 3 + ["0.2"] * 3 + ["0.3"] * 3 + ["1e15", "0.0000001"]
    for seed in range(3):
        shuffled = values[:]
        random.Random(seed).shuffle(shuffled)
        t = spark.createDataFrame([(1, 0, f"a{i}", v) for i, v in enumerate(shuffled)], LONG).repartition(5)
        assert long_ratings.scores_from_rows(t).first().score == 1000000000000001.8000001 / 11


def test_null_and_repeated_aspects(spark):
    t = spark.createDataFrame([(1, 0, "a", "1"), (1, 0, "a", "2"), (1, 1, "a", None), (1, 2, None, "3"), (1, 3, "a", "5")], LONG)
    assert rows(long_ratings.scores_from_rows(t), "comp_idx", "score") == [(0, None), (1, None), (2, None), (3, 5.0)]
    for bad in (0, 1, 2):
        with pytest.raises(Exception, match="twice for one completion"):
            long_ratings.scores_from_rows(t.where(F.col("comp_idx") == bad), on_null="error").collect()
    assert long_ratings.scores_from_rows(t.limit(0)).collect() == []


def test_long_pairs_equal_map_pairs(spark):
    flat = fx.fline_completions(spark, SF001)
    scored = long_ratings.scored_completions_long(flat, long_ratings.to_long_ratings(flat))
    cols = pairs.PAIR_COLUMNS
    assert rows(pairs.build_pairs_join(scored, score="score"), *cols) == rows(pairs.build_pairs_join(flat), *cols)


def test_rating_rows_are_reduced_before_the_shuffle(spark):
    t = spark.createDataFrame([(1, 0, "a", "1")], LONG)
    plan = long_ratings.scores_from_rows(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Python" not in plan


# ---- judge loop ----


def test_loop_gives_the_pairs_back(spark):
    for prompts in (fx.fline_prompts(spark, SF001), fx.ftext_prompts(spark, SF001)):
        answers = annotate.render_answers(prompts, absent="omit").repartition(7)
        back = judge_loop.rejoin_answers(prompts, answers)
        assert back.columns == prompts.columns
        assert rows(pairs.build_pairs(back), *pairs.PAIR_COLUMNS) == rows(pairs.build_pairs(prompts), *pairs.PAIR_COLUMNS)


def test_lost_answers_are_accounted_for(spark):
    prompts = fx.fline_prompts(spark, SF001).cache()
    expected = prompts.select(F.sum(F.size("completions"))).first()[0] * 3
    answers = annotate.render_answers(prompts, absent="omit")
    some = answers.where("prompt_id % 4 <> 0").withColumn("answer", F.when(F.col("prompt_id") % 4 == 1, F.lit(None)).otherwise(F.col("answer")))
    extra = answers.limit(3).withColumn("prompt_id", F.lit(-1).cast("long"))
    report = {r.outcome: r.n for r in judge_loop.judge_loop_report(prompts, some.unionByName(extra)).collect()}
    assert sum(n for k, n in report.items() if k != "unknown_group") == expected
    assert report["no_answer"] > 0 and report["null_answer"] > 0 and report["unknown_group"] > 0
    kept = judge_loop.rejoin_answers(prompts, some)
    assert kept.count() == prompts.count()
    assert kept.where("prompt_id % 4 in (0, 1)").select(F.max(F.aggregate("completions", F.lit(0), lambda a, c: a + F.size(c["annotations"])))).first()[0] == 0
    whole = pairs.build_pairs(prompts).where("prompt_id % 4 in (2, 3)")
    assert rows(pairs.build_pairs(kept), *KEYS) == rows(whole, *KEYS)


def test_a_rating_that_came_twice_fails(spark):
    prompts = fx.ftext_prompts(spark, SF001)
    answers = annotate.render_answers(prompts)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY|[Dd]uplicate"):
        judge_loop.rejoin_answers(prompts, answers.unionByName(answers)).collect()


# ---- costs of the judge loop ----


def _stored(spark, df, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def test_loop_scores_once_and_does_not_read_old_ratings(spark):
    prompts = _stored(spark, fx.fline_prompts(spark, SF001), "t-prompts")
    answers = _stored(spark, annotate.render_answers(prompts, absent="omit"), "t-answers")
    back = judge_loop.rejoin_answers(prompts, answers)
    length = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(length)
    spark.conf.set(length, "2000")
    plan = pairs.build_pairs(back)._jdf.queryExecution()
    try:
        scans = [line for line in plan.executedPlan().toString().split("\n") if "FileScan" in line and "completions" in line]
    finally:
        spark.conf.set(length, before)
    assert plan.optimizedPlan().toString().count("map_from_entries(") == 1  # a filter on the array's size built it again
    assert len(scans) == 1 and "response" in scans[0] and "annotations" not in scans[0]
    assert rows(pairs.build_pairs(back), *pairs.PAIR_COLUMNS) == rows(pairs.build_pairs(prompts), *pairs.PAIR_COLUMNS)


def test_whole_answers_are_cut_like_others(spark):
    """A blank line before the first heading sends an answer the general way; the rows must be the same."""
    answers = annotate.render_answers(fx.ftext_prompts(spark, SF001)).unionByName(annotate.render_answers(fx.fline_prompts(spark, SF001)))
    odd = F.when(F.col("prompt_id") % 3 == 0, F.regexp_replace("answer", "Rating: ", "Score: ")).when(F.col("prompt_id") % 3 == 1, F.regexp_replace("answer", "\n", "\r\n"))
    answers = answers.withColumn("answer", F.coalesce(odd, F.col("answer")))
    cols = ("prompt_id", "group_idx", "text_idx", "aspect", "rating", "rationale", "status")
    whole = rows(annotate.parse_answers(answers), *cols)
    assert {r[-1] for r in whole} == {"ok", "no_rating_line"} and not any((r[5] or "").endswith(("\r", "\n")) for r in whole)
    assert whole == rows(annotate.parse_answers(answers.withColumn("answer", F.concat(F.lit("\n"), "answer"))), *cols)


# ---- dealt pairs ----


def _hot(spark, n=900, others=600):
    data = [(0, i * 1_000_003, f"r{i}", str(1 + i % 5)) for i in range(n)]
    data += [(1 + i // 3, i % 3, f"s{i}", str(1 + i % 4)) for i in range(others)]
    df = spark.createDataFrame(data, "prompt_id long, comp_idx long, response string, rating string")
    value = F.struct(F.col("rating").alias("Rating"), F.lit("").alias("Rationale"))
    return df.select("prompt_id", "comp_idx", F.concat(F.lit("p"), F.col("prompt_id")).alias("prompt"), F.lit("i").alias("img_path"), "response", F.create_map(F.lit("a"), value).alias("annotations"))


def test_dealt_pairs_equal_the_join(spark):
    c = _hot(spark)
    want = rows(pairs.build_pairs_join(c), *pairs.PAIR_COLUMNS)
    for block in (50, 5000):
        assert rows(dealt_pairs.build_pairs_dealt(c, block_rows=block), *pairs.PAIR_COLUMNS) == want


def test_no_group_is_large(spark):
    v = _hot(spark).select("prompt_id", F.col("comp_idx").alias("pos"))
    left, right = dealt_pairs.dealt_groups(v, 50)
    for side in (left, right):
        sizes = [r["count"] for r in side.groupBy("prompt_id", "_x", "_y").count().where("prompt_id = 0").collect()]
        assert len(sizes) == 18 * 19 // 2
        assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert left.where("prompt_id <> 0").count() == 600  # small prompts are sent once


def test_dealt_pairs_need_keys(spark):
    c = _hot(spark, 5, 3).withColumn("prompt_id", F.when(F.col("comp_idx") > 0, F.col("prompt_id")))
    with pytest.raises(Exception, match="without a prompt id"):
        dealt_pairs.build_pairs_dealt(c).collect()


# ---- growing split ----


def test_growing_split_equals_the_whole(spark):
    p = pairs.build_pairs(fx.fline_prompts(spark, SF001)).select(*KEYS).cache()
    state = GrowingSplit(spark, scratch_path(spark, "t-split"), KEYS, test_size=0.01)
    seen = None
    for k in range(3):
        part = p.where(F.pmod("prompt_id", F.lit(3)) == k)
        state.append(part, f"p{k}")
        seen = part if seen is None else seen.unionByName(part)
        want = split.split_exact(seen, KEYS, test_size=0.01)
        assert rows(state.label(seen), *KEYS, "split") == rows(want, *KEYS, "split")
    assert state.label(p).where("split = 'test'").count() == math.ceil(0.01 * p.count())


def test_appending_a_part_again_replaces_it(spark):
    t = spark.range(500).select(F.col("id").alias("k"))
    state = GrowingSplit(spark, scratch_path(spark, "t-split"), ("k",), test_size=0.1)
    state.append(t.where("k < 200"), "a")
    state.append(t.where("k < 300"), "a")
    state.append(t.where("k >= 300"), "b")
    assert rows(state.label(t), "k", "split") == rows(split.split_exact(t, ("k",), test_size=0.1), "k", "split")


def test_growing_split_refuses_known_keys(spark):
    t = spark.range(50).select(F.col("id").alias("k"))
    state = GrowingSplit(spark, scratch_path(spark, "t-split"), ("k",))
    assert state.label(t).where("split = 'test'").count() == 0  # nothing appended yet
    state.append(t, "a")
    with pytest.raises(ValueError, match="stored already"):
        state.append(t.where("k > 40"), "b")
    with pytest.raises(ValueError, match="unique"):
        state.append(t.unionByName(t), "c")
    assert state.label(t).where("split = 'test'").count() == 1  # refused parts do not count


def test_only_the_cut_is_read(spark):
    state = GrowingSplit(spark, scratch_path(spark, "t-split"), ("k",))
    state.append(spark.range(3000).select(F.col("id").alias("k")), "a")
    cut = state.rows(bytes.fromhex("4a3f"))
    assert all("/_p=4/" in f for f in cut.inputFiles())
    assert "GreaterThanOrEqual(_h" in cut._jdf.queryExecution().executedPlan().toString()


# ---- content groups ----


def test_groups_against_a_plain_union(spark):
    r = random.Random(2)
    data = [(i, r.choice([None, f"t{r.randrange(60)}", f"own{i}"]), r.choice([None, f"g{r.randrange(80)}", f"img{i}"])) for i in range(200)]
    data += [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(60)]  # a long chain
    root = {i: i for i, _, _ in data}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for col in (1, 2):
        first = {}
        for row in data:
            if row[col] is not None:
                a, b = sorted((top(row[0]), top(first.setdefault(row[col], row[0]))))
                root[b] = a
    p = spark.createDataFrame(data, "prompt_id long, prompt string, img_path string").repartition(5)
    got = {x.prompt_id: x.group for x in content_groups.content_groups(p).collect()}
    assert got == {i: top(i) for i, _, _ in data}


def test_no_content_on_both_sides(spark):
    data = [(i, f"t{i % 40}", f"g{i // 2 % 70}") for i in range(300)] + [(None, "t1", "x")]
    p = spark.createDataFrame(data, "prompt_id long, prompt string, img_path string")
    s = content_groups.split_by_content(p.where("prompt_id is not null"), p, test_size=0.4)
    for c in ("prompt", "img_path"):
        assert s.groupBy(c).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    alone = spark.createDataFrame([(i, f"t{i}", None) for i in range(400)], "prompt_id long, prompt string, img_path string")
    share = content_groups.split_by_content(alone, alone, test_size=0.4).where("split = 'test'").count() / 400
    assert 0.3 < share < 0.5
