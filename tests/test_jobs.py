import math

from conftest import SF001
from prefloom import jobs
from prefloom.session import scratch_path
from prefloom.sources import fixtures as fx
from prefloom.sources.preferences import write_table


def test_prepare_end_to_end(spark):
    src = scratch_path(spark, "t-job-in")
    out = scratch_path(spark, "t-job-out")
    write_table(fx.ftext_prompts(spark, SF001).select("prompt_id", "prompt", "img_path", "completions"), src)
    jobs.run(spark, jobs.parse_args(["--input", src, "--output", out, "--test-size", "0.05", "--model-max-length", "512"]))
    pairs = spark.read.parquet(f"{out}/pairs")
    enc = spark.read.parquet(f"{out}/encoded")
    assert pairs.count() == enc.count() == 271
    assert pairs.where("split = 'test'").count() == math.ceil(0.05 * 271)
    assert enc.where("split = 'test'").count() == math.ceil(0.05 * 271)
    assert enc.selectExpr("max(size(chosen_input_ids))").first()[0] <= 512


def test_job_pairs_equal_built_pairs(spark):
    from prefloom.operators import pairs as P

    src = scratch_path(spark, "t-job-in2")
    out = scratch_path(spark, "t-job-out2")
    prompts = fx.ftext_prompts(spark, SF001).select("prompt_id", "prompt", "img_path", "completions")
    write_table(prompts, src)
    jobs.run(spark, jobs.parse_args(["--input", src, "--output", out]))
    got = spark.read.parquet(f"{out}/pairs").drop("split")
    want = P.build_pairs(spark.read.parquet(src))
    cols = ["prompt_id", "comp_i", "comp_j", "prompt", "chosen", "rejected"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_job_reports_bad_lines_and_null_texts(spark):
    from pyspark.sql import functions as F

    src, out = scratch_path(spark, "t-job-in3"), scratch_path(spark, "t-job-out3")
    prompts = fx.ftext_prompts(spark, SF001).select("prompt_id", "prompt", "img_path", "completions")
    prompts = prompts.withColumn("prompt", F.when(F.col("prompt_id") > 3, F.col("prompt")))
    line = F.to_json(F.struct(*prompts.columns))
    prompts.select(F.when(F.col("prompt_id") % 10 == 7, F.concat(line, F.lit("}"))).otherwise(line).alias("value")).write.text(src)
    jobs.run(spark, jobs.parse_args(["--input", src, "--output", out, "--format", "jsonl", "--on-bad", "quarantine"]))
    enc = spark.read.parquet(f"{out}/encoded")
    report = {r.split: r for r in spark.read.parquet(f"{out}/report").collect()}
    assert sum(r.n_pairs for r in report.values()) == enc.count()
    assert sum(r.n_null_text for r in report.values()) == enc.where("prompt_id <= 3").count() > 0
    assert {r.n_bad_lines for r in report.values()} == {spark.read.parquet(f"{out}/quarantine").count()} == {5}


def test_json_lines_without_ids_fail(spark):
    import pytest

    from prefloom.sources.preferences import read_preference_table

    src = scratch_path(spark, "t-no-ids")
    prompts = fx.ftext_prompts(spark, SF001).select("prompt", "img_path", "completions")
    prompts.write.json(src)
    with pytest.raises(Exception, match="no prompt_id"):
        read_preference_table(spark, src, fmt="jsonl").collect()
    assert read_preference_table(spark, src, fmt="jsonl", ids="derive").select("prompt_id").distinct().count() == prompts.count()
