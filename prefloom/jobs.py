"""End-to-end preparation job: preference table -> split, encoded pairs.

    spark-submit -m prefloom.jobs --input <path> --output <dir> [--layout nested|parallel]
        [--format parquet|jsonl] [--ids long|string|derive] [--model-max-length 2048] [--test-size 0.005] [--seed 42]

Reads the table with an explicit schema, builds pairs, holds out an exact
share of them, encodes both sides and writes `pairs/` and `encoded/`, each
partitioned by `split`.  Each text is tokenized once; the pair keys of the
split are checkpointed in the cluster's `spark.checkpoint.dir`.  `report/`
counts the pairs of each split and those that could not be encoded because
a text is null; with `--on-bad quarantine`, `quarantine/` holds the broken lines.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import encode, split
from .operators.pairs import build_pairs
from .sources.jsonl import read_jsonl_quarantine
from .sources.preferences import read_preference_table, table_schema, write_table

KEYS = ("prompt_id", "comp_i", "comp_j")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Two passes over the source: the split keys, then the encoded pairs.

    `pairs/` is written from the written `encoded/` table (it holds the
    prompt and both response texts), reading only those columns back.
    """
    prompts = read_preference_table(spark, args.input, layout=args.layout, fmt=args.format, on_bad=args.on_bad, ids=args.ids)
    cfg = replace(encode.EncodeConfig.for_model_max_length(args.model_max_length), truncation_mode=args.truncation_mode)
    keys = build_pairs(prompts, on_null=args.on_null).select(*KEYS)
    rule, _ = split.exact_split_rule(keys, KEYS, test_size=args.test_size, seed=args.seed)
    encoded = encode.encode_pairs(encode.pairs_with_ids(prompts), cfg=cfg).withColumn("split", rule.label())
    write_table(encoded, f"{args.output}/encoded", mode=args.mode, partition_by=("split",))
    written = spark.read.parquet(f"{args.output}/encoded")
    pairs = written.select(
        *KEYS,
        "prompt",
        F.col("chosen_response_only").alias("chosen"),
        F.col("rejected_response_only").alias("rejected"),
        "split",
    )
    write_table(pairs, f"{args.output}/pairs", mode=args.mode, partition_by=("split",))
    sides = F.least(*[F.col(f"{s}_input_ids").isNotNull().cast("int") for s in ("prompt", "chosen", "rejected")])
    report = written.groupBy("split").agg(F.count("*").alias("n_pairs"), F.count(F.when(sides == 0, 1)).alias("n_null_text"))
    bad_lines = F.lit(None).cast("bigint")
    if args.format == "jsonl" and args.on_bad == "quarantine":
        write_table(read_jsonl_quarantine(spark, args.input, table_schema(args.layout, args.ids)), f"{args.output}/quarantine", mode=args.mode)
        bad_lines = F.lit(spark.read.parquet(f"{args.output}/quarantine").count())
    write_table(report.withColumn("n_bad_lines", bad_lines), f"{args.output}/report", mode=args.mode)


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--layout", default="nested", choices=("nested", "parallel"))
    p.add_argument("--format", default="parquet", choices=("parquet", "jsonl"))
    # The example configuration's sequence budget, the held-out share and seed.
    p.add_argument("--model-max-length", type=int, default=2048)
    p.add_argument("--test-size", type=float, default=0.005)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--mode", default="errorifexists")
    p.add_argument("--ids", default="long", choices=("long", "string", "derive"))
    p.add_argument("--on-bad", default="error", choices=("error", "quarantine"), help="broken JSON lines")
    p.add_argument("--on-null", default="drop", choices=("drop", "error"), help="null aspect values and ratings")
    p.add_argument("--truncation-mode", default="keep_end", choices=encode.TRUNCATION_MODES)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = SparkSession.builder.appName("prefloom-prepare").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
