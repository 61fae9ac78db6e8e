"""Corpus pipeline: quality rules, line dedup, n-gram join, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  `run` applies
them to `documents`: it writes each stage's result as Parquet below the shared
checkpoint folder, and the next one reads it.  All stages but the last return
the columns of `documents`.  Null texts fail the quality rules and go; extra
columns are carried along; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm.bpe import encode_bpe
from prefloom.llm.common import settle, written
from prefloom.llm.decontaminate import remove_contamination
from prefloom.llm.host_rules import keep_good
from prefloom.llm.line_dedup import dedup_lines
from prefloom.llm.ngram_join import one_of_each_group


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each class of similar lines; documents without a line left go."""
    return _counted(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard similarity."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's spans; documents mostly made of them go."""
    return _counted(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    import public_tokenizers

    keep = [c for c in docs.columns if c not in ("text", "n_chars")]  # ids and n_tokens are replaced
    return encode_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding", encoding),
]

# byte-pair encoding has no SQL form: the stages are tested one by one against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        settle(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
