"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm import (
    bpe,
    decontaminate,
    host_rules,
    license_scan,
    line_dedup,
    ngram_join,
    passage_dedup,
    pii_bootstrap,
    ranked_search,
    tool_calls,
    toxicity,
    whitening,
    wrapper_extract,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.derived_calls(_table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.SCHEMAS)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_bpe(_table(spark, sf_dir, "documents"), path, pattern, keep=["doc_id"])
    decoded = bpe.decode_bpe(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_text(_table(spark, sf_dir, "documents"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge_documents(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_weight"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_summary(license_scan.scan_licenses(_table(spark, sf_dir, "documents")))


def op9_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data_digest(pii_bootstrap.find_personal_data(_table(spark, sf_dir, "documents")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.component_rows(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_tool_calls": op2_tool_calls,
    "op3_bpe": op3_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_host_rules": op7_host_rules,
    "op8_license_scan": op8_license_scan,
    "op9_wrapper_extract": op9_wrapper_extract,
    "op10_personal_data": op10_personal_data,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}
