"""Deterministic per-group sampling (top-k by a seeded hash).

The rank is `row_number()` over the group ordered by
`md5("{seed}:{group}:{key}")`, then the key, filtered to `<= k`.  Spark
plans this as a WindowGroupLimit before the shuffle: each map task keeps at
most k rows per group, so even a group holding a third of the data sends
only k rows per task through the exchange.  The result does not depend on
partitioning, and DuckDB computes the same md5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .split import hash_key


def sample_per_group(
    df: DataFrame, group: str, key: str, k: int, *, seed: int = 42, rank_col: str = "rank"
) -> DataFrame:
    h = hash_key(seed, group, key)
    w = Window.partitionBy(group).orderBy(h, F.col(key))
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= k)


def sample_models(completions: DataFrame, k: int = 4, *, seed: int = 42, key: str = "comp_idx") -> DataFrame:
    """Pick k responses per prompt out of its pool (the template has four slots).

    `key` is the per-prompt unique column the seeded hash ranks (a
    completion index, or a model name when each model answers once).
    """
    return sample_per_group(completions, "prompt_id", key, k, seed=seed)


def sample_by_domain(docs: DataFrame, k: int, *, domain: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Pick k instructions per domain."""
    return sample_per_group(docs, domain, key, k, seed=seed)
