"""Held-out splits that do not depend on partition layout.

`split_exact` holds out exactly `ceil(test_size * n)` rows: those with the
smallest `md5("{seed}:{key...}")`, ties broken by the key.  It never sorts
the whole table.  Each pass counts rows per 2-byte (4-hex-digit) hash
prefix inside the current region (at most 65,536 groups, so the collected
result is bounded), moves whole buckets below the cutoff to the test side
and narrows the region to the cutoff bucket, until a bucket ends exactly at
the cutoff or the hash is used up.  Keys must be unique and not null (checked:
otherwise the count could not be exact), so that at most the rows of one
16-byte hash are left to rank.  The result is a narrow filter, so the
output keeps the input's partitioning.

`split_by_prompt` keeps a whole prompt on one side (no leakage of a prompt
between train and test) with a hash threshold: approximate size, one
narrow pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

PREFIX_DIGITS = 4


def hash_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def require_unique_keys(df: DataFrame, keys: tuple[str, ...]) -> None:
    """Fail when a key column is null or a key occurs twice (one aggregation by key)."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    bad = df.groupBy(*keys).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | null).limit(1).collect()
    if bad:
        raise ValueError(f"keys {keys} must be unique and not null; found {tuple(bad[0])[:-1]} in {bad[0]['_n']} row(s)")


@dataclass
class ExactSplitRule:
    """The test side of an exact split as a condition on the key columns.

    `below`: (prefix, bucket) steps whose smaller buckets are all test;
    `whole`: a prefix whose rows are all test; `last`: (prefix, boundary
    row) for the ranked remainder.
    """

    keys: tuple[str, ...]
    seed: int
    below: list[tuple[bytes, bytes]] = field(default_factory=list)
    whole: bytes | None = None
    last: tuple[bytes, tuple] | None = None

    def hash_col(self) -> Column:
        return F.unhex(hash_key(self.seed, *self.keys))

    def condition(self, h: Column | None = None) -> Column:
        h = self.hash_col() if h is None else h
        cond = F.lit(False)
        for prefix, bucket in self.below:
            cond = cond | (_in_prefix(h, prefix) & (F.substring(h, len(prefix) + 1, len(bucket)) < F.lit(bytearray(bucket))))
        if self.whole is not None:
            cond = cond | _in_prefix(h, self.whole)
        if self.last is not None:
            prefix, row = self.last
            cond = cond | (_in_prefix(h, prefix) & tuple_le([h] + [F.col(k) for k in self.keys], list(row)))
        return cond

    def label(self, h: Column | None = None) -> Column:
        return F.when(self.condition(h), F.lit("test")).otherwise(F.lit("train"))


def _in_prefix(h: Column, prefix: bytes) -> Column:
    return F.substring(h, 1, len(prefix)) == F.lit(bytearray(prefix)) if prefix else F.lit(True)


def exact_split_rule(
    df: DataFrame,
    keys: tuple[str, ...] = ("prompt_id", "comp_i", "comp_j"),
    *,
    test_size: float = 0.005,
    seed: int = 42,
    materialize: bool = True,
) -> tuple[ExactSplitRule, DataFrame]:
    """Count passes over (key, hash); returns the rule and the (key, hash) rows used."""
    rule = ExactSplitRule(tuple(keys), seed)
    # The md5 is kept as 16 raw bytes: bytewise order equals the order of
    # its hex text, at half the size.  The counting passes read only
    # (key, hash); that narrow projection is materialised once in the shared
    # checkpoint folder so each pass does not recompute the caller's plan.
    hashed = df.select(*keys, rule.hash_col().alias("_h"))
    if materialize:
        checkpoint_dir(df.sparkSession)
        hashed = hashed.checkpoint(eager=True)
    require_unique_keys(hashed, tuple(keys))
    counts = _prefix_counts(hashed, b"")
    remaining = math.ceil(test_size * sum(n for _, n in counts))
    return refine_rule(rule, counts, remaining, lambda prefix: hashed.where(_in_prefix(F.col("_h"), prefix))), hashed


def _prefix_counts(region: DataFrame, prefix: bytes) -> list[tuple[bytes, int]]:
    """Rows of each next 2-byte step of the hash below `prefix` (at most 65,536 results)."""
    b = F.substring("_h", len(prefix) + 1, PREFIX_DIGITS // 2).alias("b")
    return sorted((bytes(r["b"]), r["n"]) for r in region.groupBy(b).agg(F.count("*").alias("n")).collect())


def refine_rule(rule: ExactSplitRule, counts: list[tuple[bytes, int]], remaining: int, region: Callable[[bytes], DataFrame]) -> ExactSplitRule:
    """Narrow the cut from the counts of the first hash bytes down to rows.

    `region(prefix)` gives the (key, `_h`) rows below a prefix; only the prefixes
    in which the cut falls are asked for.
    """
    prefix = b""
    while remaining > 0:
        cum = 0
        cut_bucket, cut_count = None, 0
        for b, n in counts:
            if cum + n >= remaining:
                cut_bucket, cut_count = b, n
                break
            cum += n
        rule.below.append((prefix, cut_bucket))
        remaining -= cum
        prefix += cut_bucket
        if remaining == cut_count:
            rule.whole = prefix
            return rule
        if len(prefix) >= 16:
            order = [F.col("_h")] + [F.col(k) for k in rule.keys]
            last = region(prefix).orderBy(*order).limit(remaining).agg(F.max(F.struct(*order)).alias("m")).collect()[0]["m"]
            rule.last = (prefix, tuple(last))
            return rule
        counts = _prefix_counts(region(prefix), prefix)
    return rule


def split_exact(
    df: DataFrame,
    keys: tuple[str, ...] = ("prompt_id", "comp_i", "comp_j"),
    *,
    test_size: float = 0.005,
    seed: int = 42,
    materialize: bool = True,
) -> DataFrame:
    rule, hashed = exact_split_rule(
        df, keys, test_size=test_size, seed=seed, materialize=materialize
    )
    # Label the caller's rows (a narrow projection); when they are just the
    # keys, the materialised projection already holds them.
    if materialize and list(df.columns) == list(keys):
        return hashed.withColumn("split", rule.label(F.col("_h"))).drop("_h")
    return df.withColumn("split", rule.label())


def tuple_le(cols: list[Column], values: list) -> Column:
    """Lexicographic `(c1, c2, ...) <= (v1, v2, ...)`."""
    lit = [F.lit(bytearray(v)) if isinstance(v, (bytes, bytearray)) else F.lit(v) for v in values]
    acc = cols[-1] <= lit[-1]
    for c, v in reversed(list(zip(cols[:-1], lit[:-1]))):
        acc = (c < v) | ((c == v) & acc)
    return acc


def threshold_hex(rate: float, digits: int = 8) -> str:
    return format(min(int(rate * 16**digits), 16**digits - 1), f"0{digits}x") if rate < 1 else "g" * digits


def split_by_prompt(df: DataFrame, key: str = "prompt_id", *, test_size: float = 0.005, seed: int = 42) -> DataFrame:
    h8 = F.substring(hash_key(seed, key), 1, 8)
    return df.withColumn("split", F.when(h8 < F.lit(threshold_hex(test_size)), "test").otherwise("train"))
