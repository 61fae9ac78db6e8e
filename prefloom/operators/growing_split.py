"""The exact held-out split of a table that grows.

`split_exact` hashes and counts a whole table.  When rows are appended, the
counts of the old rows do not change, so they are kept: a stored state holds,
for each appended part, the counts per 2-byte hash prefix and the (key, hash)
rows sorted by hash, in folders by its first digit.  An append hashes and counts
only its own rows.  The rule of the whole table then needs the sum of the stored
counts (at most 65,536 a part) and the rows of the one prefix in which the cut falls:
one of 16 folders, and there the row groups of that prefix.

The rule equals that of `split_exact` on all rows, in whatever order and however
often they were appended.  A part is written to a folder of its own and replaces
what an earlier, broken or repeated append of the same name left there.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .split import PREFIX_DIGITS, ExactSplitRule, refine_rule, require_unique_keys

STEP = PREFIX_DIGITS // 2


class GrowingSplit:
    """State of an exact split below `path` (shared storage)."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("prompt_id", "comp_i", "comp_j"), *, test_size: float = 0.005, seed: int = 42):
        self.spark, self.path, self.keys, self.test_size, self.seed = spark, path.rstrip("/"), tuple(keys), test_size, seed

    def _keys_path(self) -> str:
        return f"{self.path}/keys"

    def append(self, df: DataFrame, part: str, *, check: bool = True) -> None:
        """Add the rows of `df` under the name `part`.

        With `check`, fails if a key is null, occurs twice in the part, or is
        stored already (one join of the narrow keys); without, the caller vouches.
        """
        if "/" in part or "=" in part:
            raise ValueError("a part's name is a folder name")
        counted = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts/part={part}")
        counted.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(counted, True)  # until the new rows are counted, the part does not count
        rule = ExactSplitRule(self.keys, self.seed)
        new = df.select(*self.keys, rule.hash_col().alias("_h"))
        target = f"{self._keys_path()}/part={part}"
        # by ranges of the hash, so that a folder has few files and a file few prefixes
        laid = new.repartitionByRange("_h").sortWithinPartitions("_h").withColumn("_p", F.substring(F.hex("_h"), 1, 1))
        laid.write.mode("overwrite").partitionBy("_p").parquet(target)
        written = self.spark.read.schema(new.schema).parquet(target)
        if check:
            require_unique_keys(written, self.keys)
            old = self.rows(leave_out=part)
            if old is not None and not written.join(old, ["_h", *self.keys], "left_semi").isEmpty():
                raise ValueError(f"part {part} holds keys that are stored already")
        counts = written.groupBy(F.substring("_h", 1, STEP).alias("b")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/part={part}")

    def _parts(self) -> list[str]:
        """Names of the parts whose counts are complete."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts/{n}/_SUCCESS"))]
        return sorted(n.removeprefix("part=") for n in done if n.startswith("part="))

    def rows(self, prefix: bytes = b"", leave_out: str | None = None) -> DataFrame | None:
        """Stored (key, hash) rows, of one hash prefix only if given: other folders are not read."""
        parts = [p for p in self._parts() if p != leave_out]
        if not parts:
            return None
        sub = f"/_p={prefix[:1].hex().upper()[0]}" if prefix else ""
        paths = [f"{self._keys_path()}/part={p}{sub}" for p in parts]
        if prefix:
            fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            paths = [p for p in paths if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        df = self.spark.read.option("basePath", self._keys_path()).parquet(*paths).select(*self.keys, "_h")
        # the bounds reach the scan, which skips the row groups of other prefixes
        low, high = bytearray(prefix), bytearray(prefix + b"\xff" * 16)
        return df.where((F.col("_h") >= F.lit(low)) & (F.col("_h") <= F.lit(high))) if prefix else df

    def counts(self) -> list[tuple[bytes, int]]:
        """Rows of each 2-byte hash prefix over all parts (at most 65,536 results)."""
        parts = self._parts()
        if not parts:
            return []
        c = self.spark.read.parquet(*[f"{self.path}/counts/part={p}" for p in parts])
        return sorted((bytes(r["b"]), r["n"]) for r in c.groupBy("b").agg(F.sum("n").alias("n")).collect())

    def rule(self) -> ExactSplitRule:
        """The split of all rows appended so far; reads the stored counts and the cut's prefix."""
        rule = ExactSplitRule(self.keys, self.seed)
        counts = self.counts()
        remaining = math.ceil(self.test_size * sum(n for _, n in counts))
        return refine_rule(rule, counts, remaining, lambda prefix: self.rows(prefix))

    def label(self, df: DataFrame) -> DataFrame:
        """`df` with `split`, a narrow projection on its keys."""
        return df.withColumn("split", self.rule().label())
