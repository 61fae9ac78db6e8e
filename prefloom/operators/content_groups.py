"""Splits that keep prompts with common content on one side.

A split by prompt id leaks when one prompt text or one image stands under
several ids.  Here prompts that share a text or an image path, directly or
through others, are one group: the components of the graph whose links join
each prompt to the least prompt of its text and to the least prompt of its
image.  That is at most two links a prompt, however many share a text, and the
least prompt of a text is a partially aggregated minimum.  The components come
from alternating steps that hang every node below the least node it can see;
the split is a hash threshold on a group's least prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .split import hash_key, threshold_hex


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_links(prompts: DataFrame, *, key: str = "prompt_id", by: tuple[str, ...] = ("prompt", "img_path")) -> DataFrame:
    """(a, b): each prompt and the least prompt with an equal value of a column; nulls link nothing.

    Long values are compared by a 256-bit hash, so that no text is shuffled.
    """
    links = None
    for c in by:
        v = prompts.select(F.col(key).alias("a"), F.sha2(F.col(c).cast("string"), 256).alias("_v")).where("_v is not null and a is not null")
        least = v.groupBy("_v").agg(F.min("a").alias("b"), F.max("a").alias("_last")).where("b <> _last").drop("_last")
        one = v.join(least, "_v").where("a <> b").select("a", "b")
        links = one if links is None else links.unionByName(one)
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) links, root the least node of its component.

    Large-star and small-star steps: every step is a minimum per node and a
    join by node; each result is written, so a lost executor costs one step.
    The number of steps grows with the logarithm of the longest chain.
    """
    e = _stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = _stored(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), "links")
        # done when every node has one parent and no parent has one itself
        many = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        inner = nxt.select(F.col("v").alias("u")).join(nxt.select("u"), "u", "left_semi")
        e = nxt
        if many.unionByName(inner).isEmpty():
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def content_groups(prompts: DataFrame, *, key: str = "prompt_id", by: tuple[str, ...] = ("prompt", "img_path")) -> DataFrame:
    """(key, group): every prompt id with the least id of its group."""
    roots = components(content_links(prompts, key=key, by=by))
    ids = prompts.select(key).distinct()
    j = ids.join(roots, ids[key].eqNullSafe(roots["node"]), "left")
    return j.select(ids[key], F.coalesce(F.col("root"), ids[key]).alias("group"))


def split_by_content(
    df: DataFrame, prompts: DataFrame, *, key: str = "prompt_id", by: tuple[str, ...] = ("prompt", "img_path"), test_size: float = 0.005, seed: int = 42
) -> DataFrame:
    """`df` (any table with the prompt id) with `split`; no text or image of `prompts` is on both sides.

    The share is held by groups, so it is approximate, and a group is never
    cut: if a third of all prompts share one image, that third is on one side.
    Rows whose prompt is not in `prompts` form groups of their own.
    """
    g = content_groups(prompts, key=key, by=by).withColumnRenamed("group", "_group")
    j = df.join(g, key, "left").withColumn("_group", F.coalesce(F.col("_group"), F.col(key)))
    h8 = F.substring(hash_key(seed, "_group"), 1, 8)
    return j.withColumn("split", F.when(h8 < F.lit(threshold_hex(test_size)), "test").otherwise("train")).select(*df.columns, "split")
