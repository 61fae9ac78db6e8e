"""Shared pieces of the corpus operators: written tables and connected components."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.session import scratch_path

FEW_LINKS = 1 << 17


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared checkpoint folder and read it back.

    This cuts the lineage in a way that survives lost executors, and it gives
    Spark the table's true size, so that a join broadcasts it only when it
    is below `autoBroadcastJoinThreshold`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which a driver
    with little to do puts off; a job of several written steps would hold the
    shuffles of all of them at once.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that `written` made and that no later plan reads."""
    jvm = spark._jvm
    for f in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Distributed union-find: (a, b) links -> (node, root), root = least node.

    Alternating large-star and small-star steps until the links are stars.
    Each step is a partially aggregated minimum per node and a join on the
    node, so a hub's links are never gathered in one task (AQE splits its join
    partition), and no link reaches the driver.  Up to `FEW_LINKS` links (a
    few MB) the same steps run on one partition, which saves their exchanges.
    Nodes without a link to another node are not listed.  Null ends are
    ignored; repeated links count once.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    table = written(e, name)
    few = table.count() <= FEW_LINKS
    while True:
        e = table.coalesce(1) if few else table
        degree = e.groupBy("u").agg(F.count("*").alias("n"))
        inner = e.select(F.col("v").alias("u")).join(degree, "u", "left_semi")
        if inner.unionByName(degree.filter("n > 1").select("u")).isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if few else both
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        nxt = written((small.coalesce(1) if few else small).distinct(), name)
        remove(spark, table)
        table = nxt
    roots = table.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
