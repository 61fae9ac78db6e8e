from pyspark.sql import functions as F

from conftest import SF001
from prefloom.operators import sampling
from prefloom.sources import fixtures as fx
from prefloom.sources.tables import read_table


def test_exact_k_and_layout(spark):
    flat = fx.fline_completions(spark, SF001).select("prompt_id", "comp_idx", "model")
    a = sampling.sample_models(flat, 4)
    sizes = flat.groupBy("prompt_id").count()
    got = a.groupBy("prompt_id").count().withColumnRenamed("count", "k")
    bad = sizes.join(got, "prompt_id").where(F.col("k") != F.least(F.col("count"), F.lit(4))).count()
    assert bad == 0
    b = sampling.sample_models(flat.repartition(13), 4)
    assert a.exceptAll(b).count() == 0


def test_group_limit_before_shuffle(spark):
    docs = read_table(spark, SF001, "documents", "doc_id", "source")
    s = sampling.sample_by_domain(docs, 5)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert s.groupBy("source").count().where("count > 5").count() == 0
