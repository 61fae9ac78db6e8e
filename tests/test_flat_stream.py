"""Flat completions as a stream: equal to the batch join, late rows, restart, bounded state."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from prefloom.operators import pairs
from prefloom.plans.catalog import QUERIES
from prefloom.session import scratch_path
from prefloom.sources import fixtures as fx
from prefloom.streaming import flat_pairs

SCHEMA = "prompt_id long, comp_idx long, prompt string, img_path string, response string, annotations map<string,struct<rating:string,rationale:string>>, event_time timestamp"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def completion(prompt, idx, hour, rating=None):
    return prompt, idx, f"p{prompt}", None, f"r{prompt}.{idx}", {"helpful": (str(rating or idx + 1), "x")}, hour


def table(spark, rows):
    df = spark.createDataFrame([(*r[:6], 3600 * (1 + r[6]) if r[6] is not None else None) for r in rows], SCHEMA.replace("event_time timestamp", "event_time long"))
    return df.withColumn("event_time", F.timestamp_seconds("event_time"))


def ids(df):
    return sorted((r.prompt_id, r.comp_i, r.comp_j) for r in df.collect())


def test_query_equals_batch(spark):
    got = QUERIES["stream_pairs_flat"](spark, SF001)
    want = pairs.build_pairs_join(fx.fline_completions(spark, SF001))
    assert got.columns == want.columns
    assert rows_of(got) == rows_of(want) and got.count() > 1000


def test_blocks_give_the_same_pairs(spark):
    flat = fx.fline_completions(spark, SF001).where("prompt_id < 1000").withColumn("event_time", F.timestamp_seconds(F.lit(3600)))
    want = rows_of(pairs.build_pairs_join(flat.drop("event_time")))
    assert len(want) > 100
    for blocks in (1, 3):  # the same function on a table
        assert rows_of(flat_pairs.pair_stream(flat, blocks=blocks)) == want
    with pytest.raises(ValueError):
        flat_pairs.pair_stream(flat, blocks=0)


@pytest.mark.parametrize("blocks", [1, 2])
def test_restart_late_rows_and_state(spark, blocks):
    src, out, ckpt = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-ckpt"))

    def run(*slices):
        for s in slices:
            table(spark, s).coalesce(1).write.mode("append").parquet(src)
        schema = spark.read.parquet(src).schema
        q = flat_pairs.start_flat_stream(spark, src, schema, out, ckpt, within="2 hours", delay="1 hour", blocks=blocks)
        q.awaitTermination()
        progress = list(q.recentProgress)
        state = progress[-1]["stateOperators"][0]["numRowsTotal"] if progress else None
        return flat_pairs.late_rows(progress, blocks), state

    late, _ = run([completion(1, 0, 0), completion(1, 1, 0), completion(2, 0, 0)], [completion(2, 1, 1)])
    assert late == 0 and ids(spark.read.parquet(out)) == [(1, 0, 1), (2, 0, 1)]
    # a new query takes up the state: prompt 2's partners came before the restart
    late, _ = run([completion(2, 2, 2), completion(3, 0, 2)])
    assert late == 0 and ids(spark.read.parquet(out)) == [(1, 0, 1), (2, 0, 1), (2, 0, 2), (2, 1, 2)]
    # hour 20 moves the watermark to 19, which holds for rows one micro-batch later:
    # prompt 3's partner of hour 3 is late, and old rows leave the state
    late, state = run([completion(4, 0, 20)], [completion(4, 1, 20)], [completion(3, 1, 3), completion(4, 2, 20)])
    assert late == 1
    assert ids(spark.read.parquet(out)) == [(1, 0, 1), (2, 0, 1), (2, 0, 2), (2, 1, 2), (4, 0, 1), (4, 0, 2), (4, 1, 2)]
    assert state == 3 * (blocks + 1)  # only the three rows of hour 20


def test_far_apart_and_unusable_rows_do_not_pair(spark):
    rows = [completion(1, 0, 0), completion(1, 1, 3), completion(1, 2, 1, "n/a"), completion(1, 3, 2, 1)]
    assert ids(flat_pairs.pair_stream(table(spark, rows), within="2 hours")) == [(1, 1, 3)]  # 0 and 3 tie, 0 and 1 are too far apart


@pytest.mark.parametrize("row", [completion(None, 0, 0), completion(1, None, 0, 2), completion(1, 0, None)])
def test_rows_without_keys_fail(spark, row):
    with pytest.raises(Exception, match="without a prompt id"):
        flat_pairs.pair_stream(table(spark, [row])).collect()


def test_slices_land_in_many_files_and_are_one_batch_each(spark, monkeypatch):
    started, provider = [], "spark.sql.streaming.stateStore.providerClass"
    start, before = flat_pairs.start_flat_stream, spark.conf.get(provider, None)

    def record(spark, src, *args, **kwargs):
        q = start(spark, src, *args, **kwargs)
        started.append((q, len(spark.read.parquet(src).inputFiles()), kwargs["max_files_per_trigger"], spark.conf.get(provider)))
        return q

    monkeypatch.setattr(flat_pairs, "start_flat_stream", record)
    first = [completion(p, i, 0) for p in range(40) for i in (0, 1)]
    t = table(spark, first).repartition(4).unionByName(table(spark, [completion(7, 2, 1)]).coalesce(1))
    got = flat_pairs.flat_pairs_via_stream(spark, t, 3, F.when(F.col("comp_idx") < 2, 0).otherwise(1), within="2 hours")
    assert ids(got) == sorted([(p, 0, 1) for p in range(40)] + [(7, 0, 2), (7, 1, 2)])
    (q, files, per_batch, store), = started
    assert per_batch > 1 and files == 3 * per_batch  # one row, or none, still makes a batch of its own
    assert [p["numInputRows"] for p in q.recentProgress][:2] == [160, 2]  # both sides read a slice
    assert "RocksDB" in store and spark.conf.get(provider, None) == before


def test_rocksdb_state_without_lookups_of_its_own(spark):
    src, out, ckpt = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-ckpt"))
    slices = [completion(4, 0, 20)], [completion(4, 1, 20), completion(3, 0, 20)], [completion(3, 1, 3), completion(4, 2, 20), completion(3, 2, 21)]
    for s in slices:
        table(spark, s).coalesce(1).write.mode("append").parquet(src)
    changed = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "spark.sql.streaming.noDataMicroBatches.enabled"
    before = [spark.conf.get(c, None) for c in changed]
    with flat_pairs.rocksdb_state(spark):
        assert [spark.conf.get(c) for c in changed] == ["false", "false"]
        q = flat_pairs.start_flat_stream(spark, src, spark.read.parquet(src).schema, out, ckpt, within="2 hours", delay="1 hour")
    q.awaitTermination()
    assert [spark.conf.get(c, None) for c in changed] == before
    progress = list(q.recentProgress)
    assert [p["numInputRows"] for p in progress] == [2, 4, 6]  # no further batch only to clean the state
    assert flat_pairs.late_rows(progress) == 1
    assert ids(spark.read.parquet(out)) == [(3, 0, 2), (4, 0, 1), (4, 0, 2), (4, 1, 2)]


def test_one_block_keeps_no_block_numbers(spark):
    t = table(spark, [completion(1, 0, 0), completion(1, 1, 0)])
    for blocks, numbered in ((1, False), (2, True)):
        plan = flat_pairs.pair_stream(t, blocks=blocks)._jdf.queryExecution().optimizedPlan().toString()
        assert ("l_x#" in plan) == numbered
        assert ids(flat_pairs.pair_stream(t, blocks=blocks)) == [(1, 0, 1)]
