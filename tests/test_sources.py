import pytest

from conftest import SF001
from prefloom.operators import pairs
from prefloom.session import scratch_path
from prefloom.sources import fixtures as fx
from prefloom.sources import jsonl, schemas
from prefloom.streaming import pairs_stream


def test_jsonl_round_trip(spark):
    path = scratch_path(spark, "t-jsonl")
    src = fx.ftext_prompts(spark, SF001).select(*[f.name for f in schemas.PROMPT_ROW.fields])
    jsonl.write_jsonl(src, path)
    back = jsonl.read_jsonl(spark, path, schemas.PROMPT_ROW)
    assert back.count() == 50
    assert pairs.build_pairs(back).count() == 271


def test_jsonl_bad_lines(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"prompt_id": 1, "prompt": "a"}\n\n{"prompt_id": 2, "prompt": \n{"prompt_id": 3}\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(p), schemas.PROMPT_ROW, on_bad="error").collect()
    good = jsonl.read_jsonl(spark, str(p), schemas.PROMPT_ROW, on_bad="quarantine")
    assert sorted(r.prompt_id for r in good.collect()) == [1, 3]
    bad = sorted(r.reason for r in jsonl.read_jsonl_quarantine(spark, str(p), schemas.PROMPT_ROW).collect())
    assert bad == ["blank_line", "malformed"]


def test_stream_equals_batch(spark):
    nested = fx.fline_prompts(spark, SF001)
    s = pairs_stream.pairs_via_stream(spark, nested)
    b = pairs.build_pairs(nested)
    assert s.count() == 7810
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as entry
    from prefloom.plans.catalog import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["prompt_id", "comp_i", "comp_j", "prompt", "chosen", "rejected"]
    assert df.count() == 7810


def test_preference_table_layouts(spark):
    from prefloom.sources.preferences import read_preference_table, write_table

    nested = fx.fline_prompts(spark, SF001)
    p1 = scratch_path(spark, "t-nested")
    write_table(nested, p1)
    assert pairs.build_pairs(read_preference_table(spark, p1)).count() == 7810
    p2 = scratch_path(spark, "t-parallel")
    write_table(schemas.to_parallel_lists(nested), p2)
    back = read_preference_table(spark, p2, layout="parallel")
    assert pairs.build_pairs(back).count() == 7810


def test_arrow_tokenizer_plugin(spark):
    """An external tokenizer runs in an Arrow-batched pandas UDF."""
    from pyspark.sql import functions as F

    from prefloom.functions.tokens import ArrowTokenizer

    class Bytes:
        def encode(self, texts):
            return [list(t.encode("utf-8")) for t in texts]

    tok = ArrowTokenizer(Bytes, lambda t, texts: t.encode(texts), 256, 257, 258)
    df = spark.createDataFrame([("aé",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(tok.encode(F.col("t"))).collect()]
    assert got == [[97, 195, 169], None, []]
    assert tok.role_ids("user") == [256, 117, 115, 101, 114]


def test_stream_encode_equals_batch(spark):
    from pyspark.sql import functions as F

    from prefloom.operators import encode

    prompts = fx.ftext_prompts(spark, SF001)
    s = pairs_stream.pairs_via_stream(spark, prompts, transform=encode.encode_prompt_rows)
    b = encode.encode_prompt_rows(prompts)
    cols = ["prompt_id", "comp_i", "comp_j", "chosen_input_ids", "rejected_labels", "prompt_attention_mask"]
    js = lambda df: df.select(*[F.to_json(F.array(c)).alias(c) for c in cols])
    assert s.count() == b.count() == 271
    assert js(s).exceptAll(js(b)).count() == 0


def test_arrow_tokenizer_in_nested_encoding(spark):
    """A Python tokenizer drives the tokenize-once path: same pairs, its own ids."""
    from pyspark.sql import functions as F

    from prefloom.functions.tokens import ArrowTokenizer
    from prefloom.operators import encode

    class Bytes:
        def encode(self, texts):
            return [list(t.encode("utf-8")) for t in texts]

    tok = ArrowTokenizer(Bytes, lambda t, texts: t.encode(texts), 256, 257, 258)
    prompts = fx.ftext_prompts(spark, SF001)
    cfg = encode.EncodeConfig(max_length=4096, max_prompt_length=2048)
    a = encode.encode_prompt_rows(prompts, tok, cfg)
    b = encode.encode_pairs(pairs.build_pairs(prompts), tok, cfg)
    cols = ["prompt_id", "comp_i", "comp_j", "chosen_input_ids", "rejected_labels", "prompt_attention_mask"]
    js = lambda df: df.select(*[F.to_json(F.array(c)).alias(c) for c in cols])
    assert a.count() == 271
    assert js(a).exceptAll(js(b)).count() == 0


def test_stream_of_nothing(spark):
    nested = fx.fline_prompts(spark, SF001).limit(0)
    s = pairs_stream.pairs_via_stream(spark, nested)
    assert s.count() == 0
    assert s.columns == ["prompt_id", "comp_i", "comp_j", "prompt", "chosen", "rejected"]


def test_stream_restart_processes_new_files_once(spark):
    """A restarted query resumes from its checkpoint: new files only, no duplicates."""
    nested = fx.fline_prompts(spark, SF001)
    src = scratch_path(spark, "t-restart-src")
    out = scratch_path(spark, "t-restart-out")
    ckpt = scratch_path(spark, "t-restart-ckpt")
    from pyspark.sql import functions as F

    mid = nested.agg(F.percentile_approx("prompt_id", 0.5)).first()[0]
    first, second = nested.where(F.col("prompt_id") < mid), nested.where(F.col("prompt_id") >= mid)
    first.write.parquet(src)
    schema = spark.read.parquet(src).schema
    pairs_stream.start_pairs_stream(spark, src, schema, out, ckpt).awaitTermination()
    n_first = spark.read.parquet(out).count()
    second.write.mode("append").parquet(src)
    pairs_stream.start_pairs_stream(spark, src, schema, out, ckpt).awaitTermination()
    got = spark.read.parquet(out).drop("batch_id")
    want = pairs.build_pairs(nested)
    assert 0 < n_first < got.count() == 7810
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_strict_lines(spark, tmp_path):
    """Only lines that hold one object and nothing else pass, as json.loads has it."""
    import json

    import pytest
    from pyspark.sql import types as T

    from prefloom.sources import jsonl

    schema = T.StructType([T.StructField("prompt_id", T.LongType()), T.StructField("prompt", T.StringType())])
    lines = [
        '{"prompt_id": 1, "prompt": "a"}', '{"prompt_id": 2}{"prompt_id": 3}', '{"prompt_id": 7} junk', "{'prompt_id': 4}", '{"prompt_id": 5}]',
        '{"prompt_id": 6},"end":"x"}', '{"prompt_id": 8} ', '  {"prompt": "b} ", "prompt_id": 9}', "", "null", "[1]",
    ]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines) + "\n")

    def good(t):
        try:
            return isinstance(json.loads(t), dict)
        except ValueError:
            return False

    want = [json.loads(t)["prompt_id"] for t in lines if good(t)]
    got = jsonl.read_jsonl(spark, str(path), schema, on_bad="quarantine").collect()
    assert sorted(r.prompt_id for r in got) == sorted(want) == [1, 8, 9]
    assert jsonl.read_jsonl_quarantine(spark, str(path), schema).count() == len(lines) - len(want)
    with pytest.raises(Exception, match="bad JSON line"):
        jsonl.read_jsonl(spark, str(path), schema).collect()


def test_tables_without_ids(spark, tmp_path):
    import pytest

    from prefloom.sources import preferences

    src = fx.ftext_prompts(spark, SF001).select("prompt", "img_path", "completions")
    twice = src.unionByName(src)
    twice.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="derive"):
        preferences.read_preference_table(spark, str(tmp_path / "t"))
    a = preferences.read_preference_table(spark, str(tmp_path / "t"), ids="derive")
    ids = {r.prompt_id for r in a.select("prompt_id").collect()}
    assert len(ids) == 100
    twice.repartition(7).write.parquet(str(tmp_path / "u"))
    b = preferences.read_preference_table(spark, str(tmp_path / "u"), ids="derive")
    assert {r.prompt_id for r in b.select("prompt_id").collect()} == ids


def test_stored_nested_table_is_pruned(spark, tmp_path):
    """Pairing, encoding and judge prompts read only the completion fields that they use."""
    from conftest import plan_text
    from prefloom.operators import annotate, encode, pairs

    fx.ftext_prompts(spark, SF001).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))

    def schema_of(df):
        p = plan_text(df)
        return p[p.index("ReadSchema") :]

    assert "model" not in schema_of(pairs.build_pairs(t)) and "comp_idx" not in schema_of(pairs.build_pairs(t))
    assert "response" in schema_of(pairs.build_pairs(t))
    assert "model" not in schema_of(encode.encode_prompt_rows(t))
    assert "annotations" not in schema_of(annotate.annotation_prompts(t)) and "model" not in schema_of(annotate.annotation_prompts(t))
