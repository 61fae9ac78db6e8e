import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from model import encode as model_encode
from prefloom.operators import batches, encode
from prefloom.sources import fixtures as fx

SEQS = [f"{s}_{k}" for s in ("prompt", "chosen", "rejected") for k in ("input_ids", "labels", "attention_mask")]


def run(spark, rows, cfg):
    df = spark.createDataFrame(rows, "prompt_id long, comp_i long, comp_j long, prompt string, chosen string, rejected string")
    out = {r.prompt_id: r for r in encode.encode_pairs(df, cfg=cfg).collect()}
    for pid, _, _, p, c, r in rows:
        want = model_encode(p, c, r, cfg.max_length, cfg.max_prompt_length, cfg.truncation_mode)
        got = out[pid]
        for k in SEQS:
            assert list(got[k]) == want[k], (pid, k)
        assert got["chosen"] == p + c and got["rejected_response_only"] == r


def boundary_rows(cfg):
    """Texts sized around each truncation boundary."""
    sys_len = 1 + 6 + 1 + 28 + 2  # system segment
    user_fixed = 5 + 1 + 2  # header + nl + end + nl
    asst_fixed = 10 + 1 + 2 + 1  # header + nl + end + nl + EOS
    rows, pid = [], 0
    for plen in (0, 3, 40, 200):
        p_total = sys_len + user_fixed + plen
        for delta in (-1, 0, 1, 2):
            resp = max(0, cfg.max_length - p_total - asst_fixed + delta)
            for other in (0, resp):
                rows.append((pid, 0, 1, "p" * plen, "é" * resp, "x" * other))
                pid += 1
    rows.append((pid, 0, 1, "  emoji 😀 ", "", "a\nb"))
    # far over the budget on every side
    rows.append((pid + 1, 0, 1, "q" * (3 * cfg.max_length), "é" * (3 * cfg.max_length), "x" * (2 * cfg.max_length)))
    rows.append((pid + 2, 0, 1, "q" * 5, "é" * (3 * cfg.max_length), "x"))
    return rows


@pytest.mark.parametrize(
    "cfg",
    [
        encode.EncodeConfig(max_length=120, max_prompt_length=60),
        encode.EncodeConfig(max_length=121, max_prompt_length=60, truncation_mode="keep_start"),
        encode.EncodeConfig(max_length=101, max_prompt_length=0),
        encode.EncodeConfig(max_length=101, max_prompt_length=0, truncation_mode="keep_start"),
        encode.EncodeConfig(max_length=80, max_prompt_length=70),
    ],
)
def test_encode_matches_model(spark, cfg):
    run(spark, boundary_rows(cfg), cfg)


def test_random_texts(spark):
    rnd = random.Random(7)
    alphabet = "ab c\né😀\t"
    rows = []
    for pid in range(40):
        t = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
        rows.append((pid, 0, 1, t(rnd.randint(0, 90)), t(rnd.randint(0, 90)), t(rnd.randint(0, 90))))
    run(spark, rows, encode.EncodeConfig(max_length=128, max_prompt_length=64))


def test_bad_truncation_mode(spark):
    df = spark.createDataFrame([(1, 0, 1, "a", "b", "c")], "prompt_id long, comp_i long, comp_j long, prompt string, chosen string, rejected string")
    with pytest.raises(ValueError):
        encode.encode_pairs(df, cfg=encode.EncodeConfig(truncation_mode="middle"))


def test_nested_path_equals_text_path(spark):
    from prefloom.operators import pairs

    prompts = fx.ftext_prompts(spark, SF001)
    a = encode.encode_prompt_rows(prompts).drop("prompt_x")
    b = encode.encode_pairs(pairs.build_pairs(prompts))
    cols = ["prompt_id", "comp_i", "comp_j"] + SEQS
    sa = a.select(*[F.to_json(F.array(c)).alias(c) if c in SEQS else c for c in cols])
    sb = b.select(*[F.to_json(F.array(c)).alias(c) if c in SEQS else c for c in cols])
    assert sa.count() == 271
    assert sa.exceptAll(sb).count() == 0 and sb.exceptAll(sa).count() == 0


def test_pad_batches(spark):
    e = encode.encode_prompt_rows(fx.ftext_prompts(spark, SF001), cfg=encode.EncodeConfig(max_length=256, max_prompt_length=128))
    p = batches.pad_batches(e, batch_size=4).collect()
    by_batch = {}
    for r in p:
        by_batch.setdefault(r.batch, []).append(r)
    assert sorted(by_batch) == list(range(68)) and [len(v) for _, v in sorted(by_batch.items())] == [4] * 67 + [3]
    for rows in by_batch.values():
        for side in ("prompt", "chosen", "rejected"):
            widths = {len(r[f"{side}_input_ids"]) for r in rows} | {len(r[f"{side}_labels"]) for r in rows}
            assert widths == {rows[0][f"{side}_width"]}
        for r in rows:  # prompt padded on the left, responses on the right
            pm = list(r["prompt_attention_mask"])
            assert pm == sorted(pm)
            cm = list(r["chosen_attention_mask"])
            assert cm == sorted(cm, reverse=True)


def test_length_report(spark):
    from prefloom.operators import pairs

    rep = encode.length_report(pairs.build_pairs(fx.ftext_prompts(spark, SF001)), cfg=encode.EncodeConfig(max_length=512, max_prompt_length=256))
    got = {r["case"]: r for r in rep.collect()}
    assert sum(r.n_pairs for r in got.values()) == 271
    for r in got.values():
        assert r.max_total_after <= 512 or r["case"] != "responses_truncated"


def test_batches_do_not_depend_on_layout_or_prefix(spark):
    e = encode.encode_prompt_rows(fx.ftext_prompts(spark, SF001), cfg=encode.EncodeConfig(max_length=64, max_prompt_length=32))
    keys = ["prompt_id", "comp_i", "comp_j"]
    want = None
    for parts, digits in ((1, 4), (17, 4), (5, 0), (5, 2)):
        p = batches.pad_batches(e.repartition(parts), batch_size=8, prefix_digits=digits)
        got = sorted(map(tuple, p.select(*keys, "batch", "prompt_width", "chosen_width", "rejected_width").collect()))
        want = want or got
        assert got == want


def test_prompt_budget_over_length_is_rejected(spark):
    import pytest

    with pytest.raises(ValueError, match="max_prompt_length"):
        encode.encode_prompt_rows(fx.ftext_prompts(spark, SF001), cfg=encode.EncodeConfig(max_length=40, max_prompt_length=60))


def test_null_prompt_is_reported(spark):
    df = spark.createDataFrame([(1, 0, 1, None, "a", "b"), (2, 0, 1, "p", "a", "b")], "prompt_id long, comp_i long, comp_j long, prompt string, chosen string, rejected string")
    assert {r["case"]: r.n_pairs for r in encode.length_report(df).collect()} == {"null_text": 1, "fits": 1}


def test_tokenizer_is_built_once_per_worker(spark, tmp_path):
    from prefloom.functions.tokens import ArrowTokenizer

    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return None

    tok = ArrowTokenizer(factory, lambda t, texts: [[len(x)] for x in texts], 1, 2, 3)
    df = spark.range(0, 240, numPartitions=12).selectExpr("cast(id as string) t")
    from pyspark.sql import functions as F

    assert df.select(F.explode(tok.encode(F.col("t")))).count() == 240
    import os

    made = [x.split("-")[0] for x in os.listdir(folder)]
    assert len(made) == len(set(made)) <= 12
