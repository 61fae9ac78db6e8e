from pyspark.sql import functions as F

from conftest import SF001
from prefloom.operators import annotate
from prefloom.sources import fixtures as fx
from prefloom.sources import schemas


def test_template_parts():
    parts = annotate.template_parts()
    assert len(parts) == 6
    assert parts[0].startswith("# Assessment Guidelines\n## Helpfulness Assessment")
    assert parts[-1] == "\n\n### Output\n"
    assert "#### Helpfulness Assessment \n" in parts[0]


def test_fill_keeps_placeholder_text_verbatim(spark):
    rows = [(1, "Describe it", ["[[text_2_placeholder]] sneaky", "b", None, "d"])]
    df = spark.createDataFrame(rows, "prompt_id long, instruction string, texts array<string>")
    got = df.select(annotate.fill_template(F.col("instruction"), F.col("texts"))).first()[0]
    assert "- <text 1> [[text_2_placeholder]] sneaky\n- <text 2> b\n- <text 3> \n- <text 4> d\n" in got
    assert "Instruction: Describe it\n" in got


def test_render_parse_round_trip(spark):
    prompts = fx.ftext_prompts(spark, SF001)
    parsed = annotate.parse_annotations(annotate.render_answers(prompts))
    back = annotate.to_annotation_map(parsed).drop("group_idx")
    orig = prompts.select("prompt_id", F.posexplode("completions").alias("pos", "c")).select(
        "prompt_id", (F.col("pos") + 1).alias("text_idx"), F.col("c.annotations").alias("a")
    )
    j = orig.join(back, ["prompt_id", "text_idx"])
    assert j.count() == orig.count() == 200
    for r in j.collect():
        for aspect, v in r.a.items():
            assert r.annotations[aspect].Rating == v.Rating
            assert r.annotations[aspect].Rationale == v.Rationale


def test_malformed_blocks_quarantined(spark):
    answer = (
        "#### Helpfulness Assessment \n##### Output for Text 1\nRating: 4\nRationale: ok\nRating: 1 inside\n"
        "##### Output for Text 2\nno rating here\n\n"
        "#### Visual Faithfulness Assessment\n##### Output for Text 1\nRating:5\nRationale: line one\nline two\n"
    )
    df = spark.createDataFrame([(9, answer)], "prompt_id long, answer string")
    df = df.selectExpr("*", "2L as n_texts")
    good = sorted(tuple(r) for r in annotate.parse_annotations(df).collect())
    assert good == [
        (9, 1, "Helpfulness", "4", "ok\nRating: 1 inside"),
        (9, 1, "Visual Faithfulness", "5", "line one\nline two"),
    ]
    bad = sorted((r.text_idx or 0, r.aspect, r.status) for r in annotate.parse_quarantine(df).collect())
    assert bad == [
        (1, "Ethical Considerations", "missing_section"),
        (2, "Ethical Considerations", "missing_section"),
        (2, "Helpfulness", "no_rating_line"),
        (2, "Visual Faithfulness", "missing_block"),
    ]


def test_every_expected_block_is_accounted_for(spark):
    head = "#### Helpfulness Assessment\n"
    block = "##### Output for Text {}\nRating: 3\nRationale: r\n"
    answers = [
        (1, head + block.format(1) + block.format(3)),
        (2, None),
        (3, head + block.format(9) + "#### Foo Assessment\n" + block.format(1)),
        (4, head + block.format("12345678901234567890")),
        (5, head + block.format(1) + block.format(1) + head + block.format(1)),
        (6, ""),
    ]
    df = spark.createDataFrame(answers, "prompt_id long, answer string")
    rows = annotate.parse_answers(df).collect()
    extra = {"unknown_text", "unknown_aspect", "duplicate"}
    for k in range(1, 7):
        expected = [(r.text_idx, r.aspect) for r in rows if r.prompt_id == k and r.status not in extra]
        assert len(expected) == len(set(expected)) == 12
    status = lambda k: sorted(r.status for r in rows if r.prompt_id == k and r.aspect in ("Helpfulness", "Foo"))
    assert status(1) == ["missing_block", "missing_block", "ok", "ok"]
    assert status(2) == ["null_answer"] * 4 and status(6) == ["missing_section"] * 4
    assert status(3) == ["missing_block"] * 4 + ["unknown_aspect", "unknown_text"]
    assert status(4) == ["missing_block"] * 4 + ["unknown_text"]
    assert status(5) == ["duplicate", "duplicate", "missing_block", "missing_block", "missing_block", "ok"]
    assert annotate.to_annotation_map(annotate.parse_annotations(df)).count() == 3


def test_every_response_reaches_a_judge_prompt(spark):
    prompts = fx.fline_prompts(spark, SF001)
    a = annotate.annotation_prompts(prompts)
    assert a.agg(F.sum("n_texts")).first()[0] == 6000
    parsed = annotate.parse_annotations(annotate.render_answers(prompts))
    assert parsed.count() == 3 * 6000


def test_rating_domain_check(spark):
    rep = {(r.aspect, r.status): r.n_ratings for r in annotate.rating_domain_check(fx.fline_completions(spark, SF001)).collect()}
    assert rep[("Visual Faithfulness", "nan")] == 265
    assert rep[("Visual Faithfulness", "unparseable")] == 363 + 244
    assert sum(v for (a, _), v in rep.items() if a == "Helpfulness") == 6000
