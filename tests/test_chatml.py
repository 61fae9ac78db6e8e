import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from model import IGN, segment, system_segment
from prefloom.operators import chatml
from prefloom.sources import fixtures as fx

SCHEMA = "conv_id long, turn long, role string, text string"


def conv_df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_policies(spark):
    rows = [
        (1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "a"),
        (2, 0, "system", "s"), (2, 1, "user", "q"),
        (3, 0, "user", "q"), (3, 1, "tool", "t"), (3, 2, "assistant", "a"),
        (4, 0, "assistant", "a1"), (4, 1, "assistant", "a2"),
    ]
    df = conv_df(spark, rows)
    got = sorted(tuple(r) for r in chatml.drop_leading_nonuser(df, "drop_conversation").collect())
    assert got == [(1, 1, "user", "q"), (1, 2, "assistant", "a"), (4, 1, "assistant", "a2")]
    got = sorted(tuple(r)[:3] for r in chatml.drop_leading_nonuser(df, "drop_turn").collect())
    assert (2, 1, "user") in got and (3, 2, "assistant") in got and (3, 1, "tool") not in got
    with pytest.raises(Exception):
        chatml.drop_leading_nonuser(df, "error").collect()
    assert chatml.drop_leading_nonuser(conv_df(spark, rows[:3]), "error").count() == 2


def test_golden_turn_counts(spark):
    turns = chatml.encode_turns(chatml.drop_leading_nonuser(fx.conversations(spark, SF01)))
    assert chatml.turn_prompts(turns).count() == 217
    assert chatml.turn_answers(turns).count() == 186


def test_segments_match_model(spark):
    rows = [(7, 0, "user", "héllo 😀"), (7, 1, "assistant", ""), (7, 2, "user", "again"), (7, 3, "assistant", "ok\n")]
    turns = chatml.encode_turns(conv_df(spark, rows))
    got = {r.turn: r for r in turns.collect()}
    for _, turn, role, text in rows:
        ids, labels = segment(role, text)
        assert list(got[turn].ids) == ids and list(got[turn].labels) == labels
    sys_ids, sys_lab = system_segment()
    prompts = {r.turn: r for r in chatml.turn_prompts(turns).collect()}
    want2 = sys_ids + segment("user", rows[0][3])[0] + segment("assistant", "")[0] + segment("user", "again")[0]
    assert list(prompts[2].input_ids) == want2
    lab2 = sys_lab + segment("user", rows[0][3])[1] + segment("assistant", "")[1] + segment("user", "again")[1]
    assert list(prompts[2].labels) == lab2
    render = chatml.chatml_render(turns).first()
    assert render.text.startswith("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nhéllo")
    assert render.text.endswith("<|im_start|>assistant\nok\n<|im_end|>\n")
    assert IGN in list(render.labels)


def test_plan_one_shuffle(spark):
    turns = chatml.encode_turns(chatml.drop_leading_nonuser(fx.conversations(spark, SF001)))
    plan = chatml.turn_prompts(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def model_conversation(turns):
    """Prompts (cumulative prefix at each user turn) and answers (own segment), per the semantics."""
    if turns and turns[0][0] != "user":
        turns = turns[1:]
    sys_ids, sys_lab = system_segment()
    ids, labels = list(sys_ids), list(sys_lab)
    prompts, answers = {}, {}
    for turn, (role, text) in enumerate(turns):
        s_ids, s_lab = segment(role, text)
        ids += s_ids
        labels += s_lab
        if role == "user":
            prompts[turn] = (list(ids), list(labels))
        else:
            answers[turn] = (s_ids, s_lab)
    return prompts, answers


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="ab é😀\n", max_size=12)), min_size=1, max_size=6),
        min_size=1,
        max_size=4,
    )
)
def test_random_conversations_against_model(spark, convs):
    rows = [(cid, t, role, text) for cid, turns in enumerate(convs) for t, (role, text) in enumerate(turns)]
    df = conv_df(spark, rows)
    turns = chatml.encode_turns(chatml.drop_leading_nonuser(df))
    got_p = {(r.conv_id, r.turn): (list(r.input_ids), list(r.labels)) for r in chatml.turn_prompts(turns).collect()}
    got_a = {(r.conv_id, r.turn): (list(r.input_ids), list(r.labels)) for r in chatml.turn_answers(turns).collect()}
    want_p, want_a = {}, {}
    for cid, conv in enumerate(convs):
        offset = 1 if conv and conv[0][0] != "user" else 0
        p, a = model_conversation(conv)
        want_p.update({(cid, t + offset): v for t, v in p.items()})
        want_a.update({(cid, t + offset): v for t, v in a.items()})
    assert got_p == want_p
    assert got_a == want_a


def test_own_system_turn(spark):
    rows = [
        (1, 0, "system", "Sei knapp. é😀"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r"),
        (2, 0, "user", "q"), (2, 1, "assistant", "a"),
        (3, 0, "system", ""), (3, 1, "assistant", "dropped"), (3, 2, "user", "q"),
        (4, 0, "system", "alone"),
        (5, 0, "user", "q"), (5, 1, "system", "late"), (5, 2, "user", "r"),
    ]
    conv = chatml.drop_leading_nonuser(conv_df(spark, rows), "drop_turn", own_system=True)
    turns = chatml.encode_turns(conv)
    messages = {1: "Sei knapp. é😀", 2: chatml.SYSTEM_MESSAGE, 3: "", 5: chatml.SYSTEM_MESSAGE}
    got = {r.conv_id: r for r in chatml.chatml_render(turns).collect()}
    assert set(got) == set(messages)
    for c, message in messages.items():
        own = [(r, t) for i, _, r, t in rows if i == c and r in ("user", "assistant") and t != "dropped"]
        ids, labels = chatml.system_segment(system_message=message)
        for role, text in own:
            a, b = segment(role, text)
            ids, labels = ids + a, labels + b
        assert list(got[c].input_ids) == ids and list(got[c].labels) == labels
        assert got[c].text.startswith(f"<|im_start|>system\n{message}<|im_end|>\n")
    prompts = {(r.conv_id, r.turn): r for r in chatml.turn_prompts(turns).collect()}
    assert set(prompts) == {(1, 1), (1, 3), (2, 0), (3, 2), (5, 0), (5, 2)}
    for (c, _), r in prompts.items():
        assert got[c].text.startswith(r.prompt_text) and list(got[c].input_ids)[: len(r.input_ids)] == list(r.input_ids)
    assert prompts[1, 3].prompt_text == got[1].text
    dropped = chatml.drop_leading_nonuser(conv_df(spark, rows), "drop_conversation", own_system=True)
    assert {r.conv_id for r in dropped.collect()} == {1, 2, 3}


def test_prompts_are_slices_of_one_array(spark):
    turns = chatml.encode_turns(chatml.drop_leading_nonuser(fx.conversations(spark, SF001)))
    plan = chatml.turn_prompts(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list(") <= 4 and "slice(input_ids" in plan  # one list a conversation (partial, final), no window of lists
