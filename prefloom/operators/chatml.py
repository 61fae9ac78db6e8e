"""ChatML rendering and conversation encoding.

Input is a long conversation table `(conv_id, turn, role, text)`.  All
per-conversation work shares one hash partitioning on `conv_id`: the
role checks, the prompts of all turns and the final render reuse the
same exchange, so a conversation table is shuffled once.

Segment rules (ids and loss labels):

  system    ids  [S] + tok("system") + nl + tok(msg) + [E] + nl
            lab  [S] + IGN * (len - 3) + [E] + nl
  user      ids  R_user + nl + tok(text) + [E] + nl
            lab  [S] + IGN * (len - 3) + [E] + nl
  assistant ids  R_asst + nl + tok(text) + [E] + nl
            lab  [S] + IGN * len(R_asst) + tok(text) + [E] + nl

with R_role = tok("<|im_start|>" + role), S/E the im_start/im_end ids and
IGN the loss-ignore id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import repeat_int
from ..functions.rows import computed_once
from ..functions.tokens import IGNORE_INDEX, CodepointTokenizer, int_array

# Default system message, chat roles and ChatML markers.
SYSTEM_MESSAGE = "You are a helpful assistant."
USER = "user"
ASSISTANT = "assistant"
SYSTEM = "system"
IM_START_TEXT = "<|im_start|>"
IM_END_TEXT = "<|im_end|>"

UNKNOWN_ROLE_POLICIES = ("error", "drop_conversation", "drop_turn")


def system_segment(tok=CodepointTokenizer(), system_message: str = SYSTEM_MESSAGE) -> tuple[list[int], list[int]]:
    nl = tok.encode_const("\n")
    ids = [tok.im_start_id] + tok.encode_const("system") + nl + tok.encode_const(system_message) + [tok.im_end_id] + nl
    labels = [tok.im_start_id] + [IGNORE_INDEX] * (len(ids) - 3) + [tok.im_end_id] + nl
    return ids, labels


def system_text(system_message: str = SYSTEM_MESSAGE) -> str:
    return f"{IM_START_TEXT}system\n{system_message}{IM_END_TEXT}\n"


def segment_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(IM_START_TEXT), role, F.lit("\n"), text, F.lit(IM_END_TEXT + "\n"))


def user_segment(text_ids: Column, tok=CodepointTokenizer()) -> tuple[Column, Column]:
    nl = tok.encode_const("\n")
    ids = F.concat(int_array(tok.role_ids(USER) + nl), text_ids, int_array([tok.im_end_id] + nl))
    labels = F.concat(
        int_array([tok.im_start_id]),
        repeat_int(IGNORE_INDEX, F.size(ids) - 3),
        int_array([tok.im_end_id] + nl),
    )
    return ids, labels


def assistant_segment(text_ids: Column, tok=CodepointTokenizer()) -> tuple[Column, Column]:
    nl = tok.encode_const("\n")
    role = tok.role_ids(ASSISTANT)
    ids = F.concat(int_array(role + nl), text_ids, int_array([tok.im_end_id] + nl))
    labels = F.concat(
        int_array([tok.im_start_id] + [IGNORE_INDEX] * len(role)),
        text_ids,
        int_array([tok.im_end_id] + nl),
    )
    return ids, labels


def drop_leading_nonuser(conversations: DataFrame, unknown_role: str = "drop_conversation", own_system: bool = False) -> DataFrame:
    """Drop one leading assistant message; apply a policy to other roles.

    Only `user` and `assistant` are chat roles.  A conversation holding any
    other role (for example a leading `system` message) is an error in the
    source semantics; `unknown_role` chooses: raise at run time, drop the
    conversation, or drop only those turns.

    With `own_system`, a conversation's first turn of role `system` is not an
    unknown role: its text is the conversation's system message, in a further
    column `system` (null: the default message) that `encode_turns` passes on
    and the renderers read.  A conversation of a system turn alone has no turns.
    """
    if unknown_role not in UNKNOWN_ROLE_POLICIES:
        raise ValueError(f"unknown_role must be one of {UNKNOWN_ROLE_POLICIES}")
    known = F.col("role").isin(USER, ASSISTANT)
    df = conversations
    kept = ["conv_id", "turn", "role", "text"]
    if own_system:
        first = F.min("turn").over(Window.partitionBy("conv_id"))
        leads = (F.col("turn") == F.col("_first")) & (F.col("role") == SYSTEM)
        df = df.withColumn("_first", first).withColumn("_lead", F.coalesce(leads, F.lit(False)))
        message = F.coalesce(F.col("text"), F.lit(""))
        df = df.withColumn("system", F.max(F.when(F.col("_lead"), message)).over(Window.partitionBy("conv_id"))).where(~F.col("_lead"))
        kept.append("system")
    if unknown_role == "drop_turn":
        df = df.where(known)
    w = Window.partitionBy("conv_id")
    df = df.withColumn("_first", F.min("turn").over(w)).withColumn(
        "_n_unknown", F.sum(F.when(known, 0).otherwise(1)).over(w)
    )
    if unknown_role == "error":
        check = F.when(
            F.col("_n_unknown") > 0,
            F.raise_error(F.concat(F.lit("conversation with a role other than user/assistant: "), F.col("conv_id").cast("string"))),
        )
        df = df.where(check.isNull())
    elif unknown_role == "drop_conversation":
        df = df.where(F.col("_n_unknown") == 0)
    lead = (F.col("turn") == F.col("_first")) & (F.col("role") != USER)
    return df.where(~lead).select(*kept)


ON_NULL_TEXT = ("error", "empty")


def encode_turns(conversations: DataFrame, tok=CodepointTokenizer(), on_null: str = "error") -> DataFrame:
    """Per turn: ChatML segment text, ids and labels (input already normalised).

    A turn whose text is null fails the job (`on_null="error"`, as in the
    source) or counts as empty; it never drops out of the later prompts.
    """
    if on_null not in ON_NULL_TEXT:
        raise ValueError(f"on_null must be one of {ON_NULL_TEXT}")
    missing = F.raise_error(F.concat(F.lit("turn without text in conversation "), F.col("conv_id").cast("string"))).cast("string")
    text = F.coalesce(F.col("text"), F.lit("") if on_null == "empty" else missing)
    more = [c for c in ("system",) if c in conversations.columns]
    x = conversations.select("conv_id", "turn", "role", *more, computed_once(text.alias("text")))
    x = x.select("*", tok.encode(F.col("text")).alias("_x"))
    u_ids, u_lab = user_segment(F.col("_x"), tok)
    a_ids, a_lab = assistant_segment(F.col("_x"), tok)
    is_user = F.col("role") == USER
    return x.select(
        "conv_id",
        "turn",
        "role",
        segment_text(F.col("role"), F.col("text")).alias("seg_text"),
        F.when(is_user, u_ids).otherwise(a_ids).alias("ids"),
        F.when(is_user, u_lab).otherwise(a_lab).alias("labels"),
        *more,
    )


def _system_parts(system: Column | None, tok, system_message: str) -> tuple[Column, Column, Column]:
    """Text, ids and labels of the system segment; `system` is a conversation's own message or null."""
    ids, labels = system_segment(tok, system_message)
    text, ids, labels = F.lit(system_text(system_message)), int_array(ids), int_array(labels)
    if system is None:
        return text, ids, labels
    nl = tok.encode_const("\n")
    own = F.concat(int_array([tok.im_start_id] + tok.encode_const(SYSTEM) + nl), tok.encode(system), int_array([tok.im_end_id] + nl))
    own_labels = F.concat(int_array([tok.im_start_id]), repeat_int(IGNORE_INDEX, F.size(own) - 3), int_array([tok.im_end_id] + nl))
    return (
        F.when(system.isNull(), text).otherwise(segment_text(F.lit(SYSTEM), system)),
        F.when(system.isNull(), ids).otherwise(own),
        F.when(system.isNull(), labels).otherwise(own_labels),
    )


def _whole(turns: DataFrame, tok, system_message: str) -> DataFrame:
    """One row per conversation: `segs` (turns in order, with lengths), whole text, ids and labels."""
    own = "system" in turns.columns
    more = [F.max("system").alias("_system")] if own else []
    seg = F.struct("turn", "role", "seg_text", "ids", "labels")
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segs"), *more)
    text, ids, labels = _system_parts(F.col("_system") if own else None, tok, system_message)
    return g.select(
        "conv_id",
        F.transform(
            "segs", lambda s: F.struct(s["turn"].alias("turn"), s["role"].alias("role"), F.size(s["ids"]).alias("n_ids"), F.length(s["seg_text"]).alias("n_chars"))
        ).alias("segs"),
        F.length(text).alias("_chars"),
        F.size(ids).alias("_ids"),
        F.concat(text, F.array_join(F.transform("segs", lambda s: s["seg_text"]), "")).alias("text"),
        F.concat(ids, F.flatten(F.transform("segs", lambda s: s["ids"]))).alias("input_ids"),
        F.concat(labels, F.flatten(F.transform("segs", lambda s: s["labels"]))).alias("labels"),
    )


def turn_prompts(turns: DataFrame, tok=CodepointTokenizer(), system_message: str = SYSTEM_MESSAGE) -> DataFrame:
    """Each user turn's prompt: system + every segment up to and including it.

    A conversation's text and arrays are built once; a prompt is their
    beginning, up to the end of its turn.
    """
    whole = _whole(turns, tok, system_message)
    start = F.struct(F.col("_ids").alias("n_ids"), F.col("_chars").alias("n_chars"), F.array().cast("array<struct<turn:bigint,n_ids:int,n_chars:int>>").alias("ends"))

    def step(a: Column, s: Column) -> Column:
        n_ids, n_chars = a["n_ids"] + s["n_ids"], a["n_chars"] + s["n_chars"]
        end = F.struct(s["turn"].cast("bigint").alias("turn"), n_ids.alias("n_ids"), n_chars.alias("n_chars"))
        ends = F.when(s["role"] == USER, F.array_append(a["ends"], end)).otherwise(a["ends"])
        return F.struct(n_ids.alias("n_ids"), n_chars.alias("n_chars"), ends.alias("ends"))

    ends = F.aggregate("segs", start, step)["ends"]
    at = whole.select("conv_id", "text", "input_ids", "labels", F.explode(ends).alias("e"))
    prompts = at.select(
        "conv_id",
        F.col("e.turn").cast(turns.schema["turn"].dataType).alias("turn"),
        F.substring("text", F.lit(1), F.col("e.n_chars")).alias("prompt_text"),
        F.slice("input_ids", F.lit(1), F.col("e.n_ids")).alias("input_ids"),
        F.slice("labels", F.lit(1), F.col("e.n_ids")).alias("labels"),
    )
    return prompts.withColumn("attention_mask", attention_mask(F.col("input_ids"), tok.pad_token_id, tok.eos_token_id))


def turn_answers(turns: DataFrame, tok=CodepointTokenizer()) -> DataFrame:
    """Each assistant turn's own segment as an answer."""
    answers = turns.where(F.col("role") == ASSISTANT).select("conv_id", "turn", F.col("ids").alias("input_ids"), "labels")
    return answers.withColumn("attention_mask", attention_mask(F.col("input_ids"), tok.pad_token_id, tok.eos_token_id))


def attention_mask(ids: Column, pad_id: int, eos_id: int) -> Column:
    """0 at padding and at every EOS, else 1."""
    plain = ~F.array_contains(ids, F.lit(pad_id)) & ~F.array_contains(ids, F.lit(eos_id))
    each = F.transform(ids, lambda x: F.when((x == F.lit(pad_id)) | (x == F.lit(eos_id)), 0).otherwise(1)).cast("array<int>")
    return F.when(plain, repeat_int(1, F.size(ids))).otherwise(each)


def conversation_report(conversations: DataFrame) -> DataFrame:
    """What `drop_leading_nonuser` does to each conversation: turns in all, by kind, and rendered.

    `n_other` turns have a role other than user and assistant; `n_leading` is
    the assistant turn dropped at the front once those are gone.
    """
    known = F.col("role").isin(USER, ASSISTANT)
    per = conversations.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sum(F.when(F.col("role") == USER, 1).otherwise(0)).alias("n_user"),
        F.sum(F.when(F.col("role") == ASSISTANT, 1).otherwise(0)).alias("n_assistant"),
        F.sum(F.when(known, 0).otherwise(1)).alias("n_other"),
        F.sum(F.when(F.col("text").isNull(), 1).otherwise(0)).alias("n_null_text"),
        F.min(F.when(known, F.col("turn"))).alias("_first"),
        F.min(F.when(F.col("role") == USER, F.col("turn"))).alias("_user"),
    )
    leading = F.when(F.col("_first").isNotNull() & ((F.col("_user") > F.col("_first")) | F.col("_user").isNull()), 1).otherwise(0)
    per = per.withColumn("n_leading", leading.cast("bigint"))
    return per.withColumn("n_rendered", F.col("n_user") + F.col("n_assistant") - F.col("n_leading")).drop("_first", "_user")


def chatml_render(turns: DataFrame, tok=CodepointTokenizer(), system_message: str = SYSTEM_MESSAGE) -> DataFrame:
    """One row per conversation: full ChatML text, ids and labels."""
    whole = _whole(turns, tok, system_message)
    return whole.select("conv_id", F.size("segs").cast("bigint").alias("n_turns"), "text", "input_ids", "labels")


def make_conversations(pairs: DataFrame) -> DataFrame:
    """Two-turn conversations (user prompt, assistant answer) for both sides of a pair."""

    def conv(answer: str) -> Column:
        return F.array(
            F.struct(F.lit(USER).alias("from"), F.col("prompt").alias("value")),
            F.struct(F.lit(ASSISTANT).alias("from"), F.col(answer).alias("value")),
        )

    return pairs.select(
        "prompt_id", "comp_i", "comp_j", conv("chosen").alias("chosen_conv"), conv("rejected").alias("rejected_conv")
    )
