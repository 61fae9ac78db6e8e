"""Pair encoding: prompt / chosen / rejected ids, labels and attention masks.

One narrow stage per pair (no shuffle): the prompt is encoded as
system + user segment, each response as an assistant segment; EOS is
appended to the responses, the pair is fitted into `max_length` (the
prompt first, then both responses) and the prompt is prefixed to each
response with its labels masked.  Written to parquet once instead of being
recomputed by a data collator every epoch.

Two entry points:

* `encode_pairs(pairs)`: pairs of texts, tokenized per pair (the
  collator's signature).
* `encode_prompt_rows(prompts)`: nested prompt rows.  Each prompt and each
  completion is tokenized once, before pairing, and the ids travel with
  the pair; a completion that sits in k pairs is not tokenized k times.

Attention masks are elementwise, so they are computed after truncation on
the kept ids only; the appended EOS keeps mask 1 as in the source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import head, repeat_int, tail
from ..functions.tokens import IGNORE_INDEX, CodepointTokenizer, int_array
from .chatml import SYSTEM_MESSAGE, assistant_segment, system_segment, user_segment
from .pairs import build_pairs, fields_of, formatted_prompt

TRUNCATION_MODES = ("keep_end", "keep_start")
SEQ_KEYS = ("input_ids", "labels", "attention_mask")
KEY_COLS = ("prompt_id", "comp_i", "comp_j")


@dataclass(frozen=True)
class EncodeConfig:
    # The example configuration's sequence budget and the
    # collator settings (prompt budget = half, keep the prompt's end).
    max_length: int = 2048
    max_prompt_length: int = 1024
    truncation_mode: str = "keep_end"
    label_pad_token_id: int = IGNORE_INDEX
    system_message: str = SYSTEM_MESSAGE

    @staticmethod
    def for_model_max_length(n: int) -> "EncodeConfig":
        return EncodeConfig(max_length=n, max_prompt_length=n // 2)


def tokenize_prompt_rows(
    prompts: DataFrame, tok=CodepointTokenizer(), *, format_prompt: bool = True
) -> DataFrame:
    """Nested rows with `prompt_x` and a token array `x` inside every completion."""
    fp = formatted_prompt("prompt", "img_path", format_prompt)
    needed = fields_of(F.col("completions"), "response", "annotations")

    def completion(c: Column, x: Column) -> Column:
        return F.struct(
            c["response"].alias("response"),
            c["annotations"].alias("annotations"),
            F.when(c["response"].isNotNull(), x).alias("x"),
        )

    if isinstance(tok, CodepointTokenizer):
        # native: tokenize inside the per-completion transform
        rows = prompts.select(
            "prompt_id",
            fp.alias("prompt"),
            F.transform(needed, lambda c: completion(c, tok.encode(c["response"]))).alias("completions"),
        )
    else:
        # Python tokenizer: one UDF call per row for all its responses (one
        # Arrow batch per call), zipped back outside the lambda (a column
        # referenced inside a lambda may be inlined there and then evaluated
        # once per element)
        xs = prompts.select(
            "prompt_id",
            fp.alias("prompt"),
            needed.alias("completions"),
            tok.encode_many(F.col("completions.response")).alias("_xs"),
        )
        rows = xs.select(
            "prompt_id",
            "prompt",
            F.transform(
                F.arrays_zip(F.col("completions"), F.col("_xs")),
                lambda z: completion(z["completions"], z["_xs"]),
            ).alias("completions"),
        )
    return rows.withColumn("prompt_x", tok.encode(F.col("prompt")))


def _mask(ids: Column, pad: int, eos: int, keep_one_at: Column | None = None) -> Column:
    """1 unless the id is padding or EOS; position `keep_one_at` (0-based) stays 1."""

    def rule(x: Column, i: Column) -> Column:
        m = F.when((x == F.lit(pad)) | (x == F.lit(eos)), 0).otherwise(1)
        return m if keep_one_at is None else F.when(i == keep_one_at, 1).otherwise(m)

    # the usual case, no such id before the kept EOS, needs no per-id rule
    body = ids if keep_one_at is None else F.slice(ids, 1, F.greatest(keep_one_at, F.lit(0)))
    plain = ~F.array_contains(body, F.lit(pad)) & ~F.array_contains(body, F.lit(eos))
    return F.when(plain, repeat_int(1, F.size(ids))).otherwise(F.transform(ids, rule).cast("array<int>"))


def _encoded_parts(pairs: DataFrame, tok, cfg: EncodeConfig) -> DataFrame:
    """Untruncated segments plus lengths; keeps the key and text columns."""
    if cfg.truncation_mode not in TRUNCATION_MODES:
        raise ValueError(f"truncation_mode must be one of {TRUNCATION_MODES}, not {cfg.truncation_mode!r}")
    if cfg.max_prompt_length > cfg.max_length:
        raise ValueError("max_prompt_length must not exceed max_length")
    sys_ids, sys_lab = system_segment(tok, cfg.system_message)
    eos = tok.eos_token_id
    keys = [c for c in KEY_COLS if c in pairs.columns]

    def ids_of(col: str) -> Column:
        return F.col(f"{col}_x") if f"{col}_x" in pairs.columns else tok.encode(F.col(col))

    x = pairs.select(
        *keys,
        "prompt",
        "chosen",
        "rejected",
        ids_of("prompt").alias("_px"),
        ids_of("chosen").alias("_cx"),
        ids_of("rejected").alias("_rx"),
    )
    # Lengths come from the full token counts; the arrays themselves are cut
    # to the budget first.  A sequence longer than `bound` tokens is always
    # truncated to at most `bound`, so the cut never changes the result, and
    # no array longer than the budget is built.  (keep_end with a prompt
    # budget of 0 keeps the whole prompt, so that prompt is not cut.)
    nl = tok.encode_const("\n")
    user_fixed = len(tok.role_ids("user")) + len(nl) + 1 + len(nl)
    asst_fixed = len(tok.role_ids("assistant")) + len(nl) + 1 + len(nl) + 1  # + EOS
    bound = max(cfg.max_length, cfg.max_prompt_length)
    keep_end = cfg.truncation_mode == "keep_end"
    if keep_end and cfg.max_prompt_length == 0:
        px = F.col("_px")
    else:
        px = tail(F.col("_px"), bound) if keep_end else head(F.col("_px"), bound)
    u_ids, u_lab = user_segment(px, tok)
    c_ids, c_lab = assistant_segment(head(F.col("_cx"), bound), tok)
    r_ids, r_lab = assistant_segment(head(F.col("_rx"), bound), tok)
    eos_arr = int_array([eos])
    return x.select(
        *keys,
        "prompt",
        "chosen",
        "rejected",
        F.concat(int_array(sys_ids), u_ids).alias("p_input_ids"),
        F.concat(int_array(sys_lab), u_lab).alias("p_labels"),
        F.concat(c_ids, eos_arr).alias("c_input_ids"),
        F.concat(c_lab, eos_arr).alias("c_labels"),
        F.concat(r_ids, eos_arr).alias("r_input_ids"),
        F.concat(r_lab, eos_arr).alias("r_labels"),
        (F.size("_px") + len(sys_ids) + user_fixed).alias("prompt_len"),
        F.greatest(F.size("_cx"), F.size("_rx")).alias("_rmax"),
    ).withColumn("response_len", F.col("_rmax") + asst_fixed).drop("_rmax")


def _truncated(parts: DataFrame, tok, cfg: EncodeConfig) -> DataFrame:
    mpl = cfg.max_prompt_length
    pad, eos = tok.pad_token_id, tok.eos_token_id
    over1 = (F.col("prompt_len") + F.col("response_len")) > cfg.max_length
    cut_prompt = (lambda a: tail(a, mpl)) if cfg.truncation_mode == "keep_end" else (lambda a: head(a, mpl))
    t = parts.select(
        "*",
        over1.alias("prompt_over"),
        *[F.when(over1, cut_prompt(F.col(f"p_{k}"))).otherwise(F.col(f"p_{k}")).alias(f"tp_{k}") for k in ("input_ids", "labels")],
        # position of the appended EOS in each response (it keeps mask 1);
        # when the response was cut, it is beyond the kept ids
        (F.size("c_input_ids") - 1).alias("c_eos_pos"),
        (F.size("r_input_ids") - 1).alias("r_eos_pos"),
    ).drop("p_input_ids", "p_labels")
    t = t.withColumn("prompt_len_after", F.size("tp_input_ids"))
    over2 = (F.col("prompt_len_after") + F.col("response_len")) > cfg.max_length
    keep = cfg.max_length - mpl
    t = t.select(
        "*",
        over2.alias("response_over"),
        *[
            F.when(over2, head(F.col(f"{s}_{k}"), keep)).otherwise(F.col(f"{s}_{k}")).alias(f"t{s}_{k}")
            for s in ("c", "r")
            for k in ("input_ids", "labels")
        ],
    ).drop(*[f"{s}_{k}" for s in ("c", "r") for k in ("input_ids", "labels")])
    return t.select(
        "*",
        _mask(F.col("tp_input_ids"), pad, eos).alias("tp_attention_mask"),
        _mask(F.col("tc_input_ids"), pad, eos, F.col("c_eos_pos")).alias("tc_attention_mask"),
        _mask(F.col("tr_input_ids"), pad, eos, F.col("r_eos_pos")).alias("tr_attention_mask"),
    )


def truncation_case(prompt_over: Column, response_over: Column) -> Column:
    return (
        F.when(response_over.isNull(), F.lit("null_text"))
        .when(response_over, F.lit("responses_truncated"))
        .when(prompt_over, F.lit("prompt_truncated"))
        .otherwise(F.lit("fits"))
    )


def _final(t: DataFrame, cfg: EncodeConfig, keys: list[str]) -> DataFrame:
    plen = F.col("prompt_len_after")
    out = []
    for side, s in (("chosen", "c"), ("rejected", "r")):
        out += [
            F.concat(F.col("tp_input_ids"), F.col(f"t{s}_input_ids")).alias(f"{side}_input_ids"),
            F.concat(repeat_int(cfg.label_pad_token_id, plen), F.col(f"t{s}_labels")).alias(f"{side}_labels"),
            F.concat(F.col("tp_attention_mask"), F.col(f"t{s}_attention_mask")).alias(f"{side}_attention_mask"),
        ]
    out += [F.col(f"tp_{k}").alias(f"prompt_{k}") for k in SEQ_KEYS]
    return t.select(
        *keys,
        *out,
        F.col("prompt"),
        F.concat(F.col("prompt"), F.col("chosen")).alias("chosen"),
        F.concat(F.col("prompt"), F.col("rejected")).alias("rejected"),
        F.col("chosen").alias("chosen_response_only"),
        F.col("rejected").alias("rejected_response_only"),
    )


def encode_pairs(pairs: DataFrame, tok=CodepointTokenizer(), cfg: EncodeConfig = EncodeConfig()) -> DataFrame:
    """Pairs -> `{prompt,chosen,rejected}_{input_ids,labels,attention_mask}` and texts.

    Uses `prompt_x` / `chosen_x` / `rejected_x` token arrays when present.
    """
    keys = [c for c in KEY_COLS if c in pairs.columns]
    return _final(_truncated(_encoded_parts(pairs, tok, cfg), tok, cfg), cfg, keys)


def pairs_with_ids(prompts: DataFrame, tok=CodepointTokenizer(), *, format_prompt: bool = True) -> DataFrame:
    """Nested prompt rows -> pairs carrying `prompt_x`, `chosen_x`, `rejected_x`."""
    pre = tokenize_prompt_rows(prompts, tok, format_prompt=format_prompt)
    return build_pairs(pre, img_path=None, format_prompt=False, carry=("x",), prompt_carry=("prompt_x",))


def encode_prompt_rows(prompts: DataFrame, tok=CodepointTokenizer(), cfg: EncodeConfig = EncodeConfig()) -> DataFrame:
    """Nested prompt rows -> encoded pairs, tokenizing every text once."""
    return encode_pairs(pairs_with_ids(prompts, tok), tok, cfg)


def truncate_pairs(pairs: DataFrame, tok=CodepointTokenizer(), cfg: EncodeConfig = EncodeConfig()) -> DataFrame:
    """Per pair: lengths before and after fitting into the budget, and the case."""
    t = _truncated(_encoded_parts(pairs, tok, cfg), tok, cfg)
    keys = [c for c in KEY_COLS if c in pairs.columns]
    return t.select(
        *keys,
        F.col("prompt_len").cast("bigint").alias("prompt_len"),
        F.col("response_len").cast("bigint").alias("response_len"),
        F.col("prompt_len_after").cast("bigint").alias("prompt_len_after"),
        F.size("tc_input_ids").cast("bigint").alias("chosen_len_after"),
        F.size("tr_input_ids").cast("bigint").alias("rejected_len_after"),
        truncation_case(F.col("prompt_over"), F.col("response_over")).alias("case"),
    )


def length_report(pairs: DataFrame, tok=CodepointTokenizer(), cfg: EncodeConfig = EncodeConfig()) -> DataFrame:
    """Rows per truncation case with the longest lengths seen."""
    t = truncate_pairs(pairs, tok, cfg)
    return t.groupBy("case").agg(
        F.count("*").cast("bigint").alias("n_pairs"),
        F.max("prompt_len").cast("bigint").alias("max_prompt_len"),
        F.max("response_len").cast("bigint").alias("max_response_len"),
        F.max(F.col("prompt_len_after") + F.greatest("chosen_len_after", "rejected_len_after"))
        .cast("bigint")
        .alias("max_total_after"),
    )
