"""The registered queries: one builder per operator, `(spark, sf_dir) -> DataFrame`.

Every query reads the given tables (through the fixtures) and runs over
whole tables.  Array outputs are reported as lengths plus an md5 of the
comma-joined ids, an exact fingerprint that DuckDB computes the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import digest
from ..functions.ratings import class_of_normalized, normalize_rating
from ..operators import annotate, batches, chatml, content_groups, dealt_pairs, encode, growing_split, judge_loop, long_ratings, pairs, prompts, sampling, split
from ..sources import fixtures as fx
from ..session import scratch_path
from ..sources import jsonl, preferences, schemas
from ..streaming import flat_pairs, pairs_stream

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["prompt_id", "comp_i", "comp_j"]


# ------------------------------------------------------------ pairs (G, R, F)


def q_build_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.build_pairs(fx.fline_prompts(spark, d))


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The fixture as the written table that a job would read."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def q_build_pairs_join(spark: SparkSession, d: str) -> DataFrame:
    return pairs.build_pairs_join(_stored(spark, fx.fline_completions(spark, d), "completions"))


def _long_layout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """F-LINE as two stored tables: completions without ratings, and ratings as rows."""
    flat = fx.fline_completions(spark, d)
    ratings = _stored(spark, long_ratings.to_long_ratings(flat), "ratings")
    return _stored(spark, flat.drop("annotations"), "completions"), ratings


def q_completion_scores_long(spark: SparkSession, d: str) -> DataFrame:
    return long_ratings.completion_scores_long(*_long_layout(spark, d))


def q_build_pairs_long(spark: SparkSession, d: str) -> DataFrame:
    return pairs.build_pairs_join(long_ratings.scored_completions_long(*_long_layout(spark, d)), score="score")


DEALT_ROWS = 3  # F-LINE's prompts have up to 17 completions: blocks so small that they are dealt


def q_build_pairs_dealt(spark: SparkSession, d: str) -> DataFrame:
    return dealt_pairs.build_pairs_dealt(_stored(spark, fx.fline_completions(spark, d), "completions"), block_rows=DEALT_ROWS)


def q_build_pairs_text(spark: SparkSession, d: str) -> DataFrame:
    return pairs.build_pairs(fx.ftext_prompts(spark, d))


def q_pair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_outcomes(fx.fline_prompts(spark, d))


def q_completion_scores(spark: SparkSession, d: str) -> DataFrame:
    return pairs.completion_scores(fx.fline_prompts(spark, d))


def _flat_annotations(df: DataFrame) -> DataFrame:
    return df.select(
        "prompt_id",
        "comp_idx",
        "model",
        "response",
        F.array_join(F.map_keys("annotations"), "|").alias("aspects"),
        F.array_join(F.transform(F.map_values("annotations"), lambda v: v["Rating"]), "|").alias("ratings"),
    )


def q_unnest_completions(spark: SparkSession, d: str) -> DataFrame:
    return _flat_annotations(pairs.unnest_completions(fx.fline_prompts(spark, d)))


def q_rating_quality(spark: SparkSession, d: str) -> DataFrame:
    e = fx.fline_completions(spark, d).select(F.explode("annotations").alias("aspect", "a"))
    # normalise once (its own projection), then classify from that column
    n = e.select("aspect", F.col("a.Rating").alias("r"), normalize_rating(F.col("a.Rating")).alias("t"))
    c = n.select("aspect", class_of_normalized(F.col("r"), F.col("t")).alias("rating_class"))
    return c.groupBy("aspect", "rating_class").agg(F.count("*").cast("bigint").alias("n_ratings"))


def q_rating_domain_check(spark: SparkSession, d: str) -> DataFrame:
    return annotate.rating_domain_check(fx.fline_completions(spark, d))


# ------------------------------------------------------------ prompts (P)


def q_format_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = fx.ftext_completions(spark, d).select("prompt_id", "prompt", "img_path").distinct()
    return prompts.format_prompts(p).select("prompt_id", "prompt")


def _text_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.build_pairs(fx.ftext_prompts(spark, d))


def q_make_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = chatml.make_conversations(_text_pairs(spark, d))
    sides = [
        c.select(*KEYS, F.lit(side).alias("side"), F.posexplode(f"{side}_conv").alias("turn", "m"))
        for side in ("chosen", "rejected")
    ]
    long = sides[0].unionByName(sides[1])
    return long.select(*KEYS, "side", F.col("turn").cast("bigint").alias("turn"), F.col("m.from").alias("role"), F.col("m.value").alias("value"))


def q_full_texts(spark: SparkSession, d: str) -> DataFrame:
    return prompts.full_texts(_text_pairs(spark, d))


# ------------------------------------------------------------ sources and splits (S)


def q_split_exact(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.build_pairs(fx.fline_prompts(spark, d)).select(*KEYS)
    return split.split_exact(p, tuple(KEYS))


def q_split_growing(spark: SparkSession, d: str) -> DataFrame:
    """F-LINE's pairs appended in three parts; the split of the whole from the stored counts."""
    p = _stored(spark, pairs.build_pairs(fx.fline_prompts(spark, d)).select(*KEYS), "pair-keys")
    state = growing_split.GrowingSplit(spark, scratch_path(spark, "split-state"), tuple(KEYS))
    for k in range(3):
        state.append(p.where(F.pmod("prompt_id", F.lit(3)) == k), f"p{k}")
    return state.label(p)


CONTENT_TEST_SIZE = 0.2


def q_split_by_content(spark: SparkSession, d: str) -> DataFrame:
    """F-TEXT's pairs, where every fifth prompt text stands under several ids and three ids share an image."""
    p = fx.ftext_prompts(spark, d)
    k = F.col("prompt_id")
    own = F.concat(F.col("prompt"), F.lit(" #"), k.cast("string"))
    shared = p.select(k, F.when(k % 5 == 0, F.col("prompt")).otherwise(own).alias("prompt"), F.expr("prompt_id div 3").cast("string").alias("img_path"))
    keys = pairs.build_pairs(p).select(*KEYS)
    return content_groups.split_by_content(keys, _stored(spark, shared, "prompts"), test_size=CONTENT_TEST_SIZE)


def q_split_by_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.build_pairs(fx.fline_prompts(spark, d)).select(*KEYS)
    return split.split_by_prompt(p)


def q_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    src = fx.ftext_prompts(spark, d).select(*[f.name for f in schemas.PROMPT_ROW.fields])
    jsonl.write_jsonl(src, path)
    back = jsonl.read_jsonl(spark, path, schemas.PROMPT_ROW, on_bad="error")
    return _flat_annotations(pairs.unnest_completions(back))


def q_jsonl_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Whole F-TEXT as JSON lines, some broken by prompt id, read back strictly: good and bad lines counted."""
    src = fx.ftext_prompts(spark, d).select(*[f.name for f in schemas.PROMPT_ROW.fields])
    line, k = F.col("line"), F.col("prompt_id") % 7
    broken = (
        F.when(k == 1, F.concat(line, line))
        .when(k == 2, F.concat(line, F.lit(" junk")))
        .when(k == 3, F.translate(line, '"', "'"))
        .when(k == 4, F.expr("substr(line, 1, length(line) - 1)"))
        .when(k == 5, F.lit("  "))
        .otherwise(line)
    )
    path = scratch_path(spark, "jsonl-broken")
    src.select("prompt_id", F.to_json(F.struct(*src.columns)).alias("line")).select(broken.alias("value")).write.text(path)
    good = jsonl.read_jsonl(spark, path, schemas.PROMPT_ROW, on_bad="quarantine").select("prompt_id", F.lit("ok").alias("reason"))
    bad = jsonl.read_jsonl_quarantine(spark, path, schemas.PROMPT_ROW).select(F.lit(None).cast("bigint").alias("prompt_id"), "reason")
    return good.unionByName(bad).groupBy("reason").agg(F.count("*").alias("n_lines"), F.coalesce(F.sum("prompt_id"), F.lit(0)).alias("id_sum"))


def q_preference_table(spark: SparkSession, d: str) -> DataFrame:
    """F-TEXT written and read back in both layouts."""
    src = fx.ftext_prompts(spark, d).select(*[f.name for f in schemas.PROMPT_ROW.fields])
    out = []
    for layout, df in (("nested", src), ("parallel", schemas.to_parallel_lists(src))):
        path = scratch_path(spark, f"preferences-{layout}")
        preferences.write_table(df, path)
        back = preferences.read_preference_table(spark, path, layout=layout)
        out.append(_flat_annotations(pairs.unnest_completions(back)).withColumn("layout", F.lit(layout)))
    return out[0].unionByName(out[1])


def q_split_without_ids(spark: SparkSession, d: str) -> DataFrame:
    """A table without ids and with every third row twice: reader, pairs in both forms, exact split, counted."""
    src = fx.ftext_prompts(spark, d)
    twice = src.unionByName(src.where("prompt_id % 3 = 0")).select("prompt", "img_path", "completions")
    path = scratch_path(spark, "no-ids")
    preferences.write_table(twice, path)
    # the derived ids shuffle whole rows: stored once, not derived again by every pass of the splits
    prompts_ = _stored(spark, preferences.read_preference_table(spark, path, ids="derive"), "with-ids")
    nested = pairs.build_pairs(prompts_)
    flat = pairs.build_pairs_join(pairs.unnest_completions(prompts_))
    parts = []
    for form, df in (("nested", nested), ("flat", flat)):  # the ids are hashes, so SQL checks the counts and lengths
        s = split.split_exact(df, tuple(KEYS))
        chars = F.sum(F.length("prompt") + F.length("chosen") + 2 * F.length("rejected"))
        parts.append(s.groupBy("split").agg(F.count("*").alias("n_pairs"), chars.alias("n_chars")).withColumn("form", F.lit(form)))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("form").agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum(F.when(F.col("split") == "test", F.col("n_pairs")).otherwise(0)).alias("n_test"), F.sum("n_chars").alias("n_chars")
    )


# ------------------------------------------------------------ conversations (E1-E4)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    conv = chatml.drop_leading_nonuser(fx.conversations(spark, d), unknown_role="drop_turn")
    return chatml.encode_turns(conv)


def _own_system_turns(spark: SparkSession, d: str) -> DataFrame:
    """All turns: a leading system turn is its conversation's system message."""
    conv = chatml.drop_leading_nonuser(fx.conversations(spark, d), unknown_role="drop_turn", own_system=True)
    return chatml.encode_turns(conv)


def q_chatml_render_system(spark: SparkSession, d: str) -> DataFrame:
    return _render_report(chatml.chatml_render(_own_system_turns(spark, d)))


def q_turn_prompts_system(spark: SparkSession, d: str) -> DataFrame:
    return _prompt_report(chatml.turn_prompts(_own_system_turns(spark, d)))


def q_drop_leading_nonuser(spark: SparkSession, d: str) -> DataFrame:
    return chatml.drop_leading_nonuser(fx.conversations(spark, d), unknown_role="drop_turn")


def q_conversation_report(spark: SparkSession, d: str) -> DataFrame:
    return chatml.conversation_report(fx.conversations(spark, d))


def _render_report(r: DataFrame) -> DataFrame:
    return r.select(
        "conv_id",
        "n_turns",
        "text",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
    )


def q_chatml_render(spark: SparkSession, d: str) -> DataFrame:
    return _render_report(chatml.chatml_render(_turns(spark, d)))


def _prompt_report(t: DataFrame) -> DataFrame:
    return t.select(
        "conv_id",
        "turn",
        "prompt_text",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
        digest(F.col("attention_mask")).alias("mask_md5"),
    )


def q_turn_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _prompt_report(chatml.turn_prompts(_turns(spark, d)))


def q_turn_answers(spark: SparkSession, d: str) -> DataFrame:
    t = chatml.turn_answers(_turns(spark, d))
    return t.select(
        "conv_id",
        "turn",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
        digest(F.col("attention_mask")).alias("mask_md5"),
    )


def q_encode_labels(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return t.select(
        "conv_id",
        "turn",
        "role",
        F.size("ids").cast("bigint").alias("n_ids"),
        digest(F.col("ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
        F.size(F.filter("labels", lambda x: x == F.lit(-100))).cast("bigint").alias("n_ignored"),
    )


# ------------------------------------------------------------ pair encoding (E5-E12)


def _pairs_ids(spark: SparkSession, d: str) -> DataFrame:
    """F-TEXT pairs carrying token ids (each text tokenized once, before pairing)."""
    return encode.pairs_with_ids(fx.ftext_prompts(spark, d))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_pairs(_pairs_ids(spark, d))


SEQS = [f"{s}_{k}" for s in ("prompt", "chosen", "rejected") for k in ("input_ids", "labels", "attention_mask")]


def _encoded_report(e: DataFrame) -> DataFrame:
    return e.select(
        *KEYS,
        *[F.size(c).cast("bigint").alias(f"{c}_len") for c in SEQS if c.endswith("input_ids")],
        *[digest(F.col(c)).alias(f"{c}_md5") for c in SEQS],
        F.md5("chosen").alias("chosen_md5"),
        F.md5("rejected").alias("rejected_md5"),
    )


def q_encode_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _encoded_report(_encoded(spark, d))


def q_stream_encode_pairs(spark: SparkSession, d: str) -> DataFrame:
    # each micro-batch encodes its prompt rows and lands the same report as
    # `encode_pairs` (lengths and fingerprints, not the raw id arrays)
    return pairs_stream.pairs_via_stream(
        spark, fx.ftext_prompts(spark, d), transform=lambda b: _encoded_report(encode.encode_prompt_rows(b))
    )


STREAM_SLICES = 5  # hours of F-LINE's arrival


def q_stream_pairs_flat(spark: SparkSession, d: str) -> DataFrame:
    """F-LINE's completions as a stream: every second one of a prompt comes an hour after its partners."""
    hour = F.pmod(F.xxhash64("prompt_id"), F.lit(STREAM_SLICES - 1)) + F.col("comp_idx") % 2
    flat = fx.fline_completions(spark, d).withColumn("event_time", F.timestamp_seconds(3600 * (1 + hour) + F.col("comp_idx")))
    flat = _stored(spark, flat, "completions")
    slice_of = F.floor(F.unix_timestamp("event_time") / 3600) - 1
    return flat_pairs.flat_pairs_via_stream(spark, flat, STREAM_SLICES, slice_of, within="2 hours", delay="1 hour")


def q_encode_masks(spark: SparkSession, d: str) -> DataFrame:
    e = _encoded(spark, d)
    masks = [c for c in SEQS if c.endswith("attention_mask")]
    return e.select(
        *KEYS,
        *[digest(F.col(c)).alias(f"{c}_md5") for c in masks],
        *[F.size(F.filter(c, lambda x: x == 0)).cast("bigint").alias(f"{c}_zeros") for c in masks],
    )


def q_truncate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return encode.truncate_pairs(_pairs_ids(spark, d))


def q_length_report(spark: SparkSession, d: str) -> DataFrame:
    return encode.length_report(_pairs_ids(spark, d))


PAD_BATCH_SIZE = 8


def padded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Batches of the encoded pairs as the job stores them: ranking reads the table, not the encoder, again."""
    return batches.pad_batches(_stored(spark, batches.with_lengths(_encoded(spark, d)), "encoded"), batch_size=PAD_BATCH_SIZE)


def q_pad_batches(spark: SparkSession, d: str) -> DataFrame:
    p = padded_pairs(spark, d)
    return p.select(
        *KEYS,
        "batch",
        "prompt_width",
        "chosen_width",
        "rejected_width",
        *[digest(F.col(c)).alias(f"{c}_md5") for c in SEQS],
    )


# ------------------------------------------------------------ annotation (A)


def q_annotation_prompts(spark: SparkSession, d: str) -> DataFrame:
    return annotate.annotation_prompts(fx.ftext_prompts(spark, d))


def q_parse_annotations(spark: SparkSession, d: str) -> DataFrame:
    answers = annotate.render_answers(fx.ftext_prompts(spark, d))
    return annotate.parse_annotations(answers)


def q_parse_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Every expected and found block of F-TEXT's answers, damaged by prompt id, with its status."""
    a = annotate.render_answers(fx.ftext_prompts(spark, d))
    k, t = F.col("prompt_id") % 8, F.col("answer")
    damaged = (
        F.when(k == 1, F.lit(None).cast("string"))
        .when(k == 2, F.regexp_replace(t, "Output for Text 2", "Output for Text 9"))
        .when(k == 3, F.regexp_replace(t, "(?m)^Rating: ", "Score: "))
        .when(k == 4, F.regexp_replace(t, "#### Helpfulness", "#### Foo"))
        .when(k == 5, F.concat(t, F.lit("\n"), t))
        .when(k == 6, F.regexp_replace(t, "Output for Text 3", "Output for Text 33333333333333333333"))
        .otherwise(t)
    )
    return annotate.parse_answers(a.withColumn("answer", damaged)).select("prompt_id", "group_idx", "text_idx", "aspect", "status")


def q_judge_loop_pairs(spark: SparkSession, d: str) -> DataFrame:
    """F-LINE's ratings written as judge answers, parsed, put back into their completions and paired."""
    p = _stored(spark, fx.fline_prompts(spark, d), "prompts")
    answers = _stored(spark, annotate.render_answers(p, absent="omit"), "answers")
    return pairs.build_pairs(judge_loop.rejoin_answers(p, answers))


def q_judge_loop_report(spark: SparkSession, d: str) -> DataFrame:
    """The accounts of F-LINE's answers, damaged by prompt id."""
    p = _stored(spark, fx.fline_prompts(spark, d), "prompts")
    k = F.col("prompt_id") % 5
    a = annotate.render_answers(p, absent="omit").where(k != 0)
    text = F.when(k == 2, F.regexp_replace("answer", "#### Helpfulness", "#### Foo")).when(k != 1, F.col("answer"))
    a = a.select(F.when(k == 3, -F.col("prompt_id")).otherwise(F.col("prompt_id")).alias("prompt_id"), "group_idx", "n_texts", text.alias("answer"))
    return judge_loop.judge_loop_report(p, _stored(spark, a, "answers"))


def q_annotation_prompts_line(spark: SparkSession, d: str) -> DataFrame:
    """F-LINE prompts hold up to 17 responses: each of them reaches a judge prompt."""
    p = annotate.annotation_prompts(fx.fline_prompts(spark, d))
    return p.select("prompt_id", "group_idx", "n_texts", F.md5("annotation_prompt").alias("prompt_md5"))


SAMPLE_MODELS_K = 4
SAMPLE_DOMAIN_K = 5


def q_sample_models(spark: SparkSession, d: str) -> DataFrame:
    s = sampling.sample_models(fx.fline_completions(spark, d).select("prompt_id", "comp_idx", "model"), SAMPLE_MODELS_K)
    return s.select("prompt_id", "comp_idx", "model", "rank")


def q_sample_by_domain(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_table

    docs = read_table(spark, d, "documents", "doc_id", "source")
    return sampling.sample_by_domain(docs, SAMPLE_DOMAIN_K).select("source", "doc_id", "rank")


# ------------------------------------------------------------ streaming


def q_stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs_stream.pairs_via_stream(spark, fx.fline_prompts(spark, d))


QUERIES: dict[str, Query] = {
    "build_pairs": q_build_pairs,
    "build_pairs_join": q_build_pairs_join,
    "build_pairs_dealt": q_build_pairs_dealt,
    "build_pairs_long": q_build_pairs_long,
    "completion_scores_long": q_completion_scores_long,
    "build_pairs_text": q_build_pairs_text,
    "pair_outcomes": q_pair_outcomes,
    "completion_scores": q_completion_scores,
    "unnest_completions": q_unnest_completions,
    "rating_quality": q_rating_quality,
    "rating_domain_check": q_rating_domain_check,
    "format_prompts": q_format_prompts,
    "make_conversations": q_make_conversations,
    "full_texts": q_full_texts,
    "split_exact": q_split_exact,
    "split_growing": q_split_growing,
    "split_by_content": q_split_by_content,
    "split_by_prompt": q_split_by_prompt,
    "jsonl_roundtrip": q_jsonl_roundtrip,
    "jsonl_quarantine": q_jsonl_quarantine,
    "preference_table": q_preference_table,
    "split_without_ids": q_split_without_ids,
    "conversation_report": q_conversation_report,
    "drop_leading_nonuser": q_drop_leading_nonuser,
    "chatml_render": q_chatml_render,
    "chatml_render_system": q_chatml_render_system,
    "turn_prompts": q_turn_prompts,
    "turn_prompts_system": q_turn_prompts_system,
    "turn_answers": q_turn_answers,
    "encode_labels": q_encode_labels,
    "encode_pairs": q_encode_pairs,
    "encode_masks": q_encode_masks,
    "truncate_pairs": q_truncate_pairs,
    "length_report": q_length_report,
    "pad_batches": q_pad_batches,
    "annotation_prompts": q_annotation_prompts,
    "annotation_prompts_line": q_annotation_prompts_line,
    "parse_annotations": q_parse_annotations,
    "parse_quarantine": q_parse_quarantine,
    "judge_loop_pairs": q_judge_loop_pairs,
    "judge_loop_report": q_judge_loop_report,
    "sample_models": q_sample_models,
    "sample_by_domain": q_sample_by_domain,
    "stream_pairs": q_stream_pairs,
    "stream_encode_pairs": q_stream_encode_pairs,
    "stream_pairs_flat": q_stream_pairs_flat,
}
