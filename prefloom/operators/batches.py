"""Batch assignment and padding of encoded pairs.

Rows are ordered by the md5 of their pair key (ties by the key) and cut into
batches of `batch_size`; only the last batch is short.  Each batch is padded
to its own longest sequence: ids with `padding_value`, labels with
`label_pad_token_id`, masks with 0; prompt sequences are padded on the left,
responses on the right.

The order needs no global sort and no wide shuffle: narrow rows (key, hash,
three lengths) are counted per hash prefix, a prefix's offset is the running
sum of the counts before it, and a row's rank is that offset plus its place
within the prefix.  The prefix only spreads the work; its length changes no
result.  Batch numbers and widths are then attached to the arrays by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import repeat_int
from ..functions.tokens import CP_EOD, IGNORE_INDEX
from .split import hash_key, require_unique_keys

SIDES = ("prompt", "chosen", "rejected")
PREFIX_DIGITS = 4  # 65,536 prefixes: at 10^10 rows a prefix ranks about 150,000 narrow rows


def assign_batches(
    lengths: DataFrame, *, batch_size: int, keys: tuple[str, ...], seed: int = 42, prefix_digits: int = PREFIX_DIGITS
) -> DataFrame:
    """(keys, prompt_len, chosen_len, rejected_len) -> keys, batch, prompt_width, chosen_width, rejected_width."""
    x = lengths.withColumn("_h", hash_key(seed, *keys)).withColumn("_p", F.substring("_h", 1, prefix_digits))
    counts = x.groupBy("_p").agg(F.count("*").alias("_n"))
    # at most 16^prefix_digits rows, whatever the data: one task adds them up
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *keys)) - 1
    ranked = x.withColumn("_place", place).join(offsets, "_p")
    ranked = ranked.withColumn("batch", F.floor((F.col("_before") + F.col("_place")) / batch_size).cast("bigint"))
    widths = ranked.groupBy("batch").agg(*[F.max(f"{s}_len").cast("bigint").alias(f"{s}_width") for s in SIDES])
    return ranked.select(*keys, "batch").join(widths, "batch")


def with_lengths(encoded: DataFrame) -> DataFrame:
    """Encoded pairs with the length of each side, so that a stored table is ranked without reading its arrays."""
    return encoded.withColumns({f"{s}_len": F.size(f"{s}_input_ids") for s in SIDES})


def pad_batches(
    encoded: DataFrame,
    *,
    batch_size: int = 8,
    seed: int = 42,
    keys: tuple[str, ...] = ("prompt_id", "comp_i", "comp_j"),
    padding_value: int = CP_EOD,
    label_pad_token_id: int = IGNORE_INDEX,
    mask_padding_value: int = 0,
    prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Padded rows with `batch` and the batch's widths.  Keys must be unique and not null.

    The arrays are shuffled at most once, to meet their batch numbers, and never
    sorted: the narrow side is the one that is hashed.  Lengths stored by
    `with_lengths` are used where they are there, and left out of the result.
    """
    stored = {f"{s}_len" for s in SIDES} <= set(encoded.columns)
    lengths = encoded.select(*keys, *[f"{s}_len" for s in SIDES]) if stored else with_lengths(encoded).select(*keys, *[f"{s}_len" for s in SIDES])
    require_unique_keys(lengths, keys)
    encoded = encoded.drop(*[f"{s}_len" for s in SIDES]) if stored else encoded
    assigned = assign_batches(lengths, batch_size=batch_size, keys=keys, seed=seed, prefix_digits=prefix_digits)
    x = encoded.join(assigned.hint("shuffle_hash"), list(keys))
    cols = []
    for side in SIDES:
        width = F.col(f"{side}_width")
        for k, value in (("input_ids", padding_value), ("labels", label_pad_token_id), ("attention_mask", mask_padding_value)):
            a = F.col(f"{side}_{k}")
            fill = repeat_int(value, width - F.size(a))
            padded = F.concat(fill, a) if side == "prompt" else F.concat(a, fill)
            cols.append(padded.alias(f"{side}_{k}"))
    rest = [c for c in encoded.columns if c not in {f"{s}_{k}" for s in SIDES for k in ("input_ids", "labels", "attention_mask")}]
    return x.select(*rest, "batch", *[f"{s}_width" for s in SIDES], *cols)
