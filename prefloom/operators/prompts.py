"""Prompt formatting and pair texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import image_prompt


def format_prompts(df: DataFrame, prompt: str = "prompt", img_paths: str = "img_path") -> DataFrame:
    """Replace `prompt` by the image-prompt format; `img_paths` may be one path or an array."""
    from pyspark.sql.types import ArrayType

    paths = F.col(img_paths)
    if not isinstance(df.schema[img_paths].dataType, ArrayType):
        paths = F.array(paths)
    return df.withColumn(prompt, image_prompt(F.col(prompt), paths))


def full_texts(pairs: DataFrame) -> DataFrame:
    """Prompt-prefixed texts and response-only copies, as the pair encoder emits them."""
    keys = [c for c in ("prompt_id", "comp_i", "comp_j") if c in pairs.columns]
    return pairs.select(
        *keys,
        "prompt",
        F.concat("prompt", "chosen").alias("chosen"),
        F.concat("prompt", "rejected").alias("rejected"),
        F.col("chosen").alias("chosen_response_only"),
        F.col("rejected").alias("rejected_response_only"),
    )
