"""Pairs of flat completions when one prompt may hold a large share of all rows.

A self-join by prompt sends all rows of a prompt to one task; splitting it is
left to adaptive execution, which depends on its settings.  Here the rows of a
prompt are dealt into blocks of about `block_rows` rows, and every unordered
pair of blocks (x, y), x <= y, is a join group of its own: block b is the left
side of the groups (b, y) and the right side of the groups (x, b).  Each pair of
rows meets in exactly one group.  A group holds about `block_rows` rows a side,
whatever the prompt, so no task depends on how large a prompt is; a row is sent
to as many groups as its prompt has blocks, far fewer than the pairs it forms.
Prompts of one block, the usual case, have the single group (0, 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import mean_rating, usable
from ..functions.rows import computed_once
from ..session import scratch_path
from .pairs import formatted_prompt

BLOCK_ROWS = 2000
BROADCAST_PROMPTS = 100_000  # hot prompts (16 bytes each) that may be broadcast; more are joined


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows with `_b`, the block, and `_nb`, the number of blocks of the prompt."""
    sizes = rows.groupBy("prompt_id").agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows)
    large = sizes.select("prompt_id", F.ceil(F.col("_n") / block_rows).cast("int").alias("_nb"))
    few = large.limit(BROADCAST_PROMPTS + 1).count() <= BROADCAST_PROMPTS
    joined = rows.join(F.broadcast(large) if few else large, "prompt_id", "left")
    nb = F.coalesce(F.col("_nb"), F.lit(1))
    # by hash, so that blocks are even whatever the positions are
    return joined.withColumn("_nb", nb).withColumn("_b", F.pmod(F.xxhash64("pos"), F.col("_nb")).cast("int"))


def dealt_groups(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Left and right sides: each row once per group (prompt_id, _x, _y) that it belongs to."""
    b = _blocks(rows, block_rows)
    cols = [c for c in rows.columns]
    left = b.select(*cols, F.col("_b").alias("_x"), F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_y"))
    right = b.select(*cols, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_x"), F.col("_b").alias("_y"))
    return left, right


def build_pairs_dealt(
    completions: DataFrame,
    *,
    key: str = "prompt_id",
    idx: str = "comp_idx",
    prompt: str = "prompt",
    img_path: str | None = "img_path",
    format_prompt: bool = True,
    on_null: str = "drop",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The pairs of `build_pairs_join`; positions must be unique within a prompt."""
    v = completions.select(
        F.col(key).alias("prompt_id"),
        F.col(idx).cast("bigint").alias("pos"),
        computed_once(
            F.when(F.col(key).isNull() | F.col(idx).isNull(), F.raise_error(F.lit("completion without a prompt id or position")).cast("string"))
            .otherwise(F.col("response"))
            .alias("response"),
            mean_rating(F.col("annotations"), on_null).alias("score"),
            formatted_prompt(prompt, img_path, format_prompt).alias("prompt"),
        ),
    ).where(usable(F.col("score")) & F.col("response").isNotNull())
    # counted, and read by both sides: the scored rows are written once, so that ratings are not parsed three times
    path = scratch_path(v.sparkSession, "scored")
    v.write.parquet(path)
    left, right = dealt_groups(v.sparkSession.read.schema(v.schema).parquet(path), block_rows)
    l, r = left.alias("l").hint("merge"), right.alias("r")
    j = l.join(
        r,
        (F.col("l.prompt_id") == F.col("r.prompt_id"))
        & (F.col("l._x") == F.col("r._x"))
        & (F.col("l._y") == F.col("r._y"))
        & ((F.col("l._x") < F.col("l._y")) | (F.col("l.pos") < F.col("r.pos")))
        & (F.col("l.score") != F.col("r.score")),
    )
    first_wins = F.col("l.score") > F.col("r.score")
    return j.select(
        F.col("l.prompt_id").alias("prompt_id"),
        F.least("l.pos", "r.pos").alias("comp_i"),
        F.greatest("l.pos", "r.pos").alias("comp_j"),
        F.col("l.prompt").alias("prompt"),
        F.when(first_wins, F.col("l.response")).otherwise(F.col("r.response")).alias("chosen"),
        F.when(first_wins, F.col("r.response")).otherwise(F.col("l.response")).alias("rejected"),
    )
