"""Preference pairs from rated completions.

Semantics: for every prompt, every unordered pair of completions (i < j by
position) whose two mean ratings both parse, are not NaN and differ gives
one row; the higher mean is `chosen`, the lower `rejected`.  A completion
whose rating does not parse drops every pair it is in, not the prompt.

Plans
-----
* Nested input (one row per prompt, `completions` array): each completion is
  scored once, then an `explode` over the completions and a second
  `explode` over the *filtered* tail of the array emit only the surviving
  pairs.  No shuffle, no Python worker.
* Flat input (one row per completion): an equi self-join on the prompt key
  with `i < j` and unequal scores as the join condition.  Both sides read
  one exchange; a prompt holding a large share of the rows makes its
  shuffle partition skewed, and AQE's skew-join rule splits that partition
  on both sides, so its pairs are produced by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import mean_rating, usable
from ..functions.rows import computed_once
from ..functions.text import image_prompt

PAIR_COLUMNS = ("prompt_id", "comp_i", "comp_j", "prompt", "chosen", "rejected")


def fields_of(completions: Column, *names: str) -> Column:
    """The named fields of an array of structs, zipped: a stored table is read without the others."""
    return F.arrays_zip(*[completions[f].alias(f) for f in names])


def scored_completions(completions: Column, carry: tuple[str, ...] = (), on_null: str = "drop") -> Column:
    """array<struct<pos, response, score, carry...>> with one mean rating per completion."""
    return F.transform(
        fields_of(completions, "response", "annotations", *carry),
        lambda c, k: F.struct(
            k.cast("bigint").alias("pos"),
            c["response"].alias("response"),
            mean_rating(c["annotations"], on_null).alias("score"),
            *[c[f].alias(f) for f in carry],
        ),
    )


def pairable(x: Column) -> Column:
    return usable(x["score"]) & x["response"].isNotNull()


def _choose(a_score: Column, a_resp: Column, b_score: Column, b_resp: Column) -> tuple[Column, Column]:
    first_wins = a_score > b_score
    chosen = F.when(first_wins, a_resp).otherwise(b_resp)
    rejected = F.when(first_wins, b_resp).otherwise(a_resp)
    return chosen, rejected


def formatted_prompt(prompt: str, img_path: str | None, format_prompt: bool) -> Column:
    if format_prompt and img_path:
        return image_prompt(F.col(prompt), F.array(F.col(img_path)))
    return F.col(prompt)


def build_pairs(
    prompts: DataFrame,
    *,
    key: str = "prompt_id",
    prompt: str = "prompt",
    img_path: str | None = "img_path",
    completions: str = "completions",
    format_prompt: bool = True,
    carry: tuple[str, ...] = (),
    prompt_carry: tuple[str, ...] = (),
    on_null: str = "drop",
) -> DataFrame:
    """Nested prompts -> (prompt_id, comp_i, comp_j, prompt, chosen, rejected).

    Every row is paired where it is read (one narrow stage), by its position
    in the array, so neither a null nor a repeated id mixes prompts.  A row is
    one record, so its size is bounded; huge prompts belong in the flat layout.
    """
    # scored once: the explode's own filter on the array's size would score it again
    scored = prompts.select(
        F.col(key).alias("prompt_id"),
        formatted_prompt(prompt, img_path, format_prompt).alias("prompt"),
        *prompt_carry,
        computed_once(scored_completions(F.col(completions), carry, on_null).alias("s")),
    )
    return _pairs_in_row(scored, carry, prompt_carry)


def _carried(a_score: Column, b_score: Column, a: str, b: str, carry, prompt_carry) -> list[Column]:
    out = [F.col(c) for c in prompt_carry]
    for f in carry:
        ch, rj = _choose(a_score, F.col(f"{a}{f}"), b_score, F.col(f"{b}{f}"))
        out += [ch.alias(f"chosen_{f}"), rj.alias(f"rejected_{f}")]
    return out


def _pairs_in_row(base: DataFrame, carry=(), prompt_carry=()) -> DataFrame:
    a = base.select("prompt_id", "prompt", *prompt_carry, "s", F.explode("s").alias("a")).where(pairable(F.col("a")))
    a_score = F.col("a.score")
    tail = F.slice("s", (F.col("a.pos") + 2).cast("int"), (F.size("s") - F.col("a.pos") - 1).cast("int"))
    partners = F.filter(tail, lambda b: pairable(b) & (b["score"] != a_score))
    p = a.select("prompt_id", "prompt", *prompt_carry, "a", F.explode(partners).alias("b"))
    chosen, rejected = _choose(a_score, F.col("a.response"), F.col("b.score"), F.col("b.response"))
    return p.select(
        "prompt_id",
        F.col("a.pos").alias("comp_i"),
        F.col("b.pos").alias("comp_j"),
        "prompt",
        chosen.alias("chosen"),
        rejected.alias("rejected"),
        *_carried(a_score, F.col("b.score"), "a.", "b.", carry, prompt_carry),
    )


def build_pairs_join(
    completions: DataFrame,
    *,
    key: str = "prompt_id",
    idx: str = "comp_idx",
    prompt: str = "prompt",
    img_path: str | None = "img_path",
    format_prompt: bool = True,
    on_null: str = "drop",
    score: str | None = None,
) -> DataFrame:
    """Flat completions -> the same pairs as `build_pairs`, by an equi self-join.

    `score`: a column that holds the scores already (see `long_ratings`); else
    they are computed from the annotation maps.
    """
    # The rating parser runs once per completion (not once per filter term).
    # The key passes through the generator unchanged, so an input already
    # partitioned by it is not shuffled again.
    # A row without a key would silently match nothing (the check reads only the keys).
    if not completions.where(F.col(key).isNull() | F.col(idx).isNull()).select(key).isEmpty():
        raise ValueError("completion without a prompt id or position")
    v = completions.select(
        F.col(key).alias("prompt_id"),
        F.col(idx).cast("bigint").alias("pos"),
        computed_once(
            F.col("response").alias("response"),
            (F.col(score) if score else mean_rating(F.col("annotations"), on_null)).alias("score"),
            formatted_prompt(prompt, img_path, format_prompt).alias("prompt"),
        ),
    ).where(usable(F.col("score")) & F.col("response").isNotNull())
    # Both sides keep the same columns, so they are one shuffle (the second
    # side is a ReusedExchange).  Neither side is broadcast: both grow with
    # the data (AQE may still switch to a broadcast when the measured
    # shuffle is small).
    left = v.alias("l").hint("merge")
    right = v.alias("r")
    j = left.join(
        right,
        (F.col("l.prompt_id") == F.col("r.prompt_id"))
        & (F.col("l.pos") < F.col("r.pos"))
        & (F.col("l.score") != F.col("r.score")),
    )
    chosen, rejected = _choose(F.col("l.score"), F.col("l.response"), F.col("r.score"), F.col("r.response"))
    return j.select(
        F.col("l.prompt_id").alias("prompt_id"),
        F.col("l.pos").alias("comp_i"),
        F.col("r.pos").alias("comp_j"),
        # equal on both sides within a prompt; reading both keeps the two
        # sides' columns identical
        F.coalesce(F.col("l.prompt"), F.col("r.prompt")).alias("prompt"),
        chosen.alias("chosen"),
        rejected.alias("rejected"),
    )


# ------------------------------------------------------------ reports


def _tie_pairs(scores: Column) -> Column:
    """Number of equal-value pairs in an array of doubles (sort, then count runs)."""
    init = F.struct(
        F.lit(None).cast("double").alias("prev"),
        F.lit(0).cast("bigint").alias("run"),
        F.lit(0).cast("bigint").alias("acc"),
    )

    def step(st: Column, x: Column) -> Column:
        same = F.coalesce(x == st["prev"], F.lit(False))
        return F.struct(
            x.alias("prev"),
            F.when(same, st["run"] + 1).otherwise(F.lit(1).cast("bigint")).alias("run"),
            F.when(same, st["acc"] + st["run"]).otherwise(st["acc"]).alias("acc"),
        )

    return F.aggregate(F.array_sort(scores), init, step)["acc"]


def _c2(n: Column) -> Column:
    n = n.cast("bigint")
    return n * (n - 1) / 2


OUTCOMES = ("combinations", "unparseable", "nan", "tie", "missing_response", "pair")


def pair_outcomes(prompts: DataFrame, *, completions: str = "completions") -> DataFrame:
    """Why each combination is kept or dropped, counted without forming pairs.

    Per prompt the counts follow from the number of completions in each
    class and the sizes of equal-score runs, so the work is linear in the
    completions; the totals are one partial aggregation.
    """
    s = scored_completions(F.col(completions))
    base = prompts.select(s.alias("s"))
    # the filtered arrays get their own projection, so each is built once
    v = base.select(
        F.size("s").alias("n"),
        F.size(F.filter("s", lambda x: x["score"].isNull())).alias("u"),
        F.transform(F.filter("s", lambda x: usable(x["score"])), lambda x: x["score"]).alias("vs"),
        F.transform(
            F.filter("s", lambda x: usable(x["score"]) & x["response"].isNotNull()), lambda x: x["score"]
        ).alias("vrs"),
    )
    v = v.select("n", "u", "vs", "vrs", _tie_pairs(F.col("vs")).alias("t"))
    per = v.select(
        "n",
        "u",
        F.size("vs").alias("m"),
        F.size("vrs").alias("mp"),
        "t",
        # no response missing (the usual case): the same runs
        F.when(F.size("vrs") == F.size("vs"), F.col("t")).otherwise(_tie_pairs(F.col("vrs"))).alias("tp"),
    )
    n, u, m, mp, t, tp = (F.col(c) for c in ("n", "u", "m", "mp", "t", "tp"))
    tot = per.agg(
        F.sum(_c2(n)).cast("bigint").alias("combinations"),
        F.sum(_c2(n) - _c2(n - u)).cast("bigint").alias("unparseable"),
        F.sum(_c2(n - u) - _c2(m)).cast("bigint").alias("nan"),
        F.sum(t).cast("bigint").alias("tie"),
        F.sum((_c2(m) - t) - (_c2(mp) - tp)).cast("bigint").alias("missing_response"),
        F.sum(_c2(mp) - tp).cast("bigint").alias("pair"),
    )
    long = tot.unpivot([], list(OUTCOMES), "outcome", "n_pairs")
    return long.select("outcome", F.coalesce(F.col("n_pairs"), F.lit(0)).cast("bigint").alias("n_pairs"))


def unnest_completions(prompts: DataFrame, *, keep: tuple[str, ...] = ("prompt_id", "prompt", "img_path")) -> DataFrame:
    """One row per completion; `comp_idx` is the position in the array (0-based)."""
    cols = [c for c in keep if c in prompts.columns]
    e = prompts.select(*cols, F.posexplode("completions").alias("pos", "c"))
    return e.select(
        *cols,
        F.col("pos").cast("bigint").alias("comp_idx"),
        F.col("c.model").alias("model"),
        F.col("c.response").alias("response"),
        F.col("c.annotations").alias("annotations"),
    )


def completion_scores(prompts: DataFrame) -> DataFrame:
    """Mean rating per completion (NULL: unparseable, NaN: empty map or NaN rating)."""
    e = prompts.select("prompt_id", F.posexplode("completions").alias("pos", "c"))
    return e.select(
        "prompt_id",
        F.col("pos").cast("bigint").alias("comp_idx"),
        F.size("c.annotations").cast("bigint").alias("n_aspects"),
        mean_rating(F.col("c.annotations")).alias("score"),
    )
