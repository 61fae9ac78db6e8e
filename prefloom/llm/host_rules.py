"""Quality rules at host level: rule failures by domain, shrunk by an empirical beta prior.

Everything is DataFrame and SQL functions.  A document's figures come from
its own row (no shuffle); hosts are aggregated with partial sums; the host
verdicts are written once, so that their join broadcasts only a table whose
measured size is below the threshold, and otherwise is a sort-merge join
whose hot host AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.rows import computed_once
from prefloom.llm.common import written

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
GRAM = 8

# a word equal to the next, in words joined and led by single spaces
STUTTER = r"( [^ ]++)(?=\1(?: |$))"

# rule name -> (weight, failure condition over the figures)
RULES = {
    "symbols": (2, "n_words > 0 and n_symbols > 0.1 * n_words"),
    "stutter": (2, "n_words > 0 and n_stutter > 0.3 * n_words"),
    "length": (1, "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)"),
    "repetition": (1, "(n_lines > 1 and n_dup_lines > 0.3 * n_lines) or 10 * n_repeat_words > n_words"),
}
HOST_LIMIT = 0.3  # a host whose shrunk failure rate is above this is strict
STRICT, LENIENT = 1, 2  # weight of failed rules that rejects a document of a strict / another host


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def document_figures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (the `keep` columns as a struct) and n_words, word_chars, n_symbols,
    n_stutter, n_lines, n_dup_lines, n_repeat_words of each row's text.

    A null or empty text has zeros.  `n_repeat_words` hashes the 8-word
    windows of the row and sorts them only where one occurs twice.
    """
    row = F.struct(*(docs.columns if keep is None else keep)).alias("row")
    d = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("row", computed_once(_words(F.col("t")).alias("w"), F.col("t").alias("t")))
    d = d.select(
        "row",
        computed_once(
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(F.concat(F.lit(" "), F.array_join("w", " ")), F.lit(STUTTER)).cast("long").alias("n_stutter"),
            _lines(F.col("t")).alias("l"),
            _windows().alias("g"),
        ),
    )
    d = d.withColumns({
        "n_lines": F.size("l").cast("long"),
        "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        "n_repeat_words": _covered(),
    })
    return d.drop("l", "g")


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _windows() -> Column:
    """Hashes of the row's 8-word windows, in order: words, then pairs, fours and eights of them."""
    h = "transform(w, x -> xxhash64(x))"
    for step in (1, 2, 4):
        h = (
            f"transform(array({h}), h -> zip_with(slice(h, 1, size(h) - {step}), slice(h, {1 + step}, size(h) - {step}),"
            " (a, b) -> xxhash64(a, b)))[0]"
        )
    return F.expr(f"if(size(w) < {GRAM}, cast(array() as array<bigint>), {h})")


def _covered() -> Column:
    """Words covered by windows that occur twice or more in the row."""
    pairs = "array_sort(transform(g, (h, i) -> struct(h as h, i as i)))"
    twice = (
        f"transform(array({pairs}), s -> array_sort(transform(filter(transform(s, (x, k) -> struct(x.i as i,"
        " (k > 0 and s[k - 1].h = x.h) or (k + 1 < size(s) and s[k + 1].h = x.h) as again)),"
        " x -> x.again), x -> x.i)))[0]"
    )
    total = (
        f"transform(array({twice}), p -> aggregate(transform(p, (x, k) ->"
        f" if(k + 1 < size(p), least({GRAM}, p[k + 1] - x), {GRAM})), 0L, (a, x) -> a + x))[0]"
    )
    return F.expr(f"if(size(array_distinct(g)) = size(g), 0L, {total})")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def failed_weight() -> Column:
    """Sum of the weights of the rules that a document fails."""
    total = F.lit(0)
    for weight, rule in RULES.values():
        total = total + F.when(F.expr(rule), weight).otherwise(0)
    return total


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, base_failed, failed_weight) rows -> host, n_docs, n_failing, rate (shrunk), strict.

    The beta prior's mean and strength come from the hosts themselves by
    moments; with no spread between hosts, the rate is the overall mean.
    """
    hosts = judged.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.when((F.col("failed_weight") > 0) | F.col("base_failed"), 1).otherwise(0)).alias("n_failing")
    )
    hosts = written(hosts, "hosts")
    p = F.col("n_failing") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failing") / F.sum("n_docs")).alias("mean"),
        F.avg(p * p).alias("square"),
        F.avg(p).alias("plain"),
        F.avg(1 / F.col("n_docs")).alias("small"),
    ).first()
    mean = prior["mean"] or 0.0
    noise = mean * (1 - mean) * (prior["small"] or 0.0)
    spread = max(0.0, (prior["square"] or 0.0) - (prior["plain"] or 0.0) ** 2 - noise)
    # without spread beyond sampling noise, hosts are alike: a very strong prior
    weight = mean * (1 - mean) / spread - 1 if spread > 1e-12 else 1e12
    weight = max(weight, 1.0)
    rate = (F.col("n_failing") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select("host", "n_docs", "n_failing", rate.alias("rate"), (rate > limit).alias("strict"))


def _judged(docs: DataFrame, text_col: str, host_col: str, keep: list[str], store: bool) -> DataFrame:
    """row, figures, base_failed, failed_weight, strict_host, kept."""
    figures = document_figures(docs, text_col, list(dict.fromkeys([*keep, host_col])))
    figures = figures.select("*", computed_once(base_failed().alias("base_failed"), failed_weight().alias("failed_weight")))
    figures = written(figures, "figures") if store else figures
    host = F.col("row").getField(host_col)
    verdicts = host_verdicts(figures.select(host.alias("host"), "base_failed", "failed_weight"))
    verdicts = written(verdicts.select("host", F.col("strict").alias("strict_host")), "verdicts")
    judged = figures.join(verdicts, host.eqNullSafe(F.col("host")), "left").drop("host")
    limit = F.when(F.coalesce("strict_host", F.lit(False)), STRICT).otherwise(LENIENT)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed_weight") < limit))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document row: the id, the figures, base_failed, failed_weight, strict_host and kept.

    A document without a failed rule is kept whatever its host.  A heavy
    failure rejects it anywhere, a light one only on a strict host.  Null
    hosts form one host.  Repeated rows are judged alike; an empty table gives
    none; further columns are ignored, whatever their names.
    """
    judged = _judged(docs, text_col, host_col, [id_col], store=True)
    return judged.select(F.col("row").getField(id_col).alias(id_col), *[c for c in judged.columns if c != "row"])


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns as they were.

    Texts are too large to write twice, so the figures are computed once for
    the hosts and again with the verdicts; nothing is shuffled but host sums.
    """
    return _judged(docs, text_col, host_col, docs.columns, store=False).filter("kept").select("row.*")
