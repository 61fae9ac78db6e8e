"""Personal data by bootstrapped contextual extraction.

1. One pass over whole texts finds the base entities (email, ip, card, phone)
   and candidate identifiers (other words with several digits), each with the
   lexical patterns before it: its last one, two and three tokens.
2. Base entities are seeds.  Spark scores the graph of patterns and instances
   by turns: a pattern is as confident as the instances it introduces, an
   instance as its best pattern.
3. Candidates after a confident pattern are added as further identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import written
from prefloom.llm.words import blocks

KINDS = ["email", "ip", "card", "phone", "id"]  # "id": an identifier that the method adds
ROUNDS = 3
MIN_SUPPORT = 5.0  # summed scores of the different instances that a pattern introduces
MIN_CONFIDENCE = 0.8
WINDOW = 64  # characters before a span in which its pattern's tokens lie

DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[A-Za-z0-9_+/-]+")
TOKEN = re.compile(r"\w+|[^\w\s]")
NOT_DIGIT = re.compile(r"[^0-9]")

SPAN = "array<struct<kind:string,start:int,stop:int>>"
MENTION = "array<struct<start:int,stop:int,value:string,seed:boolean,patterns:array<string>>>"

_place = [("start", pa.int32()), ("stop", pa.int32())]
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), *_place]))
ARROW_MENTION = pa.list_(pa.struct([*_place, ("value", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email expression, found from each @ so that long words cost linear time."""
    at, done = t.find("@"), 0
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = t.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the base entities, by start and then kind."""
    out = [(a, b, "email") for a, b in _emails(t)] if "@" in t else []
    if DIGIT.search(t):
        for m in IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(t):
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in t:
            for m in PHONE.finditer(t):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _candidates(t: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Words of 6 to 64 characters with four digits or more, outside the base entities."""
    busy, k = sorted((a, b) for a, b, _ in taken), 0
    pos, first = 0, DIGIT.search(t)
    while first:
        start = first.start()
        while start > pos and (t[start - 1].isascii() and (t[start - 1].isalnum() or t[start - 1] in "_+/-")):
            start -= 1
        stop = CANDIDATE.match(t, start).end()
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        free = k == len(busy) or busy[k][0] >= stop
        if free and 6 <= stop - start <= 64 and sum(c in "0123456789" for c in t[start:stop]) >= 4:
            yield start, stop
        pos, first = stop, DIGIT.search(t, stop)


def _patterns(t: str, start: int) -> list[str]:
    tokens = [x.lower() for x in TOKEN.findall(t[max(0, start - WINDOW) : start])]
    return [" ".join(tokens[-k:]) for k in (1, 2, 3) if len(tokens) >= k]


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, _, _ in blocks(batch.column("t"), 4 << 20):
            spans, mentions = [], []
            for t in batch.column("t").slice(lo, hi - lo).to_pylist():
                if not t or not DIGIT.search(t) and "@" not in t:
                    spans.append([])
                    mentions.append([])
                    continue
                base = base_spans(t)
                spans.append([{"kind": k, "start": a, "stop": b} for a, b, k in base])
                every = [(a, b, True) for a, b, _ in base] + [(a, b, False) for a, b in _candidates(t, base)]
                mentions.append([
                    {"start": a, "stop": b, "value": t[a:b].lower()[:64], "seed": s, "patterns": _patterns(t, a)} for a, b, s in every
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), pa.array(spans, ARROW_SPAN), pa.array(mentions, ARROW_MENTION)], names=["id", "base", "mentions"]
            )


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(pattern, value, seed) -> pattern, support, confidence, after some rounds over the graph.

    support: summed scores of the different values after the pattern;
    confidence: support / (number of different values + 1).
    """
    graph = written(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pattern-graph")
    values = graph.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for r in range(rounds):
        scored = graph.join(values, "value")
        pats = scored.groupBy("pattern").agg(F.sum("score").alias("support"), F.count("*").alias("n"))
        pats = pats.select("pattern", "support", (F.col("support") / (F.col("n") + 1)).alias("confidence")).filter(F.col("support") >= min_support)
        pats = written(pats, "pattern-scores")
        if r + 1 < rounds:
            best = F.max(F.greatest(F.col("seed").cast("double"), F.coalesce("confidence", F.lit(0.0))))
            values = written(graph.join(pats, "pattern", "left").groupBy("value").agg(best.alias("score")), "value-scores")
    return pats


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """id, base (spans of the base entities), added (identifiers after confident patterns).

    One row per input row; a null or empty text has no spans; further columns
    are ignored.  Offsets count code points, ends are exclusive.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = d.schema["id"].dataType.simpleString()
    found = d.mapInArrow(_finder, f"id {kind}, base {SPAN}, mentions {MENTION}")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "mentions")
    mention = found.select("row", F.inline("mentions"))
    edges = mention.select("row", "start", "stop", "value", "seed", F.explode("patterns").alias("pattern"))
    pats = score_patterns(edges.select("pattern", "value", "seed"), rounds, min_support)
    good = written(pats.filter(F.col("confidence") >= min_confidence).select("pattern"), "good-patterns")
    extra = edges.filter("not seed").join(good, "pattern").select("row", "start", "stop").distinct()
    extra = extra.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "stop"))).alias("added"))
    return found.join(extra, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def _written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def personal_data_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from `find_personal_data`."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:4]]
    place = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s.start, order[s.kind].alias("o"), s.kind.alias("kind"), s.stop.alias("stop")))
    return found.select(
        id_col, *counts, F.sha2(_written_spans(F.col("base")), 256).alias("base_sha256"), _written_spans(F.array_sort(keyed)).alias("spans")
    )


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base entities of each text replaced by their kind in brackets; columns as they were."""

    @F.pandas_udf("string")
    def mask(text):  # noqa: ANN001
        import pandas as pd

        out = []
        for t in text:
            if t:
                kept, at = [], 0
                for a, b, k in base_spans(t):
                    if a >= at:
                        kept += [t[at:a], f"[{k}]"]
                        at = b
                t = "".join(kept) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, mask(text_col))
