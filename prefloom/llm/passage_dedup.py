"""Substring dedup: MinHash banding of paragraphs and of the passages within them.

Paragraphs are lines of at least `min_words` words.  They are signed, banded,
verified by exact Jaccard similarity on 5-word shingles and clustered by the
blocks of the n-gram join, with bands tuned for paragraphs.

Passages that repeat inside otherwise different paragraphs are found by the
least hash of each run of `SPAN` consecutive 16-word windows (a one-row MinHash
of every passage of 39 words, whatever its place): two texts that share 39
words in a row share such a window, so no repeat of 39 words or more is missed.
The windows meet in a shuffle on 128 bits of hash of their 16 words.  Each one
found in several documents is extended word by word against its home, the least
of these documents; a passage's windows are at most `SPAN` apart, so `SPAN` - 1
words on each side reach its ends.  Extended windows of one home that touch are
merged into passages, so the kept occurrence is decided for each home apart, and
passages that share a window are one cluster (connected components).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.rows import computed_once
from prefloom.llm.common import connected_components, remove, settle, written
from prefloom.llm.ngram_join import ngram_join
from prefloom.llm.words import Words, blocks, mix

U = np.uint64
GRAM = 16
SPAN = 24
MIN_WORDS = 20
THRESHOLD = 0.8
ROWS, BANDS = 4, 10  # a pair of paragraphs at 0.8 meets with probability 0.995


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each n consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= n:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1])


def chosen_windows(g: np.ndarray, ok: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Indexes of the windows that are least among some `span` consecutive ones."""
    if not len(g):
        return np.zeros(0, np.int64)
    top = U(0xFFFFFFFFFFFFFFFF)
    h = np.where(ok, g, top)
    pad = np.full(span - 1, top)
    low = _sliding(np.concatenate([pad, h, pad]), span, np.minimum)
    return np.flatnonzero(ok & (_sliding(low, span, np.maximum) == h))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for lo, _, data, offs in blocks(batch.column("t")):
            w = Words(data, offs)
            g, ok = w.grams(GRAM)
            at = chosen_windows(g, ok)
            doc = w.doc[at]
            # a second, independent hash of the same 16 words
            other = w.hash ^ U(0x5851F42D4C957F2D)
            second = np.zeros(len(at), U)
            for k in range(GRAM):
                second = mix(second + other[at + k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[lo:][doc], pa.int64()),
                    pa.array((at - w.first[doc]).astype(np.int32)),
                    pa.array(g[at].view(np.int64)),
                    pa.array(second.view(np.int64)),
                ],
                names=["doc", "pos", "g1", "g2"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hit of a document with the SPAN - 1 words before and after it, fewer at the ends of the text."""
    names = ["pos", "g1", "g2", "first"]
    for batch in batches:
        ids, hits = batch.column("id").to_numpy(zero_copy_only=False), batch.column("hits")
        for lo, hi, data, offs in blocks(batch.column("t")):
            w = Words(data, offs)
            g = w.grams(GRAM)[0].view(np.int64)
            part = hits.slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), pc.list_value_length(part).to_numpy(zero_copy_only=False))
            found = part.flatten()
            pos, g1, g2, first = (pc.struct_field(found, c).to_numpy(zero_copy_only=False) for c in names)
            at, begin, end = w.first[row] + pos, w.first[row], w.first[row + 1]
            # rows that share an id: the hit may be in another one
            here = np.flatnonzero(at + GRAM <= end)
            here = here[g[at[here]] == g1[here]]
            at, begin, end = at[here], begin[here], end[here]
            before = w.texts(np.maximum(begin, at - SPAN + 1), at)
            after = w.texts(at + GRAM, np.minimum(end, at + GRAM + SPAN - 1))
            cols = [pa.array(x[here]) for x in (ids[lo:][row], pos, g1, g2, first)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["doc", *names, "before", "after"])


def _same(x: bytes, y: bytes, back: bool = False) -> int:
    """How many words two texts have in common from their start (or back from their end)."""
    if x == y:
        return x.count(b" ") + 1 if x else 0
    n = 0
    step = -1 if back else 1
    for a, b in zip(x.split()[::step], y.split()[::step], strict=False):
        if a != b:
            break
        n += 1
    return n


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits with their home's words -> how many words more are equal on each side."""
    for batch in batches:
        before, home_before, after, home_after = (batch.column(c).to_pylist() for c in ("before", "home_before", "after", "home_after"))
        left = [_same(x, y, True) for x, y in zip(before, home_before, strict=True)]
        right = [_same(x, y) for x, y in zip(after, home_after, strict=True)]
        names = ["doc", "pos", "g1", "g2", "first", "home_pos"]
        cols = [*(batch.column(c) for c in names), pa.array(left, pa.int32()), pa.array(right, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=[*names, "left", "right"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (words), cluster, keeper: passages found in several documents.

    A passage is made of shared windows of one home, the least document that
    has them, which touch once they are extended to the ends of what is shared;
    `keeper` is this home.  Passages of different homes can overlap.  A word
    that is removed stands in its keeper too, kept or removed for a lesser one,
    so one occurrence of it always stays.
    """
    spark = docs.sparkSession
    d = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    found = d.mapInArrow(_windows, "doc long, pos int, g1 long, g2 long")
    found = written(found, "windows")
    shared = found.groupBy("g1", "g2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last")
    hits = written(found.join(shared.drop("last").hint("merge"), ["g1", "g2"]), "shared-windows")
    remove(spark, found)
    settle(spark)
    in_doc = hits.groupBy(F.col("doc").alias("id")).agg(F.collect_set(F.struct("pos", "g1", "g2", "first")).alias("hits"))
    around = d.join(in_doc.hint("merge"), "id").select("id", "t", "hits")
    kinds = "doc long, pos int, g1 long, g2 long, first long"
    around = written(around.mapInArrow(_contexts, f"{kinds}, before binary, after binary"), "window-contexts")
    remove(spark, hits)
    settle(spark)
    home = around.filter("doc = first").groupBy("g1", "g2").agg(F.min(F.struct("pos", "before", "after")).alias("home"))
    home = home.select("g1", "g2", F.col("home.pos").alias("home_pos"), F.col("home.before").alias("home_before"), F.col("home.after").alias("home_after"))
    copies = around.join(home.hint("merge"), ["g1", "g2"]).filter("doc <> first or pos <> home_pos")
    copies = written(copies.mapInArrow(_extended, f"{kinds}, home_pos int, left int, right int"), "extended-windows")
    remove(spark, around)
    settle(spark)
    # the home's own passage goes as far as any copy of it
    homes = copies.groupBy("g1", "g2", "first", "home_pos").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    homes = homes.select(F.col("first").alias("doc"), F.col("home_pos").alias("pos"), "g1", "g2", "first", "left", "right")
    spans = copies.select("doc", "pos", "g1", "g2", "first", "left", "right").unionByName(homes)
    spans = spans.select("doc", "g1", "g2", "first", F.expr("pos - left").alias("lo"), F.expr(f"pos + {GRAM} + right").alias("hi"))
    order = Window.partitionBy("doc", "first").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    runs = written(runs.select("doc", "lo", "hi", "g1", "g2", "first", "run"), "passage-windows")
    remove(spark, copies)
    settle(spark)
    passages = runs.groupBy("doc", "first", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("stop")).withColumn("keeper", F.col("first"))
    passages = written(passages.withColumn("passage", F.monotonically_increasing_id()), "passages")
    place = runs.join(passages.select("doc", "first", "run", "passage"), ["doc", "first", "run"]).select("g1", "g2", "doc", "first", "passage")
    place = written(place, "passage-places")
    remove(spark, runs)
    settle(spark)
    home = place.filter("doc = first").groupBy("g1", "g2").agg(F.min("passage").alias("home"))
    links = place.join(home, ["g1", "g2"]).filter("passage <> home").select(F.col("passage").alias("a"), F.col("home").alias("b")).distinct()
    comps = connected_components(links, "passage-components").select(F.col("node").alias("passage"), "root")
    out = passages.join(comps, "passage", "left").select("doc", "start", "stop", "keeper", F.coalesce("root", "passage").alias("cluster"))
    out = written(out, "passage-clusters")
    for t in (place, passages):
        remove(spark, t)
    settle(spark)
    return out


def similar_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, threshold: float = THRESHOLD
) -> DataFrame:
    """doc, line, n_words, cluster, keeper, first: paragraphs that resemble another.

    `first` marks the one that stays: of the least document id, then line.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line", "t"))
    # counted once: a filter on a projected column would count again below it; a shorter line has not the bytes for its words
    lines = lines.filter(F.octet_length("t") >= 2 * min_words - 1)
    counted = computed_once(F.regexp_count("t", F.lit("[0-9A-Za-z\\u0080-\\x{10FFFF}]+")).alias("n_words"))
    lines = lines.select("doc", "line", "t", counted).filter(F.col("n_words") >= min_words)
    lines = written(lines.withColumn("id", F.monotonically_increasing_id()), "paragraphs")
    classes = ngram_join(lines.select("id", "t"), "id", "t", threshold=threshold, rows=ROWS, bands=BANDS)
    classes = written(classes.filter("n_links > 0").select("id", F.col("class_id").alias("cluster")), "paragraph-classes")
    settle(spark)
    found = written(lines.select("id", "doc", "line", "n_words").join(classes, "id"), "paragraph-clusters")
    first = found.groupBy("cluster").agg(F.min(F.struct("doc", "line", "id")).alias("k"))
    for t in (lines, classes):
        remove(spark, t)
    out = found.join(first, "cluster")
    return out.select("doc", "line", "n_words", "cluster", F.col("k.doc").alias("keeper"), (F.col("k.id") == F.col("id")).alias("first"))


def repeated_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every repeated paragraph and passage: doc_id, kind, start, stop, cluster, keeper, removed.

    kind "paragraph": start and stop are line numbers (stop exclusive);
    kind "passage": word numbers of the text.  `removed` is false for the one
    occurrence that stays.  Documents without repeated text are not listed.
    Null ids and null or empty texts give no rows; rows that share an id count
    as one document; further columns are ignored.
    """
    passages = repeated_passages(docs, id_col, text_col).select(
        F.col("doc").alias(id_col), F.lit("passage").alias("kind"), F.col("start").cast("long").alias("start"),
        F.col("stop").cast("long").alias("stop"), "cluster", "keeper", (F.col("doc") != F.col("keeper")).alias("removed"),
    )
    paragraphs = similar_paragraphs(docs, id_col, text_col).select(
        F.col("doc").alias(id_col), F.lit("paragraph").alias("kind"), F.col("line").cast("long").alias("start"),
        (F.col("line") + 1).cast("long").alias("stop"), "cluster", "keeper", (~F.col("first")).alias("removed"),
    )
    return paragraphs.unionByName(passages)


def drop_repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the paragraphs that resemble an earlier one; columns as they were."""
    gone = similar_paragraphs(docs, id_col, text_col).filter(~F.col("first")).groupBy("doc").agg(F.collect_set("line").alias("_gone"))
    d = docs.join(gone.withColumnRenamed("doc", "_doc"), F.col(id_col).cast("long") == F.col("_doc"), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return d.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
