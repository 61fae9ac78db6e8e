"""Benchmark decontamination: hash set of test n-grams, token-window scan, exact verification.

The benchmark's windows (10 consecutive words; all words of a shorter item)
are the broadcast side.  The size of what is broadcast, the serialised index,
is checked: a benchmark whose index would be larger is split into blocks of
items, one block is indexed, broadcast, scanned for and dropped at a time, and
the hits are merged by a number given to every document row.  The result is
the same with one block or many.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import written
from prefloom.llm.words import Words, blocks, mix

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
INDEX_GROWTH = 16  # bytes of serialised index for a byte of text, about: the first guess of the number of blocks
_BITS = 20
HITS = "n_words long, n_hit long, spans array<struct<start:int,stop:int>>, items array<string>"


class WindowIndex:
    """Item windows by length and hash, with the words of each for verification."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = [t or "" for _, t in items]
        self.lengths: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for lo, _, data, offs in blocks(pa.array(texts, pa.large_string())):
            w = Words(data, offs)
            for d, n in enumerate(w.count().tolist()):
                k = min(n, window)
                for i in range(int(w.first[d]), int(w.first[d]) + n - k + 1 if k else 0):
                    h = _gram(w.hash[i : i + k])
                    owners = self.lengths.setdefault(k, {}).setdefault(h, {}).setdefault(w.text(i, i + k), [])
                    if items[lo + d][0] not in owners:
                        owners.append(items[lo + d][0])
        self.filters = {}
        for k, table in self.lengths.items():
            f = np.zeros(1 << _BITS, bool)
            f[[h >> (64 - _BITS) for h in table]] = True
            self.filters[k] = f

    def scan(self, w: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Hit flag of each word, and the items of each text."""
        cover = np.zeros(len(w) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(w.n_texts)]
        for k, table in self.lengths.items():
            g, same = w.grams(k)
            at = np.flatnonzero(same & self.filters[k][g >> np.uint64(64 - _BITS)])
            for i, h in zip(at.tolist(), g[at].tolist(), strict=True):
                texts = table.get(h)
                owners = texts and texts.get(w.text(i, i + k))
                if owners:
                    cover[i] += 1
                    cover[i + k] -= 1
                    found[int(w.doc[i])].update(owners)
        return np.cumsum(cover)[:-1] > 0, found


def _gram(hashes: np.ndarray) -> int:
    g = hashes[:1].copy()
    for x in hashes[1:]:
        g = g * np.uint64(0xD1342543DE82EF95) + x
    return int(mix(g)[0])


def _scanner(shared, id_col: str, text_col: str, schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value  # a Python worker reads it once
        for batch in batches:
            ids, texts = batch.column(id_col), batch.column(text_col)
            for lo, hi, data, offs in blocks(texts):
                w = Words(data, offs)
                hit, items = index.scan(w)
                n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), w.first[:-1]) if len(w) else np.zeros(hi - lo, np.int64)
                n_hit[w.count() == 0] = 0
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                if hit.any():
                    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                        for d in range(int(w.doc[a]), int(w.doc[b - 1]) + 1):
                            i, j = max(a, int(w.first[d])), min(b, int(w.first[d + 1]))
                            if i < j:
                                spans[d].append({"start": i - int(w.first[d]), "stop": j - int(w.first[d])})
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).cast(schema.field(0).type),
                        pa.array(w.count().astype(np.int64)),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array(spans, schema.field(3).type),
                        pa.array([sorted(x) for x in items], schema.field(4).type),
                    ],
                    schema=schema,
                )

    return scan


def _halves(items: list[tuple[str, str]], window: int) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The items in two parts; a single item is cut so that each window is whole in one of them."""
    if len(items) > 1:
        return items[: len(items) // 2], items[len(items) // 2 :]
    raw = items[0][1].encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    if len(w) <= window:
        return items, []
    cut = (len(w) + window) // 2  # the words before it, and the last window - 1 of them with the rest
    return [(items[0][0], raw[: w.end[cut - 1]].decode())], [(items[0][0], raw[w.start[cut - window + 1] :].decode())]


def _indexed(items: list[tuple[str, str]], window: int, max_bytes: int) -> Iterator[WindowIndex]:
    index = WindowIndex(items, window)
    if len(pickle.dumps(index)) > max_bytes:
        left, right = _halves(items, window)
        if right:
            del index
            yield from _indexed(left, window, max_bytes)
            yield from _indexed(right, window, max_bytes)
            return
    yield index


def benchmark_indexes(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int) -> Iterator[WindowIndex]:
    """Indexes of the benchmark's items, each below `max_bytes` when serialised.

    The texts' size is summed on Spark first and gives the number of blocks; a
    block is fetched when its index is asked for, and halved while that is
    too large (a single window is the least there is).
    """
    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter("i is not null")
    total = b.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n = int(total * INDEX_GROWTH // max_bytes) + 1
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in [0] if n == 1 else sorted(r.k for r in b.select(block.alias("k")).distinct().toLocalIterator()):
        items = [(r.i, r.t) for r in b.filter(block == k).toLocalIterator()]
        yield from _indexed(items, window, max_bytes)


def _one_or_more(indexes: Iterator[WindowIndex]) -> tuple[WindowIndex | None, Iterator[WindowIndex]]:
    """The only index, or None and all of them."""
    first = next(indexes, None) or WindowIndex([])
    second = next(indexes, None)
    return (first, iter(())) if second is None else (None, chain([first, second], indexes))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _hits_of_blocks(keyed: DataFrame, indexes: Iterator[WindowIndex]) -> DataFrame:
    """(key, t) -> key, n_words, n_hit, spans, items: a row for each row, the hits of all blocks merged.

    `keyed` must be a written table.  One index at a time is in the driver and broadcast.
    """
    spark = keyed.sparkSession
    schema = f"key long, {HITS}"
    parts: list[DataFrame] = []
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)
        part = keyed.select("key", "t").mapInArrow(_scanner(shared, "key", "t", _arrow(schema)), schema)
        parts.append(written(part.filter("n_hit > 0") if parts else part, "block-hits"))
        shared.destroy()
        del index, shared
    return _merge(reduce(DataFrame.unionByName, parts))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, spans (word ranges), items.

    A null text or item text has no words; an item without words has no
    window; a null item id is skipped; equal windows of several items count
    for each; an empty benchmark hits nothing.  Repeated document rows each
    give a row.  Further columns of either table are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    only, indexes = _one_or_more(benchmark_indexes(benchmark, item_col, item_text_col, window, max_broadcast_bytes))
    if only is not None:
        schema = f"id {d.schema['id'].dataType.simpleString()}, {HITS}"
        shared = spark.sparkContext.broadcast(only)
        return d.mapInArrow(_scanner(shared, "id", "t", _arrow(schema)), schema).withColumnRenamed("id", id_col)
    keyed = written(d.withColumn("key", F.monotonically_increasing_id()), "documents-with-key")
    hits = _hits_of_blocks(keyed, indexes)
    return keyed.select("key", F.col("id").alias(id_col)).join(hits, "key").drop("key")


def _merge(hits: DataFrame) -> DataFrame:
    """Union of the word ranges and items that several blocks found for a row."""
    g = hits.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.expr(
        "aggregate(s, cast(array() as array<struct<start:int,stop:int>>), (acc, x) ->"
        " if(size(acc) > 0 and element_at(acc, -1).stop >= x.start,"
        " concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start,"
        " greatest(element_at(acc, -1).stop, x.stop) as stop))), concat(acc, array(x))))"
    )
    g = g.withColumn("spans", joined)
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + (x.stop - x.start))")
    return g.select("key", "n_words", n_hit.alias("n_hit"), "spans", "items")


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from `find_contamination`."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _word_cutter():
    @F.pandas_udf("string")
    def cut(text, spans):  # noqa: ANN001
        import pandas as pd

        out = []
        for t, ss in zip(text, spans, strict=True):
            if t is None or ss is None or not len(ss):
                out.append(t)
                continue
            raw = t.encode()
            w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            kept, at = [], 0
            for s in ss:
                a, b = int(w.start[s["start"]]), int(w.end[s["stop"] - 1])
                kept.append(raw[at:a])
                at = b
            out.append((b"".join(kept) + raw[at:]).decode())
        return pd.Series(out, dtype=object)

    return cut


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_share: float = 0.5,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Cut the hit spans out of each text; drop a document when more than
    `max_share` of its words are hit.  Columns stay as they are.

    One narrow pass when the benchmark fits one block; otherwise the merged
    spans are joined back by a row number.  A document without words is kept.
    """
    cols = docs.columns
    spark = docs.sparkSession
    only, indexes = _one_or_more(benchmark_indexes(benchmark, "item_id", "text", WINDOW, max_broadcast_bytes))
    if only is not None:
        shared = spark.sparkContext.broadcast(only)
        return docs.mapInArrow(_cleaner(shared, text_col, max_share), docs.schema).select(*cols)
    row = F.col("row")
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*cols).alias("row"), F.col(text_col).alias("t"))
    keyed = written(keyed, "documents-with-key")
    found = _hits_of_blocks(keyed, indexes).select("key", F.col("n_words").alias("n"), F.col("n_hit").alias("hit"), "spans")
    out = keyed.select("key", "row").join(found, "key").filter(F.col("hit") <= F.col("n") * max_share)
    text = F.when(F.col("hit") > 0, _word_cutter()(row.getField(text_col), "spans")).otherwise(row.getField(text_col))
    return out.select(*[text.alias(c) if c == text_col else row.getField(c).alias(c) for c in cols])


def _cleaner(shared, text_col: str, max_share: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value  # a Python worker reads it once
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi, data, offs in blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                w = Words(data, offs)
                hit, _ = index.scan(w)
                if not hit.any():
                    yield part
                    continue
                texts, keep = part.column(at).to_pylist(), np.ones(hi - lo, bool)
                for d in np.unique(w.doc[hit]).tolist():
                    i, j = int(w.first[d]), int(w.first[d + 1])
                    flags = hit[i:j]
                    if flags.sum() > max_share * (j - i):
                        keep[d] = False
                        continue
                    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
                    raw, out, last = data[offs[d] : offs[d + 1]].tobytes(), [], 0
                    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        out.append(raw[last : int(w.start[i + a] - offs[d])])
                        last = int(w.end[i + b - 1] - offs[d])
                    texts[d] = (b"".join(out) + raw[last:]).decode()
                arrays = list(part.columns)
                arrays[at] = pa.array(texts, part.column(at).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array(keep))

    return clean


def contaminated(share: Column | None = None) -> Column:
    """Condition on `find_contamination` rows: any hit, or more than `share` of the words."""
    return F.col("n_hit") > 0 if share is None else F.col("n_hit") > share * F.col("n_words")
