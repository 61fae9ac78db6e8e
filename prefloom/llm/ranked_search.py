"""Ranked lexical search over per-term posting lists cut into geometric blocks.

Every posting list is cut into blocks of similar documents, and each block
stores the coordinatewise maximum of its documents' term weights: no document
of the block can score more for a query than the maxima summed over the
query's terms.  A search

1. bounds every block of a query's lists from the summaries,
2. scores the documents of the best blocks of each query; the k-th best of
   these scores is a threshold no result can fall below,
3. skips every block whose bound does not reach the threshold (or reaches it
   while its least id cannot win the tie), and scores the documents that are in
   no skipped block.

A document is left out only when an exact bound says so, so the result is that
of scoring all documents.

On Spark: one pass over the texts counts query terms and writes a table with a
row per document (term numbers and counts); its aggregates give the collection
figures.  A second pass writes the index: a row per run of documents with their
vectors and the blocks of the run's posting lists, built inside the task without a
shuffle.  Both search steps read the index run by run, bound, skip and score where
the run is, and hand on the k best of a task per query.  The query side alone is
held by tasks; queries are dealt to groups of bounded size (`MAX_QUERY_TERMS`),
and the groups are searched in turn.

Edge cases: null and empty texts have no terms; such documents never appear and
such queries have no rows.  Repeated document rows are ranked as rows of their
own, equal scores by ascending id (null ids last); repeated query rows each get
their results.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import remove, settle, written
from prefloom.llm.words import Words, blocks
from prefloom.session import scratch_path

MAX_QUERY_TERMS = 200_000  # (query, term) pairs of a group of queries, held by every task
RUN_DOCS = 512  # documents whose posting lists are cut together, a row of the index
RUN_POSTINGS = 100_000
BLOCK_DOCS = 32
RUNS_PER_FILE = 4  # readers decode a file's runs together
FIRST_BLOCKS = 4  # blocks of a query and run that are scored for the threshold
DENSE = 1 << 21  # entries of a matrix held by a task
LAST_ID = (1 << 63) - 1

# ---- queries -------------------------------------------------------------


class Queries:
    """Distinct terms of a group of queries and each query's terms, as arrays."""

    def __init__(self, terms: list[list[bytes]]):
        self.words = sorted({t for q in terms for t in q})
        number = {t: i for i, t in enumerate(self.words)}
        self.of = [np.array(sorted(number[t] for t in q), np.int32) for q in terms]
        self.n = len(terms)

    def together(self) -> np.ndarray | None:
        """Which pairs of terms some query holds both of; None where that table would be large."""
        k = len(self.words)
        if k * k > 1 << 26:
            return None
        out = np.zeros((k, k), bool)
        for t in self.of:
            out[t[:, None], t] = True
        return out

    def weights(self, n_docs: int, df: dict[int, int]) -> np.ndarray:
        """floor(1000 ln((2N+2)/(2df+1))) of each term."""
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.words))], np.int64)


def _words_of(data: bytes) -> Words:
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))


class Vocabulary:
    """Finds the terms of a block of texts among `words`: by hash, then byte by byte."""

    def __init__(self, words: list[bytes]):
        joined = _words_of(b" ".join(words)) if words else None
        h = joined.hash if words else np.zeros(0, np.uint64)
        self.order = np.argsort(h, kind="stable")
        self.hash = h[self.order]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.at = np.cumsum([0, *map(len, words)])
        self.bits = 1 << max(10, (8 * len(words)).bit_length())
        self.maybe = np.zeros(self.bits, bool)
        self.maybe[(h % np.uint64(self.bits)).astype(np.int64)] = True

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and their term numbers."""
        if not len(self.hash) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(w.hash & np.uint64(self.bits - 1)).astype(np.int64)])
        slot = np.searchsorted(self.hash, w.hash[at])
        slot[slot == len(self.hash)] = 0
        ok = self.hash[slot] == w.hash[at]
        at, term = at[ok], self.order[slot[ok]]
        size = w.end[at] - w.start[at]
        same = size == self.at[term + 1] - self.at[term]
        for length in np.unique(size[same]).tolist():
            i = np.flatnonzero(same & (size == length))
            for lo in range(0, len(i), 1 << 18):
                part = i[lo : lo + (1 << 18)]
                step = np.arange(length)
                equal = w.low[w.start[at[part]][:, None] + step] == self.bytes[self.at[term[part]][:, None] + step]
                same[part] &= equal.all(axis=1)
        return at[same], term[same]


def query_terms(queries: DataFrame, text: str, id_column: str) -> DataFrame:
    """(id, terms): the distinct terms of each query as binary strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), []
            for _, _, data, offs in blocks(b.column(1)):
                w = Words(data, offs)
                lists += [sorted({w.text(i, i + 1) for i in range(w.first[d], w.first[d + 1])}) for d in range(w.n_texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lists, pa.list_(pa.binary()))], ["id", "terms"])

    kind = queries.schema[id_column].dataType.simpleString()
    return queries.select(id_column, text).mapInArrow(run, f"id {kind}, terms array<binary>")


def groups_of_queries(found: DataFrame) -> Iterator[list]:
    """Rows (id, terms) of queries with terms, in groups of bounded size."""
    group, size = [], 0
    for r in found.filter(F.size("terms") > 0).toLocalIterator():
        if group and size + len(r.terms) > MAX_QUERY_TERMS:
            yield group
            group, size = [], 0
        group.append((r.id, [bytes(t) for t in r.terms]))
        size += len(r.terms)
    if group:
        yield group


# ---- documents -----------------------------------------------------------


def _count_terms(vocabulary: list[bytes]):
    """(id, text) -> (id, all terms with repeats, term numbers, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, k = Vocabulary(vocabulary), max(1, len(vocabulary))
        for b in batches:
            for lo, hi, data, offs in blocks(b.column(b.num_columns - 1)):
                w = Words(data, offs)
                at, term = known.find(w)
                key, tf = np.unique(w.doc[at] * k + term, return_counts=True)
                doc = key // k
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (key % k, tf)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), pa.array(w.count(), pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+size[0]-1, start[1].., as one array."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    live = size > 0
    first, length = start[live], size[live]
    ends = np.cumsum(length)
    out[0] = first[0]
    out[ends[:-1]] = first[1:] - first[:-1] - length[:-1] + 1
    return np.cumsum(out)


def term_parts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) for each posting; n repeats its document's length."""
    if (50 * int(n.max(initial=0)) * n_docs) >= 1 << 62:
        m = np.array([50 + (50 * int(x) * n_docs) // total for x in n.tolist()], np.int64)
    else:
        m = 50 + (50 * n.astype(np.int64) * n_docs) // max(total, 1)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Run:
    """Some documents as sparse vectors of term parts, and their blocks."""

    def __init__(self, ids, sizes, terms, parts, weights, together=None):
        self.ids, self.sizes, self.terms, self.parts = ids, sizes, terms, parts
        self.together = together
        self.start = np.cumsum(sizes) - sizes
        self.weights = weights

    def geometry(self, dims: int = 12) -> np.ndarray:
        """A direction code per document: signs of projections of its weighted vector.

        Similar vectors share signs.  A Gray order of the codes puts documents
        next to each other that differ in few of them.
        """
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        value = self.parts * self.weights[self.terms].astype(np.float64)
        length = np.sqrt(np.bincount(doc, value * value, len(self.ids)))
        value /= np.maximum(length, 1)[doc]
        code = np.zeros(len(self.ids), np.int64)
        r = np.random.default_rng(12)
        for _ in range(dims):
            axis = r.standard_normal(len(self.weights))
            p = np.bincount(doc, value * axis[self.terms], len(self.ids))
            code = 2 * code + (p > np.median(p))
        gray = code.copy()
        for shift in (1, 2, 4, 8):
            gray ^= gray >> shift
        return gray

    def blocks(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of every posting list: (list's term, documents, summary terms, summary maxima).

        The documents of a list are put in the order of their geometry and cut
        into even blocks of at most BLOCK_DOCS.  A summary holds the terms that
        a query of the list can ask for.
        """
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        near = np.empty(len(self.ids), np.int64)
        near[np.lexsort((self.ids, self.geometry()))] = np.arange(len(self.ids))
        order = np.lexsort((near[doc], self.terms))
        owner, term = doc[order], self.terms[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(term)])
        cuts = -(-size // BLOCK_DOCS)
        of = np.repeat(np.arange(len(first)), cuts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = first[of] + nth * size[of] // cuts[of]
        end = first[of] + (nth + 1) * size[of] // cuts[of]
        lo = 0
        entries = np.concatenate([[0], np.cumsum(self.sizes[owner])])
        while lo < len(begin):  # some blocks at a time, to bound memory
            hi = max(lo + 1, int(np.searchsorted(entries[end], entries[begin[lo]] + DENSE // 4, side="right")))
            hi = min(hi, len(begin), lo + max(1, DENSE // len(self.weights)))
            members = owner[begin[lo] : end[hi - 1]]
            block = np.repeat(np.arange(hi - lo), end[lo:hi] - begin[lo:hi])
            at = _spans(self.start[members], self.sizes[members])
            block_of, other = np.repeat(block, self.sizes[members]), self.terms[at]
            if self.together is not None:
                asked = self.together[term[begin[lo:hi]][block_of], other]
                at, block_of, other = at[asked], block_of[asked], other[asked]
            table = np.zeros((hi - lo, len(self.weights)), np.int32)
            np.maximum.at(table.ravel(), block_of * len(self.weights) + other, self.parts[at].astype(np.int32))
            rows, keys = np.nonzero(table)
            yield term[begin[lo:hi]], members, np.bincount(block, minlength=hi - lo), keys, np.bincount(rows, minlength=hi - lo), table[rows, keys]
            lo = hi


RUN_ROW = "ids array<{kind}>, least array<long>, sizes array<int>, terms array<int>, parts array<int>, list array<int>, docs array<int>, members array<int>, keys array<int>, summary array<int>, most array<int>"


def _build(q: Queries, weights: np.ndarray, n_docs: int, total: int):
    """Document rows -> a row per run: its documents' vectors, and list, documents and summary of each block."""
    names = [c.split()[0] for c in RUN_ROW.split(", ")]

    def emit(held: list[tuple], together) -> Iterator[pa.RecordBatch]:
        ids = pa.chunked_array([h[0] for h in held]).combine_chunks()
        number, sizes, terms, parts = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
        blocks_ = [np.concatenate(x) for x in zip(*Run(number, sizes, terms, parts, weights, together).blocks(), strict=True)]
        lists, members, docs, summary, keys, most = blocks_ or [np.zeros(0, np.int64)] * 6
        values = [ids, pa.array(number, pa.int64()), *(pa.array(v, pa.int32()) for v in (sizes, terms, parts, lists, docs, members, keys, summary, most))]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, postings, together = [], 0, 0, q.together()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                number, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                terms, sizes = _lists(b.column(3))
                tfs, _ = _lists(b.column(4))
                held.append((b.column(0), number, sizes, terms, term_parts(tfs, np.repeat(n, sizes), n_docs, total)))
                docs, postings = docs + len(n), postings + len(terms)
                if docs >= RUN_DOCS or postings >= RUN_POSTINGS:
                    yield from emit(held, together)
                    held, docs, postings = [], 0, 0
        if docs:
            yield from emit(held, together)

    return run


# ---- search --------------------------------------------------------------


def _sums(q: Queries, weights: np.ndarray, sizes: np.ndarray, keys: np.ndarray, values: np.ndarray, asked: Iterator | list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Weighted sums of sparse rows over the terms of queries.

    `asked` holds (query, rows) pairs; a row's values come in order of the rows.
    """
    n, k = len(sizes), len(weights)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = {i: [] for i, _ in asked}
    step = max(1, DENSE // max(1, k))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        table = np.zeros((hi - lo, k), np.int32)
        part = slice(at[lo], at[hi])
        table[np.repeat(np.arange(hi - lo), sizes[lo:hi]), keys[part]] = values[part]
        for i, rows in asked:
            own = rows[np.searchsorted(rows, lo) : np.searchsorted(rows, hi)] - lo
            if len(own):
                out[i].append(table[own[:, None], q.of[i]] @ weights[q.of[i]])
    for i, rows in asked:
        yield i, rows, np.concatenate(out[i]) if out[i] else np.zeros(0, np.int64)


class Best:
    """The k best (score, id number, id) of each query seen so far."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, i: int, score: np.ndarray, number: np.ndarray, ids: pa.Array) -> None:
        old = self.held.get(i)
        if old is not None:
            score, number, ids = np.concatenate([old[0], score]), np.concatenate([old[1], number]), pa.concat_arrays([old[2], ids])
        if len(score) > self.k:
            if number.min() < 0:  # ids that are no numbers: keep all ties of the k-th score
                order = np.flatnonzero(score >= np.partition(score, -self.k)[-self.k])
            else:
                order = np.lexsort((number, -score))[: self.k]
            score, number, ids = score[order], number[order], ids.take(pa.array(order))
        self.held[i] = score, number, ids

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, (score, _, ids) in self.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), ids, pa.array(score)], ["query", "id", "score"])


def _search(q: Queries, weights: np.ndarray, k: int, limits: dict[int, tuple[int, int]] | None):
    """Runs -> (query, id, score): the k best of a task.

    Without limits only the documents of the FIRST_BLOCKS best blocks of each
    query and run are scored.  With limits, a query's (threshold, id of the result
    there), all documents that are in no block that the limit rules out.
    """
    asks = np.concatenate(q.of)
    order = np.argsort(asks, kind="stable")
    asking = np.repeat(np.arange(q.n), [len(t) for t in q.of])[order]  # queries by term
    at_term = np.searchsorted(asks[order], np.arange(len(weights) + 1))

    def one(row: pa.RecordBatch, best: Best) -> None:
        ids = row.column(0).flatten()
        number, sizes, terms, parts, lists, docs, members, keys, summary, most = (row.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(1, 11))
        first = np.cumsum(docs) - docs
        least = np.minimum.reduceat(number[members], first) if len(first) else first
        times = at_term[lists + 1] - at_term[lists]
        queries = asking[_spans(at_term[lists], times)]
        wanted = []
        for i, blocks_, bound in _sums(q, weights, keys, summary, most, list(_grouped(queries, np.repeat(np.arange(len(lists)), times)))):
            if limits is None:
                stay = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
                chosen = np.unique(members[_spans(first[blocks_[stay]], docs[blocks_[stay]])])
            else:
                floor, last = limits.get(i, (1, LAST_ID))
                stay = (bound > floor) | (bound == floor) & (least[blocks_] <= last)
                state = np.zeros(len(sizes), np.int8)
                for block_set, mark in ((blocks_[stay], 1), (blocks_[~stay], 2)):
                    state[members[_spans(first[block_set], docs[block_set])]] = mark
                chosen = np.flatnonzero(state == 1)
            if len(chosen):
                wanted.append((i, chosen))
        for i, rows, score in _sums(q, weights, sizes, terms, parts, wanted):
            keep = score > 0
            if limits is not None:
                floor, last = limits.get(i, (1, LAST_ID))
                keep = (score > floor) | (score == floor) & (number[rows] <= last)
            if keep.any():
                best.add(i, score[keep], number[rows[keep]], ids.take(pa.array(rows[keep])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            for r in range(b.num_rows):
                one(b.slice(r, 1), best)
        yield from best.rows()

    return run


def _grouped(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with its values, rising."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for lo, hi in zip(heads, [*heads[1:], len(keys)], strict=True):
        yield int(keys[lo]), values[lo:hi]


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Index:
    """Document vectors and blocks of the terms of one group of queries, as written tables."""

    def __init__(self, documents: DataFrame, text: str, id_column: str, q: Queries):
        self.q = q
        kind = documents.schema[id_column].dataType.simpleString()
        rows = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
        counted = rows.mapInArrow(_count_terms(q.words), f"id {kind}, n long, terms array<int>, tfs array<int>").filter("n > 0")
        self.docs = written(counted, "search-docs")
        figures = self.docs.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
        self.n_docs, self.total = figures.n, int(figures.total or 0)
        df = self.docs.select(F.explode("terms").alias("t")).groupBy("t").count()
        self.weights = q.weights(self.n_docs, {r.t: r["count"] for r in df.collect()})
        # ids order ties only where they are numbers; other kinds never skip an equal bound
        number = F.coalesce(F.col("id").cast("long"), F.lit(LAST_ID)) if kind in ("bigint", "int", "smallint", "tinyint") else F.lit(-LAST_ID)
        vectors = self.docs.filter(F.size("terms") > 0).select("id", number.alias("least"), "n", "terms", "tfs")
        built = vectors.mapInArrow(_build(q, self.weights, self.n_docs, self.total), RUN_ROW.format(kind=kind))
        path = scratch_path(documents.sparkSession, "search-index")
        built.write.option("maxRecordsPerFile", RUNS_PER_FILE).parquet(path)
        self.runs = documents.sparkSession.read.schema(built.schema).parquet(path)

    def search(self, k: int) -> DataFrame:
        """(query, id, score, rank) of the k best documents of each query."""
        shape = f"query int, id {self.docs.schema['id'].dataType.simpleString()}, score long"
        tried = _top(self.runs.mapInArrow(_search(self.q, self.weights, k, None), shape), k).filter(F.col("rank") == k)
        number = F.coalesce(F.expr("try_cast(id as bigint)"), F.lit(LAST_ID))
        limits = {r.query: (r.score, r.id) for r in tried.select("query", "score", number.alias("id")).collect()}
        return _top(self.runs.mapInArrow(_search(self.q, self.weights, k, limits), shape), k)

    def drop(self) -> None:
        for t in (self.docs, self.runs):
            remove(t.sparkSession, t)
        settle(self.docs.sparkSession)


def ranked_search(documents: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The k documents of highest score above 0 for each query: (item id, rank, document id, score)."""
    spark = documents.sparkSession
    out = None
    for group in groups_of_queries(query_terms(queries, text, item_id)):
        index = Index(documents, text, doc_id, Queries([t for _, t in group]))
        found = written(index.search(k), "search-found")
        index.drop()
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"query int, {item_id} {queries.schema[item_id].dataType.simpleString()}")
        part = found.join(names, "query").select(item_id, "rank", F.col("id").alias(doc_id), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = [t.schema[c].dataType.simpleString() for t, c in ((queries, item_id), (documents, doc_id))]
        return spark.createDataFrame([], f"{item_id} {kinds[0]}, rank int, {doc_id} {kinds[1]}, score long")
    return out
