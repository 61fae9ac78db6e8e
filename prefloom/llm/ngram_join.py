"""N-gram Jaccard join: MinHash banding, block-wise verification on full n-gram sets.

1. One pass hashes each text's n-gram set into a MinHash signature and a key
   of its word sequence.  Rows with equal words are one class.
2. Bands of the classes' signatures meet in a shuffle on the band hash; each
   bucket links its members to its least one (never all pairs), and the
   links' connected components hold all candidates together.
3. A component's n-gram sets are dealt to blocks of bounded size, each pair of
   blocks is one group, and all pairs in a group are verified exactly by
   sparse counting.  Only link counts and a spanning forest leave a group.
4. Connected components of the verified links give the class ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import connected_components, remove, settle, written
from prefloom.llm.words import Words, blocks, mix, shingles

U = np.uint64
N = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 20  # a pair at 0.8 meets with probability 1 - (1 - 0.8^5)^20 = 0.9996
BLOCK_SHINGLES = 1 << 20
BLOCK_MEMBERS = 2000  # about; a pair of blocks then takes 64 MB for its counts, however short the texts
STRIPE = 256  # rows of the counts compared at a time
SEED = 20240229

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=U) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=U)


def class_keys(w: Words) -> np.ndarray:
    """Two hashes of each text's word sequence, with each word's place; 0 for a text without words."""
    has = np.flatnonzero(w.count() > 0)
    keys = np.zeros((2, w.n_texts), np.int64)
    if len(has):
        place = (np.arange(len(w)) - w.first[:-1][w.doc]).astype(U)
        for s in range(2):
            keys[s, has] = mix(np.add.reduceat(mix(w.hash ^ mix(place + U(s + 1))), w.first[:-1][has])).view(np.int64)
    return keys


def _signer(n: int, rows: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("t")):
                w = Words(data, offs)
                count = w.count()
                g, doc = shingles(w, n)
                has = np.flatnonzero(count > 0)
                first = np.searchsorted(doc, has)
                keys = class_keys(w)
                sig = np.zeros((rows * bands, len(has)), U)
                if len(has):
                    for k in range(rows * bands):
                        sig[k] = np.minimum.reduceat(g * _MUL[k] + _ADD[k], first)
                band = np.zeros((len(has), bands), np.int64)
                for b in range(bands):
                    h = np.full(len(has), U(b + 1))
                    for k in range(b * rows, (b + 1) * rows):
                        h = mix(h ^ sig[k])
                    band[:, b] = h.view(np.int64)
                lists = np.zeros(hi - lo + 1, np.int32)
                lists[1:] = np.cumsum((count > 0) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(band.reshape(-1))),
                    ],
                    names=["id", "c1", "c2", "n_words", "bands"],
                )

    return sign


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(comp, n_blocks, k, weight, c1, c2, t) -> comp, n_blocks, k, weight and the sorted n-gram set as binary.

    Rows that only share the elected row's id have another class key and go;
    of repeated rows, which the join leaves side by side, the first counts.
    """
    last = None
    for batch in batches:
        for lo, hi, data, offs in blocks(batch.column("t")):
            w = Words(data, offs)
            part = batch.slice(lo, hi - lo)
            same = (class_keys(w) == np.stack([part.column(c).to_numpy() for c in ("c1", "c2")])).all(axis=0)
            chosen = []
            for i, k in enumerate(part.column("k").to_pylist()):
                if same[i] and k != last:
                    chosen.append(i)
                    last = k
            g, doc = shingles(w, n)
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            sets = [np.unique(g[first[i] : first[i + 1]]).tobytes() for i in chosen]
            cols = [part.column(c).take(pa.array(chosen, pa.int64())) for c in ("comp", "n_blocks", "k", "weight")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], names=["comp", "n_blocks", "k", "weight", "grams"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def links_within(sets: list[np.ndarray], left: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, whose sets' Jaccard similarity reaches the threshold.

    Where two blocks meet, `left` marks the members of the first, and a pair
    must have one end in each.  Shared n-grams are counted by products of 0/1
    matrices over slices of the vocabulary and compared in stripes of rows, so
    memory stays at members x (members + slice) whatever the set sizes; blocks
    are bounded by members too.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m <= 4:
        shared = np.zeros((m, m), np.float32)
        for i in range(m):
            for j in range(i + 1, m):
                shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        gram = np.cumsum(new) - 1
        df = np.bincount(gram)
        keep = df[gram] > 1
        gram, owner = gram[keep], owner[keep]
        if len(gram):
            gram = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        shared = np.zeros((m, m), np.float32)
        step = max(64, (1 << 22) // m)
        for lo in range(0, int(gram[-1]) + 1 if len(gram) else 0, step):
            a, b = np.searchsorted(gram, [lo, lo + step])
            x = np.zeros((m, step), np.float32)
            x[owner[a:b], gram[a:b] - lo] = 1
            shared += x @ x.T
    found = []
    for lo in range(0, m, STRIPE):
        part = shared[lo : lo + STRIPE]
        ok = part >= threshold * (size[lo : lo + STRIPE, None] + size[None, :] - part) - 1e-6
        ok &= np.arange(m)[None, :] > np.arange(lo, lo + len(part))[:, None]
        if left is not None:
            ok &= left[lo : lo + STRIPE, None] != left[None, :]
        i, j = np.nonzero(ok)
        found.append((i + lo, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, weights, sets, side, seen = None, [], [], [], [], set()

        def done() -> pa.RecordBatch | None:
            if len(ids) < 2:
                return None
            i, j = links_within(sets, None if key[1] == key[2] else np.array(side), threshold)
            if not len(i):
                return None
            weight = np.array(weights, np.int64)
            total = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            forest = _Forest(len(ids))
            for lo in range(0, len(i), 1 << 16):
                for a, b in zip(i[lo : lo + (1 << 16)].tolist(), j[lo : lo + (1 << 16)].tolist(), strict=True):
                    forest.join(a, b)
            at = np.flatnonzero(total > 0)
            roots = [ids[forest.find(x)] for x in at.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[x] for x in at.tolist()], pa.int64()), pa.array(roots, pa.int64()), pa.array(total[at].astype(np.int64))],
                names=["a", "b", "n_links"],
            )

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("comp", "x", "y", "block", "k", "weight")]
            grams = batch.column("grams")
            for r, (comp, x, y, block, k, weight) in enumerate(zip(*cols, strict=True)):
                if (comp, x, y) != key:
                    if (out := done()) is not None:
                        yield out
                    key, ids, weights, sets, side, seen = (comp, x, y), [], [], [], [], set()
                if k in seen:
                    continue
                seen.add(k)
                ids.append(k)
                weights.append(weight)
                sets.append(np.frombuffer(grams[r].as_buffer(), U).copy())
                side.append(block == x)
        if (out := done()) is not None:
            yield out

    return run


def block_count(block_shingles: int = BLOCK_SHINGLES) -> Column:
    """Blocks of a component: bounded by words and by members."""
    return F.greatest(F.ceil(F.sum("n_words") / block_shingles), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int")


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    rows: int = ROWS,
    bands: int = BANDS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document row: id, class_id (least id of its class), n_links.

    `n_links` counts the other rows whose n-gram sets reach the threshold,
    equal texts included.  A text of fewer than n words has one n-gram, all
    its words; a text without words (null, empty) links to none and is a class
    of its own.  Ids should be unique integers.  Repeated rows count as rows
    each; rows that share an id but not the text are rows like any others,
    each with its own links, and their id may then name several classes.  A
    null id gets class null and counts for no other.  Further columns are
    ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    spark = docs.sparkSession
    signed = written(d.mapInArrow(_signer(n, rows, bands), "id long, c1 long, c2 long, n_words long, bands array<long>"), "signed")
    classes = signed.filter("n_words > 0 and id is not null").groupBy("c1", "c2").agg(
        F.min("id").alias("rep"), F.count("*").alias("size"), F.max("n_words").alias("n_words"), F.first("bands").alias("bands")
    )
    # k numbers the classes; it is written once, so every later step sees the same numbers
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    settle(spark)
    links = _verified_links(d, classes, n, threshold, block_shingles)
    roots = connected_components(links.select("a", "b"), "classes-of-links").withColumnRenamed("node", "k")
    total = links.groupBy(F.col("a").alias("k")).agg(F.sum("n_links").alias("others"))
    placed = classes.select("c1", "c2", "k", "rep", "size").join(roots, "k", "left").join(total, "k", "left")
    placed = placed.withColumn("root", F.coalesce("root", "k"))
    names = roots.join(classes.select("k", "rep"), "k").groupBy("root").agg(F.min("rep").alias("least"))
    result = placed.join(names, "root", "left").select(
        "c1", "c2", F.coalesce("least", "rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    result = written(result, "class-table")
    for t in (classes, links):
        remove(spark, t)
    settle(spark)
    named = signed.select("id", F.when((F.col("n_words") > 0) & F.col("id").isNotNull(), F.col("c1")).alias("c1"), "c2")
    out = named.join(result, ["c1", "c2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _verified_links(d: DataFrame, classes: DataFrame, n: int, threshold: float, block_shingles: int) -> DataFrame:
    """a, b, n_links: each class with links in a group, the least class it reaches there, and the rows it links to."""
    spark = d.sparkSession
    member = classes.select("k", F.explode("bands").alias("band"))
    hubs = member.groupBy("band").agg(F.min("k").alias("hub"), F.count("*").alias("m")).filter("m > 1").select("band", "hub")
    # both sides of this join and the next grow with the documents: the same plan at every size
    star = member.join(hubs.hint("merge"), "band").filter("k <> hub").select(F.col("k").alias("a"), F.col("hub").alias("b"))
    comps = connected_components(star, "candidates").withColumnRenamed("node", "k").withColumnRenamed("root", "comp")
    settle(spark)
    comps = written(comps.join(classes.select("k", "c1", "c2", "rep", "size", "n_words"), "k"), "candidates")
    sizes = comps.groupBy("comp").agg(block_count(block_shingles).alias("n_blocks"))
    wanted = written(comps.join(sizes, "comp").select("comp", "n_blocks", "k", "c1", "c2", "rep", F.col("size").alias("weight")), "wanted")
    texts = d.join(wanted.hint("merge"), d.id == wanted.rep).select("comp", "n_blocks", "k", "weight", "c1", "c2", "t")
    sets = texts.mapInArrow(lambda b: _sets(b, n), "comp long, n_blocks int, k long, weight long, grams binary")
    block = F.pmod(F.xxhash64("k"), F.col("n_blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "k", "weight", "grams")
    grouped = dealt.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y")
    links = written(grouped.mapInArrow(_verify(threshold), "a long, b long, n_links long"), "links")
    for t in (comps, wanted):
        remove(spark, t)
    settle(spark)
    return links


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that carry their class's id: the one with the least id of each group."""
    classes = ngram_join(docs, id_col, text_col)
    rest = classes.filter(F.col("class_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(rest, id_col, "left_anti").select(*docs.columns)
