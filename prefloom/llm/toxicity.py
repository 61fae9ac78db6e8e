"""Toxicity by weak supervision.

1. Voters.  A lexicon of insults, and patterns (words and word beginnings) that
   a bounded sample of labelled texts shows to go with toxic texts: the
   likelihood ratio of a pattern must be one that few of as many random ones reach.
2. Votes.  Every voter is asked about every document; equal vote patterns are
   counted together.
3. Label model.  A generative model with a label per document, known for the
   labelled sample (whose texts count again) and else hidden: expectation maximisation first gives each voter's rates of firing on toxic and on clean
   texts, taking voters as independent.  Voters whose votes still correlate
   given the label are then joined into groups, the number of a
   group's voters that fire (0 to 3 or more) takes the place of its single votes,
   and the rates are estimated again.  Toxic texts are of one kind for each group.
4. Classifier.  A logistic regression on words and word beginnings, fitted on
   the posterior labels of a bounded sample of texts, so that it also knows
   features that are no voter.  A logistic curve fitted on the labelled sample
   turns its margins into probabilities.

Labels are learnt only from rows whose crc32(id as text) mod 4 is not 2, and no
text of the other rows is fitted on.  Steps 2 and 4 read whole texts of
all documents; copies count once where rows are fitted on.

Bounds (parameters): `labels` labelled texts, `texts` texts to fit on, MAX_VOTERS
voters, MAX_FEATURES features.  Nothing else is bounded.

Edge cases: null and empty texts have no features and get the classifier's base
rate.  A null id is never held out and has no label.  An id with several labels
is toxic if one of them says so; labels other than 0 and 1 are ignored.  Repeated
rows are scored each.  Without labels the lexicon alone votes and margins are
not recalibrated.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.common import written
from prefloom.llm.words import Words, blocks, shingles

LABELS, TEXTS = 20_000, 8_000
MAX_VOTERS, MAX_FEATURES = 256, 4096
THRESHOLD = 0.3
BAR = 2.0  # a feature's likelihood ratio must exceed this many logs of the number of features
BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
TIMES = (1, 2, 4)  # a feature is a word or beginning that a text has at least so often
STATES = 4  # 0, 1, 2, 3 or more voters of a group fire

# fixed values: insults
LEXICON = """
idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb dumbass fool jerk
bastard bitch asshole retard garbage vermin filth imbecile shithead cretin crap hate kill
dummkopf trottel arschloch abschaum versager widerlich erbärmlich wertlos hurensohn schwachkopf
connard salaud ordure crétin débile minable dégoûtant abruti imbécile raclure
estúpido imbécil basura escoria patético asqueroso gilipollas inútil cabrón tonto
""".split()


# ---- features of texts ---------------------------------------------------


def _word_key(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(8)


def keys_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of every word and word beginning, with repeats.

    The key of a beginning is its bytes with their number in the bits above; that
    of a word is 56 bits of its hash.  Four more bits say which of TIMES is meant.
    """
    size = w.end - w.start
    padded = np.concatenate([w.low, np.zeros(8, np.uint8)])
    load = np.lib.stride_tricks.sliding_window_view(padded, 8)[w.start].copy().view("<u8").ravel() if len(size) else np.zeros(0, np.uint64)
    docs, keys = [w.doc], [_word_key(w.hash)]
    for n in BEGINNINGS:
        long = size >= n
        docs.append(w.doc[long])
        keys.append(load[long] & np.uint64((1 << 8 * n) - 1) | np.uint64(n << 56))
    return np.concatenate(docs), np.concatenate(keys)


def sketch(w: Words) -> np.ndarray:
    """The least hash of each text's 5-word shingles: equal for copies, mostly equal for near copies."""
    g, doc = shingles(w, 5)
    out = np.zeros(w.n_texts, np.uint64)
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    if len(heads):
        out[doc[heads]] = np.minimum.reduceat(g, heads)
    return out.view(np.int64)


def beginning(key: int) -> bytes | None:
    n = key >> 56 & 15
    return (key & ((1 << 8 * n) - 1)).to_bytes(n, "little") if n else None


def described(key: int, text: bytes) -> str:
    times = TIMES[key >> 60]
    return ("beginning " if key >> 56 & 15 else "word ") + text.decode(errors="replace") + (f" {times} times" if times > 1 else "")


def lexicon_keys(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return _word_key(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64)).hash)


class Finder:
    """Which of the given keys a text has."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.keys, where = np.unique(keys & np.uint64((1 << 60) - 1), return_inverse=True)
        self.number = np.full((len(TIMES), len(self.keys)), -1)
        self.number[(keys >> np.uint64(60)).astype(np.int64), where] = np.arange(len(keys))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, number of the key), sorted."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(w.hash):
            return none, none
        doc, key = keys_of(w)
        at = np.flatnonzero(self.maybe[self._slot(key)])
        doc, key = doc[at], key[at]
        slot = np.searchsorted(self.keys, key)
        slot[slot == len(self.keys)] = 0
        ok = self.keys[slot] == key
        pair, seen = np.unique(doc[ok] * len(self.keys) + slot[ok], return_counts=True)
        doc, slot = pair // len(self.keys), pair % len(self.keys)
        number = np.concatenate([np.where(seen >= t, self.number[i][slot], -1) for i, t in enumerate(TIMES)])
        doc = np.tile(doc, len(TIMES))[number >= 0]
        number = number[number >= 0]
        order = np.lexsort((number, doc))
        return doc[order], number[order]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, share toxic) rows -> texts with each key: how many, and how many of them toxic."""
    keys, n, toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def merged(parts):
        k, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return k, *(np.bincount(where, np.concatenate([p[i] for p in parts]), len(k)) for i in (1, 2))

    held, size = [(keys, n, toxic)], 0
    for b in batches:
        share = b.column(1).to_numpy(zero_copy_only=False).astype(float)
        for lo, _, data, offs in blocks(b.column(0)):
            doc, key = keys_of(Words(data, offs))
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
            seen = np.diff(np.r_[heads, len(key)])
            often = [heads[seen >= t] for t in TIMES]
            key = np.concatenate([key[h] | np.uint64(i << 60) for i, h in enumerate(often)])
            doc = doc[np.concatenate(often)]
            held.append((key, np.ones(len(key)), share[lo + doc]))
            size += len(key)
            if size > 3_000_000:
                held = [merged(held)]
                size = len(held[0][0])
    keys, n, toxic = merged(held)
    for lo in range(0, len(keys), 100_000):
        part = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(n[part]), pa.array(toxic[part])], ["key", "n", "toxic"])


def tally(rows: DataFrame, name: str) -> DataFrame:
    """(key, n, toxic) of the features of (text, share) rows, as a written table."""
    parts = rows.select("text", "share").mapInArrow(_tally, "key long, n double, toxic double")
    return written(parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), name)


def likelihood_ratio(n: Column, toxic: Column, total: float, total_toxic: float) -> Column:
    """G of the two-by-two table of a feature and the label; positive only."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    clean, total_clean = n - toxic, total - total_toxic
    out = part(toxic, n * total_toxic / total) + part(clean, n * total_clean / total)
    return out + part(total_toxic - toxic, (total - n) * total_toxic / total) + part(total_clean - clean, (total - n) * total_clean / total)


# ---- voters --------------------------------------------------------------


@dataclass
class Voters:
    """Keys of the voters, their texts, and their first rates of firing on toxic and clean texts."""

    keys: np.ndarray
    names: list[str]
    toxic_rate: np.ndarray
    clean_rate: np.ndarray


def choose_voters(labelled: DataFrame) -> Voters:
    """Lexicon words, and patterns that distinguish the toxic texts of (text, share) rows."""
    lexicon = lexicon_keys(LEXICON)
    found, names = [int(k) for k in lexicon], [f"word {w}" for w in LEXICON]
    rates = {k: (0.3, 0.01) for k in found}
    total, total_toxic = (float(x or 0) for x in labelled.agg(F.count("*"), F.sum("share")).first())
    if 0 < total_toxic < total:
        features = tally(labelled, "toxicity-voters")
        bar = BAR * math.log(max(2, features.count()))
        g = likelihood_ratio(F.col("n"), F.col("toxic"), total, total_toxic)
        better = features.withColumn("g", g).filter((F.col("g") > bar) & (F.col("toxic") * total > F.col("n") * total_toxic))
        best = better.orderBy(F.desc("g"), "key").limit(8 * MAX_VOTERS).collect()
        rate = {r.key: ((r.toxic + 0.5) / (total_toxic + 1), (r.n - r.toxic + 0.5) / (total - total_toxic + 1)) for r in best}
        rates |= {k: rate[k] for k in found if k in rate}
        chosen = _cover(labelled, [r.key for r in best], found, bar)
        spelled = spell(labelled, [k for k in chosen if not k >> 56 & 15])
        for k in chosen:
            found.append(k)
            names.append(described(k, beginning(k) or spelled[k]))
            rates[k] = rate[k]
    a, b = (np.array([rates[k][i] for k in found]) for i in (0, 1))
    return Voters(np.array(found, np.uint64), names, a, b)


def _cover(labelled: DataFrame, candidates: list[int], given: list[int], bar: float) -> list[int]:
    """Candidates that tell toxic texts apart which the voters before them do not.

    A text's weight falls to a third with every voter that fires on it, so a
    candidate that fires where others do adds little.
    """
    candidates = [k for k in candidates if k not in set(given)]
    keys = np.array(given + candidates, np.uint64)
    found, share = _rows_of(labelled, keys)
    fires = [np.zeros(0, np.int64)] * len(keys)
    doc = np.repeat(np.arange(len(share)), found.value_lengths().to_numpy(zero_copy_only=False))
    flat = found.flatten().to_numpy(zero_copy_only=False)
    for k, docs in _grouped(flat, doc):
        fires[k] = docs
    weight = np.ones(len(share))
    for k in range(len(given)):
        weight[fires[k]] /= 3
    out, left = [], set(range(len(given), len(keys)))

    def value(k: int) -> float:
        n, toxic = weight[fires[k]].sum(), (weight * share)[fires[k]].sum()
        whole, whole_toxic = weight.sum(), (weight * share).sum()
        if not 0 < n < whole or not 0 < whole_toxic < whole or toxic * whole <= n * whole_toxic:
            return 0.0
        cells = ((toxic, n * whole_toxic), (n - toxic, n * (whole - whole_toxic)), (whole_toxic - toxic, (whole - n) * whole_toxic), (whole - whole_toxic - n + toxic, (whole - n) * (whole - whole_toxic)))
        return sum(2 * o * math.log(o * whole / e) for o, e in cells if o > 1e-9)

    bound = {k: math.inf for k in left}  # values hardly ever rise: look again only at what still may be best
    while left and len(given) + len(out) < MAX_VOTERS:
        best, most = -1, bar
        for k in sorted(left, key=lambda k: -bound[k]):
            if bound[k] <= most:
                break
            bound[k] = value(k)
            if bound[k] > most:
                best, most = k, bound[k]
        if best < 0:
            break
        left.remove(best)
        out.append(candidates[best - len(given)])
        weight[fires[best]] /= 3
    return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for lo, hi in zip(heads, [*heads[1:], len(keys)], strict=True):
        yield int(keys[lo]), values[lo:hi]


def _rows_of(rows: DataFrame, keys: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """Numbers of the keys in each of a bounded number of (text, share) rows, and the shares."""
    out = rows.select("text", "share").mapInArrow(_presence(keys), "votes array<int>, share double").toArrow()
    return out.column("votes").combine_chunks(), out.column("share").to_numpy()


def spell(rows: DataFrame, words: list[int]) -> dict[int, bytes]:
    """The words behind word keys."""
    hashes = np.array(words, np.uint64) & np.uint64((1 << 56) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bytes] = {}
        for b in batches:
            for _, _, data, offs in blocks(b.column(0)):
                w = Words(data, offs)
                at = np.flatnonzero(np.isin(_word_key(w.hash), hashes))
                k, first = np.unique(_word_key(w.hash[at]), return_index=True)
                seen |= {int(x): w.text(i, i + 1) for x, i in zip(k, at[first], strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], ["key", "word"])

    found = rows.select("text").mapInArrow(run, "key long, word binary").groupBy("key").agg(F.min("word").alias("word"))
    by_hash = {r.key: bytes(r.word) for r in found.collect()}
    return {k: by_hash[k & ((1 << 56) - 1)] for k in words}


# ---- label model ---------------------------------------------------------


@dataclass
class LabelModel:
    """Rates of each group's states, shares of the kinds of toxic texts, and the share of toxic texts.

    A toxic text is of one kind: the voters of the kind's group fire at their
    rates for toxic texts, and what other voters do says nothing.  So voters that
    never fire together (of two languages, say) do not speak against each other.
    """

    groups: list[int]  # group of each voter
    toxic: np.ndarray  # group x state
    clean: np.ndarray
    kinds: np.ndarray  # share of each group's kind among toxic texts
    prior: float
    correlated: dict[tuple[int, int], float] = field(default_factory=dict)  # voters' correlation given the label

    def states(self, votes: Column) -> Column:
        """Group and state (group * STATES + state) of the groups that fire."""
        fired = F.transform(votes, lambda v: F.element_at(F.array(*map(F.lit, self.groups)), v + 1))
        return F.transform(F.array_distinct(fired), lambda g: g * STATES + F.least(F.lit(STATES - 1), F.size(F.filter(fired, lambda x: x == g))))

    def ratio(self, votes: Column) -> Column:
        """Likelihood of the votes on a toxic text over that on a clean one."""
        part = self.kinds[:, None] * self.toxic / self.clean
        gain = F.array(*[F.lit(float(x)) for x in (part - part[:, :1]).ravel()])
        return F.greatest(F.lit(1e-12), F.aggregate(self.states(votes), F.lit(float(part[:, 0].sum())), lambda s, i: s + F.element_at(gain, i + 1)))

    def posterior(self, votes: Column) -> Column:
        z = self.prior * self.ratio(votes)
        return z / (z + (1 - self.prior))


def _joined(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    number = {r: k for k, r in enumerate(sorted({top(i) for i in range(n)}))}
    return [number[top(i)] for i in range(n)]


def _estimate(patterns: DataFrame, model: LabelModel, steps: int) -> LabelModel:
    """Expectation maximisation over (votes, n, share) rows, share null where the label is hidden.

    Each step reads one sum per group and state.
    """
    n_groups = len(model.kinds)
    for _ in range(steps):
        votes = F.col("votes")
        # p: toxic; u: toxic, over the likelihood ratio, so that kind g has kinds[g] * toxic / clean * u of a text
        likely = F.coalesce(F.col("share"), model.posterior(votes))
        p = patterns.select("n", (F.col("n") * likely).alias("p"), (F.col("n") * likely / model.ratio(votes)).alias("u"), model.states(votes).alias("states"))
        total, toxic, all_u = (float(x or 0) for x in p.agg(F.sum("n"), F.sum("p"), F.sum("u")).first())
        one = p.select((F.col("n") - F.col("p")).alias("c"), "u", F.explode("states").alias("s"))
        rest, u = np.zeros((2, n_groups, STATES))
        for r in one.groupBy("s").agg(F.sum("c").alias("c"), F.sum("u").alias("u")).collect():
            rest[divmod(r.s, STATES)], u[divmod(r.s, STATES)] = r.c, r.u
        for of, whole in ((rest, total - toxic), (u, all_u)):
            of[:, 0] = np.maximum(whole - of[:, 1:].sum(axis=1), 0)
        own = u * model.kinds[:, None] * model.toxic / model.clean
        # a prior worth two texts with the first rates holds voters that hardly ever fire
        new = [(c + 2 * first) / (c.sum(axis=1, keepdims=True) + 2) for c, first in ((own, model.toxic), (rest, model.clean))]
        model.kinds = (own.sum(axis=1) + 0.1) / (own.sum() + 0.1 * n_groups)
        model.toxic, model.clean = new
        model.prior = min(max((toxic + 0.5) / (total + 1), 1e-6), 0.5)
    return model


def fit_label_model(patterns: DataFrame, voters: Voters, prior: float, link: float = 0.1) -> LabelModel:
    """Accuracies and correlations of voters from (votes, n, share) rows."""
    n = len(voters.keys)

    def single(rate: np.ndarray) -> np.ndarray:
        return np.column_stack([1 - rate, rate, np.full(n, 1e-9), np.full(n, 1e-9)])

    sure = np.full(n, 0.8)  # a kind's own voter fires on most of its texts
    model = LabelModel(list(range(n)), single(sure), single(voters.clean_rate), voters.toxic_rate / voters.toxic_rate.sum(), prior)
    model = _estimate(patterns, model, 4)
    likely = F.col("n") * F.coalesce(F.col("share"), model.posterior(F.col("votes")))
    p = patterns.filter(F.size("votes") > 0).select("votes", likely.alias("p"), "n")
    i = p.select("p", "n", "votes", F.explode("votes").alias("i"))
    both = i.select("p", "n", "i", F.explode("votes").alias("j")).filter("i <= j").groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
    total, toxic = (float(x or 0) for x in patterns.agg(F.sum("n"), F.sum(likely)).first())
    pair = {(r.i, r.j): (r.p, r.n - r.p) for r in both}
    correlated = {}
    for (a, b), seen in pair.items():
        if a == b:
            continue
        most = 0.0
        for k, whole in enumerate((toxic, total - toxic)):
            if whole > 0 and seen[k] >= 2:
                x, y, xy = pair[a, a][k] / whole, pair[b, b][k] / whole, seen[k] / whole
                spread = math.sqrt(max(x * (1 - x) * y * (1 - y), 1e-18))
                most = max(most, (xy - x * y) / spread)
        if most >= link:
            correlated[a, b] = most
    groups = _joined(n, list(correlated))
    n_groups = max(groups, default=-1) + 1
    kinds, clean = np.zeros(n_groups), np.zeros((n_groups, STATES))
    for g in range(n_groups):
        own = [v for v in range(n) if groups[v] == g]
        kinds[g] = model.kinds[own].sum()
        some = min(max(1 - float(np.prod(1 - model.clean[own, 1])), 1e-6), 0.9)
        clean[g] = [1 - some, 0.9 * some, 0.09 * some, 0.01 * some]
    toxic = np.tile([0.1, 0.3, 0.3, 0.3], (n_groups, 1))
    return _estimate(patterns, LabelModel(groups, toxic, clean, kinds, model.prior, correlated), 6)


# ---- classifier ----------------------------------------------------------


def fit_logistic(indptr: np.ndarray, index: np.ndarray, width: int, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression with soft labels on rows of 0/1 features, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(y)), np.diff(indptr))
    weight = weight / weight.sum()
    coefficient, base = np.zeros(width), 0.0
    ahead, ahead_base, t = coefficient.copy(), 0.0, 1.0
    # the largest curvature is at most a quarter of the weighted mean of the rows' squared lengths
    rate = 1 / (0.25 * max(1.0, float((weight * (np.diff(indptr) + 1)).sum())) + ridge)
    for _ in range(steps):
        z = np.bincount(row, ahead[index], len(y)) + ahead_base
        r = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        new = ahead - rate * (np.bincount(index, r[row], width) + ridge * ahead)
        new_base = ahead_base - rate * r.sum()
        step = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_base = new + (t - 1) / step * (new - coefficient), new_base + (t - 1) / step * (new_base - base)
        coefficient, base, t = new, new_base, step
    return coefficient, base


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels (Newton steps, smoothed labels)."""
    toxic, clean = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    x = np.column_stack([margin, np.ones(len(y))])
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -500, 500)))
        slope = x.T @ (p - goal) + 1e-3 * (c - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        c = c - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(c[0]), 1e-3), float(c[1])


@dataclass
class Classifier:
    keys: np.ndarray
    weight: np.ndarray
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """`keep` columns and `margin` of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(self.keys)
            for b in batches:
                margin = np.full(b.num_rows, self.base)
                for lo, _, data, offs in blocks(b.column(0)):
                    doc, k = finder.find(Words(data, offs))
                    np.add.at(margin, lo + doc, self.weight[k])
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(margin)], [*keep, "margin"])

        schema = T.StructType([rows.schema[c] for c in keep]).add("margin", "double")
        return rows.select(text, *keep).mapInArrow(run, schema)

    def score(self, margin: Column) -> Column:
        z = F.lit(self.slope) * margin + F.lit(self.offset)
        return 1 / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), z))))


def _presence(keys: np.ndarray):
    """(text, share) rows -> (key numbers, share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(keys)
        for b in batches:
            for lo, hi, data, offs in blocks(b.column(0)):
                doc, k = finder.find(Words(data, offs))
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(k, pa.int32())), b.column(1).slice(lo, hi - lo)], ["votes", "share"])

    return run


def fit_classifier(sample: DataFrame) -> Classifier:
    """Logistic regression on the features of (text, share) rows that tell most about the share."""
    total, toxic = (float(x or 0) for x in sample.agg(F.count("*"), F.sum("share")).first())
    if not 0 < toxic < total:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), math.log((toxic + 0.5) / (total - toxic + 0.5)))
    features = tally(sample, "toxicity-features")
    bar = BAR * math.log(max(2, features.count()))
    features = features.withColumn("g", likelihood_ratio(F.col("n"), F.col("toxic"), total, toxic)).filter(F.col("g") > bar)
    keys = np.array(sorted(r.key for r in features.orderBy(F.desc("g"), "key").limit(MAX_FEATURES).collect()), np.uint64)
    found, y = _rows_of(sample, keys)
    sizes = found.value_lengths().to_numpy(zero_copy_only=False)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = y * (0.5 / share) + (1 - y) * (0.5 / (1 - share))
    return Classifier(keys, *fit_logistic(np.r_[0, np.cumsum(sizes)], found.flatten().to_numpy(zero_copy_only=False), len(keys), y, weight))


# ---- the whole -----------------------------------------------------------


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    classifier: Classifier

    def voter_report(self, spark) -> DataFrame:
        """Each voter with its group and the rates of its group's firing on toxic and clean texts."""
        rows = [(n, g, float(1 - self.labels.toxic[g, 0]), float(1 - self.labels.clean[g, 0])) for n, g in zip(self.voters.names, self.labels.groups, strict=True)]
        return spark.createDataFrame(rows, "voter string, group_id int, toxic_rate double, clean_rate double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bounded(rows: DataFrame, order: Column, bound: int, count: int) -> DataFrame:
    """At most `bound` rows, the first by `order`, a hash that spreads over all longs."""
    share = 1.2 * bound / max(count, 1)
    if share < 1:
        rows = rows.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return rows.orderBy(order).limit(bound)


def _sketched(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, `text` and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in blocks(b.column(0)):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), pa.array(sketch(Words(data, offs)))], ["text", *keep, "sketch"])

    return rows.select("text", *keep).mapInArrow(run, T.StructType([rows.schema[c] for c in ("text", *keep)]).add("sketch", "long"))


def fit_toxicity(documents: DataFrame, labels: DataFrame, n_labels: int = LABELS, n_texts: int = TEXTS) -> ToxicityModel:
    """Fit on (doc_id, text) and (doc_id, toxic) tables."""
    documents = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("share"))
    known = known.filter(~held_out(F.col("doc_id")))
    picked = F.broadcast(_bounded(known, F.xxhash64("doc_id"), n_labels, known.count()))
    texts = _sketched(documents.join(picked, "doc_id"), ["share"])
    labelled = written(texts.groupBy("sketch", "share").agg(F.first("text").alias("text")).repartition(16), "toxicity-labelled")
    voters = choose_voters(labelled)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(voters.keys)
        for b in batches:
            for lo, hi, data, offs in blocks(b.column(0)):
                w = Words(data, offs)
                doc, k = finder.find(w)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(sketch(w)), pa.ListArray.from_arrays(ends, pa.array(k, pa.int32()))], ["doc_id", "sketch", "votes"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    voted = written(documents.select("text", "doc_id").mapInArrow(vote, f"doc_id {kind}, sketch long, votes array<int>"), "toxicity-votes")
    open_votes = voted.select("votes", F.lit(None).cast("double").alias("share"))
    known_votes = labelled.select("text", "share").mapInArrow(_presence(voters.keys), "votes array<int>, share double")
    patterns = written(open_votes.unionByName(known_votes).groupBy("votes", "share").agg(F.count("*").cast("double").alias("n")), "toxicity-patterns")
    seen = labelled.agg(F.avg("share")).first()[0]
    model = fit_label_model(patterns, voters, min(max(seen or 0.05, 0.01), 0.5))

    judged = voted.filter(~held_out(F.col("doc_id"))).select("doc_id", "sketch", model.posterior(F.col("votes")).alias("share"))
    sides = []
    for side in (F.col("share") >= 0.5, F.col("share") < 0.5):
        one = judged.filter(side & F.col("doc_id").isNotNull()).groupBy("sketch").agg(F.min_by("share", "doc_id").alias("share"), F.min("doc_id").alias("doc_id"))
        sides.append(_bounded(one, F.xxhash64("sketch"), n_texts // 2, one.count()).select("doc_id", "sketch", "share"))
    picked = written(sides[0].unionByName(sides[1]), "toxicity-picked")
    sample = _sketched(documents.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id"), ["doc_id"]).join(F.broadcast(picked), ["doc_id", "sketch"])
    classifier = fit_classifier(written(sample.dropDuplicates(["sketch", "share"]).select("text", "share").repartition(16), "toxicity-texts"))
    if seen is not None and 0 < seen < 1:
        margins = classifier.margins(labelled, ["share"]).toArrow()
        classifier.slope, classifier.offset = fit_curve(margins.column("margin").to_numpy(), margins.column("share").to_numpy())
    return ToxicityModel(voters, model, classifier)


def score_documents(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    margins = model.classifier.margins(documents, ["doc_id"])
    scored = margins.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.classifier.score(F.col("margin")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
