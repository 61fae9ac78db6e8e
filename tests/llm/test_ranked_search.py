"""Ranked search against a plain-Python ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from prefloom.llm import ranked_search as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, k):
    lists = [(i, words(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in lists if w]
    n, total = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        ask = set(words(text))
        found = []
        for i, w, c in held:
            m = 50 + (50 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ask if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search(spark, docs, items, k, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in rs.ranked_search(d, q, k).collect()), key=str)


def corpus(seed, n, vocabulary=60):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    docs = [(i, " ".join(r.choices(pool, weights, k=r.choice([1, 3, 10, 40, 200])))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(40)]  # equal scores
    items = [(i, " ".join(r.choices(pool, k=r.randrange(1, 12)))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize(("seed", "block", "run"), [(1, 128, 8192), (2, 4, 50), (3, 1, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, block, run):
    monkeypatch.setattr(rs, "BLOCK_DOCS", block)
    monkeypatch.setattr(rs, "RUN_DOCS", run)
    docs, items = corpus(seed, 250)
    assert search(spark, docs, items, 10) == brute(docs, items, 10)


def test_groups_of_queries_and_wide_vocabulary(spark, monkeypatch):
    docs, items = corpus(5, 120)
    want = brute(docs, items, 7)
    monkeypatch.setattr(rs, "MAX_QUERY_TERMS", 20)
    monkeypatch.setattr(rs, "DENSE", 64)
    assert search(spark, docs, items, 7) == want
    monkeypatch.setattr(rs.Queries, "together", lambda self: None)
    assert search(spark, docs, items, 7, parts=1) == want


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha BETA"), (5, "ÉTÉ été alpha"), (6, "beta " * 30000)]
    docs += [(10 + i, f"filler{i} gamma") for i in range(6)]
    items = [(1, None), (2, "--"), (3, "alpha"), (3, "alpha"), (None, "beta Alpha alpha"), (4, "été"), (5, "absent")]
    assert search(spark, docs, items, 50) == brute(docs, items, 50)
    assert search(spark, [], items, 5) == []
    assert search(spark, docs, [], 5) == []
    assert search(spark, [(1, "")], items, 5) == []


def test_other_columns_and_kinds(spark):
    d = spark.createDataFrame([("a", "x y", 1, 2), ("b", "x", 3, 4), ("c", "z", 5, 6)], "key string, body string, rank int, score int")
    q = spark.createDataFrame([("i", "x", 9)], "name string, body string, query int")
    got = rs.ranked_search(d, q, 5, doc_id="key", item_id="name", text="body")
    assert got.columns == ["name", "rank", "key", "score"]
    assert [(r.name, r["rank"], r.key) for r in got.orderBy("rank").collect()] == [("i", 1, "b"), ("i", 2, "a")]


def test_summaries_bound_every_document():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 9, 300)
    terms = np.concatenate([np.sort(r.choice(30, n, replace=False)) for n in sizes])
    parts = r.integers(1, 1000, len(terms))
    weights = r.integers(1, 50, 30)
    seen = Counter()
    run = rs.Run(np.arange(300), sizes, terms, parts, weights)
    start = np.cumsum(sizes) - sizes
    for term, members, n_docs, keys, n_keys, most in run.blocks():
        d = k = 0
        for t, nd, nk in zip(term, n_docs, n_keys, strict=True):
            top = dict(zip(keys[k : k + nk].tolist(), most[k : k + nk].tolist(), strict=True))
            for doc in members[d : d + nd].tolist():
                own = range(start[doc], start[doc] + sizes[doc])
                assert t in terms[own] and all(top[terms[i]] >= parts[i] for i in own)
                seen[t] += 1
            assert nd <= rs.BLOCK_DOCS
            d, k = d + nd, k + nk
    assert seen == Counter(terms.tolist())  # every posting is in one block


def test_unlike_words_of_one_hash_are_kept_apart():
    v = rs.Vocabulary([b"abc", b"xyz"])
    w = rs._words_of(b"abc abd xyz ABC")
    at, term = v.find(w)
    assert at.tolist() == [0, 2, 3] and term.tolist() == [0, 1, 0]
    w.hash[1] = w.hash[0]  # as if they collided
    assert v.find(w)[0].tolist() == [0, 2, 3]
